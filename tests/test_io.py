from linkscope.operators import extract as X
from linkscope.operators import text as T
from linkscope.sources import io


def test_tables(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("# node_id\tname\nA\tone \"x\nB\ttwo\nC\tthree\n")
    (tmp_path / "e.tsv").write_text("A\tB\nA\tB\nB\tB\nB\tZ\n")
    nodes = io.read_tsv(spark, str(tmp_path / "n.tsv"), ["node_id", "name"], quote=None)
    g = io.load_graph(nodes, io.read_tsv(spark, str(tmp_path / "e.tsv"), ["s", "t"]))
    assert g.nodes.count() == 3 and [tuple(r) for r in g.edges.collect()] == [("A", "B")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "Iron%20Man.txt").write_text("Some text.\nMore.")
    assert [tuple(r) for r in io.load_documents(spark, str(tmp_path / "d")).collect()] == [("Iron Man", "Some text.\nMore.")]
    (tmp_path / "q.tsv").write_text("# id\n1\tpage\tA\t who is it \n\n2\tabsent\t\tnobody\n")
    assert [tuple(r) for r in io.load_queries(spark, str(tmp_path / "q.tsv")).orderBy("qid").collect()] == [("1", "page", "A", "who is it"), ("2", "absent", None, "nobody")]
    io.write_table(nodes, str(tmp_path / "out"), "node_id")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).count() == 3
    made = []
    for _ in range(2):
        t = io.cached_table(nodes, lambda d: (made.append(1), d)[1], "v1")
        assert t.count() == 3
    assert len(made) == 1


def test_wiki_links_and_fields(spark):
    text = "{{Infobox person\n| name = [[A|B]]\n| debut = {{date|1963|a=b}} <ref>1950</ref>\n}} See [[Iron_man#x|y]] and [[File:z.png]]."
    p = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    assert [r["target"] for r in X.extract_links(p, "id").collect()] == ["A", "Iron_man#x"]
    got = {r["field"]: r["value"] for r in X.infobox_fields(p, "id", ["name", "debut"]).collect()}
    assert got["name"] == "[[A|B]]" and got["debut"].startswith("{{date|1963|a=b}}")
    row = p.filter("id = 1").select(X.infobox_kind(p.text).alias("k"), X.first_year(p.text).alias("y"), X.normalise_title(p.text).alias("t")).first()
    assert row["k"] == "person" and row["y"] == 1963


def test_passages(spark):
    d = spark.createDataFrame([(1, "One two three. Four five. Six seven eight nine. Ten."), (2, None), (3, "")], "doc_id long, text string")
    got = [r["text"] for r in T.passages(d, 5).orderBy("doc_id", "passage").collect()]
    assert got == ["One two three. Four five.", "Six seven eight nine. Ten."]
    assert T.sentences(d).count() == 4
