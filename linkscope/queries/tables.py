"""Queries that read and write tables in the formats of sources and sinks: what is written
is read again, and is the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkscope.functions.scalars import count_uses
from linkscope.operators import extract as X
from linkscope.operators import text as T
from linkscope.plans.iterate import shared_dir
from linkscope.queries.registry import CUES, query
from linkscope.queries.words import TOK
from linkscope.sources import io
from linkscope.sources.fixtures import read


def place(spark) -> str:
    return f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"


@query("src1_read_tsv", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def src1(spark, sf):
    path = place(spark)
    io.write_table(read(spark, sf, "nation").select("n_nationkey", "n_name"), path, "n_nationkey")
    return io.read_tsv(spark, path, ["key", "name"], header=True)


@query("src2_read_tsv_quotes", "SELECT CAST(item_id AS VARCHAR) AS key, '\"' || n || ' words' AS text FROM (SELECT item_id, len(string_split(text, ' ')) AS n FROM benchmark)")
def src2(spark, sf):
    """A quote that never closes stands at the start of every field."""
    path = place(spark)
    b = read(spark, sf, "benchmark").select(F.concat_ws("\t", F.col("item_id").cast("string"), F.concat(F.lit('"'), F.size(F.split("text", " ")).cast("string"), F.lit(" words"))).alias("line"))
    b.write.text(path)
    return io.read_tsv(spark, path, ["key", "text"], quote=None)


@query("src3_load_graph", "WITH n AS (SELECT CAST(c_custkey AS VARCHAR) AS node FROM customer WHERE c_acctbal > 0), o AS (SELECT CAST(a.o_custkey AS VARCHAR) AS src, CAST(b.o_custkey AS VARCHAR) AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1) SELECT DISTINCT src, dst FROM o WHERE src <> dst AND src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def src3(spark, sf):
    nodes, edges = place(spark), place(spark)
    io.write_table(read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id")), nodes, "id")
    o = read(spark, sf, "orders")
    e = o.select(F.col("o_custkey").cast("string").alias("a"), (F.col("o_orderkey") + 1).alias("k")).join(o.select(F.col("o_custkey").cast("string").alias("b"), F.col("o_orderkey").alias("k")), "k").select("a", "b")
    io.write_table(e, edges, "a")
    return io.load_graph(io.read_tsv(spark, nodes, ["node_id"], header=True), io.read_tsv(spark, edges, ["a", "b"], header=True)).edges


@query("src5_load_documents", "SELECT 'nation ' || n_nationkey AS doc_id, n_name || chr(10) AS text FROM nation")
def src5(spark, sf):
    """A file for each nation, named by its key."""
    path = place(spark)
    read(spark, sf, "nation").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("k"), "n_name").write.partitionBy("k").text(path)
    found = spark.read.text(f"{path}/*", wholetext=True).select(F.url_decode(F.regexp_extract(F.input_file_name(), r"/k=([^/]+)/", 1)).alias("doc_id"), F.col("value").alias("text"))
    own = io.load_documents(spark, f"{path}/*")
    return found.join(own.select("text").distinct(), "text", "left_semi").select(F.url_decode("doc_id").alias("doc_id"), "text")


@query("src6_load_queries", r"SELECT CAST(item_id AS VARCHAR) AS qid, CASE WHEN item_id > 20 THEN 'absent' ELSE 'page' END AS style, CASE WHEN item_id <= 20 THEN CAST(item_id AS VARCHAR) END AS target, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM benchmark")
def src6(spark, sf):
    path = place(spark)
    item = F.col("item_id").cast("string")
    b = read(spark, sf, "benchmark").select(F.concat_ws("\t", item, F.when(F.col("item_id") > 20, "absent").otherwise("page"), F.when(F.col("item_id") <= 20, item).otherwise(""), F.concat(F.lit(" "), F.regexp_replace("text", "\\s+", " "), F.lit(" "))).alias("line"))
    b.union(b.sparkSession.createDataFrame([("# a comment",), ("",)], "line string")).write.text(path)
    return io.load_queries(spark, path)


@query("src7_load_labels", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS label FROM labels WHERE toxic = 0")
def src7(spark, sf):
    path = place(spark)
    rows = read(spark, sf, "labels").select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.when(F.col("toxic") == 0, F.col("quality").cast("string")).otherwise("")).alias("line"))
    rows.write.text(path)
    return io.load_labels(spark, path, ["doc_id", "label"])


@query("snk1_write_result", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def snk1(spark, sf):
    path = place(spark)
    io.write_result(read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name"), path)
    return spark.read.schema("r_regionkey long, r_name string").json(path)


@query("snk2_write_table", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def snk2(spark, sf):
    path = place(spark)
    io.write_table(read(spark, sf, "supplier").select("s_suppkey", "s_name"), path, "s_suppkey")
    return spark.read.schema("s_suppkey string, s_name string").option("sep", "\t").option("header", True).csv(path)


@query("snk3_write_postings", f"WITH {TOK}, tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token HAVING count(*) >= 2) SELECT token, doc_id, tf AS w, df, CASE WHEN length(token) > 8 THEN 'name' ELSE 'other' END AS kind FROM tf JOIN df USING (token)")
def snk3(spark, sf):
    path = place(spark)
    c = T.term_counts(T.tokenize(read(spark, sf, "documents")))
    kinds = c.groupBy("token").agg(F.count("*").alias("df")).withColumn("kind", F.when(F.length("token") > 8, "name").otherwise("other"))
    io.write_postings(c.select("token", "doc_id", F.col("tf").alias("w")), kinds, path)
    return spark.read.parquet(path).select("token", "doc_id", "w", "df", "kind")


@query("snk4_cached_table", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def snk4(spark, sf):
    make = lambda o: o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    source = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    io.cached_table(source, make, "counts")
    return io.cached_table(source, make, "counts")


def boxes(spark, sf):
    """Orders as the source text of pages with a template."""
    o = read(spark, sf, "orders")
    text = F.concat(F.lit("Before {{x}} {{Infobox  Sales order\n| key = "), F.col("o_orderkey").cast("string"), F.lit("\n| priority = [[Level|"), "o_orderpriority", F.lit("]] {{note|a=b|c}}\n| other = 1\n}} after | key = 0"))
    return o.select("o_orderkey", text.alias("text"))


@query("ext4_infobox_kind", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, 'sales order' AS kind FROM orders")
def ext4(spark, sf):
    return boxes(spark, sf).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), X.infobox_kind(F.col("text")).alias("kind"))


@query("ext5_infobox_fields", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, 'key' AS field, CAST(o_orderkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', '[[Level|' || o_orderpriority || ']] {{note|a=b|c}}' FROM orders")
def ext5(spark, sf):
    return X.infobox_fields(boxes(spark, sf).withColumn("o_orderkey", F.col("o_orderkey").cast("long")), "o_orderkey", ["key", "priority"])


@query("fn10_relation_words", r"SELECT doc_id, " + ", ".join(rf"len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), lambda x: x IN {tuple(CUES[k])})) AS {k}" for k in CUES) + " FROM documents")
def fn10(spark, sf):
    """Uses of words that tell how two stand to each other."""
    return read(spark, sf, "documents").select("doc_id", *[count_uses(F.col("text"), CUES[k]).alias(k) for k in CUES])
