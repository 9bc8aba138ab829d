"""Queries on evidence, relations, blanks and sets of engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkscope.functions.scalars import STOPWORDS
from linkscope.operators import community as M
from linkscope.operators import evidence as E
from linkscope.operators import extract as X
from linkscope.operators import relations as L
from linkscope.operators import retrieval as R
from linkscope.operators import text as T
from linkscope.operators import vectors as V
from linkscope.plans.iterate import cut
from linkscope.queries.graph import customers, f1, r
from linkscope.queries.models import pairs
from linkscope.queries.registry import CUES, W, query
from linkscope.queries.sets import COS, MIX, QW, WT, both_searches, counts, queries_, scores, targets, unit, vectors, weights
from linkscope.queries.words import HREF, NT, PAIRS, SH, STOP, TOK, docs, sh
from linkscope.sources.fixtures import read

PICK = "pick AS (SELECT qid, first(doc_id ORDER BY round(score, 9) DESC, doc_id) AS doc_id FROM sc GROUP BY qid)"


@query("vs31_matched_overlap", f"WITH {WT}, {QW}, {PICK}, k AS (SELECT DISTINCT qid, token FROM qt WHERE token NOT IN ({STOP})) SELECT k.qid, count(*) AS words, count(tf.tf) AS found, round(count(tf.tf) / CAST(count(*) AS DOUBLE), 6) AS share FROM k LEFT JOIN pick USING (qid) LEFT JOIN tf ON tf.doc_id = pick.doc_id AND tf.token = k.token GROUP BY k.qid")
def vs31(spark, sf):
    picks = R.top_pick(cut(scores(spark, sf)))
    on = docs(spark, sf).select("doc_id", "text").join(R.few(cut(picks)), "doc_id").select("qid", "text")
    return E.matched_overlap(queries_(spark, sf), on).withColumn("share", r("share"))


EV = "ev AS (SELECT 'sparse' AS engine, qid, doc_id, round(score, 9) AS s FROM sc UNION ALL SELECT 'dense', qid, doc_id, score FROM db), er AS (SELECT *, row_number() OVER (PARTITION BY engine, qid ORDER BY s DESC, doc_id) AS i FROM ev), et AS (SELECT engine, qid, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY i) AS top, max(doc_id) FILTER (i = 1) AS pick FROM er WHERE i <= 10 GROUP BY 1, 2)"


@query("vs34_evidence_table", f"WITH {WT}, {QW}, dq AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), ds AS (SELECT qid, p.vec_id AS passage, CAST(p.label AS BIGINT) AS doc_id, round(list_dot_product(v, CAST(p.embedding AS DOUBLE[])), 9) AS s FROM dq, embeddings p WHERE p.vec_id <> qid), db AS (SELECT qid, doc_id, max(s) AS score, first(passage ORDER BY s DESC, passage) AS passage FROM ds GROUP BY 1, 2), {EV}, pw AS (SELECT qw.qid, un.doc_id, un.token, row_number() OVER (PARTITION BY qw.qid, un.doc_id ORDER BY round(qw.w * un.w, 9) DESC, un.token) AS i FROM qw JOIN un USING (token) WHERE qw.w <> 0 AND un.w <> 0), ws AS (SELECT qid, doc_id, string_agg(token, ',' ORDER BY i) AS words FROM pw WHERE i <= 10 GROUP BY 1, 2) SELECT engine, et.qid, top, pick, coalesce(words, '') AS words, passage FROM et LEFT JOIN ws ON engine = 'sparse' AND ws.qid = et.qid AND ws.doc_id = pick LEFT JOIN db ON engine = 'dense' AND db.qid = et.qid AND db.doc_id = pick")
def vs34(spark, sf):
    c = counts(spark, sf)
    w, u = cut(weights(spark, sf, c)), cut(unit(spark, sf, c))
    p = R.contributions(w, u).withColumn("engine", F.lit("sparse"))  # not written: many times the scores
    d = cut(R.dense_search(*vectors(spark, sf), skip_self=True).withColumn("engine", F.lit("dense")))
    engines = R.sparse_search(w, u).withColumn("engine", F.lit("sparse")).unionByName(d.select("engine", "qid", "doc_id", "score"))
    got = E.evidence_table(engines, p, d)
    return got.select("engine", "qid", F.array_join(F.col("top").cast("array<string>"), ",").alias("top"), "pick", F.array_join("words", ",").alias("words"), "passage")


UNIT = "list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"
SETS = f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), h AS (SELECT vec_id, label, v[1:32] AS v FROM e), sets AS (SELECT 'whole' AS name, * FROM e UNION ALL SELECT 'half', vec_id, label, {UNIT.format(v='v')} FROM h),
dp AS (SELECT p.name, q.vec_id AS qid, CAST(p.label AS BIGINT) AS doc_id, p.vec_id AS passage, list_dot_product(q.v, p.v) AS s FROM sets p JOIN sets q ON q.name = p.name AND q.vec_id % 50 = 0),
mv AS (SELECT name, CAST(label AS BIGINT) AS doc_id, sqrt(sum(x * x)) AS len FROM (SELECT name, label, i, sum(x) AS x FROM (SELECT name, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM sets) GROUP BY 1, 2, 3) GROUP BY 1, 2),
dv AS (SELECT name AS variant, qid, doc_id, max(s) FILTER (passage <> qid) AS score FROM dp GROUP BY 1, 2, 3 UNION ALL SELECT name || '-mean', qid, doc_id, sum(s) / max(len) FROM dp JOIN mv USING (name, doc_id) GROUP BY 1, 2, 3, name)"""


@query("vs21_dense_variants", f"WITH {SETS} SELECT variant, qid, doc_id, round(score, 5) AS score FROM dv")
def vs21(spark, sf):
    q, p = vectors(spark, sf)
    part = lambda c: F.slice(c, 1, 32).cast("array<double>")

    def half(d, c):
        d = d.withColumn("h", part(c))
        return d.withColumn(c, F.transform("h", lambda x: x / F.sqrt(F.aggregate("h", F.lit(0.0), lambda a, y: a + y * y)))).drop("h")

    got = E.dense_variants({"whole": (q, p), "half": (half(q, "v"), half(p, "v"))}, skip_self=True)
    return got.withColumn("score", F.round("score", 5))


@query("vs35_engine_comparison")
def vs35(spark, sf):
    """Search by weighed and by distinct words, with the standing-out of the best as confidence."""
    t = cut(targets(spark, sf))
    n = docs(spark, sf).count()
    found = dict(zip(("sparse", "words"), both_searches(spark, sf), strict=True))
    rows, ranks = [], []
    for name, s in found.items():
        z = R.top_pick(s).join(R.standout(s, n), "qid").join(t, "qid", "left")
        rows.append(z.select(F.lit(name).alias("engine"), "qid", F.when(F.col("target").isNull(), "absent").otherwise("page").alias("style"), F.coalesce(F.col("doc_id") == F.col("target"), F.lit(False)).alias("correct"), F.round("z", 6).alias("value")))
        ranks.append(R.rank_of_target(s, t).withColumn("engine", F.lit(name)))
    got = E.engine_comparison(cut(rows[0].union(rows[1])), ranks[0].unionByName(ranks[1]), MIX, list(found))
    return got.select("engine", "n", "top1", "top3", "top10", "median_rank", r("mrr"), r("threshold"), r("fitted"), r("left_out"))


POOL = "vn AS (SELECT doc_id, other, row_number() OVER (PARTITION BY doc_id ORDER BY round(cos, 9) DESC, other) AS rank FROM (SELECT x.vec_id AS doc_id, y.vec_id AS other, list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS cos FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id)), pool AS (SELECT vec_id AS doc_id FROM embeddings WHERE label < 5), ring AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i, count(*) OVER () AS n FROM pool), near AS (SELECT * FROM (SELECT doc_id, other, row_number() OVER (PARTITION BY doc_id ORDER BY rank, other) AS r FROM vn WHERE rank <= 5 AND doc_id IN (SELECT doc_id FROM pool) AND other IN (SELECT doc_id FROM pool)) WHERE r <= 4), fill AS (SELECT a.doc_id, b.doc_id AS other, s + 4 AS r FROM ring a, range(1, 9) t(s), ring b WHERE s < a.n AND b.i = (a.i + s) % a.n AND NOT EXISTS (SELECT 1 FROM near WHERE near.doc_id = a.doc_id AND near.other = b.doc_id))"


@query("vs37_hard_negatives", f"WITH {POOL} SELECT doc_id, other, CAST(place AS INT) AS place, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS place FROM (SELECT doc_id, other, r, 'near' AS kind FROM near UNION ALL SELECT doc_id, other, r, 'random' FROM fill)) WHERE place <= 4")
def vs37(spark, sf):
    from linkscope.queries.sets import vector_neighbours

    pool = read(spark, sf, "embeddings").filter("label < 5").select(F.col("vec_id").alias("doc_id"))
    return E.hard_negatives(vector_neighbours(spark, sf, 5), pool, 4)


@query("vs13_far_twins", f"WITH {WT}, {COS}, {SH}, {PAIRS}, lk AS (SELECT a, b FROM cp UNION SELECT b, a FROM cp), nr AS (SELECT a, b FROM lk UNION SELECT x.a, y.b FROM lk x JOIN lk y ON y.a = x.b) SELECT a, b, round(cos, 6) AS cos FROM cs WHERE (SELECT length(text) FROM documents WHERE doc_id = a) >= 1000 AND (SELECT length(text) FROM documents WHERE doc_id = b) >= 1000 AND NOT EXISTS (SELECT 1 FROM nr WHERE nr.a = cs.a AND nr.b = cs.b) ORDER BY round(cs.cos, 9) DESC, a, b LIMIT 50")
def vs13(spark, sf):
    long = docs(spark, sf).select("doc_id", F.length("text").alias("length"))
    links = cut(T.copy_pairs(sh(spark, sf)).select("a", "b"))
    return V.far_twins(cut(unit(spark, sf)), links, long, 1000, 50).withColumn("cos", r("cos"))


def page_links(spark, sf):
    h = X.extract_hrefs(read(spark, sf, "pages"), "page_id")
    return h.select(F.col("page_id").cast("string").alias("src"), X.normalise_title(F.ltrim("target", F.lit("/"))).alias("dst")).filter("dst <> ''").distinct()


@query("tx17_link_anchor_check", f"WITH {HREF}, {NT}, l AS (SELECT DISTINCT page_id, title FROM nt WHERE title <> ''), x AS (SELECT count(*) AS links, count(*) FILTER (contains(regexp_replace(html, '<[^>]*>', ' ', 'g'), title)) AS anchored FROM l JOIN pages USING (page_id)) SELECT links, anchored, round(anchored / CAST(links AS DOUBLE), 6) AS share FROM x")
def tx17(spark, sf):
    links = page_links(spark, sf)
    names = links.select(F.col("dst").alias("node"), F.col("dst").alias("name")).distinct()
    text = read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return L.link_anchor_check(links, names, text).withColumn("share", r("share"))


#: Documents that copy from each other are linked; a document is named by its weightiest
#: word of four letters or more, and its lines are its sentences.
NAMED = f"{WT}, {SH}, {PAIRS}, lk AS (SELECT a AS src, b AS dst FROM cp UNION SELECT b, a FROM cp), nm AS (SELECT doc_id AS node, first(token ORDER BY round(w, 9) DESC, token) AS name FROM un WHERE length(token) >= 4 GROUP BY doc_id), ln AS (SELECT doc_id, pos - 1 AS pos, lower(s) AS sentence FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)), rs AS (SELECT src, dst, pos, sentence, b.name FROM lk JOIN nm b ON b.node = dst LEFT JOIN nm a ON a.node = src JOIN ln ON doc_id = src WHERE (a.name IS NULL OR NOT contains(a.name, b.name)) AND length(sentence) < 600 AND regexp_matches(sentence, '(^|[^0-9A-Za-z_-])' || b.name || '([^0-9A-Za-z_-]|$)'))"


def cue_sql(kind):
    c = "|".join(CUES[kind])
    return rf"(regexp_matches(sentence, '\b({c})(\W+\w+){{0,3}}\W+' || name || '([^0-9A-Za-z_-]|$)') OR regexp_matches(sentence, '(^|[^0-9A-Za-z_-])' || name || '\W+(\w+\W+){{0,3}}({c})\b'))"


RL = f"{NAMED}, pr AS (SELECT src, dst, count(*) AS n, count(*) FILTER ({cue_sql('ally')}) AS x, count(*) FILTER ({cue_sql('family')}) AS y, count(*) FILTER ({cue_sql('foe')}) AS z FROM rs GROUP BY 1, 2), tw AS (SELECT node FROM nm WHERE name IN (SELECT name FROM nm GROUP BY name HAVING count(*) > 1)), rl AS (SELECT src, dst, coalesce(n, 0) AS sentences, CASE WHEN dst IN (SELECT node FROM tw) THEN 'ambiguous' WHEN n IS NULL THEN 'none' WHEN greatest(x, y, z) = 0 THEN 'unlabelled' WHEN CAST(x = greatest(x, y, z) AS INT) + CAST(y = greatest(x, y, z) AS INT) + CAST(z = greatest(x, y, z) AS INT) > 1 THEN 'mixed' WHEN x = greatest(x, y, z) THEN 'ally' WHEN y = greatest(x, y, z) THEN 'family' ELSE 'foe' END AS label FROM lk LEFT JOIN pr USING (src, dst))"


def relations(spark, sf):
    """links, names and the sentences found."""
    p = T.copy_pairs(sh(spark, sf))
    links = cut(p.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(p.select("b", "a")))
    u = unit(spark, sf).filter("length(token) >= 4 and w is not null")
    names = cut(u.groupBy(F.col("doc_id").alias("node")).agg(F.min_by("token", F.struct(-F.round("w", 9), "token")).alias("name")))
    lines = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "s")).select("doc_id", "pos", F.lower("s").alias("sentence"))
    return links, names, cut(L.relation_sentences(links, names, lines))


@query("tx27_relation_sentences", f"WITH {NAMED} SELECT src, dst, CAST(pos AS INT) AS pos, sentence, name FROM rs")
def tx27(spark, sf):
    return relations(spark, sf)[2]


@query("tx28_relation_labels", f"WITH {RL} SELECT src, dst, sentences, label FROM rl")
def tx28(spark, sf):
    return L.relation_labels(*relations(spark, sf), CUES)


@query("tx29_mutual_labels", f"WITH {RL} SELECT x.label, count(*) AS links, count(*) FILTER (x.label = y.label) AS agreeing, round(count(*) FILTER (x.label = y.label) / CAST(count(*) AS DOUBLE), 6) AS share FROM rl x JOIN rl y ON y.src = x.dst AND y.dst = x.src WHERE x.src < x.dst GROUP BY 1")
def tx29(spark, sf):
    return L.mutual_summary(L.mutual_labels(cut(L.relation_labels(*relations(spark, sf), CUES)))).withColumn("share", r("share"))


@query("tx29_most_named", f"WITH {RL} SELECT label, dst, n, CAST(rank AS INT) AS rank FROM (SELECT label, dst, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, dst) AS rank FROM rl GROUP BY 1, 2) WHERE rank <= 5")
def tx29m(spark, sf):
    return L.most_named(L.relation_labels(*relations(spark, sf), CUES))


@query("tx25_concordance_blanks")
def tx25(spark, sf):
    lines = cut(T.clean_sentences(docs(spark, sf)))
    return L.concordance_blanks(cut(L.blank_targets(T.capitalisation(docs(spark, sf)), 20, 1500)), lines)


@query("fn8_mentions", "SELECT item_id, (SELECT count(*) FROM documents WHERE regexp_matches(lower(text), '(^|[^0-9A-Za-z_-])' || w || '([^0-9A-Za-z_-]|$)')) AS documents FROM (SELECT item_id, lower(regexp_extract(text, '[A-Za-z]{5,}')) AS w FROM benchmark) WHERE w <> ''")
def fn8(spark, sf):
    """Documents that have the first long word of a benchmark item as a whole word."""
    b = read(spark, sf, "benchmark").select("item_id", F.lower(F.regexp_extract("text", "[A-Za-z]{5,}", 0)).alias("w")).filter("w <> ''")
    # a mention stands between other characters than these, so it is a whole run of them
    t = docs(spark, sf).select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^0-9A-Za-z_-]+"))).alias("w"))
    hit = t.join(F.broadcast(b), "w")  # one word an item
    return b.join(hit.groupBy("item_id").agg(F.count("*").alias("documents")), "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


@query("vs19_word_status", rf"WITH {TOK}, df AS (SELECT DISTINCT token FROM tok), w AS (SELECT item_id AS qid, unnest(string_split_regex(lower(trim(text)), '\s+')) AS word, generate_subscripts(string_split_regex(lower(trim(text)), '\s+'), 1) - 1 AS pos FROM benchmark) SELECT qid, CAST(pos AS INT) AS pos, word, CASE WHEN word = '' THEN 'empty' WHEN NOT regexp_full_match(word, '[a-z]+') THEN 'invalid' WHEN word IN ({STOP}) THEN 'banned' WHEN pos > min(pos) OVER (PARTITION BY qid, word) THEN 'duplicate' WHEN word NOT IN (SELECT token FROM df) THEN 'unknown' ELSE 'ok' END AS status FROM w")
def vs19w(spark, sf):
    q = queries_(spark, sf)
    words = spark.createDataFrame([(w,) for w in STOPWORDS], "token string")
    banned = q.select("qid").crossJoin(F.broadcast(words))  # a fixed list
    df = T.term_counts(T.tokenize(docs(spark, sf))).select("token").distinct()
    return R.word_status(q, df, banned)


@query("cm4_attribute_partition", f"{W}, lab AS (SELECT CAST(c_custkey AS BIGINT) AS node, c_mktsegment AS x, c_nationkey AS y FROM customer), e AS (SELECT p.x AS ca, q.x AS cb FROM sym JOIN lab p ON p.node = src JOIN lab q ON q.node = dst), per AS (SELECT ca, count(*) AS d, count(*) FILTER (ca = cb) AS i FROM e GROUP BY ca), m AS (SELECT CAST(sum(d) AS DOUBLE) AS m2 FROM per), c AS (SELECT x, y, count(*) AS n FROM lab GROUP BY 1, 2), w AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, CAST(sum(n) OVER () AS DOUBLE) AS t FROM c) SELECT (SELECT round(sum(i / m2 - (d / m2) * (d / m2)), 6) FROM per, m) AS q, (SELECT round(2 * sum(n / t * ln(n * t / (nx * ny))) / (-sum(n / t * ln(nx / t)) - sum(n / t * ln(ny / t))), 6) FROM w) AS nmi")
def cm4(spark, sf):
    from linkscope.queries.models import nations

    own = customers(spark, sf).join(read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("node"), "c_mktsegment"), "node")
    return M.attribute_partition(pairs(spark, sf), own, "c_mktsegment", nations(spark, sf)).select(r("q"), r("nmi"))


@query("cm17_swap_improve")
def cm17(spark, sf):
    """The ten customers of most links, each with five neighbours by number, bettered."""
    e = cut(pairs(spark, sf))
    near = M.both_ways(e).select(F.col("a").alias("host"), F.col("b").alias("node"))
    top = f1(spark, sf)[1]
    hosts = top.groupBy(F.col("src").alias("host")).count().orderBy(F.desc("count"), "host").limit(10).select("host")
    from pyspark.sql.window import Window

    some = near.join(hosts, "host").withColumn("i", F.row_number().over(Window.partitionBy("host").orderBy("node"))).filter("i <= 5").select("host", "node")
    return M.swap_improve(e, cut(some.union(hosts.select("host", F.col("host").alias("node")))))
