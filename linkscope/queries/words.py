"""Queries on documents and pages: text statistics, copying, extraction, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkscope.functions import scalars as L
from linkscope.operators import extract as X
from linkscope.operators import text as T
from linkscope.queries.graph import r
from linkscope.queries.registry import query
from linkscope.sources.fixtures import read

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in L.STOPWORDS)
TOK = "tok AS (SELECT doc_id, CAST(p - 1 AS INT) AS pos, lower(t) AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS p FROM documents))"
RANKED = "c AS (SELECT token, count(*) AS n FROM tok GROUP BY token), rk AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rank FROM c)"
HEAPS = "firsts AS (SELECT token, min(doc_id) AS d FROM tok GROUP BY token), per AS (SELECT d.doc_id, (SELECT count(*) FROM tok t WHERE t.doc_id = d.doc_id) AS n, (SELECT count(*) FROM firsts f WHERE f.d = d.doc_id) AS k FROM documents d), hp AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank, CAST(sum(n) OVER (ORDER BY doc_id) AS BIGINT) AS tokens, CAST(sum(k) OVER (ORDER BY doc_id) AS BIGINT) AS types FROM per)"


def docs(spark, sf):
    return read(spark, sf, "documents")


def tok(spark, sf):
    return T.tokenize(docs(spark, sf))


def ranked(spark, sf):
    return T.ranked_types(tok(spark, sf))


@query("tx1_tokenize", f"WITH {TOK} SELECT doc_id, pos, token FROM tok")
def tx1(spark, sf):
    return tok(spark, sf)


@query("tx2_remove_stopwords", f"WITH {TOK} SELECT doc_id, count(*) AS n FROM tok WHERE token NOT IN ({STOP}) GROUP BY doc_id")
def tx2(spark, sf):
    return T.remove_stopwords(tok(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("tx3_vocab_stats", f"WITH {TOK}, c AS (SELECT lang, token, count(*) AS n FROM tok JOIN documents USING (doc_id) GROUP BY lang, token) SELECT lang, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, CAST(sum(CAST(n = 1 AS INT)) AS BIGINT) AS hapax, round(sum(CAST(n = 1 AS INT)) / CAST(count(*) AS DOUBLE), 6) AS hapax_share FROM c GROUP BY lang")
def tx3(spark, sf):
    t = tok(spark, sf).join(docs(spark, sf).select("doc_id", "lang"), "doc_id")
    return T.vocab_stats(t, ["lang"]).withColumn("hapax_share", r("hapax_share"))


@query("tx3_ranked_types", f"WITH {TOK}, {RANKED} SELECT token, n, rank FROM rk")
def tx3r(spark, sf):
    return ranked(spark, sf)


@query("tx4_coverage", f"WITH {TOK}, {RANKED} SELECT CAST(k AS INT) AS top, round(sum(n) FILTER (rank <= k) / sum(n), 6) AS share FROM rk, (VALUES (10), (100), (1000)) v(k) GROUP BY k")
def tx4(spark, sf):
    return T.coverage(ranked(spark, sf)).withColumn("share", r("share"))


@query("tx5_zipf_slope", f"WITH {TOK}, {RANKED} SELECT round(-regr_slope(ln(n), ln(rank)), 6) AS slope FROM rk WHERE rank <= 1000")
def tx5(spark, sf):
    return T.zipf_slope(ranked(spark, sf), 1000).select(r("slope"))


def heaps(spark, sf):
    from linkscope.operators.arrival import arrival_ranks

    d = docs(spark, sf).select("doc_id", F.lit(0).alias("year"))
    return T.heaps_curve(tok(spark, sf), arrival_ranks(d, "year", "doc_id").select("doc_id", F.col("rank").cast("long").alias("rank")))


@query("tx6_heaps_curve", f"WITH {TOK}, {HEAPS} SELECT doc_id, rank, tokens, types FROM hp")
def tx6(spark, sf):
    return heaps(spark, sf)


@query("tx6_heaps_exponent", f"WITH {TOK}, {HEAPS} SELECT round(regr_slope(ln(types), ln(tokens)), 5) AS beta, round(exp(regr_intercept(ln(types), ln(tokens))), 3) AS scale FROM hp WHERE tokens > 0")
def tx6e(spark, sf):
    return T.heaps_exponent(heaps(spark, sf)).select(r(F.col("beta"), 5).alias("beta"), r(F.col("scale"), 3).alias("scale"))


@query("tx7_new_type_rate", f"WITH {TOK}, {HEAPS} SELECT doc_id, rank, round(1000.0 * (types - lag(types, 1, 0) OVER (ORDER BY rank)) / nullif(tokens - lag(tokens, 1, 0) OVER (ORDER BY rank), 0), 6) AS rate FROM hp")
def tx7(spark, sf):
    return T.new_type_rate(heaps(spark, sf)).withColumn("rate", r("rate"))


@query("tx8_length_report", f"WITH {TOK}, p AS (SELECT log10(length(text)) AS lx, log10((SELECT count(DISTINCT token) FROM tok t WHERE t.doc_id = d.doc_id)) AS ly FROM documents d WHERE length(text) > 0 AND doc_id IN (SELECT doc_id FROM tok)), f AS (SELECT regr_slope(ly, lx) AS s, regr_intercept(ly, lx) AS i FROM p), k AS (SELECT rank() OVER (ORDER BY lx) + (count(*) OVER (PARTITION BY lx) - 1) / 2.0 AS a, rank() OVER (ORDER BY ly) + (count(*) OVER (PARTITION BY ly) - 1) / 2.0 AS b FROM p) SELECT (SELECT count(*) FROM p) AS n, (SELECT round(corr(a, b), 5) FROM k) AS spearman, (SELECT round(s, 5) FROM f) AS slope, (SELECT round(stddev_pop(ly - i - s * lx), 5) FROM p, f) AS spread")
def tx8(spark, sf):
    t = tok(spark, sf).groupBy("doc_id").agg(F.count_distinct("token").alias("types"))
    return T.length_report(docs(spark, sf).select("doc_id", F.length("text").alias("len")).join(t, "doc_id"), "len", "types").select("n", *[r(F.col(c), 5).alias(c) for c in ("spearman", "slope", "spread")])


@query("tx9_sentences")
def tx9(spark, sf):
    return T.sentences(docs(spark, sf))


@query("tx10_clean_sentences")
def tx10(spark, sf):
    return T.clean_sentences(docs(spark, sf))


@query("tx11_passages")
def tx11(spark, sf):
    return T.passages(docs(spark, sf))


@query("tx12_capitalisation")
def tx12(spark, sf):
    return T.capitalisation(docs(spark, sf))


def titles(spark, sf):
    """Words of the link targets of pages stand for titles."""
    return X.extract_hrefs(read(spark, sf, "pages"), "page_id").select(F.explode(T.tokens_of(F.col("target"))).alias("token")).distinct()


def names(spark, sf):
    return T.name_words(T.capitalisation(docs(spark, sf)), titles(spark, sf))


@query("tx13_name_words")
def tx13(spark, sf):
    return names(spark, sf)


@query("tx14_term_kinds")
def tx14(spark, sf):
    return T.term_kinds(T.term_counts(tok(spark, sf)), names(spark, sf), docs(spark, sf).count())


@query("tx15_entity_names", "WITH e AS (SELECT s_suppkey AS entity, s_name AS name FROM supplier UNION SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT CAST(entity AS BIGINT) AS entity, name FROM (SELECT *, count(*) OVER (PARTITION BY name) AS k FROM e) WHERE k = 1 AND length(name) >= 4")
def tx15(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("alias"))
    return T.entity_names(read(spark, sf, "supplier").join(n, "s_nationkey").select(F.col("s_suppkey").cast("long").alias("entity"), F.col("s_name").alias("title"), "alias"))


@query("tx16_mask_terms")
def tx16(spark, sf):
    d = docs(spark, sf)
    return T.mask_terms(d, d.select("doc_id", F.substring_index("text", "\n", 1).alias("title")))


@query("tx19_ngram_counts")
def tx19(spark, sf):
    return T.ngram_counts(docs(spark, sf), 2)


SH = "sh AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, string_agg(token, ' ') OVER w AS shingle, count(*) OVER w AS n FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8)"


def sh(spark, sf):
    return T.shingles(docs(spark, sf))


@query("tx20_copy_guard", f"WITH {TOK}, bt AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS p FROM benchmark), bs AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, string_agg(lower(t), ' ') OVER w AS s, count(*) OVER w AS n FROM bt WINDOW w AS (PARTITION BY item_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)) WHERE n = 9), ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, string_agg(token, ' ') OVER w AS s, count(*) OVER w AS n FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)) WHERE n = 9) SELECT doc_id FROM ds WHERE s IN (SELECT s FROM bs) UNION SELECT doc_id FROM documents WHERE text IN (SELECT text FROM benchmark)")
def tx20(spark, sf):
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return T.copy_guard(docs(spark, sf).select("doc_id", "text"), b)


@query("tx21_shingle_report", f"WITH {TOK}, {SH}, p AS (SELECT shingle, count(*) AS df FROM sh GROUP BY shingle) SELECT count(*) AS n_distinct, count(*) FILTER (df = 1) AS on_one, count(*) FILTER (df = 2) AS on_two, count(*) FILTER (df >= 30) AS boilerplate FROM p")
def tx21(spark, sf):
    return T.shingle_report(sh(spark, sf))


PAIRS = "rare AS (SELECT shingle FROM sh GROUP BY shingle HAVING count(*) BETWEEN 2 AND 4), cp AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sh x JOIN sh y ON y.shingle = x.shingle AND x.doc_id < y.doc_id WHERE x.shingle IN (SELECT shingle FROM rare) GROUP BY 1, 2)"


@query("tx22_copy_pairs", f"WITH {TOK}, {SH}, {PAIRS} SELECT a, b, shared FROM cp")
def tx22(spark, sf):
    return T.copy_pairs(sh(spark, sf))


@query("tx23_longest_shared_run")
def tx23(spark, sf):
    return T.longest_shared_run(docs(spark, sf), T.copy_pairs(sh(spark, sf)))


@query("tx24_copy_clusters", f"WITH {TOK}, {SH}, {PAIRS}, s AS (SELECT a, b FROM cp WHERE shared >= 15 UNION ALL SELECT b, a FROM cp WHERE shared >= 15), w AS (WITH RECURSIVE walk(node, m) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, walk.m FROM walk JOIN s ON s.a = walk.node) SELECT * FROM walk) SELECT node, min(m) AS component FROM w GROUP BY node")
def tx24(spark, sf):
    return T.copy_clusters(T.copy_pairs(sh(spark, sf)))


@query("tx26_similar_words")
def tx26(spark, sf):
    return T.similar_words(tok(spark, sf))


@query("tx30_audit_sample", "SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':5')) AS i FROM labels) WHERE i <= 20")
def tx30(spark, sf):
    return T.audit_sample(read(spark, sf, "labels"), "quality", 20, 5).select("doc_id", "quality")


@query("tx31_audit_precision", "SELECT lang AS label, count(v) AS judged, count(*) FILTER (v = lang) AS correct, round(count(*) FILTER (v = lang) / CAST(nullif(count(v), 0) AS DOUBLE), 6) AS precision FROM (SELECT lang, CASE WHEN quality = 1 THEN lang WHEN quality = 0 THEN 'none' END AS v FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang")
def tx31(spark, sf):
    j = docs(spark, sf).join(read(spark, sf, "labels"), "doc_id", "left").withColumn("v", F.when(F.col("quality") == 1, F.col("lang")).when(F.col("quality") == 0, "none"))
    return T.audit_precision(j, "lang", "v").withColumn("precision", r("precision"))


TT = "tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)"


@query("tx32_term_tables", f"WITH {TOK}, {TT}, n AS (SELECT count(*) AS n FROM documents), u AS (SELECT doc_id, 'raw' AS weighting, token, CAST(tf AS DOUBLE) AS weight FROM tf UNION ALL SELECT doc_id, 'plain', token, tf FROM tf WHERE token NOT IN ({STOP}) UNION ALL SELECT doc_id, 'tfidf', token, round(tf * ln(n / CAST(df AS DOUBLE)), 9) FROM tf JOIN df USING (token), n WHERE tf >= 2) SELECT doc_id, weighting, token, round(weight, 6) AS weight, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, weighting ORDER BY weight DESC, token) AS rank FROM u) WHERE rank <= 10")
def tx32(spark, sf):
    return T.term_tables(T.term_counts(tok(spark, sf)), docs(spark, sf).count()).withColumn("weight", r("weight"))


@query("tx33_capped_sample", f"WITH {TOK} SELECT doc_id, pos, token FROM (SELECT *, md5(CAST(doc_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':3') AS h, row_number() OVER (PARTITION BY doc_id ORDER BY md5(CAST(doc_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':3')) AS i FROM tok) WHERE i <= 3 ORDER BY h LIMIT 200")
def tx33(spark, sf):
    return T.capped_sample(tok(spark, sf), 3, 3, 200)


@query("tx34_quota_match", "WITH q AS (SELECT lang, count(*) AS quota FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY lang) SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':9')) AS i FROM documents) JOIN q USING (lang) WHERE i <= quota")
def tx34(spark, sf):
    ref = docs(spark, sf).join(read(spark, sf, "labels").filter("quality = 0"), "doc_id", "left_semi")
    return T.quota_match(docs(spark, sf), ref, "lang", 9).select("doc_id", "lang")


# Extraction

HREF = """h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)"""


@query("ext1_extract_links", f"WITH {HREF} SELECT page_id, target, count(*) AS n FROM h GROUP BY 1, 2")
def ext1(spark, sf):
    return X.extract_hrefs(read(spark, sf, "pages"), "page_id").groupBy("page_id", "target").agg(F.count("*").alias("n"))


NORM = "CASE WHEN t = '' THEN '' ELSE replace(upper(substr(t, 1, 1)), 'ẞ', 'SS') || substr(t, 2) END"
NT = f"nt AS (SELECT page_id, {NORM} AS title FROM (SELECT page_id, trim(regexp_replace(replace(split_part(ltrim(target, '/'), '#', 1), '_', ' '), ' +', ' ', 'g')) AS t FROM h))"


@query("ext2_normalise_title", f"WITH {HREF}, {NT} SELECT page_id, title, count(*) AS n FROM nt GROUP BY 1, 2")
def ext2(spark, sf):
    h = X.extract_hrefs(read(spark, sf, "pages"), "page_id")
    return h.select("page_id", X.normalise_title(F.ltrim("target", F.lit("/"))).alias("title")).groupBy("page_id", "title").agg(F.count("*").alias("n"))


@query("ext3_resolve_redirects", f"WITH {HREF}, {NT}, red AS (SELECT title AS source, lower(title) AS landing FROM nt GROUP BY title HAVING count(*) > 2) SELECT page_id, title, coalesce(landing, title) AS landing, count(*) AS n FROM nt LEFT JOIN red ON red.source = title GROUP BY 1, 2, 3")
def ext3(spark, sf):
    h = X.extract_hrefs(read(spark, sf, "pages"), "page_id").select("page_id", X.normalise_title(F.ltrim("target", F.lit("/"))).alias("title"))
    red = h.groupBy("title").count().filter("count > 2").select(F.col("title").alias("source"), F.lower("title").alias("landing"))
    return X.resolve_redirects(h, red).groupBy("page_id", "title", "landing").agg(F.count("*").alias("n"))


@query("ext6_first_year", "SELECT page_id, (SELECT min(CAST(y AS INT)) FROM (SELECT unnest(regexp_extract_all(html, '\\b(19[3-9][0-9]|20[0-2][0-9])\\b', 1)) AS y)) AS year FROM pages")
def ext6(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.first_year(F.col("html")).alias("year"))


@query("ext7_filter_candidates", "SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN regexp_matches(url, '[?#]') THEN 'variant' WHEN length(html) < 1200 THEN 'short' ELSE 'kept' END AS reason FROM pages")
def ext7(spark, sf):
    rules = {"empty": F.col("html").isNull() | (F.col("html") == ""), "variant": F.col("url").rlike("[?#]"), "short": F.length("html") < 1200}
    return X.filter_candidates(read(spark, sf, "pages"), rules).select("page_id", "reason")


@query("ext8_merge_rosters", "SELECT key, CASE WHEN bool_and(l) THEN 'first' WHEN bool_or(l) THEN 'both' ELSE 'second' END AS side FROM (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS key, true AS l FROM customer WHERE c_acctbal > 9000 UNION SELECT DISTINCT CAST(s_nationkey AS BIGINT), false FROM supplier) GROUP BY key")
def ext8(spark, sf):
    a = read(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("key"))
    return X.merge_rosters(a, read(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("key")))


@query("ext9_build_edges", f"WITH {HREF}, {NT}, ros AS (SELECT title FROM nt GROUP BY title HAVING count(DISTINCT page_id) > 1) SELECT DISTINCT CAST(page_id AS VARCHAR) AS src, title AS dst FROM nt WHERE title IN (SELECT title FROM ros) AND title <> CAST(page_id AS VARCHAR)")
def ext9(spark, sf):
    h = X.extract_hrefs(read(spark, sf, "pages"), "page_id").select(F.col("page_id").cast("string").alias("src"), X.normalise_title(F.ltrim("target", F.lit("/"))).alias("dst"))
    ros = h.groupBy("dst").agg(F.count_distinct("src").alias("n")).filter("n > 1").select(F.col("dst").alias("node"))
    return X.build_edges(h, ros)


@query("ext10_edge_set_diff", "WITH a AS (SELECT DISTINCT o_custkey AS src, year(o_orderdate) AS dst FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS src, year(o_orderdate) AS dst FROM orders WHERE o_orderpriority = '2-HIGH') SELECT CAST(coalesce(a.src, b.src) AS BIGINT) AS src, count(a.src) AS n_left, count(b.src) AS n_right, count(*) FILTER (a.src IS NOT NULL AND b.src IS NOT NULL) AS shared, round(count(*) FILTER (a.src IS NOT NULL AND b.src IS NOT NULL) / CAST(count(*) AS DOUBLE), 6) AS jaccard FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst GROUP BY 1")
def ext10(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("src"), F.year("o_orderdate").alias("dst"), "o_orderpriority")
    pick = lambda p: o.filter(F.col("o_orderpriority") == p).select("src", "dst").distinct()
    return X.edge_set_diff(pick("1-URGENT"), pick("2-HIGH")).withColumn("jaccard", r("jaccard"))


@query("ext12_value_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def ext12(spark, sf):
    return X.value_counts(read(spark, sf, "orders"), "o_orderpriority")


@query("ext13_attribute_coverage", "SELECT count(*) AS n, count(q) AS known, round(count(q) / CAST(count(*) AS DOUBLE), 6) AS share FROM (SELECT (SELECT max(quality) FROM labels l WHERE l.doc_id = d.doc_id) AS q FROM documents d)")
def ext13(spark, sf):
    q = read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return X.attribute_coverage(docs(spark, sf).join(q, "doc_id", "left"), "q").withColumn("share", r("share"))


# Scalar functions


@query("fn_names", "SELECT CAST(p_partkey AS BIGINT) AS part, regexp_replace(p_name, '[ _]*\\([^()]*\\)$', '') AS base, substr(upper(substr(p_type, 1, 1) || substr(p_brand, 1, 1)), 1, 2) AS code, CAST(floor(p_size / 10) * 10 AS INT) AS ten, CAST(nullif(list_position(['STANDARD', 'SMALL', 'MEDIUM', 'LARGE'], split_part(p_type, ' ', 1)), 0) - 1 AS BIGINT) AS place FROM part")
def fn(spark, sf):
    p = read(spark, sf, "part")
    order = ["STANDARD", "SMALL", "MEDIUM", "LARGE"]
    return p.select(F.col("p_partkey").cast("long").alias("part"), L.base_title(F.col("p_name")).alias("base"), L.pair_code(F.col("p_type"), F.col("p_brand")).alias("code"), L.decade(F.col("p_size")).alias("ten"), L.ordered_category(F.substring_index("p_type", " ", 1), order).alias("place"))


@query("fn_texts")
def fnt(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", L.shorten(F.col("text"), 60).alias("short"), L.pretty_name(F.col("source")).alias("pretty"), L.alias_from_description(F.col("text")).alias("alias"), F.array_join(L.own_words(F.substring_index("text", "\n", 1)), " ").alias("words"), F.regexp_count("text", F.lit(L.mention_regex("the"))).alias("mentions"))


@query("ext11_spread_sample")
def ext11(spark, sf):
    return X.spread_sample(docs(spark, sf).select(F.col("doc_id").alias("node"), F.length("text").alias("score")), "score", 12)


@query("tx18_mention_report")
def tx18(spark, sf):
    """Mentions and documents of each name word."""
    t = tok(spark, sf).join(names(spark, sf).select("token"), "token", "left_semi")
    return t.groupBy("token").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("documents"))
