"""The queries over the test tables; each is a thin use of its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.bpe import bpe_decode, bpe_encode

    coded = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "byte_bpe_50k.json").drop("text")
    ids, out = F.col("ids"), bpe_decode(coded, "byte_bpe_50k.json")
    return out.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.chat import as_events, conversation_digests, format_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return conversation_digests(format_conversations(as_events(rows.unionByName(extra))))


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.shards import histogram_shards, text_bytes

    got = histogram_shards(table(spark, sf_dir, "documents"), 8)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return got.select("doc_id", text_bytes(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.imatch import imatch

    return imatch(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.pages import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.convnet import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source", "quota")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.rules import quality_verdicts

    got = quality_verdicts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *[f"counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "p_good")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.license import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.infill import fill_in_middle, restore_middle

    made = restore_middle(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    digests = [F.sha2(c, 256).alias(f"{name}_sha256") for name, c in (("output", "infill"), ("restored", "restored"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.personal import BASE_KINDS, find_personal_data, joined

    got = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    kinds = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: s["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return got.select("doc_id", *n, F.sha2(joined(F.col("spans"), base=True), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkscope.llm.negatives import hard_negatives, vectors_as_integers

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors_as_integers(rows.withColumn("label", label)), F.col("id") % 50 == 0)


# What SQL can say of the operators' results, through the same operators.


def base_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_near_duplicates(spark, sf_dir).select("doc_id", "n_shingles")


def base_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, and the slots of each shard: as many as rows, from 0."""
    got = op4_histogram_shards(spark, sf_dir)
    return got.agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"), F.count_distinct("shard", "slot").alias("places"), F.count_distinct("shard").alias("shards"))


def base_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def base_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality_rules(spark, sf_dir).drop("kept", "p_good")


def base_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_license_scan(spark, sf_dir).drop("labels", "score")


def base_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_personal_data(spark, sf_dir).drop("base_sha256", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_chat_format": op3_chat_format,
    "op4_histogram_shards": op4_histogram_shards,
    "op5_imatch": op5_imatch,
    "op6_main_text": op6_main_text,
    "op7_quality_cnn": op7_quality_cnn,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_infill": op11_infill,
    "op12_personal_data": op12_personal_data,
    "op13_hard_negatives": op13_hard_negatives,
    "base_op2": base_op2,
    "base_op4": base_op4,
    "base_op8": base_op8,
    "base_op9": base_op9,
    "base_op10": base_op10,
    "base_op12": base_op12,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_PARTS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BASE9 = f"""w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS l FROM documents)),
win AS (SELECT doc_id, i, k FROM (SELECT doc_id, i, string_agg(word, ' ') OVER x AS k, count(*) OVER x AS n FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS i FROM twice, range(8) t(j)) GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS n, CAST(sum(length(word)) AS BIGINT) AS c FROM w GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id)"""
_LABELS = "('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])"
_CUTS = "least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b"


def _lines(k: str) -> str:
    return f"array_to_string(l[1:{k}], chr(10)) || CASE WHEN {k} > 0 AND {k} < len(l) THEN chr(10) ELSE '' END"


#: Sums of the digits of a card number, every second from the right doubled.
_LUHN = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) ELSE 2 * CAST(d[i] AS INT) - CASE WHEN d[i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
ORACLE_SQL: dict[str, str] = {
    "op13_hard_negatives": """WITH e AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor, other AS positive, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, positive AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, s.other) AS INT) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3""",
    "base_op12": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip, list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[ -]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM t)
SELECT doc_id, n_email, len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS HUGEINT))) <= 255)) AS n_ip, len(list_filter(card, lambda d: len(d) BETWEEN 13 AND 19 AND {_LUHN})) AS n_card, len(list_filter(phone, lambda d: len(d) BETWEEN 9 AND 15)) AS n_phone FROM m""",
    "op11_infill": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
x AS (SELECT doc_id, t, string_split(t, chr(10)) AS l, {", ".join(f"CAST('0x' || h[{8 * i + 1}:{8 * i + 8}] AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
y AS (SELECT *, len(l) - CAST(t = '' OR suffix(t, chr(10)) AS BIGINT) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, {_CUTS} FROM y), p AS (SELECT doc_id, t, n, form, {_lines("a")} AS pre, {_lines("b")} AS two FROM z),
q AS (SELECT doc_id, t, n, form, pre, substr(two, length(pre) + 1) AS mid, substr(t, length(two) + 1) AS suf FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM q""",
    "base_op2": f"WITH w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS l FROM documents), s AS (SELECT DISTINCT doc_id, l[i] || ' ' || l[i + 1] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM w)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) SELECT doc_id, CASE WHEN len(l) < 2 THEN len(l) ELSE n END AS n_shingles FROM w LEFT JOIN n USING (doc_id)",
    "base_op4": "SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, count(*) AS places, CAST(8 AS BIGINT) AS shards FROM documents",
    "base_op8": f"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
c AS (SELECT source, z, 2.0 * z AS cap, CAST(CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM s),
l AS (SELECT *, (1.5 * (SELECT sum(z) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, z, least(cap, w * coalesce((SELECT arg_min(x.level, x.cap / x.w) FROM l x WHERE x.level * x.w <= x.cap), cap / w)) AS target FROM l)
SELECT doc_id, size, z AS source_size, round(target, 4) AS target FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source""",
    "base_op9": f"WITH {_BASE9}, c AS (SELECT doc_id, coalesce(wc.n, 0) AS n_words, coalesce(wc.c, 0) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM documents LEFT JOIN wc USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)) SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c",
    "base_op10": f"WITH w AS (SELECT doc_id, {_PARTS.format(_LOWER)} AS l FROM documents), p AS (SELECT * FROM (VALUES {_LABELS}) v(label, ph)), h AS (SELECT doc_id, label, i - 1 AS pos FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM w) JOIN p ON l[i : i + len(ph) - 1] = ph), g AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id) SELECT doc_id, len(l) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)",
}
