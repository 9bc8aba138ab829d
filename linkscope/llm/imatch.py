"""I-Match fingerprints.

Terms whose document frequency lies within a band are kept; copies count once in it, so
that a large group of them doesn't push its own terms out. The distinct terms are
sorted, and the sorted list is hashed once for each of several randomised subsets of the
lexicon. A subset holds a term by a hash of the term alone, so a subset needs no
storage. Small subsets see few terms of a long text and survive edits; large ones
see the terms of a short text.

Groups of copies are found by keys that near copies share. A group that holds at least
GROUP_SHARE of all rows, and so could move a term over an edge of the band, weighs as one
document, each of its rows by its share of that; there are at most 1 / GROUP_SHARE such
groups for a key, and they are broadcast. So nothing but counts is shuffled for the band.

The lexicon joins by broadcast. Its size has a bound that doesn't grow with the
corpus: document frequencies sum to (documents x mean distinct terms), so at most
(mean distinct terms / MIN_SHARE) terms can reach the share MIN_SHARE.

Only built-in expressions are used.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from linkscope.llm.common import ascii_lower, cut, words
from linkscope.llm.runs import ROW, run_edges, run_of

#: The band: a term stands in at least this share of the documents (and in two)
#: and in at most that share, copies counted once.
MIN_SHARE, MAX_SHARE = 0.0015, 0.25
#: Copies: words of a shingle; four keys, each of the smallest shingles in three orders
#: (hashes xor a constant). Texts with 90 % of shingles in common share a key with
#: probability 0.995, those with 10 % with 0.004.
SHINGLE = 2
ORDERS = [[int.from_bytes(hashlib.sha256(b"%d %d" % (i, j)).digest()[:8], "big", signed=True) for j in range(3)] for i in range(4)]
#: (bits, subsets): each of so many subsets holds a term with probability 2 ** -bits.
SCALES = ((4, 4), (6, 24), (8, 32), (10, 32))
#: Groups of copies with this share of all rows (and two rows) weigh as one document.
GROUP_SHARE = 0.0001
#: Sums of weights in another order differ by less than this share of them.
NEAR = 1e-6
#: Stands for the text itself, so that a text without terms of the band keeps its row.
MARK = 0


def terms(text: Column) -> Column:
    """Distinct 64-bit codes of the words of text, A-Z lower-cased."""
    return F.array_distinct(F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w)))


def with_copy_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with w, the words of the text, and k0, k1, ...: keys that near copies are likely
    to share. Each hashes the smallest shingles of a text in a few orders; a text shorter
    than a shingle has its own."""
    # columns of their own, as the next ones refer to them again and again
    split = docs.withColumn("w", words(ascii_lower(F.col(f"`{text}`"))))
    starts = F.sequence(F.lit(0), F.size("w") - SHINGLE)
    shingles = F.when(F.size("w") >= SHINGLE, F.transform(starts, lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(SHINGLE)]))).otherwise(F.array("tie"))
    least = lambda c: F.array_min(F.transform("h", lambda h: h.bitwiseXOR(F.lit(c))))
    return split.withColumn("h", shingles).withColumns({f"k{i}": F.xxhash64(*map(least, row)) for i, row in enumerate(ORDERS)}).drop("h")


def weighed_docs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(w, weight): the words of each text of docs (with the column tie, the text's hash), and
    1 divided by the size of the largest group of copies that it is in."""
    keyed = with_copy_keys(docs.select("tie", text), text)
    names = [f"k{i}" for i in range(len(ORDERS))]
    counted = keyed.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(k).alias("k")) for i, k in enumerate(names)])).alias("x")).groupBy("x.i", "x.k").agg(F.count("*").alias("n"))
    least = max(2, math.ceil(GROUP_SHARE * docs.count()))
    groups = cut(counted.filter(F.col("n") >= least))
    for i, k in enumerate(names):
        side = groups.filter(F.col("i") == i).select(F.col("k").alias(k), F.col("n").alias(f"n{i}"))
        keyed = keyed.join(F.broadcast(side), k, "left")  # 1 / GROUP_SHARE rows at most
    size = F.greatest(F.lit(1).cast("long"), *[F.coalesce(F.col(f"n{i}"), F.lit(1).cast("long")) for i in range(len(names))])
    return keyed.select("w", (F.lit(1.0) / size).alias("weight"))


def lexicon(docs: DataFrame, text: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """(term): codes of the terms in the band, over docs with the column tie (the text's
    hash). Document frequencies are sums of weights, MARK's that of all documents."""
    codes = F.array_append(F.array_distinct(F.transform("w", lambda w: F.xxhash64(w))), F.lit(MARK).cast("long"))
    found = cut(weighed_docs(docs, text).select("weight", F.explode(codes).alias("term")).groupBy("term").agg(F.sum("weight").alias("df")))
    n = (found.filter(F.col("term") == MARK).agg(F.sum("df")).first()[0] or 0.0)
    low, high = max(2.0, min_share * n), max(2.0, max_share * n)
    return found.filter((F.col("term") != MARK) & (F.col("df") >= low * (1 - NEAR)) & (F.col("df") <= high * (1 + NEAR))).select("term")


def tagged(sorted_terms: Column) -> list[Column]:
    """For each scale, the terms that some subset holds, with its index, still sorted."""

    def index(t: Column, bits: int) -> Column:
        return F.xxhash64(t, F.lit(bits)).bitwiseAND((1 << bits) - 1)

    def of(bits: int, m: int) -> Column:
        held = F.filter(sorted_terms, lambda t: index(t, bits) < m)
        return F.transform(held, lambda t: F.struct(index(t, bits).alias("i"), t.alias("t")))

    return [of(bits, m) for bits, m in SCALES]


def subset_hashes(scales: list[Column]) -> Column:
    """One hash for each lexicon subset, "-" where the subset has no term of the text."""

    def one(scale: Column, i: int) -> Column:
        own = F.filter(scale, lambda x: x.i == i)
        return F.when(F.size(own) == 0, F.lit("-")).otherwise(F.lower(F.lpad(F.hex(F.xxhash64(own).bitwiseAND(0xFFFFFFFF)), 8, "0")))

    return F.array(*[one(scale, i) for scale, (_, m) in zip(scales, SCALES, strict=True) for i in range(m)])


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Share of equal hashes among the subsets that have a term of either text;
    where no subset has one, whether the texts are the same."""
    some = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: (x.a != "-") | (x.b != "-")))
    equal = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: (x.a != "-") & (x.a == x.b)))
    return F.when(same, F.lit(1.0)).when(some == 0, F.lit(0.0)).otherwise(equal / some).cast("double")


def as_text(hashes: Column, sha: Column) -> Column:
    """The fingerprint: the hashes, or the text's own digest where no subset has a term."""
    blank = F.size(F.filter(hashes, lambda h: h != "-")) == 0
    return F.when(blank, F.concat(F.lit("text:"), sha)).otherwise(F.array_join(hashes, ":"))


def place(key: Column, tie: Column) -> tuple[Column, Column]:
    """The order by key (null first), then tie, as a pair of numbers for runs."""
    hi = F.coalesce(F.shiftright(key, 1) + F.lit(1 << 62), F.lit(-1).cast("long"))
    odd = F.coalesce(key.bitwiseAND(1), F.lit(0).cast("long"))
    return hi, F.shiftleft(odd, 62) + F.shiftright(tie, 2) + F.lit(1 << 61)


def in_runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, tie) cut into runs of neighbours, each followed by a copy
    (later = 1) of the next run's first row; the last run by the first row of all. So a
    window inside a run sees every row's successor, and the texts are shuffled once."""
    spark = docs.sparkSession
    hi, lo = place(F.col("doc_id"), F.col("tie"))
    slim = cut(docs.select("doc_id", "tie", hi.alias("hi"), lo.alias("lo"), (F.octet_length("text") + F.lit(ROW).cast("long")).alias("weight")))
    edges = run_edges(slim)
    heads = slim.groupBy(run_of(edges, F.col("hi"), F.col("lo")).alias("run")).agg(F.min(F.struct("hi", "lo", F.col("doc_id").alias("id"), F.col("tie").alias("t"))).alias("f"))
    firsts = sorted(((r["run"], r["f"]["id"], r["f"]["t"]) for r in heads.collect()), key=lambda r: r[0])  # one row a run
    rows = [(firsts[i - 1][0], f[1], f[2]) for i, f in enumerate(firsts)]  # the run before; before the first, the last
    kind = T.StructType([T.StructField("to", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("t", T.LongType())])
    heads = spark.createDataFrame(rows, kind)
    # of rows equal in key and text, one follows; the others are equal to it
    later = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t")))
    later = later.select("doc_id", "text", "tie", F.col("to").alias("run"), F.lit(1).alias("later"))
    docs = docs.select("doc_id", "text", "tie", run_of(edges, hi, lo).alias("run"), F.lit(0).alias("later"))
    return docs.unionByName(later.dropDuplicates(["run"]))


def imatch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints each document and the same document edited: its second half
    replaced by the start of the document next by key, the last one's by the first's.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) for every row. A null text is empty; equal texts have
    equal fingerprints; null keys come first and rows of one key in the order of
    their texts' hashes; a single row is its own successor; an empty table gives an
    empty result. Texts without a term of the band have their own digest as
    fingerprint and are alike only if equal. Keys are whole numbers, or are cast to them.
    """
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    band = lexicon(docs)
    lex = band.union(docs.sparkSession.createDataFrame([(MARK,)], band.schema))
    rows = in_runs(docs)
    order = Window.partitionBy("run").orderBy("later", F.col("doc_id").asc_nulls_first(), "tie")
    n = F.length("text")
    rows = (
        rows.withColumn("rn", F.row_number().over(order))
        .withColumn("next", F.lead("text").over(order))
        .withColumn("n_chars", n.cast("long"))
        .withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(coalesce(next, ''), 1, cast(floor(length(text) / 2) as int))")))
    )
    pairs = F.concat(
        F.array(F.struct(F.lit(MARK).cast("long").alias("t"), F.lit(0).alias("which"))),
        F.transform(terms(F.col("text")), lambda t: F.struct(t.alias("t"), F.lit(0).alias("which"))),
        F.transform(terms(F.col("edited")), lambda t: F.struct(t.alias("t"), F.lit(1).alias("which"))),
    )
    meta = F.struct("doc_id", "n_chars", F.sha2("text", 256).alias("sha"), F.sha2("edited", 256).alias("edited_sha"), "later")
    flat = rows.select("run", "rn", meta.alias("meta"), pairs.alias("pairs")).select("run", "rn", "meta", F.explode("pairs").alias("x"))
    flat = flat.select("run", "rn", F.when(F.col("x.t") == MARK, F.col("meta")).alias("meta"), F.col("x.t").alias("term"), F.col("x.which").alias("which"))
    banded = flat.join(F.broadcast(lex), "term")  # bounded, see above
    real = F.col("term") != MARK
    one = (
        banded.groupBy("run", "rn")
        .agg(
            F.first("meta", ignorenulls=True).alias("meta"),
            F.sort_array(F.collect_list(F.when(real & (F.col("which") == 0), F.col("term")))).alias("a"),
            F.sort_array(F.collect_list(F.when(real & (F.col("which") == 1), F.col("term")))).alias("b"),
        )
        .select("run", "rn", "meta.*", *[x.alias(f"a{i}") for i, x in enumerate(tagged(F.col("a")))], *[x.alias(f"b{i}") for i, x in enumerate(tagged(F.col("b")))])
    )
    one = one.select(
        "run", "rn", "doc_id", "n_chars", "sha", "edited_sha", "later",
        *[subset_hashes([F.col(f"{c}{i}") for i in range(len(SCALES))]).alias(f"f{c}") for c in "ab"],
    )
    follow = Window.partitionBy("run").orderBy("rn")
    out = one.withColumn("fn", F.lead("fa").over(follow)).withColumn("next_sha", F.lead("sha").over(follow)).filter("later = 0")
    return out.select(
        "doc_id",
        "n_chars",
        F.col("edited_sha").alias("edited_sha256"),
        as_text(F.col("fa"), F.col("sha")).alias("fingerprint"),
        as_text(F.col("fb"), F.col("edited_sha")).alias("edited_fingerprint"),
        likeness(F.col("fa"), F.col("fb"), F.col("sha") == F.col("edited_sha")).alias("near_edited"),
        likeness(F.col("fa"), F.col("fn"), F.col("sha") == F.col("next_sha")).alias("near_next"),
    )
