"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ...; they
share 150 % of all words by weight; a target stops at twice its source's words and
the excess goes to the others by weight. Written in closed form: with sources in
the order of (cap / weight), prefix sums give the one level at which all is shared.

Quotas: the mix consists of blocks of BLOCK words. The blocks of the first j of
SHARDS equal parts go to the sources by highest quotients target / (2 s + 1);
the method never takes a block back as the house grows, so the differences between
consecutive j are each shard's quotas. Only a few seats of each source are near the
cut, so the quotients compared are a few per source, however many blocks there are.

Blocks: a source's documents in a seeded hash order form a stream of words, read
again from its start once it ends, and cut into blocks. Shard by shard the source
deals its next blocks, as many as its quota there. That is a seeded choice of blocks
which needs no sort of documents: of each shard's end only the hash is wanted at which
it falls. A document below it belongs to that shard or an earlier one, and the
one document at it is cut. The ends are found from word counts by ranges of the hash.

Only built-in expressions are used. Tables of sources stay small next to the data
(one row per source and hash range at most); documents are never grouped by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscope.llm.common import cut, n_words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, TIMES = 1.5, 2
#: Words of a block; parts of the mix; ranges of the hash.
BLOCK, SHARDS, RANGES = 64, 8, 1024
SEED = 20240229


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per
    source. One task sorts the sources, which are few next to documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    s = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", TIMES * F.col("source_size"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("wanted", SHARE * F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    # sources up to the first whose share fits below its cap stop at their cap
    s = s.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    first_fit = F.first("fits", ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("common", first_fit)
    return s.select("source", "source_size", "weight", F.when(F.col("common").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight"))).alias("target"))


def source_quotas(targets: DataFrame) -> DataFrame:
    """(source, shard, quota): blocks of each source in each shard. A source's
    quotas add up to its Sainte-Lague seats among all blocks."""
    everything = Window.partitionBy("shard")
    t = targets.filter("target > 0").crossJoin(F.broadcast(targets.sparkSession.range(1, SHARDS + 1).select(F.col("id").cast("int").alias("shard"))))  # SHARDS rows
    t = t.withColumn("house", F.round(F.sum("target").over(everything) / BLOCK * F.col("shard") / SHARDS).cast("long"))
    t = t.withColumn("share", F.col("target") / F.sum("target").over(everything) * F.col("house"))
    t = t.withColumn("n", F.count("*").over(everything))
    # seats that no source can lose: the divisor moves by less than n / (2 house)
    slack = F.col("share") * F.col("n") / F.greatest(F.col("house"), F.lit(1)) + 2
    t = t.withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("share") - slack)).cast("long"))
    t = t.withColumn("left", F.col("house") - F.sum("sure").over(everything))
    seats = t.withColumn("seat", F.explode(F.sequence(F.col("sure"), F.ceil(F.col("share") + slack).cast("long"))))
    best = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("seat") + 1)).desc(), F.col("source").asc_nulls_last(), "seat")
    won = seats.withColumn("rank", F.row_number().over(best))
    so_far = won.groupBy("source", "shard", "sure").agg(F.sum(F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).alias("more"))
    so_far = so_far.select("source", "shard", (F.col("sure") + F.col("more")).alias("seats"))
    grown = F.col("seats") - F.lag("seats", 1, 0).over(Window.partitionBy("source").orderBy("shard"))
    return so_far.select("source", "shard", grown.alias("quota"))


def spot(key: Column, text: Column) -> Column:
    """A document's place in its source's stream: a seeded hash."""
    return F.xxhash64(key, text, F.lit(SEED))


def hash_range(at: Column) -> Column:
    """One of RANGES equal ranges of the hash, in its order."""
    return (F.shiftright(at, 64 - RANGES.bit_length() + 1) + RANGES // 2).cast("int")


def mixing_plan(sized: DataFrame) -> DataFrame:
    """For sized(source, size, at), the plan with a row per source: source,
    source_size, target, quota (array of blocks by shard) and ends, for each shard the
    place in the stream where it ends: in which pass, at which hash (null: at the pass's
    start), and the words (rest) it has of each row standing there."""
    ranges = cut(sized.groupBy("source", hash_range(F.col("at")).alias("range")).agg(F.sum("size").alias("size")))
    sizes = ranges.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes))
    quotas = source_quotas(targets).groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "quota"))), lambda x: x.quota).alias("quota"))  # SHARDS rows
    plan = cut(targets.alias("t").join(quotas.alias("q").hint("shuffle_hash"), F.col("t.source").eqNullSafe(F.col("q.source")), "left").select("t.*", F.coalesce("quota", F.array_repeat(F.lit(0).cast("long"), SHARDS)).alias("quota")))

    # the blocks dealt up to each shard, as a place in the stream; all passes end it
    dealt = plan.select(F.col("source").alias("s"), "source_size", "quota", F.explode(F.sequence(F.lit(1), F.lit(SHARDS))).alias("shard"))
    words = F.least(F.aggregate(F.slice("quota", 1, F.col("shard")), F.lit(0).cast("long"), lambda a, x: a + x) * BLOCK, TIMES * F.col("source_size"))
    dealt = dealt.withColumn("words", words).withColumn("pass", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0).cast("int"))
    ends = cut(dealt.select("s", "shard", "pass", (F.col("words") - F.col("pass") * F.col("source_size")).alias("inside")))
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranges.withColumn("upto", F.sum("size").over(running))  # RANGES rows of a source at most
    at_end = upto.join(ends.filter("inside > 0").hint("shuffle_hash"), F.col("source").eqNullSafe(F.col("s")) & (F.col("upto") > F.col("inside")) & (F.col("upto") - F.col("size") <= F.col("inside")))
    at_end = cut(at_end.select("s", "shard", "range", (F.col("inside") - F.col("upto") + F.col("size")).alias("inside")))

    # inside the one range of each source and shard: rows of one hash are dealt alike
    near = sized.withColumn("range", hash_range(F.col("at"))).alias("d").join(at_end.alias("e").hint("shuffle_hash"), F.col("d.source").eqNullSafe(F.col("e.s")) & (F.col("d.range") == F.col("e.range")))
    near = near.groupBy("s", "shard", "at", "inside").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    within = Window.partitionBy("s", "shard").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.sum("size").over(within))
    cuts = near.filter((F.col("upto") > F.col("inside")) & (F.col("upto") - F.col("size") <= F.col("inside")))
    cuts = cuts.groupBy("s", "shard").agg(F.min("at").alias("cut_at"), F.min(F.floor((F.col("inside") - F.col("upto") + F.col("size")) / F.col("rows"))).alias("rest"))
    every = ends.alias("n").join(cuts.alias("c").hint("shuffle_hash"), F.col("n.s").eqNullSafe(F.col("c.s")) & (F.col("n.shard") == F.col("c.shard")), "left").select("n.s", "n.shard", "pass", "cut_at", "rest")
    lists = every.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("shard", "pass", "cut_at", "rest"))).alias("ends"))  # SHARDS rows
    return cut(plan.join(lists.hint("shuffle_hash"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def dealt_before(shard: int, p: int, at: Column, size: Column) -> Column:
    """Words of a document that pass p deals to the first so many shards."""
    if not shard:
        return F.lit(0).cast("long")
    end = F.element_at("ends", shard)
    here = F.when(end["cut_at"].isNull() | (at > end["cut_at"]), 0).when(at < end["cut_at"], size).otherwise(F.least(size, end["rest"]))
    return F.when(end["pass"] > p, size).when(end["pass"] < p, 0).otherwise(here).cast("long")


#: Sources up to which the plan is broadcast (about 200 bytes a row); beyond, it is
#: joined by shuffling, and Spark splits the hot sources.
BROADCAST_SOURCES = 50_000


def join_plan(df: DataFrame, plan: DataFrame, source: Column) -> DataFrame:
    few = plan.count() <= BROADCAST_SOURCES
    side = plan.withColumnRenamed("source", "_source")
    return df.join(F.broadcast(side) if few else side.hint("merge"), source.eqNullSafe(F.col("_source")), "left").drop("_source")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, shard_words, quota) for every
    row; shard_words has the words that each shard takes of it, which add up to taken.

    A null text has no words and is never taken; a null source is a source of its
    own, the last; rows that are equal in key and text stand at one place and are
    taken alike; an empty table gives an empty result.
    """
    sized = cut(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"), spot(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("at")))
    plan = mixing_plan(sized.select("source", "size", "at"))
    joined = join_plan(sized, plan, F.col("source"))
    upto = F.array(*[sum((dealt_before(j, p, F.col("at"), F.col("size")) for p in range(TIMES)), F.lit(0).cast("long")) for j in range(SHARDS + 1)])
    rows = joined.withColumn("upto", upto)  # a column of its own, as it is referred to again and again
    shares = F.transform(F.slice("upto", 2, SHARDS), lambda x, i: x - F.get("upto", i))
    return rows.select("doc_id", "size", "source", "source_size", "target", F.element_at("upto", -1).alias("taken"), shares.alias("shard_words"), "quota")


def words_between(text: Column, first: Column, n: Column) -> Column:
    """The n words of text after the first ones, with the white space between them."""
    parts = F.split(F.ltrim(text, F.lit(" \t\n\x0b\f\r")), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.ltrim(F.array_join(F.slice(parts, first.cast("int") + 1, n.cast("int")), ""), F.lit(" \t\n\x0b\f\r"))


def mix_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", shard: str | None = None) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each pass that takes words
    of a document; where a pass ends inside one, its text ends there (and n_chars, if
    there is such a column, follows). With shard, a column of that name (replacing one
    of docs) has the shard from 0, and what a pass takes of a document has a row for each
    shard that it falls into. Texts stay in their partitions."""
    kept = [c for c in docs.columns if c != shard]
    place = {c: F.col(f"_{i}") for i, c in enumerate(kept)}
    named = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)])
    at, size = spot(place[key], place[text]), n_words(place[text])
    sized = cut(named.select(place[source].alias("source"), size.alias("size"), at.alias("at")))
    joined = join_plan(named.withColumns({"at": at, "size": size}), mixing_plan(sized), place[source])
    ways = [(0, SHARDS)] if shard is None else [(j, j + 1) for j in range(SHARDS)]
    pieces = F.array(*[F.struct(F.lit(a).alias("shard"), dealt_before(a, p, F.col("at"), F.col("size")).alias("lo") if shard else F.lit(0).cast("long").alias("lo"), dealt_before(b, p, F.col("at"), F.col("size")).alias("hi")) for p in range(TIMES) for a, b in ways])
    rows = joined.select(*place.values(), "size", F.explode(F.filter(pieces, lambda x: x.hi > x.lo)).alias("x")).select(*place.values(), "size", "x.*")
    whole = F.col("hi") - F.col("lo") == F.col("size")
    rows = rows.withColumn("part", F.when(whole, place[text]).otherwise(words_between(place[text], F.col("lo"), F.col("hi") - F.col("lo"))))
    out = {c: x for c, x in place.items()} | {text: F.col("part")}
    if n_chars in out:
        out[n_chars] = F.when(whole, place[n_chars]).otherwise(F.length("part").cast(docs.schema[n_chars].dataType))
    return rows.select(*[x.alias(c) for c, x in out.items()], *([F.col("shard").alias(shard)] if shard else []))
