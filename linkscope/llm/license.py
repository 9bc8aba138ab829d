"""License scans by diagonal voting.

Each document's rolling word k-gram hashes join the positions of the same hashes in
the license templates. A match votes for the diagonal (document position minus
template position) on which the template would start. Runs of matches on diagonals
that lie close together and follow one another in template and text - the text has a
word more, less or another - chain into one candidate span, which is verified by how
much of the template it covers, in order, and by its length.

The base phrases are templates of their own: one stands exactly where a single
diagonal has all its k-grams, so their places come from the unmerged diagonals.

The templates are fixed and few (about a hundred k-grams), so they are broadcast.
Only built-in expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from linkscope.llm.common import ascii_lower, cut

#: Letters a-z, digits, and all beyond ASCII make words; everything else parts them.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
#: Phrases whose every place counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wordings of public licenses, with the label of each.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("the software is provided as is without warranty of any kind", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("free software you can redistribute it and or modify it under the terms of the gnu", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
)
#: Diagonals this close chain. A span must cover this share of its template's words,
#: all of them if the template is shorter than SHORT, and be at most LONGER times as long.
NEAR, COVER, SHORT, LONGER = 3, 0.7, 8, 1.5


def license_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PARTS), lambda w: w != "")


def gram_hashes(words: Column) -> Column:
    """Hashes of the rolling k-grams of words; none if there are fewer than k."""
    starts = F.sequence(F.lit(1), F.size(words) - (K - 1))
    return F.when(F.size(words) >= K, F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(K)]))).otherwise(F.array().cast("array<bigint>"))


def template_table(spark) -> DataFrame:
    """(template, label, exact, length, tpos, hash): a row for each k-gram."""
    rows = [(i, label, exact, text) for i, (text, label, exact) in enumerate([*((t, b, True) for t, b in BASE.items()), *((t, b, False) for t, b in TEMPLATES)])]
    kind = T.StructType([T.StructField("template", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("exact", T.BooleanType()), T.StructField("phrase", T.StringType())])
    t = spark.createDataFrame(rows, kind).withColumn("w", license_words(F.col("phrase")))
    return t.select("template", "label", "exact", F.size("w").alias("length"), F.posexplode(gram_hashes(F.col("w"))).alias("tpos", "hash"))


def diagonals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Votes by (k1, k2, template, diagonal). k1 and k2 identify the row's content, so
    repeated rows share their votes; positions are counted once."""
    split = docs.select("k1", "k2", license_words(F.col(text)).alias("w"))  # a column of its own, as the k-grams refer to it again and again
    grams = split.select("k1", "k2", F.posexplode(gram_hashes(F.col("w"))).alias("pos", "hash"))
    hits = grams.join(F.broadcast(template_table(docs.sparkSession)), "hash")  # the templates are fixed
    by = ["k1", "k2", "template", "label", "exact", "length", (F.col("pos") - F.col("tpos")).alias("diagonal")]
    return hits.groupBy(*by).agg(F.expr("bit_or(shiftleft(1L, tpos))").alias("grams")).withColumn("votes", F.bit_count("grams"))


def runs(votes: DataFrame) -> DataFrame:
    """Unbroken runs of matches on a diagonal: (k1, k2, template, label, length, run),
    run being (start, t0, t1, diagonal), where start is its first word in the text and
    t0 and t1 its first and last k-gram in the template."""
    hit = lambda t: (t >= 0) & (t <= F.col("length") - K) & (F.getbit("grams", F.greatest(t, F.lit(0))) == 1)
    every = F.sequence(F.lit(0), F.col("length") - K)
    first, last = F.filter(every, lambda t: hit(t) & ~hit(t - 1)), F.filter(every, lambda t: hit(t) & ~hit(t + 1))
    pairs = F.transform(F.arrays_zip(first.alias("t0"), last.alias("t1")), lambda r: F.struct((F.col("diagonal") + r.t0).alias("start"), r.t0.alias("t0"), r.t1.alias("t1"), F.col("diagonal").alias("diagonal")))
    return votes.filter("not exact").select("k1", "k2", "template", "label", "length", F.explode(pairs).alias("run"))


def chained(first: Column, others: Column) -> Column:
    """The chains that begin with the run first and go on through others (sorted), each
    as (start, t0, t1, diagonal, words) of its last run with the words of the template
    that the best such chain covers. A run follows another if it is further on in
    both the template and the text and their diagonals differ by at most NEAR; words
    that both hold count once."""

    def follows(c: Column, x: Column) -> Column:
        on = (x.t0 > c.t0) & (x.t1 > c.t1) & (x.start > c.start) & (x.diagonal + x.t1 > c.diagonal + c.t1)
        return on & (F.abs(x.diagonal - c.diagonal) <= NEAR)

    def words(c: Column, x: Column) -> Column:
        shared = F.greatest(F.lit(0), c.t1 + K - x.t0, c.diagonal + c.t1 + K - x.start)
        return c.words + F.greatest(F.lit(0), x.t1 - x.t0 + K - shared)

    def state(x: Column, n: Column) -> Column:
        return F.array(F.struct(x.start.alias("start"), x.t0.alias("t0"), x.t1.alias("t1"), x.diagonal.alias("diagonal"), n.alias("words")))

    def step(chains: Column, x: Column) -> Column:
        best = F.array_max(F.transform(F.filter(chains, lambda c: follows(c, x)), lambda c: words(c, x)))
        return F.when(best.isNull(), chains).otherwise(F.concat(chains, state(x, best)))

    return F.aggregate(others, state(first, first.t1 - first.t0 + K), step)


def spans(votes: DataFrame) -> DataFrame:
    """Chained runs: (k1, k2, template, label, start, stop, coverage), verified. Of spans
    of a template that overlap, the one with the largest coverage stays."""
    far = int(LONGER * max(len(t.split()) for t, _ in TEMPLATES))  # no span is longer
    by = Window.partitionBy("k1", "k2", "template").orderBy("start")
    need = F.col("length") * F.when(F.col("length") < SHORT, 1.0).otherwise(COVER)
    s = runs(votes).withColumn("start", F.col("run.start"))
    s = s.withColumn("near", F.sort_array(F.collect_list("run").over(by.rangeBetween(0, far))))
    # a chain has no more words than its runs together
    s = s.filter(F.aggregate("near", F.lit(0), lambda n, x: n + x.t1 - x.t0 + K) >= need)
    ends = F.transform(chained(F.col("run"), F.col("near")), lambda c: F.struct(c.words.alias("words"), (-(c.diagonal + c.t1 + K)).alias("back")))
    s = s.withColumn("best", F.array_max(F.filter(ends, lambda e: -e.back - F.col("start") <= LONGER * F.col("length"))))
    s = s.filter(F.col("best.words") >= need)
    s = s.select("k1", "k2", "template", "label", "start", (-F.col("best.back")).alias("stop"), F.least(F.lit(1.0), F.col("best.words") / F.col("length")).alias("coverage")).distinct()
    better = F.struct(F.col("coverage"), (F.col("start") - F.col("stop")).alias("short"), (-F.col("start")).alias("early"))
    s = s.withColumn("rank", better).withColumn("others", F.collect_list(F.struct("start", "stop", "rank")).over(by.rangeBetween(-far, far)))
    beaten = F.exists("others", lambda o: (o.start < F.col("stop")) & (o.stop > F.col("start")) & (o.rank > F.col("rank")))
    return s.filter(~beaten).drop("rank", "others")


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)
    for every row of docs.

    score is the largest coverage of a verified span, 1.0 where a base phrase stands,
    else 0.0. Null, empty and unlicensed texts have no places (null first_word and
    last_word, empty label strings); repeated rows give repeated rows.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), body.alias("text"))
    docs = docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(K), "doc_id")})
    votes = cut(diagonals(docs))  # few rows, read twice
    places = votes.filter(F.col("exact") & (F.col("votes") == F.col("length") - (K - 1))).select("k1", "k2", "template", "label", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length")).alias("stop"), F.lit(1.0).alias("coverage"), F.lit(True).alias("base"))
    found = places.unionByName(spans(votes).select("k1", "k2", "template", "label", "start", "stop", "coverage", F.lit(False).alias("base")))
    base = F.col("base")
    per = found.groupBy("k1", "k2").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "stop", "label", "coverage"))).alias("spans"),
    )
    every = docs.select("k1", "k2", "doc_id", F.size(license_words(F.col("text"))).cast("long").alias("n_words"))
    out = every.join(per.hint("merge"), ["k1", "k2"], "left")
    blank = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in (("n_base", 0), ("base_labels", ""), ("labels", ""), ("score", 0.0))}
    return out.select("doc_id", "n_words", blank["n_base"].cast("long").alias("n_base"), "first_word", "last_word", blank["base_labels"].alias("base_labels"), blank["labels"].alias("labels"), blank["score"].alias("score"), "spans")
