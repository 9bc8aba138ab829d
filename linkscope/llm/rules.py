"""Quality rules as weak supervision.

Each rule reads a document's counts and votes good, bad, or abstains. No rule
decides alone: expectation-maximisation over the votes of *all* documents
estimates how often each rule is right on good and on bad documents, and a
document stays if the posterior probability of being good reaches one half.

The votes of a corpus are at most 3 ** (number of rules) patterns. Spark counts
the patterns (a map-side aggregation); the driver fits on those counts, whose
number doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import arrow_schema, cut, release, text_batches

#: Counted in each text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper_words", "n_symbol_words", "n_run_words")
SYMBOLS = "#*$%&|<>"
_SYMBOLS = SYMBOLS.encode()
#: Words of a window whose repetition counts.
WINDOW = 8
GOOD, BAD, ABSTAIN = 1, 0, 2
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of eight found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        windows += ids[j : j + n] * _FACTORS[j]
    windows ^= windows >> np.uint64(29)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[WINDOW:] -= twice
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text; all 0 for a null."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "replace")
    n_symbols = sum(map(text.count, SYMBOLS))
    words = raw.split()  # bytes split at ASCII white space only
    seen, n_dup, n_lines, n_ended = set(), 0, 0, 0
    for line in raw.split(b"\n"):
        if body := line.strip():
            n_lines += 1
            n_ended += body[-1:] in b'.!?:;"' and not body.endswith(b"!!")
            n_dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\x0b\f\r")),
        n_symbols,
        n_dup,
        repeated_words(words),
        n_lines,
        n_ended,
        sum(map(bytes.isupper, words)),
        sum(w.translate(None, _SYMBOLS) != w for w in words) if n_symbols else 0,
        sum(map(eq, words, words[1:])),
    )


def add_counts(docs: DataFrame, text: str = "text", name: str = "counts", keep_text: bool = True) -> DataFrame:
    """Adds a struct column of COUNTS, one pass, no shuffle. All other columns
    stay (the text too, if keep_text); one already so named is replaced."""
    docs = docs.drop(name) if name in docs.columns else docs
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    docs = docs.select(*[f"`{f.name}`" for f in kept], F.col(f"`{text}`").alias("_text"))
    struct = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])
    schema = T.StructType([*kept, T.StructField(name, struct, False)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t.as_py()) for t in batch.column(len(kept))]
            columns = zip(*rows, strict=True) if rows else [[] for _ in COUNTS]
            got = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(arrow.field(len(kept)).type))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], got], schema=arrow)
        release()

    return text_batches(docs).mapInArrow(run, schema)


def rules(c: str = "counts") -> dict[str, Column]:
    """Each rule's vote. Without words only the length rule votes."""

    def n(x: str) -> Column:
        return F.col(f"{c}.{x}")

    words, lines = n("n_words"), n("n_lines")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    some, never = words > 0, F.lit(False)
    return {
        "length": vote(words < 20, never),
        "word_length": vote(some & ((n("word_chars") < 2 * words) | (n("word_chars") > 15 * words)), never),
        "symbols": vote(some & (5 * n("n_symbols") > words), some & (50 * n("n_symbols") <= words)),
        "symbol_words": vote(some & (4 * n("n_symbol_words") > words), some & (50 * n("n_symbol_words") <= words)),
        "symbol_share": vote(some & (20 * n("n_symbols") > n("word_chars")), some & (200 * n("n_symbols") <= n("word_chars"))),
        "line_copies": vote((lines > 1) & (10 * n("n_dup_lines") > 3 * lines), never),
        "repetition": vote(some & (5 * n("n_repeat_words") > words), (words >= WINDOW) & (20 * n("n_repeat_words") <= words)),
        "word_runs": vote(some & (3 * n("n_run_words") > words), (words > 1) & (20 * n("n_run_words") <= words)),
        "capitals": vote(some & (2 * n("n_upper_words") > words), some & (10 * n("n_upper_words") <= words)),
        "line_ends": vote((lines > 0) & (10 * n("n_ended_lines") < lines), (lines > 0) & (2 * n("n_ended_lines") > lines)),
    }


def pattern(c: str = "counts") -> Column:
    """All votes as one number in base 3."""
    return sum((v.cast("int") * 3**i for i, v in enumerate(rules(c).values())), F.lit(0)).cast("int")


@dataclass
class VoteModel:
    prior: float
    right_on_good: np.ndarray
    right_on_bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes; the prior where all abstain."""
        good = np.log(np.where(votes == GOOD, self.right_on_good, np.where(votes == BAD, 1 - self.right_on_good, 1.0)))
        bad = np.log(np.where(votes == BAD, self.right_on_bad, np.where(votes == GOOD, 1 - self.right_on_bad, 1.0)))
        x = np.log(self.prior / (1 - self.prior)) + good.sum(1) - bad.sum(1)
        return 1 / (1 + np.exp(-x))


def votes_of(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(n_rules) % 3


#: Where EM starts, and what its pseudo-count of a tenth of the documents holds:
#: a rule seldom blames a good document, and finds half of the bad ones.
START_GOOD, START_BAD, START_PRIOR, HELD = 0.98, 0.6, 0.85, 0.1


def fit(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> VoteModel:
    """EM over vote patterns with their counts. Accuracies stay within 0.5 to
    0.995, so that the classes can't change places."""
    n_rules = votes.shape[1]
    model = VoteModel(START_PRIOR, np.full(n_rules, START_GOOD), np.full(n_rules, START_BAD))
    total = max(float(n.sum()), 1.0)
    held = HELD * total
    is_good, is_bad = votes == GOOD, votes == BAD
    for _ in range(rounds):
        p = model.posterior(votes)
        g, b = n * p, n * (1 - p)
        right_good = (g @ is_good + START_GOOD * held) / (g @ (is_good | is_bad) + held)
        right_bad = (b @ is_bad + START_BAD * held) / (b @ (is_good | is_bad) + held)
        after = VoteModel(float(np.clip(g.sum() / total, 0.5, 0.98)), np.clip(right_good, 0.5, 0.995), np.clip(right_bad, 0.5, 0.995))
        moved = max(np.abs(after.right_on_good - model.right_on_good).max(), np.abs(after.right_on_bad - model.right_on_bad).max(), abs(after.prior - model.prior))
        model = after
        if moved < 1e-9:
            break
    return model


def fit_votes(counted: DataFrame, c: str = "counts") -> VoteModel:
    """Fits the model on all rows of counted; an empty table gives the starting one."""
    rows = counted.groupBy(pattern(c).alias("pattern")).count().collect()  # 3 ** 10 rows at most
    rows.sort()
    n_rules = len(rules(c))
    patterns, n = np.array([r[0] for r in rows], np.int64), np.array([float(r[1]) for r in rows])
    return fit(votes_of(patterns, n_rules), n) if rows else VoteModel(START_PRIOR, np.full(n_rules, START_GOOD), np.full(n_rules, START_BAD))


def add_verdict(counted: DataFrame, model: VoteModel, c: str = "counts") -> DataFrame:
    """Adds p_good (posterior), base_failed and kept to counted."""
    spark, n_rules = counted.sparkSession, len(rules(c))
    every = np.arange(3**n_rules)
    p = model.posterior(votes_of(every, n_rules))
    table = spark.createDataFrame([(int(i), float(x)) for i, x in zip(every, p, strict=True)], "_pattern int, p_good double")
    n, repeated = F.col(f"{c}.n_words"), F.col(f"{c}.n_repeat_words")
    return (
        counted.withColumn("_pattern", pattern(c))
        .join(F.broadcast(table), "_pattern", "left")  # 3 ** 10 rows
        .drop("_pattern")
        .withColumn("base_failed", (n < 20) | (100 * repeated > 30 * n))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
    )


def quality_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts, p_good, base_failed, kept) for every row of docs.

    Null and empty texts have no words and fail; repeated rows give repeated rows.
    """
    counted = cut(add_counts(docs.select(key, text), text, keep_text=False))
    return add_verdict(counted, fit_votes(counted))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they came.

    Two passes over the texts (votes, then verdicts) instead of a join that would
    shuffle the texts; rows need no key.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    inner = docs.select(*[x.alias(f"_{i}") for i, x in enumerate(columns)])
    counted = add_counts(inner, f"_{docs.columns.index(text)}")
    model = fit_votes(counted)
    kept = add_verdict(counted, model).filter("kept")
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
