"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each
byte has a learned vector; learned filters run over a chunk, and each filter's
strongest response in the chunk is kept (max-pooling). The chunks' responses combine,
as their mean and their maximum, into one probability by a logistic unit. Everything
is trained together by gradient descent.

Training reads a bounded sample: at most TRAIN_ROWS labelled documents of each class
with at most TRAIN_BYTES bytes each, chosen by a hash of their id. Scoring reads
every whole text in its partition, a block of chunks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import arrow_schema, release, text_batches

CHUNK, OVERLAP = 256, 32
#: Byte vectors, filter width, filters, step of a filter.
SIZE, WIDTH, FILTERS, STEP = 4, 8, 16, 2
#: Chunks computed at once.
BLOCK = 256
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, RATE = 1000, 65_536, 20, 0.01
#: Rows whose crc32 of the id as text leaves this remainder are never learned from.
FOLDS, HELD_OUT = 5, 0
#: A document is good from this score on.
THRESHOLD = 0.3


def chunks_of(raw: bytes) -> np.ndarray:
    """(chunks, CHUNK) bytes, padded with zeros; an empty text has one empty chunk."""
    stride = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // stride))
    padded = np.zeros((n - 1) * stride + CHUNK, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::stride]


@dataclass
class ByteNet:
    embed: np.ndarray  # (256, SIZE)
    filters: np.ndarray  # (WIDTH * SIZE, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    offset: float

    @classmethod
    def start(cls, seed: int = 7) -> ByteNet:
        r = np.random.default_rng(seed)
        f = np.float32
        embed = r.normal(0, 1, (256, SIZE)).astype(f)
        embed[0] = 0
        return cls(embed, r.normal(0, (WIDTH * SIZE) ** -0.5, (WIDTH * SIZE, FILTERS)).astype(f), np.zeros(FILTERS, f), r.normal(0, 0.1, 2 * FILTERS).astype(f), 0.0)

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * SIZE) view of the embedded bytes."""
        e = self.embed[chunks].reshape(len(chunks), CHUNK * SIZE)
        return np.lib.stride_tricks.sliding_window_view(e, WIDTH * SIZE, axis=1)[:, :: STEP * SIZE]

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strongest response of each filter in each chunk, and where it is."""
        got, places = [], []
        for lo in range(0, len(chunks), BLOCK):
            w = self.windows(chunks[lo : lo + BLOCK])
            r = (np.ascontiguousarray(w).reshape(-1, WIDTH * SIZE) @ self.filters).reshape(*w.shape[:2], FILTERS)
            places.append(r.argmax(1))
            got.append(np.take_along_axis(r, places[-1][:, None], 1)[:, 0])
        return np.concatenate(got) + self.bias, np.concatenate(places)

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """As pooled, without the places."""
        got = []
        for lo in range(0, len(chunks), BLOCK):
            w = self.windows(chunks[lo : lo + BLOCK])
            got.append((np.ascontiguousarray(w).reshape(-1, WIDTH * SIZE) @ self.filters).reshape(*w.shape[:2], FILTERS).max(1))
        return np.maximum(np.concatenate(got) + self.bias, 0)

    def combine(self, relu: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean and maximum of each document's chunks; first: where its chunks begin."""
        n = np.diff(np.append(first, len(relu)))[:, None]
        return np.concatenate([np.add.reduceat(relu, first) / n, np.maximum.reduceat(relu, first)], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of good; a long text goes through in blocks."""
        out = np.empty(len(texts))
        lo = 0
        while lo < len(texts):
            cut, n = [], 0
            while lo + len(cut) < len(texts) and n < 4 * BLOCK:
                cut.append(chunks_of(texts[lo + len(cut)]))
                n += len(cut[-1])
            relu = np.concatenate([self.responses(c) for c in cut]) if n > 16 * BLOCK else self.responses(np.concatenate(cut))
            first = np.cumsum([0, *map(len, cut[:-1])])
            out[lo : lo + len(cut)] = self.combine(relu, first) @ self.weights + self.offset
            lo += len(cut)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 7) -> ByteNet:
    """Adam on the cross-entropy, both classes weighing the same; afterwards the
    offset is moved to the prior, the share of good among all labelled rows."""
    net, r = ByteNet.start(seed), np.random.default_rng(seed)
    cut = [chunks_of(t) for t in texts]
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    names = ("embed", "filters", "bias", "weights", "offset")
    m = {k: np.zeros_like(getattr(net, k), dtype=np.float64) for k in names}
    v = {k: np.zeros_like(getattr(net, k), dtype=np.float64) for k in names}
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), 32):
            rows = order[lo : lo + 32]
            mine = [cut[i] for i in rows]
            n = np.array([len(c) for c in mine])
            first = np.cumsum([0, *n[:-1]])
            chunks = np.concatenate(mine)
            raw, places = net.pooled(chunks)
            relu = np.maximum(raw, 0)
            both = net.combine(relu, first)
            p = 1 / (1 + np.exp(-np.clip(both @ net.weights + net.offset, -30, 30)))
            d = (p - labels[rows]) * weight[rows] / len(rows)
            g = {"weights": both.T @ d + 1e-4 * net.weights, "offset": d.sum()}
            up = d[:, None] * net.weights
            doc = np.repeat(np.arange(len(rows)), n)
            top = relu == both[doc, FILTERS:]
            down = up[doc, :FILTERS] / n[doc, None] + np.where(top, up[doc, FILTERS:], 0)
            down = np.where(raw > 0, down, 0)
            g["bias"] = down.sum(0)
            at = places * STEP
            bytes_ = chunks[np.arange(len(chunks))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # (chunks, FILTERS, WIDTH)
            seen = net.embed[bytes_].reshape(len(chunks), FILTERS, WIDTH * SIZE)
            g["filters"] = np.einsum("cf,cfk->kf", down, seen)
            back = (down[:, :, None] * net.filters.T).reshape(-1, SIZE)
            g["embed"] = np.stack([np.bincount(bytes_.ravel(), back[:, i], 256) for i in range(SIZE)], 1)
            g["embed"][0] = 0
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * np.square(g[k])
                move = RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, float(net.offset - move) if k == "offset" else (getattr(net, k) - move).astype(np.float32))
    net.offset += float(np.log(prior / (1 - prior)))
    return net


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> ByteNet:
    """Trains on at most rows labelled documents of each class that aren't held out.

    Rows without a key, a label of 0 or 1 or a document are left out, as are keys with
    both labels; with one class only, or none, the network knows nothing and gives
    every text the same score.
    """
    own = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y")).filter("k is not null and y in (0, 1)")
    own = own.filter(~held_out(F.col("k"))).groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z")
    n = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    prior = min(max((n.get(1, 0) + 1) / (sum(n.values()) + 2), 0.02), 0.98)
    picked = [own.filter(F.col("y") == y).orderBy(F.xxhash64("k", F.lit(11)), "k").limit(2 * rows).select("k", "y") for y in (0, 1)]
    few = picked[0].union(picked[1])  # 4 * rows at most
    found = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter(F.octet_length(F.coalesce("t", F.lit(""))) <= TRAIN_BYTES).join(F.broadcast(few), "k")
    sample: list = []
    for y in (0, 1):
        sample += found.filter(F.col("y") == y).orderBy(F.xxhash64("k", F.lit(11)), "k", F.xxhash64("t")).limit(rows).collect()
    y = np.array([r["y"] for r in sample], np.float64)
    if len(set(y)) < 2:
        net = ByteNet.start()
        net.weights[:] = 0
        net.offset = float(np.log(prior / (1 - prior)))
        return net
    return train([(r["t"] or "").encode("utf-8", "replace") for r in sample], y, prior)


def add_score(docs: DataFrame, net: ByteNet, text: str = "text", name: str = "score", keep_text: bool = True) -> DataFrame:
    """Adds a column with the score (0 to 1) of each whole text; null: as empty. All
    other columns stay (the text too, if keep_text); one already so named is replaced."""
    docs = docs.drop(name) if name in docs.columns else docs
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    docs = docs.select(*[f"`{f.name}`" for f in kept], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType(), False)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(len(kept)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(net.scores(texts), pa.float64())], schema=arrow)
        release()

    return text_batches(docs).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for every row of docs; a null key counts as
    not held out; repeated rows give repeated rows."""
    scored = add_score(docs.select(key, text), fit_quality(docs, labels, key, text), text, keep_text=False)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the classifier calls good, with their columns as they came."""
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    scored = add_score(inner, fit_quality(docs, labels, key, text), f"_{docs.columns.index(text)}")
    return scored.filter(F.col("score") >= THRESHOLD).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
