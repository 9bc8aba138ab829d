"""Byte-level BPE encoding and decoding.

A pre-token's bytes form a doubly linked list of symbols. A heap holds the
adjacent pairs that have a merge, ordered by (rank, position); a popped entry
that no longer describes two living neighbours is stale and skipped. The
pieces of real text repeat, so each task keeps the finished pieces in a bounded
map, as packed ids. Decoding joins the vocabulary strings of the ids.

Texts never leave their partition: encoding is one ``mapInArrow`` without a shuffle.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from linkscope.llm.common import arrow_schema, release, text_batches, vocabulary_path

#: The published pattern that splits text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII alone, which the plainer engine reads in half the time.
ASCII_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: Finished pieces of a generation, of which a worker keeps two: about 50 MB at most.
KEPT_PIECES = 120_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file:
    a visible Latin-1 character for itself, the others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


#: A pair's key is its left id above so many bits of its right one.
PAIR = 32


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"={len(ids)}i", *ids)


class Pieces(dict):
    """Finished pieces with their ids packed as 32-bit numbers: a missing one is merged
    on first sight. A full generation becomes the old one, from which pieces still in
    use come over."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge
        self.kept = KEPT_PIECES
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drops the old generation once a task is over."""
        self.old = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) or packed(self.merge(piece))
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class ByteBPE:
    """A vocabulary with its merges, as read from a tokenizer's JSON file."""

    def __init__(self, spec: dict):
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank_of = {self.vocab[a] << PAIR | self.vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        alphabet = byte_alphabet()
        self.byte_id = [self.vocab[c] for c in alphabet]
        self.byte_rank = [[self.rank_of.get(a << PAIR | b, -1) for b in self.byte_id] for a in self.byte_id]
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in self.vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.pattern, self.ascii_pattern = regex.compile(PIECES), re.compile(ASCII_PIECES)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.seen = Pieces(self.merge)
        strings = [self.bytes_of.get(i) for i in range(max(self.bytes_of) + 1)]
        self.strings = pa.array(strings, pa.large_binary())

    @classmethod
    def load(cls, path: str) -> ByteBPE:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece. A heap entry holds a rank and, in its low bits, a position;
        it is stale unless the pair that starts there still has that rank."""
        raw = piece.encode("utf-8", "surrogatepass")
        ids = [self.byte_id[b] for b in raw]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, merged, byte_rank = self.rank_of.get, self.merged, self.byte_rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [byte_rank[a][b] for a, b in zip(raw, raw[1:], strict=False)]
        rank.append(-1)
        low = n.bit_length()
        mask = (1 << low) - 1
        heap = [r << low | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, r = entry & mask, entry >> low
            if rank[i] != r:
                continue  # stale
            j = after[i]
            ids[i] = new = merged[r]
            ids[j] = rank[j] = -1  # no longer a symbol
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank[i] = r = rank_of(new << PAIR | ids[k], -1)
                if r >= 0:
                    heappush(heap, r << low | i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                rank[h] = r = rank_of(ids[h] << PAIR | new, -1)
                if r >= 0:
                    heappush(heap, r << low | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text; a null is an empty text. Special strings in the
        text become their own id, as the reading library does by default."""
        if not text:
            return b""
        if not self.splitter or not any(s in text for s in self.special):
            return self.merge_all(text)
        parts = self.splitter.split(text)
        return b"".join(packed([self.special[x]]) if x in self.special else self.merge_all(x) for x in parts)

    def merge_all(self, text: str) -> bytes:
        pattern = self.ascii_pattern if text.isascii() else self.pattern
        return b"".join(map(self.seen.__getitem__, pattern.findall(text)))

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        """A list of ids for each text."""
        got = [self.encode(t) for t in texts]
        ends = np.zeros(len(got) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in got], out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32)))

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids; empty for a null."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        flat = ids.flatten()
        strings = self.strings.take(flat)
        if flat.null_count or strings.null_count:
            raise ValueError("an id outside the vocabulary")
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), strings), pa.scalar(b"", pa.large_binary()))
        try:
            return joined.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # some text isn't UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


class _Lazy:
    """Made once in each Python worker."""

    models: dict[str, ByteBPE] = {}

    @classmethod
    def get(cls, path: str, raw) -> ByteBPE:
        if path not in cls.models:
            cls.models[path] = ByteBPE(json.loads(raw.value))
        return cls.models[path]


def _vocabulary(df: DataFrame, vocabulary: str):
    path = vocabulary_path(vocabulary)
    with open(path, encoding="utf-8") as f:
        return path, df.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of about 1.5 MB


def bpe_encode(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the column ids (array<int>) to df.

    Null text: no ids. Rows, their order within a partition and all other columns
    stay; a column already named as the new one is replaced.
    """
    path, raw = _vocabulary(df, vocabulary)
    df = df.drop(ids) if ids in df.columns else df
    at, n_cols = df.columns.index(text), len(df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Lazy.get(path, raw)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = model.encode_all(part.column(at).to_pylist()).cast(arrow.field(n_cols).type)
                yield pa.RecordBatch.from_arrays([*part.columns, got], schema=arrow)
        model.seen.forget()
        release()

    return text_batches(df).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the column text: the ids' vocabulary strings joined, read as UTF-8
    (bytes that aren't UTF-8 become U+FFFD). Null ids: an empty text. An id
    outside the vocabulary is an error."""
    path, raw = _vocabulary(df, vocabulary)
    df = df.drop(text) if text in df.columns else df
    at = df.columns.index(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType(), False)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Lazy.get(path, raw)
        for batch in batches:
            got = model.decode_all(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, got], schema=arrow)

    return text_batches(df).mapInArrow(run, schema)
