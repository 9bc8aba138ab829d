"""Fill-in-the-middle transformation by in-place block rotation.

A text is cut between lines into prefix, middle and suffix. Its bytes go into one
bytearray with a sentinel before each part, and the parts change places inside it: two
neighbouring blocks are exchanged by reversing each of them and then both together.
The way back finds the sentinels, rotates the blocks again and takes the sentinels out,
which gives the text byte for byte.

Rows never leave their partition: each way is one ``mapInArrow`` without a shuffle, and a
task holds one Arrow batch of bounded bytes. Nulls and empty texts have the form plain;
so have texts that hold a sentinel already. A null id is hashed as an empty one. Other
columns stay; ones named as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import arrow_schema, release, text_batches

#: Sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes of UTF-8 that only go on with a character.
_TAILS = bytes(range(0x80, 0xC0))
_SCHEMA = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("infill", T.StringType())]


def n_chars(raw: bytes | bytearray) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw.translate(None, _TAILS))


def n_lines(raw: bytes) -> int:
    """Lines with their ends; what follows the last end is a line if there is any."""
    return raw.count(b"\n") + (raw[-1:] not in (b"", b"\n"))


def line_ends(raw: bytes, first: int, second: int) -> tuple[int, int]:
    """Where the first and the second number of lines end (first <= second), by one scan."""
    at, ends = 0, []
    for k in range(second + 1):
        if k == first:
            ends.append(at)
        if k < second:
            at = raw.find(b"\n", at) + 1 or len(raw)
    return ends[0], at


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchanges buffer[start:cut] and buffer[cut:end] by three reversals."""
    for a, b in ((start, cut), (cut, end), (start, end)):
        part = buffer[a:b]
        part.reverse()
        buffer[a:b] = part


def transform(raw: bytes, cuts: tuple[int, int], form: str) -> bytearray:
    """psm: prefix, suffix, middle; spm: suffix, prefix, middle; each after its sentinel."""
    buffer = bytearray(raw)
    for at, mark in ((cuts[1], SUFFIX), (cuts[0], MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    middle = cuts[0] + len(PREFIX)
    suffix = cuts[1] + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def restore(infill: bytes, form: str) -> bytearray:
    """The text that transform took."""
    buffer = bytearray(infill)
    if form == "plain":
        return buffer
    start, cut = (buffer.index(SUFFIX), buffer.index(MIDDLE)) if form == "psm" else (0, buffer.index(PREFIX))
    rotate(buffer, start, cut, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return buffer


def seeds(doc_id: Column, seed: int) -> Column:
    """The first four 8-digit groups of the hash of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def _rows(docs: DataFrame, text: str, made: list[T.StructField], work, *more: Column) -> DataFrame:
    """docs with the columns made, each the list that work gives for a batch's texts (as
    bytes) and the columns more."""
    names = {f.name for f in made}
    kept = [f for f in docs.schema.fields if f.name not in names]
    frame = docs.select(*[f"`{f.name}`" for f in kept], F.col(f"`{text}`").cast("binary").alias("_raw"), *[c.alias(f"_more{i}") for i, c in enumerate(more)])
    schema = T.StructType([*kept, *made])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = work(*[batch.column(i).to_pylist() for i in range(len(kept), batch.num_columns)])
            got = [pa.array(c, pa.binary() if pa.types.is_string(t) else t).cast(t) for c, t in zip(columns, arrow.types[len(kept) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *got], schema=arrow)
        release()

    return text_batches(frame).mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", rate: int = 100, spm_rate: int = 50, seed: int = 7) -> DataFrame:
    """docs with n (lines), form, prefix_chars, middle_chars (code points; null if plain) and
    infill, the text rearranged; rate and spm_rate are percentages. Where the cuts fall
    depends on seed and id alone, so reruns agree."""

    def work(texts: list[bytes | None], hashes: list[list[int]]):
        rows = []
        for raw, (h1, h2, h3, h4) in zip(texts, hashes, strict=True):
            raw = raw or b""
            n = n_lines(raw)
            if not raw or any(m in raw for m in MARKS) or h3 % 100 >= rate:
                rows.append((n, b"plain", None, None, raw))
                continue
            form = "spm" if h4 % 100 < spm_rate else "psm"
            a, b = line_ends(raw, *sorted((h1 % (n + 1), h2 % (n + 1))))
            rows.append((n, form.encode(), n_chars(raw[:a]), n_chars(raw[a:b]), bytes(transform(raw, (a, b), form))))
        return zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA)

    return _rows(docs, text, _SCHEMA, work, seeds(F.col(f"`{key}`"), seed))


def restore_middle(docs: DataFrame, infill: str = "infill", form: str = "form") -> DataFrame:
    """docs with restored: the text that fill_in_middle rearranged, from its output and form."""

    def work(texts: list[bytes | None], forms: list[str]):
        return [[bytes(restore(raw or b"", f)) for raw, f in zip(texts, forms, strict=True)]]

    return _rows(docs, infill, [T.StructField("restored", T.StringType())], work, F.coalesce(F.col(f"`{form}`"), F.lit("plain")))
