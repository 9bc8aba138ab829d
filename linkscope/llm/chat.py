"""Chat formatting from an event log.

A conversation's log holds events in sequence: a message as a whole, the start of
one and its streamed deltas, edits, deletions and regenerations. The log is
partitioned by conversation and sorted by sequence, so each task folds a stream of
events, whatever their number; only one conversation's messages are held at a time.
The final messages are rendered into one string with a loss mask over what the
assistant says.

The template marks a turn as ``### role:\\n text </turn>\\n``. Inside roles and texts
a backslash is doubled, one is put between any two number signs and one into
``</turn>``, so that neither mark is ever part of a text, and every text is read back
exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import arrow_schema, text_batches

HEAD, MIDDLE, TAIL = "### ", ":\n", "</turn>\n"
#: Whose words the loss counts.
LEARNED = "assistant"
_SIGNS = re.compile("#(?=#)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType(), False),
        T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("stop", T.LongType(), False)]), False), False),
    ]
)
MESSAGES = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType(), False), T.StructField("role", T.StringType(), False), T.StructField("text", T.StringType(), False)])


def escape(text: str) -> str:
    """text in which HEAD and TAIL can't stand: the marks themselves are broken."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _SIGNS.sub(r"#\\", text).replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    """A role ends at the first colon and line feed that isn't escaped."""
    return escape(role).replace(":", "\\:")


class Fold:
    """One conversation's messages, as its events come in sequence.

    kind: "message" (role, text) adds a finished message; "start" (role) opens one
    and "delta" (text) adds to the one named by ref, or to the last; "edit" (text)
    replaces the text of ref; "delete" drops it; "regenerate" empties it (its new
    text follows as deltas) and drops all messages after it. ref is the message's
    number in order of its opening, from 0. An event whose ref doesn't exist, or of
    another kind, is passed over; a null kind is "message".
    """

    def __init__(self):
        self.role: dict[int, str] = {}
        self.parts: dict[int, list[str]] = {}
        self.opened = 0

    def take(self, kind: str | None, ref: int | None, role: str | None, text: str | None) -> None:
        if kind in (None, "message", "start"):
            self.role[self.opened] = role or ""
            self.parts[self.opened] = [text or ""]
            self.opened += 1
            return
        at = ref if ref is not None else max(self.role, default=-1)
        if at not in self.role:
            return
        if kind == "delta":
            self.parts[at].append(text or "")
        elif kind == "edit":
            self.parts[at] = [text or ""]
        elif kind == "delete":
            del self.role[at], self.parts[at]
        elif kind == "regenerate":
            self.parts[at] = [text or ""]
            for later in [k for k in self.role if k > at]:
                del self.role[later], self.parts[later]

    def messages(self) -> list[tuple[str, str]]:
        return [(self.role[k], "".join(self.parts[k])) for k in sorted(self.role)]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans (code points) of what is learned."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = HEAD + escape_role(role) + MIDDLE, escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, TAIL)
        at += len(head) + len(body) + len(TAIL)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted string. Escaped text has neither a tail nor an
    escaped role a colon of its own, so the marks are unambiguous."""
    out = []
    for turn in formatted.split(TAIL)[:-1]:
        stop, at = -1, len(HEAD)
        while stop < 0:
            at = turn.index(MIDDLE, at)
            before = turn[len(HEAD) : at]
            if (len(before) - len(before.rstrip("\\"))) % 2 == 0:
                stop = at
            at += 1
        out.append((unescape(turn[len(HEAD) : stop]), unescape(turn[stop + len(MIDDLE) :])))
    return out


def as_events(messages: DataFrame) -> DataFrame:
    """The log of finished messages(conv_id, turn, role, text), as a chat would have
    written it: each message is opened and streamed in two deltas; a third of them (by a
    hash) have a draft that an edit replaces, a third a first answer that is generated
    again. seq keeps the order of turns, then of role and a hash of the text; repeated
    rows follow one another."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    one, two = text.substr(F.lit(1), half), text.substr(half + 1, F.length(text))

    def event(kind: str, said: Column | None = None, role: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), (none if role is None else role).alias("role"), (none if said is None else said).alias("text"))

    start, deltas = event("start", role=F.col("role")), [event("delta", one), event("delta", two)]
    way = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(3))
    events = F.when(way == 0, F.array(start, *deltas)).when(way == 1, F.array(start, event("delta", two), event("edit", text))).otherwise(F.array(start, event("delta", F.lit("a first answer")), event("regenerate"), *deltas))
    rows = messages.select("conv_id", "turn", "role", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), F.posexplode(events).alias("step", "e"))
    return rows.select("conv_id", F.struct("turn", "role", "tie", "row", "step").alias("seq"), "e.kind", F.lit(None).cast("long").alias("ref"), "e.role", "e.text")


def _sorted_log(events: DataFrame) -> DataFrame:
    log = events.select("conv_id", "kind", F.col("ref").cast("long").alias("ref"), "role", "text", "seq")
    return log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text").select("conv_id", "kind", "ref", "role", "text")


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Fold]]:
    conv, fold = None, None
    for batch in batches:
        for c, kind, ref, role, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if fold is None or c != conv:
                if fold is not None:
                    yield conv, fold
                conv, fold = c, Fold()
            fold.take(kind, ref, role, text)
    if fold is not None:
        yield conv, fold


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans), a row per conversation of events(conv_id,
    seq, kind, ref, role, text; see Fold). seq is of any type that has an order.

    Events of one seq go by role and text (nulls first), so that equal logs give
    equal results; a null text or role is empty; events without a conv_id make one
    conversation, that of null; repeated messages are messages of their own; a
    conversation whose messages are all deleted is an empty string; an empty log
    gives no rows; further columns are left out.
    """
    arrow = arrow_schema(FORMATTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, spans, size = [], [], [], 0

        def batch() -> pa.RecordBatch:
            marks = [[{"start": a, "stop": b} for a, b in s] for s in spans]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(marks, arrow.field(2).type)], schema=arrow)

        for conv, fold in _folds(batches):
            text, span = render(fold.messages())
            ids.append(conv)
            texts.append(text)
            spans.append(span)
            size += len(text)
            if size > 4_000_000:
                yield batch()
                ids, texts, spans, size = [], [], [], 0
        yield batch()

    return text_batches(_sorted_log(events)).mapInArrow(run, FORMATTED)


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) back from format_conversations."""
    arrow = arrow_schema(MESSAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = parse(text)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(got), pa.int64()), pa.array(range(len(got)), pa.int64()), pa.array([r for r, _ in got], pa.string()), pa.array([t for _, t in got], pa.string())], schema=arrow)

    return text_batches(formatted.select("conv_id", "formatted")).mapInArrow(run, MESSAGES)


DIGEST = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType(), False),
        T.StructField("turns_sha256", T.StringType(), False),
        T.StructField("loss_chars", T.LongType(), False),
        T.StructField("loss_sha256", T.StringType(), False),
        T.StructField("formatted_chars", T.LongType(), False),
    ]
)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say, read back from them alone: turns, what the loss
    mask covers (unescaped), and their hashes."""
    arrow = arrow_schema(DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, text, spans in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = n_loss = 0
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in spans:
                    part = unescape(text[s["start"] : s["stop"]])
                    loss.update(part.encode())
                    n_loss += len(part)
                rows.append((c, n, turns.hexdigest(), n_loss, loss.hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(DIGEST)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return text_batches(formatted.select("conv_id", "formatted", "loss_spans")).mapInArrow(run, DIGEST)
