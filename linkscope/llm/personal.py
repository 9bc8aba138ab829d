"""Personal data: fixed patterns, and a linear-chain conditional random field.

The patterns find emails, addresses of machines, card and telephone numbers; all that they
find stays. The field adds what has no fixed form: spelt-out emails, telephone numbers
without a country code, and keys or passwords (kind secret). A line of a text, or what
lies between pieces that the patterns took, is a sequence of words, numbers and marks, each of which has a shape; a token's features are
the shapes of itself and of two tokens on either side. Weights are fitted to the labelled
table by gradient steps on the likelihood (forward and backward sums), on the driver:
the table is small. Viterbi decodes in numpy batches of many lines.

Most tokens are unremarkable: words, full stops at an end and marks without meaning. That such a
token, with none but its like around it, carries no label whatever lies farther off is
proven from the weights once, by all sequences of their shapes (``certain_reach``). So
only the stretches around other tokens are decoded, with the same result as all.

Texts are read whole and never leave their partition; a task holds one Arrow batch of
bounded bytes, or one text, with about 30 bytes a character. Nulls and empty texts have
no spans. Other columns stay; ones named as a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import arrow_schema, release, text_batches
from linkscope.llm.labelled import LINES

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Kinds that the field labels; numbers of cards and machines have a fixed form.
LEARNT = ("email", "phone", "secret")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False), T.StructField("base", T.BooleanType(), False)]), False)

# Fixed patterns. Possessive repeats match what plain ones do, in one pass.

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def base_emails(text: str) -> list[tuple[int, int]]:
    """From each @ the domain to its right, then the name to its left as far as it goes."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        if domain := _DOMAIN.match(text, at + 1):
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = domain.end()
                found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start; code points."""
    found = [(0, *s) for s in base_emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
    for k, pattern, least, most in ((2, _CARD, 13, 19), (3, _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = _NOT_DIGITS.sub("", m[0])
            if least <= len(digits) <= most and (k == 3 or luhn(digits)):
                found.append((k, *m.span()))
    return found


# Tokens and their shapes.

#: Kinds of characters; punctuation marks that mean something have one each.
_SPACE, _LINE, _LETTER, _DIGIT, _OTHER = range(5)
_MARKS = "()[]-+@=:/_."
#: Words that announce a kind, by kind.
CUES = {"call": ("tel", "phone", "call", "mobile", "fax", "whatsapp", "hotline", "number", "cell"), "lock": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "bearer"), "at": ("at",), "dot": ("dot",)}
SHAPES = ["edge", "word", "other", *_MARKS, *CUES, "mixed", "keylike", *(f"digits{n}" for n in ("1", "2", "3", "4", "5-6", "7-8", "9-12", "13-19", "20"))]
_SHAPE = {s: i for i, s in enumerate(SHAPES)}
#: Shapes of unremarkable tokens.
PLAIN = [_SHAPE["word"], _SHAPE["other"]]
#: A token of letters and digits from this length on looks like a key.
KEY_CHARS = 16
#: Tokens on either side whose shapes are features.
AROUND = 2
_DIGIT_SHAPES = np.array([0, *(_SHAPE[f"digits{n}"] for n in ("1", "2", "3", "4")), *[_SHAPE["digits5-6"]] * 2, *[_SHAPE["digits7-8"]] * 2, *[_SHAPE["digits9-12"]] * 4, *[_SHAPE["digits13-19"]] * 7, _SHAPE["digits20"]], np.int8)
_CHARS = np.full(129, _LETTER, np.uint8)
for _c in range(128):
    _x = chr(_c)
    _CHARS[_c] = _LINE if _x == "\n" else _SPACE if _x in " \t\r\x0b\f" else _LETTER if _x.isalpha() else _DIGIT if _x.isdigit() else _OTHER + 1 + _MARKS.index(_x) if _x in _MARKS else _OTHER
_MARK_SHAPES = np.array([0, _SHAPE["edge"], 0, 0, _SHAPE["other"], *[_SHAPE[m] for m in _MARKS]], np.int8)
#: Letters of a cue word that are compared; longer words are none.
_CUE_CHARS = 8


def _packed(word: str) -> int:
    return int.from_bytes(word.encode().ljust(_CUE_CHARS, b"\0"), "big")


_CUE_KEYS = np.array(sorted(_packed(w) for ws in CUES.values() for w in ws), np.uint64)
_CUE_SHAPES = np.array([_SHAPE[s] for _, s in sorted((_packed(w), s) for s, ws in CUES.items() for w in ws)], np.int8)


def tokens(text: str, taken: list[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, shapes): runs of letters and digits, and single marks; a line end has
    the shape edge, and so have the tokens of pieces that are taken."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CHARS[np.minimum(points, 128)]
    solid = (kind == _LETTER) | (kind == _DIGIT)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    over = solid.copy()
    over[:-1] &= ~solid[1:]
    starts = np.flatnonzero(begins | ((kind != _SPACE) & ~solid))
    runs = solid[starts]
    ends = starts + 1
    ends[runs] = np.flatnonzero(over) + 1
    shapes = _MARK_SHAPES[kind[starts]]
    # a full stop before a space ends something; others join
    after = kind[np.minimum(starts + 1, len(kind) - 1)]
    stop = (shapes == _SHAPE["."]) & ((after == _SPACE) | (after == _LINE) | (starts == len(kind) - 1))
    shapes[stop] = _SHAPE["other"]
    digits = np.zeros(len(points) + 1, np.int32)
    np.cumsum(kind == _DIGIT, out=digits[1:])
    n_digits, length = digits[ends] - digits[starts], ends - starts
    shapes[runs] = _SHAPE["word"]
    whole = runs & (n_digits == length)
    shapes[whole] = _DIGIT_SHAPES[np.minimum(length[whole], len(_DIGIT_SHAPES) - 1)]
    both = runs & (n_digits > 0) & ~whole
    shapes[both] = np.where(length[both] >= KEY_CHARS, _SHAPE["keylike"], _SHAPE["mixed"])
    short = np.flatnonzero(runs & (n_digits == 0) & (length <= _CUE_CHARS))
    keys, at, left = np.zeros(len(short), np.uint64), starts[short], length[short]
    for i in range(_CUE_CHARS):
        point = points[np.minimum(at + i, len(points) - 1)]
        keys = keys << np.uint64(8) | np.where(left > i, np.where(point < 128, point | 0x20, 0xFF), 0).astype(np.uint64)
    slot = np.minimum(np.searchsorted(_CUE_KEYS, keys), len(_CUE_KEYS) - 1)
    hit = _CUE_KEYS[slot] == keys
    shapes[short[hit]] = _CUE_SHAPES[slot[hit]]
    # at and dot mean something in brackets only
    spelt = np.flatnonzero((shapes == _SHAPE["at"]) | (shapes == _SHAPE["dot"]))
    before = shapes[np.maximum(spelt - 1, 0)]
    shapes[spelt[(spelt == 0) | ((before != _SHAPE["("]) & (before != _SHAPE["["]))]] = _SHAPE["word"]
    for a, b in taken:
        shapes[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = _SHAPE["edge"]
    return starts, ends, shapes


# The field. State 0 is outside; kind k begins with 1 + 2 * k and goes on with 2 + 2 * k.

STATES = 1 + 2 * len(LEARNT)
OUTSIDE = np.arange(STATES) == 0
_NEVER = -50.0


def _allowed() -> np.ndarray:
    ok = np.zeros((STATES, STATES))
    for s in range(STATES):
        for k in range(len(LEARNT)):
            if s not in (1 + 2 * k, 2 + 2 * k):
                ok[s, 2 + 2 * k] = _NEVER
    return ok


@dataclass(frozen=True)
class Field:
    """emit[slot][shape] and move[from] are rows of a number for each state; reach: how far
    around an unremarkable token all must be so for it to be outside, None if unproven."""

    emit: np.ndarray
    move: np.ndarray
    reach: int | None = None


def scores(emit: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """A row of states for each token of shapes, which has AROUND edges at both ends."""
    n = len(shapes) - 2 * AROUND
    return sum(emit[i][shapes[i : i + n]] for i in range(2 * AROUND + 1))


def labelled_lines(lines: list[str]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts and marked spans of lines with [[kind|text]] pieces."""
    out = []
    for line in lines:
        text, spans = "", []
        for i, part in enumerate(re.split(r"\[\[(\w+\|.*?)\]\](?!\])", line)):
            if i % 2:
                kind, _, part = part.partition("|")
                spans.append((kind, len(text), len(text) + len(part)))
            text += part
        out.append((text, spans))
    return out


def train(lines: list[str] = LINES, rounds: int = 200, rate: float = 0.1, decay: float = 0.0003) -> Field:
    """Fits a field to the marked lines by Adam steps on the mean log-likelihood less
    decay times the squared weights. No randomness: reruns agree."""
    rows = []
    for text, spans in labelled_lines(lines):
        starts, ends, shapes = tokens(text, [s[1:] for s in base_spans(text)])
        states = np.zeros(len(starts), np.int64)
        for kind, a, b in spans:
            inside = np.flatnonzero((starts >= a) & (ends <= b))
            states[inside] = 2 + 2 * LEARNT.index(kind)
            states[inside[:1]] -= 1
        first, last = stretches(shapes, None)
        rows += [(shapes[a:b], states[a:b]) for a, b in zip(first, last, strict=True)]
    longest, n = max(len(s) for s, _ in rows), len(rows)
    shapes = np.zeros((n, longest + 2 * AROUND), np.int64)
    states, real = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for r, (s, y) in enumerate(rows):
        shapes[r, AROUND : AROUND + len(s)] = s
        states[r, : len(y)], real[r, : len(y)] = y, True
    hot = np.eye(STATES)[states] * real[:, :, None]
    slots = range(2 * AROUND + 1)
    fixed = _allowed()
    weights = [np.zeros((len(slots), len(SHAPES), STATES)), np.zeros((STATES, STATES))]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    before = np.concatenate([np.zeros((n, 1), np.int64), states[:, :-1]], 1)
    moves = np.zeros((STATES, STATES))
    np.add.at(moves, (before[real], states[real]), 1)
    for step in range(1, rounds + 1):
        emit, move = weights[0], weights[1] + fixed
        e = sum(emit[i][shapes[:, i : i + longest]] for i in slots)
        forward, pairs = np.zeros((n, longest, STATES)), np.zeros((n, longest, STATES, STATES))
        a = np.where(np.arange(STATES) == 0, 0.0, -1e9)[None].repeat(n, 0)  # a line starts outside
        for t in range(longest):
            both = a[:, :, None] + move + e[:, t, None, :]
            top = both.max(1)
            new = top + np.log(np.exp(both - top[:, None]).sum(1))
            pairs[:, t], forward[:, t] = both, new
            a = np.where(real[:, t, None], new, a)
        top = a.max(1)
        total = top + np.log(np.exp(a - top[:, None]).sum(1))
        backward = np.zeros((n, STATES))
        grad_e, grad_m = np.zeros_like(e), np.zeros_like(moves)
        for t in range(longest - 1, -1, -1):
            share = np.exp(np.minimum(pairs[:, t] + backward[:, None, :] - total[:, None, None], 0)) * real[:, t, None, None]
            grad_e[:, t], grad_m = share.sum(1), grad_m + share.sum(0)
            back = move[None] + (e[:, t] + backward)[:, None, :]
            top = back.max(2)
            backward = np.where(real[:, t, None], top + np.log(np.exp(back - top[:, :, None]).sum(2)), backward)
        rest = hot - grad_e
        up = np.zeros_like(emit)
        for i in slots:
            np.add.at(up[i], shapes[:, i : i + longest].ravel(), rest.reshape(-1, STATES))
        for w, g, m, v in zip(weights, (up / n - decay * emit, (moves - grad_m) / n - decay * weights[1]), mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    found = Field(weights[0], weights[1] + fixed)
    return Field(found.emit, found.move, certain_reach(found))


def certain_reach(field: Field, most: int = 5) -> int | None:
    """The least reach, up to most, such that a plain token is outside in every best path if
    all within reach + AROUND tokens of it, as far as its line goes, are plain. All
    sequences of their shapes are tried, with all states before and after them."""
    for reach in range(1, most + 1):
        whole = reach + AROUND
        # so many tokens on a side; whole: the line goes on there, and anything may follow
        if all(_certain(field, left, right, reach) for left in range(whole, -1, -1) for right in range(whole, -1, -1)):
            return reach
    return None


def _certain(field: Field, left: int, right: int, reach: int) -> bool:
    whole, edge = reach + AROUND, [_SHAPE["edge"]] * AROUND
    sides = np.array(list(product(PLAIN, repeat=left + 1 + right)), np.int64)
    row = np.hstack([*([np.tile(edge, (len(sides), 1))] if left < whole else []), sides, *([np.tile(edge, (len(sides), 1))] if right < whole else [])])
    n = row.shape[1] - 2 * AROUND
    e = sum(field.emit[i][row[:, i : i + n]] for i in range(2 * AROUND + 1))
    at = left if left < whole else reach
    start = field.move if left == whole else field.move[:1]
    ways = start[None, None] + e[:, None, None, 0]  # sequence, outside at the token or not, state before, state
    for t in range(n):
        if t:
            ways = (ways[..., None] + field.move).max(-2) + e[:, None, None, t]
        if t == at:
            ways = np.concatenate([np.where(OUTSIDE, ways, -1e9), np.where(OUTSIDE, -1e9, ways)], 1)
    ways = (ways[..., None] + field.move).max(-2) if right == whole else ways.max(-1, keepdims=True)
    return bool((ways[:, 0] > ways[:, 1] + 1e-6).all())


def stretches(shapes: np.ndarray, reach: int | None) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 token of each stretch that has to be decoded."""
    edge = shapes == _SHAPE["edge"]
    open_ = ~edge
    if reach is not None:
        odd = open_ & ~np.isin(shapes, PLAIN)
        near = np.cumsum(np.concatenate([np.zeros(1, np.int64), odd]))
        at, far = np.arange(len(shapes)), reach + AROUND
        open_ &= near[np.minimum(at + far + 1, len(shapes))] > near[np.maximum(at - far, 0)]
    steps = np.diff(np.concatenate([[0], open_.astype(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def viterbi(field: Field, shapes: np.ndarray) -> np.ndarray:
    """The best state of each token; all stretches step by step together, longest first."""
    out = np.zeros(len(shapes), np.int8)
    first, last = stretches(shapes, field.reach)
    if not len(first):
        return out
    length = last - first
    order = np.argsort(-length, kind="stable")
    first, last, length = first[order], last[order], length[order]
    edges = np.full(AROUND, _SHAPE["edge"], shapes.dtype)
    padded = np.concatenate([edges, shapes, edges])
    # what lies beyond a line's end isn't seen from inside it
    ends_line = (last == len(shapes)) | (shapes[np.minimum(last, len(shapes) - 1)] == _SHAPE["edge"])
    best: np.ndarray | None = None
    came: list[np.ndarray] = []
    live = np.searchsorted(-length, -np.arange(length[0]), side="left")  # stretches longer than t
    for t in range(int(length[0])):
        at = first[: live[t]] + t
        own = _own_scores(field, padded, at)
        if best is None:
            best = field.move[0] + own
            came.append(np.zeros((len(at), 0), np.int8))
            continue
        ways = best[: len(at), :, None] + field.move
        came.append(ways.argmax(1).astype(np.int8))
        best[: len(at)] = ways.max(1) + own
    best = best + np.where(ends_line[:, None], 0.0, field.move[:, 0])
    state = best.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        n = live[t]
        out[first[:n] + t] = state[:n]
        if t:
            state[:n] = came[t][np.arange(n), state[:n]]
    return out


def _own_scores(field: Field, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of the tokens at; shapes beyond a line's end are edges."""
    own = field.emit[AROUND][padded[at + AROUND]]
    for way in (-1, 1):
        edge = np.zeros(len(at), bool)
        for d in range(1, AROUND + 1):
            shape = padded[at + AROUND + way * d]
            edge |= shape == _SHAPE["edge"]
            own = own + field.emit[AROUND + way * d][np.where(edge, _SHAPE["edge"], shape)]
    return own


def field_spans(field: Field, text: str, taken: list[tuple[int, int]] = ()) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the field's spans, by start; pieces that are taken
    end a sequence, as lines do."""
    starts, ends, shapes = tokens(text, taken)
    states = viterbi(field, shapes)
    found, i = [], 0
    for i in np.flatnonzero(states % 2 == 1):
        kind, j = states[i] // 2, i + 1
        while j < len(states) and states[j] == states[i] + 1:
            j += 1
        found.append((KINDS.index(LEARNT[kind]), int(starts[i]), int(ends[j - 1])))
    return found


def spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """(kind's number, start, end, base) for each text, by kind, then start: all base spans,
    and what the field finds between them. Texts are decoded together, as lines of one."""
    base = [base_spans(t) for t in texts]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    taken = [(a + int(o), b + int(o)) for own, o in zip(base, offsets, strict=False) for _, a, b in own]
    out = [[(*s, True) for s in own] for own in base]
    for k, a, b in field_spans(field, "\n".join(texts), taken):
        i = int(np.searchsorted(offsets, a, side="right")) - 1
        out[i].append((k, a - int(offsets[i]), b - int(offsets[i]), False))
    return [sorted(x) for x in out]


@lru_cache(maxsize=4)
def trained(lines: tuple[str, ...] = tuple(LINES)) -> Field:
    return train(list(lines))


#: Characters that are decoded together; a longer text is alone.
TOGETHER = 400_000


def find_personal_data(docs: DataFrame, text: str = "text", field: Field | None = None, name: str = "spans") -> DataFrame:
    """docs with spans(kind, start, end, base), code points of the whole text, end exclusive."""
    field = field or trained()
    kept = [f for f in docs.schema.fields if f.name != name]
    frame = docs.select(*[f"`{f.name}`" for f in kept], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*kept, T.StructField(name, SPAN, False)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held, size = [], [], 0
            for t in batch.column(len(kept)):
                held.append(t.as_py() or "")
                size += len(held[-1]) + 1
                if size >= TOGETHER:
                    found += spans(field, held)
                    held, size = [], 0
            found += spans(field, held) if held else []
            flat = [s for row in found for s in row]
            struct = pa.StructArray.from_arrays([pa.array([KINDS[s[0]] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int64()), pa.array([s[2] for s in flat], pa.int64()), pa.array([s[3] for s in flat], pa.bool_())], fields=list(arrow.field(len(kept)).type.value_type))
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            column = pa.ListArray.from_arrays(offsets, struct).cast(arrow.field(len(kept)).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], column], schema=arrow)
        release()

    return text_batches(frame).mapInArrow(run, schema)


def joined(spans: Column, base: bool = False) -> Column:
    """kind:start:end of all spans, or of the base ones, comma-joined."""
    chosen = F.filter(spans, lambda s: s["base"]) if base else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_personal_data(docs: DataFrame, text: str = "text", field: Field | None = None, name: str = "masked") -> DataFrame:
    """docs with masked: the text with <kind> in place of each span. Of spans that overlap the
    first to start counts, the longer on ties, and what others cover beyond it goes too.
    Empty for a null."""
    found = find_personal_data(docs.drop(name), text, field, "_spans")
    order = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"], (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def add(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], whole.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], -s["end"]).alias("at"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], whole.substr((acc["at"] + 1).cast("int"), F.length(whole)))

    return found.withColumn(name, F.aggregate(order, start, add, rest)).drop("_spans")
