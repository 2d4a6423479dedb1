"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ncontent<|im_end|>\\n``.  Inside roles and texts
``<`` + k backslashes + ``|`` is written with one backslash more, so no text can
form a control string and unescaping is exact.  A batch of turns is assembled at
once: the lengths of header, content and trailer of every turn give cumulative
offsets; the three source buffers are copied into one preallocated Arrow buffer
through scatter indices computed in numpy (a long stretch is copied as it is).  Turns are assembled a few MB at a time, however long they are.  The loss mask of a turn is the byte
span of its content if the role is ``assistant``, else empty.

A conversation is the concatenation of its formatted turns in order, so turns are
formatted where they lie; nothing gathers a conversation.  ``read_back`` streams
sorted partitions and keeps only running digests, so a conversation of any
length needs constant memory.

Defined results: null text counts as empty, null role as an empty role; rows of
equal turn are ordered by role and text as formatted, null turns first; texts of any length are streamed; repeated rows are turns
of their own; a null conv_id is one conversation; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = r"<(\\*)\|", re.compile(r"<\\(\\*)\|")
_BYTES = 1 << 22  # of contents assembled together, and one turn at least
_LONG = 1 << 12  # bytes from which a stretch is copied as one slice


def escaped(col):
    return F.regexp_replace(col, _ESCAPE, r"<\\$1|")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each value, length of each value) of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at[:-1], np.diff(at)


def _spread(out: np.ndarray, to: np.ndarray, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy every stretch raw[start:start+length] to out[to:to+length] with one scatter, long ones by themselves."""
    for k in np.flatnonzero(length > _LONG).tolist():
        out[to[k]:to[k] + length[k]] = raw[start[k]:start[k] + length[k]]
    some = (length > 0) & (length <= _LONG)
    to, start, length = to[some], start[some], length[some]
    begin = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(begin, length)
    out[np.repeat(to, length) + within] = raw[np.repeat(start, length) + within]


def _slices(contents: pa.Array) -> Iterator[tuple[int, int]]:
    """(first turn, number) of stretches of turns of at most _BYTES, or one turn."""
    ends = np.cumsum(pc.binary_length(contents).to_numpy().astype(np.int64))
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _BYTES, side="right")))
        yield a, z - a
        a = z


def assemble(roles: pa.Array, contents: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(formatted turns, content start, content length), in bytes, of escaped roles and contents."""
    n = len(roles)
    head, tail = np.frombuffer(START.encode(), np.uint8), np.frombuffer(f"{END}\n".encode(), np.uint8)
    role, role_at, role_n = _raw(roles)
    text, text_at, text_n = _raw(contents)
    size = len(head) + role_n + 1 + text_n + len(tail)
    offsets = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(int(offsets[-1]), np.uint8)
    begin = offsets[:-1]
    body = len(head) + role_n + 1
    fixed = lambda seg, at: _spread(out, at, seg, np.zeros(n, np.int64), np.full(n, len(seg)))
    fixed(head, begin)
    _spread(out, begin + len(head), role, role_at, role_n)
    out[begin + body - 1] = 10
    _spread(out, begin + body, text, text_at, text_n)
    fixed(tail, begin + body + text_n)
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    return made, body, text_n


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_bytes): one row per turn, spans in bytes of ``formatted``."""
    part = lambda c: escaped(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    line_free = F.replace(F.replace(part(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    slim = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                        line_free.alias("role"), part(text).alias("content"))
    schema = slim.select("conv_id", "turn").schema.add("formatted", "string").add(
        "loss_start", "long").add("loss_bytes", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, n in _slices(whole.column(3)):
                b = whole.slice(a, n)
                made, start, length = assemble(b.column(2), b.column(3))
                trained = np.array(b.column(2).to_pylist(), object) == "assistant"
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), made.cast(pa.string()), pa.array(np.where(trained, start, 0)),
                     pa.array(np.where(trained, length, 0))], schema.names)

    return slim.mapInArrow(run, schema)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    head, _, body = formatted.removeprefix(START).partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head)
    return unescape(role), unescape(body[:-len(END) - 1])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, read from its formatted turns in order."""
    # ties in turn fall back to the formatted turn itself: role, then text
    sorted_ = (formatted.repartition("conv_id")
               .sortWithinPartitions("conv_id", "turn", "formatted"))
    schema = formatted.select("conv_id").schema
    for name, kind in (("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"),
                       ("loss_sha256", "string"), ("formatted_chars", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None

        def done() -> pa.RecordBatch:
            values = [key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], b_type) for v, b_type in zip(values, types)], schema.names)

        types: list[pa.DataType] = []
        for b in batches:
            types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for conv, text, at, n in zip(*(b.column(k) for k in (0, 2, 3, 4))):
                if state is None or conv.as_py() != key:
                    if state is not None:
                        yield done()
                    key, state = conv.as_py(), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                whole = text.as_py()
                role, said = parse_turn(whole)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                state[4] += len(whole)
                if n.as_py():
                    masked = unescape(whole.encode()[at.as_py():at.as_py() + n.as_py()].decode())
                    state[2] += len(masked)
                    state[3].update(masked.encode())
        if state is not None:
            yield done()

    return sorted_.mapInArrow(run, schema)
