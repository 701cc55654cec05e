"""Chat formatting by columnar byte assembly.

A conversation becomes one string::

    ### <role>: <text></turn>\\n   for each turn

``\\``, ``#`` and ``<`` inside texts (and ``:`` inside roles) are written as
``\\\\``, ``\\h``, ``\\l`` and ``\\c``, so neither ``###`` nor ``</turn>`` can occur
in a text and the string reads back exactly.

For a batch of conversations the lengths of all segments are computed first;
their cumulative sums are the offsets; headers and contents are then copied
by index arrays into one preallocated buffer, which becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.llm.tables import small_batches

HEAD, MIDDLE, END = b"### ", b": ", b"</turn>\n"
#: What stands for the byte behind a backslash.
ESCAPES = {b"\\": b"\\", b"#": b"h", b"<": b"l", b":": b"c"}
_BACK = {v: k for k, v in ESCAPES.items()}
FORMATTED = "conv_id bigint, formatted string, loss_spans array<struct<start:int,end:int>>"
_CODES = np.zeros(256, np.uint8)
for _byte in b"\\", b"#", b"<":
    _CODES[_byte[0]] = ESCAPES[_byte][0]


def _gather(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i] + lengths[i]`` of all i, in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)


def assemble(sizes: np.ndarray, roles: pa.Array, contents: pa.Array, loss_role: str = "assistant"):
    """Formatted strings of conversations with ``sizes`` turns each, and their loss spans."""
    roles = roles.fill_null("")
    coded = roles.dictionary_encode()
    names = [name.encode() for name in coded.dictionary.to_pylist()]
    heads = [HEAD + re.sub(rb"[\\#<:]", lambda m: b"\\" + ESCAPES[m[0]], name) + MIDDLE for name in names]
    pool = np.frombuffer(b"".join(heads) + END, np.uint8)
    head_size = np.array([len(h) for h in heads], np.int64)
    head_from = np.cumsum(head_size) - head_size
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    at, data = _bytes_of(contents)
    special = _CODES[data] > 0
    before = np.concatenate([[0], np.cumsum(special)])
    content_size = np.diff(at) + before[at[1:]] - before[at[:-1]]
    head = head_size[code] if len(code) else np.zeros(0, np.int64)
    turn_size = head + content_size + len(END)
    turn_end = np.cumsum(turn_size)
    turn_from = turn_end - turn_size

    out = np.empty(int(turn_end[-1]) if len(turn_end) else 0, np.uint8)
    out[_gather(head, turn_from)] = pool[_gather(head, head_from[code] if len(code) else head)]
    put = np.repeat(turn_from + head - before[at[:-1]] - at[:-1], np.diff(at)) + np.arange(len(data)) + before[:-1]
    out[put] = np.where(special, np.uint8(92), data)
    out[put[special] + 1] = _CODES[data[special]]
    tail = np.full(len(turn_size), len(END), np.int64)
    out[_gather(tail, turn_end - len(END))] = pool[_gather(tail, np.full(len(tail), len(pool) - len(END)))]

    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ends = np.concatenate([[0], turn_end])[edges]
    strings = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out)])
    base = np.repeat(ends[:-1], sizes)
    mine = np.array([n == loss_role.encode() for n in names], bool)[code] if len(code) else np.zeros(0, bool)
    start, end = (turn_from + head - base)[mine], (turn_end - len(END) - base)[mine]
    kept = np.concatenate([[0], np.cumsum(mine)])[edges].astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"])
    return strings.cast(pa.string()), pa.ListArray.from_arrays(pa.array(kept, pa.int32()), spans)


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans`` (byte offsets).

    Turns stand in the order of (turn, role, text), so ties and repeated rows
    have one defined place each and all are kept. Null texts and roles count
    as empty; rows without a conv_id form one conversation of their own. An
    empty table gives an empty result. A conversation is one output string and
    so has to fit into a task; other columns are ignored.
    """
    small_batches(conversations.sparkSession)
    turns = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t")
    ).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, contents = batch.column(1), batch.column(2)
            sizes = roles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            strings, spans = assemble(sizes, roles.flatten(), contents.flatten(), loss_role)
            yield pa.RecordBatch.from_arrays([batch.column(0), strings, spans], ["conv_id", "formatted", "loss_spans"])

    return turns.mapInArrow(run, FORMATTED)


def unescape(data: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: _BACK[m[1]], data, flags=re.S) if b"\\" in data else data


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) pairs of a formatted conversation."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn[len(HEAD):].partition(MIDDLE)
        out.append((unescape(role), unescape(text)))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the strings and spans alone."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                turns = parse(data)
                whole = hashlib.sha256()
                for role, content in turns:
                    whole.update(role + b"\n" + content + b"\n")
                loss = b"".join(unescape(data[s["start"] : s["end"]]) for s in spans)
                rows.append((conv, len(turns), whole.hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(text)))
            names = [part.split()[0] for part in schema.split(", ")]
            yield pa.RecordBatch.from_pydict(
                {n: pa.array(v, pa.string() if "sha" in n else pa.int64()) for n, v in zip(names, zip(*rows, strict=True) if rows else [[]] * 6, strict=True)}
            )

    return formatted.mapInArrow(run, schema)
