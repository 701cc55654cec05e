"""Secret scans with one automaton for all rules.

Short forms of all rules are compiled into one minimal automaton that accepts
wherever one occurs. A batch of texts is cut at the bytes that lead back to the
start from every state, so the pieces are independent, and the automaton steps
through all pieces side by side: one pass over the bytes, whatever the number
of rules. Pieces in which it accepted are few. Those are read once from their
end by the joint automaton of the whole rules, which accepts wherever a match
of a rule begins; from the leftmost beginnings each match is followed to its
end. So no byte is a start in vain, and the work is linear in the piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.llm.automaton import compile_rules
from hotspan.llm.tables import small_batches, texts


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret: ``match`` finds it, ``head`` is what stands before the secret itself.

    A match counts if the part behind its head has ``least`` characters;
    ``spot`` is an expression that occurs in every match that counts: a short
    one keeps the common automaton small.
    """

    kind: str
    match: str
    spot: str
    least: int
    head: str = ""
    ignore_case: bool = False


_WORD = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=-]"
BASE = (
    SecretRule("assign", f"{_WORD}{_VALUE}+", f"{_WORD}{_VALUE}", 8, _WORD, True),
    SecretRule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", 16),
    SecretRule("hex", "[0-9a-f]+", "[0-9a-f]{32,}", 32),
)
MORE = (
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_", 24),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-", 15),
    SecretRule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", "eyJ[A-Za-z0-9_-]", 20),
    SecretRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN ", 1),
)
#: Bytes that are scanned together.
BLOCK_BYTES = 4 << 20
#: With fewer pieces than this the rest of each is stepped through alone.
FEW = 16


class Scanner:
    """The compiled rules; small, and the same for every task."""

    def __init__(self, rules: tuple[SecretRule, ...]) -> None:
        self.rules = rules
        self.spot = compile_rules([(r.spot, r.ignore_case) for r in rules])
        self.begins = compile_rules([(r.match, r.ignore_case) for r in rules], backward=True)
        self.single = [compile_rules([(r.match, r.ignore_case)], anchored=True) for r in rules]
        self.heads = [compile_rules([(r.head, r.ignore_case)], anchored=True) if r.head else None for r in rules]
        self.resets, self.least = self.spot.resets, self.spot.shortest()

    def pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces in which the automaton accepts. ``at``: offsets of the texts."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        live = ~self.resets[data]
        opens, closes = live.copy(), live.copy()
        opens[1:] &= ~live[:-1]
        closes[:-1] &= ~live[1:]
        edges = at[(at > 0) & (at < len(data))]
        opens[edges] = live[edges]
        closes[edges - 1] = live[edges - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        long = ends - starts >= self.least
        starts, ends = starts[long], ends[long]
        order = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[order], ends[order]
        size = ends - starts
        grouped = self.spot.group[data]
        width = self.spot.table.shape[1]
        steps, accepting = (self.spot.table * width).ravel(), np.repeat(self.spot.accepts > 0, width)
        state, hit = np.zeros(len(starts), np.int32), np.zeros(len(starts), bool)
        negative, t, count = -size, 0, len(starts)
        while count > FEW:
            state[:count] = steps[state[:count] + grouped[starts[:count] + t]]
            hit[:count] |= accepting[state[:count]]
            t += 1
            count = int(np.searchsorted(negative, -t, side="left"))
        rows, accepts = self.spot.rows, self.spot.accepting
        for i in range(count):
            now = int(state[i]) // width
            for byte in data[starts[i] + t : ends[i]].tobytes():
                now = rows[now][byte]
                if accepts[now]:
                    hit[i] = True
                    break
        keep = np.sort(np.flatnonzero(hit))
        return starts[keep], ends[keep]

    def matches(self, piece: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) of the leftmost non-overlapping matches that count."""
        out = []
        begins = np.array(self.begins.marks(piece), np.int64)
        for k, (rule, single, head) in enumerate(zip(self.rules, self.single, self.heads, strict=True)):
            free = 0
            for at in np.flatnonzero(begins >> k & 1).tolist():
                if at < free:
                    continue
                free = single.longest(piece, at)
                begin = head.longest(piece, at) if head else at
                if free - begin >= rule.least:
                    out.append((k, at, free))
        return out

    def scan(self, data: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Spans (rule, start, end in code points) by number of the text."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        starts, ends = self.pieces(data, at)
        owner = np.searchsorted(at, starts, side="right") - 1
        for doc, start, end in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
            spans = self.matches(data[start:end].tobytes())
            if spans:  # a piece is ASCII, so only what is before it counts
                before = int(np.count_nonzero((data[at[doc] : start] & 0xC0) != 0x80))
                found.setdefault(doc, []).extend((k, before + a, before + b) for k, a, b in spans)
        return found


SPANS = "doc_id bigint, kinds array<string>, starts array<int>, ends array<int>"


def spans_of(scanner: Scanner, column: pa.Array) -> list[list[tuple[int, int, int]]]:
    """(rule, start, end) of the secrets of each text, in the order of (start, rule)."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, buffer = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES, side="right")) - 1)
        part = at[first : last + 1]
        for doc, rows in scanner.scan(data[part[0] : part[-1]], part - part[0]).items():
            spans[first + doc] = sorted(rows, key=lambda r: (r[1], r[0]))
        first = last
    return spans


def scan_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE + MORE) -> DataFrame:
    """``doc_id`` and the spans of its secrets, in the order of (start, rule).

    One row per input row; a text without secrets, a null or an empty one has
    empty lists. Offsets are code points, ends exclusive. A null doc_id stays
    null; other columns are ignored. No shuffle.
    """
    small_batches(docs.sparkSession)
    scanner, kinds = Scanner(rules), [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = spans_of(scanner, batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([[kinds[k] for k, _, _ in s] for s in spans], pa.list_(pa.string())),
                pa.array([[a for _, a, _ in s] for s in spans], pa.list_(pa.int32())),
                pa.array([[b for _, _, b in s] for s in spans], pa.list_(pa.int32())),
            ], ["doc_id", "kinds", "starts", "ends"])

    return texts(docs).mapInArrow(run, SPANS)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with ``mark`` in place of each stretch that spans cover."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE + MORE, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; overlapping spans by one mark.

    Rows and all other columns stay; ``n_chars``, if there is one, follows the
    text. A null text stays null. No shuffle.
    """
    small_batches(docs.sparkSession)
    scanner, at = Scanner(rules), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            spans = spans_of(scanner, column)
            if any(spans):
                clean = [redact(t, s, mark) if s else t for t, s in zip(column.to_pylist(), spans, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(clean, column.type))
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        size = F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", size)
    return out
