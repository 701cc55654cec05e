"""Runs of repeated word sequences inside a text: seed and extend on diagonals.

A run is a stretch of words with smallest period q and at least
``max(least, repeats * q)`` words that cannot be made longer. Shifted by q it
agrees with itself over ``length - q`` words, so some k-gram of words occurs
twice, q words apart, for every k up to that overlap.

* **Seeds.** For k = 16, 32, 64, ... the k-grams of a text are named by exact
  ranks: a 2k-gram is a pair of k-gram ranks, so nothing rests on hashes. The
  lags of the class k are those up to k (above k / 2 after the first class):
  each such run overlaps itself by more than k words. A k-gram with k >= q
  recurs in a run of period q after exactly q words, hence only neighbouring
  occurrences are paired: as many pairs as positions, not their square.
* **Dead positions.** A 2k-gram can occur twice only where both of its halves
  do; other positions leave the next class, and most texts end in the first.
* **Extension.** A seed is followed to both sides along its diagonal. A table
  holds, for each lag, how far the diagonal is covered, so that a stretch is
  extended once, however many seeds lie in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.llm.tables import small_batches, texts

#: Bytes of texts that are indexed together; a longer text is indexed alone.
GROUP_BYTES = 4 << 20
#: Length of the shortest seeds.
SEED = 16
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string"


def _agree(codes: np.ndarray, at: int, lag: int, stop: int) -> int:
    """The first place from ``at`` on, or ``stop``, where the word ``lag`` further differs."""
    step = 64
    while at < stop:
        to = min(at + step, stop)
        differ = codes[at:to] != codes[at + lag : to + lag]
        if differ.any():
            return at + int(differ.argmax())
        at, step = to, min(2 * step, 1 << 16)
    return stop


def _agree_back(codes: np.ndarray, at: int, lag: int, first: int) -> int:
    """The first place of the agreeing stretch that ends before ``at``."""
    step = 64
    while at > first:
        low = max(at - step, first)
        differ = codes[low:at] != codes[low + lag : at + lag]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = low, min(2 * step, 1 << 16)
    return first


def _repeated(rank: np.ndarray, alive: np.ndarray, keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name equal keys at ``alive`` positions; give (earlier, later, positions of any pair).

    Pairs are neighbouring occurrences in the same text; ``rank`` is set at
    the positions that are in a pair and -1 elsewhere.
    """
    order = np.argsort(keys, kind="stable")
    sorted_keys, places = keys[order], alive[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (sorted_keys[1:] != sorted_keys[:-1]) | (text[places[1:]] != text[places[:-1]])
    twice = ~fresh
    paired = twice.copy()
    paired[:-1] |= twice[1:]
    rank.fill(-1)
    rank[places[paired]] = np.cumsum(fresh)[paired]
    later = np.flatnonzero(twice)
    return places[later - 1], places[later], np.sort(places[paired])


def runs_of(codes: np.ndarray, first: np.ndarray, least: int, repeats: int) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of all runs of each text, by start, then period.

    Text ``i`` has the word codes ``codes[first[i]:first[i + 1]]``.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rank = np.array(codes, np.int64)
    alive, k = np.arange(len(codes)), 1
    _, _, alive = _repeated(rank, alive, rank[alive], text)
    covered: dict[int, int] = {}
    while True:
        # The next class: both halves of the gram have to be alive, in one text.
        alive = alive[alive + k < len(codes)]
        other = alive + k
        alive = alive[(rank[other] >= 0) & (text[other] == text[alive])]
        if not len(alive):
            return [sorted(f) for f in found]
        keys = rank[alive] * (int(rank.max()) + 1) + rank[alive + k]
        early, late, alive = _repeated(rank, alive, keys, text)
        k *= 2
        if k < SEED:
            continue
        lags = late - early
        fits = (lags <= k) & (lags > (k // 2 if k > SEED else 0))
        order = np.argsort(early[fits], kind="stable")
        for at, lag in zip(early[fits][order].tolist(), lags[fits][order].tolist(), strict=True):
            if covered.get(lag, -1) > at:
                continue
            t = int(text[at])
            stop = _agree(codes, at + k, lag, int(first[t + 1]) - lag)
            start = _agree_back(codes, at, lag, int(first[t]))
            covered[lag] = stop
            length = stop - start + lag
            if length >= max(least, repeats * lag):
                found[t].append((start - int(first[t]), length, lag))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def _groups(column: list) -> Iterator[list[list[bytes]]]:
    """The words of successive texts, in groups of bounded size."""
    group, size = [], 0
    for text in column:
        data = (text or "").encode()
        if group and size + len(data) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(data.split())  # bytes are cut at 0x20 and 0x09-0x0D alone
        size += len(data)
    if group:
        yield group


def find_runs(docs: DataFrame, least: int = 24, repeats: int = 3) -> DataFrame:
    """``doc_id, n_words, runs, kept`` of every whole text, row by row.

    ``runs`` holds (start, length, period) in words, by start, then period;
    ``kept`` is the text without the repetitions, its words joined by one
    space. Null, empty and blank texts have no words, no runs and an empty
    ``kept``. Repeated rows are judged each; a null doc_id stays null; other
    columns are ignored. A very long text is a group alone: its work grows
    with n log n and its memory with n. No shuffle.

    Every run overlaps itself by at least ``SEED`` words only if ``least`` and
    ``repeats`` say so, therefore ``repeats`` is at least 3 and ``least`` 24.
    """
    if repeats < 3 or least < 24:
        raise ValueError("runs need at least 3 repeats and 24 words")
    small_batches(docs.sparkSession)
    from hotspan.llm.tables import _arrow

    schema = _arrow(docs.sparkSession, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for group in _groups(batch.column(1).to_pylist()):
                first = np.cumsum([0, *map(len, group)])
                codes, _ = pd.factorize(np.array([w for words in group for w in words], dtype=object))
                found = runs_of(codes.astype(np.int64), first, least, repeats)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(group)).cast(pa.int64()),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found], schema.field("runs").type),
                    pa.array([b" ".join(collapsed(w, r)).decode() for w, r in zip(group, found, strict=True)], schema.field("kept").type),
                ], schema=schema)
                at += len(group)

    return texts(docs).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with repetitions put into about every tenth text.

    With h the crc32 of the decimal doc_id, g = h div 10 and n words: where
    h % 10 = 0 and n > 0, each word from a = g % n on becomes the word
    a + (i - a) % p, with p = 1 + (n - a) div (3 + g % 8). A null doc_id
    leaves the text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.col("doc_id").isNotNull() & (h % 10 == 0)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    # Exploding one struct makes the words a value that is computed once.
    row = F.explode(F.array(F.struct(
        "doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(chosen, words).alias("w")))).alias("r")
    rows = texts(docs).select(row).select("r.*")
    n = F.size("w").cast("long")
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = F.expr("1 + (n - a) div (3 + g % 8)")
    rows = rows.withColumn("p", period)
    head = F.expr("slice(w, 1, cast(a as int))")
    # The tail is whole copies of one period and a part of it.
    piece = F.expr("slice(w, cast(a + 1 as int), cast(p as int))")
    tail = F.slice(F.flatten(F.array_repeat(piece, F.expr("cast((n - a) div p + 1 as int)"))), F.lit(1), F.expr("cast(n - a as int)"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


def run_report(found: DataFrame) -> DataFrame:
    """The rows of ``op11``: the run with the greatest length / period, and digests."""
    # Exponents are compared by cross multiplication: as fractions, not as doubles.
    better = lambda a, r: (r["length"] * a["period"] > a["length"] * r["period"]) | (
        (r["length"] * a["period"] == a["length"] * r["period"]) & (
            (r["start"] < a["start"]) | ((r["start"] == a["start"]) & (r["period"] < a["period"]))))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(better(a, r), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
