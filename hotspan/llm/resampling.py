"""Importance resampling of documents towards a target text, by hashed n-grams.

Words are runs of digits, letters and characters beyond ASCII, with A-Z in
lower case; features are single words and pairs of neighbouring words, hashed
by crc32 into buckets. A bucket's gain is the logarithm of its share in the
target over its share in the documents; a document's weight is the mean gain
of its features. The draw adds a Gumbel number made from a hash of the
document's id, and takes the highest scores: sampling without replacement,
the same in every run.

* **Segments.** Newlines cut texts into lines, and words never hold one. The
  features inside a line are computed once for every distinct line of a group
  of texts and counted as often as the line occurs; the pairs across lines
  (the last word before and the first after a cut) are added apart. A text is
  never shuffled: the corpus counts are 10,000 numbers a task, merged by one
  aggregate, and the second pass adds gains instead of counts.
* **Bytes.** The crc32 of a pair is that of its words, shifted and joined, so
  a group's features need no loop over words.
* **Ranks** come from a range partitioning by score and one count for each
  partition, never from a window over all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.llm.tables import small_batches, texts
from hotspan.llm.words import groups
from hotspan.operators.ordered import ranked
from hotspan.session import stage_table

BUCKETS = 10_000
#: Bytes of texts whose lines are compared with each other; a longer text is a group alone.
GROUP_BYTES = 8 << 20
#: Words longer than this are hashed one by one, shorter ones side by side.
SHORT = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _byte_table() -> np.ndarray:
    """What one byte does to a crc32 register, by the reversed polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _byte_table()


def _shift_tables() -> np.ndarray:
    """``[n, i, b]``: byte ``i`` of a register, with value ``b``, after ``n`` zero bytes."""
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for n in range(SHORT):
        out[n + 1] = _TABLE[out[n] & 0xFF] ^ (out[n] >> 8)
    return out


_SHIFT = _shift_tables()


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after ``n <= SHORT`` zero bytes."""
    out = _SHIFT[n, 0, crc & 0xFF]
    for i in (1, 2, 3):
        out ^= _SHIFT[n, i, (crc >> np.uint32(8 * i)) & 0xFF]
    return out


@dataclass
class Lines:
    """Words of distinct lines: line ``i`` has the words ``first[i]:first[i + 1]``."""

    first: np.ndarray
    crc: np.ndarray
    spaced: np.ndarray  # crc32 of the word and one space
    sizes: np.ndarray
    data: np.ndarray
    starts: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """crc32 of ``left word + space + right word`` for word numbers."""
        size = self.sizes[right]
        out = _shifted(self.spaced[left], np.minimum(size, SHORT)) ^ self.crc[right]
        for i in np.flatnonzero(size > SHORT):
            out[i] = zlib.crc32(self.word(right[i]), int(self.spaced[left[i]]))
        return out


def words_of_lines(data: np.ndarray, at: np.ndarray) -> Lines:
    """Words and their checksums of the lines ``data[at[i]:at[i + 1]]``."""
    data = _LOWER[data]
    live = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    opens, closes = live.copy(), live.copy()
    if len(data):
        opens[1:] &= ~live[:-1] | edge[1:-1]
        closes[:-1] &= ~live[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    sizes = np.flatnonzero(closes) + 1 - starts
    order = np.argsort(-np.minimum(sizes, SHORT + 1), kind="stable")
    by_size, from_ = sizes[order], starts[order]
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for j in range(min(SHORT, int(by_size[0]) if len(by_size) else 0)):
        n = int(np.searchsorted(-by_size, -j, side="left"))  # words longer than j
        crc[:n] = _TABLE[(crc[:n] ^ data[from_[:n] + j]) & 0xFF] ^ (crc[:n] >> 8)
    out = np.empty(len(starts), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(sizes > SHORT):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes())
    open_ = ~out
    spaced = ~(_TABLE[(open_ ^ np.uint32(32)) & 0xFF] ^ (open_ >> np.uint32(8)))
    return Lines(np.searchsorted(starts, at), out, spaced, sizes, data, starts)


def line_features(column: pa.Array) -> tuple[Lines, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of a group of texts, those inside a line once for each distinct line.

    Gives the distinct lines, (distinct line, bucket) of their features, (text,
    distinct line) of all lines, and (text, bucket) of the pairs across lines.
    """
    cut = pc.split_pattern(column, "\n")
    text = np.repeat(np.arange(len(column)), cut.value_lengths().to_numpy(zero_copy_only=False))
    named = cut.flatten().dictionary_encode()
    code = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = named.dictionary.cast(pa.large_string())
    _, offsets, buffer = distinct.buffers()
    at = np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = np.frombuffer(buffer, np.uint8)[at[0] : at[-1]] if buffer else np.zeros(0, np.uint8)
    lines = words_of_lines(data, at - at[0])
    line = np.repeat(np.arange(len(distinct)), np.diff(lines.first))
    left = np.flatnonzero(line[1:] == line[:-1])
    inside = np.stack([np.concatenate([line, line[left]]), np.concatenate([lines.crc, lines.pairs(left, left + 1)]) % BUCKETS])
    spoken = np.flatnonzero(lines.first[code + 1] > lines.first[code])  # lines with a word
    before, after = spoken[:-1], spoken[1:]
    same = text[before] == text[after]
    before, after = before[same], after[same]
    across = lines.pairs(lines.first[code[before] + 1] - 1, lines.first[code[after]]) % BUCKETS
    return lines, inside, np.stack([text, code]), text[before], across.astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of successive groups of rows, over the borders of batches."""
    ids, columns, size = [], [], 0
    for batch in batches:
        column = batch.column(1).fill_null("").cast(pa.string())
        for first, last, data, _ in groups(column):
            if columns and size + len(data) > GROUP_BYTES:
                yield pa.concat_arrays(ids), pa.concat_arrays(columns)
                ids, columns, size = [], [], 0
            ids.append(batch.column(0).cast(pa.int64()).slice(first, last - first))
            columns.append(column.slice(first, last - first))
            size += len(data)
    if columns:
        yield pa.concat_arrays(ids), pa.concat_arrays(columns)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """``bucket, n``: features of all texts in each bucket that has any; only ``text`` is read.

    A task gives one row a bucket at most, so the shuffle is bounded by the
    buckets times the tasks.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, column in _grouped(batches):
            lines, inside, (_, code), _, across = line_features(column)
            often = np.bincount(code, minlength=len(lines.first) - 1)
            total += np.bincount(inside[1], often[inside[0]], BUCKETS).astype(np.int64)
            total += np.bincount(across, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["bucket", "n"])

    counted = texts(docs.select(F.lit(0).alias("doc_id"), "text")).mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame) -> list[int]:
    """The gain of every bucket: floor(1000 ln) of the smoothed ratio of shares."""
    source, aim = ({r["bucket"]: r["n"] for r in bucket_counts(t).collect()} for t in (docs, target))
    all_source, all_aim = sum(source.values()) + BUCKETS, sum(aim.values()) + BUCKETS
    return [
        math.floor(1000 * math.log(
            float(aim.get(b, 0) + 1) * float(all_source) / (float(source.get(b, 0) + 1) * float(all_aim))))
        for b in range(BUCKETS)
    ]


def weighted(docs: DataFrame, gains: list[int]) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain of a text's features."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_words", "n_features", "weight"]
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for ids, column in _grouped(batches):
            lines, inside, (text, code), text_across, across = line_features(column)
            n, n_lines = len(ids), len(lines.first) - 1

            def over_texts(of_lines: np.ndarray) -> np.ndarray:
                return np.bincount(text, of_lines[code], n).astype(np.int64)

            total = over_texts(np.bincount(inside[0], gain[inside[1]], n_lines).astype(np.int64))
            total += np.bincount(text_across, gain[across], n).astype(np.int64)
            features = over_texts(np.bincount(inside[0], minlength=n_lines)) + np.bincount(text_across, minlength=n)
            words = over_texts(np.diff(lines.first))
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, features, weight))], names)

    return texts(docs).mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 x) of a Gumbel number made from the first 32 bits of sha256(``seed:doc_id``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``.

    Of the N rows with at least ``least_words`` words, floor(percent N / 100)
    with the highest scores are drawn and have ranks 1, 2, 3 ...; ties go to
    the smaller doc_id (a null one last), then to fewer features. Texts are
    whole; a null or empty one has no features and weight 0. Repeated rows are
    counted and drawn each, with ranks of their own. A null doc_id has the
    hash of an empty one. Without rows in ``target`` its shares are even;
    other columns are ignored in both tables. A very long text is a group
    alone and takes memory in proportion to its length.
    """
    scored = weighted(docs, bucket_gains(docs, target)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = stage_table(scored, "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    place = ranked(able, order, "rank")
    return place.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(
        scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
