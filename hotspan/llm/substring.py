"""Substring dedup by seed and extend.

A window is ``window`` consecutive words. Winnowing picks in each window the
anchor (``anchor`` words) with the least hash, so equal windows have equal
anchors at equal places. Then:

1. Documents are joined on anchors. The first place of an anchor (in the order
   of documents and words) is the one the others are compared with: one row
   for each place, never all pairs.
2. Each place carries a hash of its anchor with the ``window - anchor`` words
   on both sides. If it equals the first place's, the match extends that far
   both ways; longer matches continue in the next anchor's seed.
3. Where the words differ, the extension ends somewhere inside. There, and
   only there, the single windows of the anchor are compared, by 128-bit
   hashes, with those of the anchor's other places that differ.
4. The union of what was matched gives the maximal repeats, all of at least
   ``window`` words; every window that also starts earlier is in one.

Crowded anchors (found by a count sketch) are aggregated before they are
shuffled and joined over salted keys; all others are grouped once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspan.llm.crowded import CROWDED, PART, Sketch, bucket_levels
from hotspan.llm.tables import small_batches, texts
from hotspan.llm.words import Words, grams, groups, signed, words_of
from hotspan.session import stage_table

#: A place is the number of a word in its text, above it 22 bits of the text's
#: checksum, which tell apart different texts of one doc_id.
PLACE_BITS = 40
SALTS = 32


@dataclass(frozen=True)
class SubstringConfig:
    window: int = 20
    anchor: int = 8

    @property
    def side(self) -> int:
        return self.window - self.anchor


@dataclass
class Marked:
    """Words of a group of texts, laid out with ``side`` blanks between texts."""

    words: Words
    shift: np.ndarray  # of each text, from word numbers to places in the layout
    hashes: np.ndarray
    windows: np.ndarray  # layout places of all windows
    anchors: np.ndarray  # layout place of each window's anchor
    grams: np.ndarray
    tags: list[int]
    first: np.ndarray

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1


def lay_out(data: np.ndarray, at: np.ndarray, config: SubstringConfig) -> Marked:
    """The words in their layout, without windows."""
    words = words_of(data, at, lower=False)
    count = np.diff(words.first)
    shift = config.side * (np.arange(len(count)) + 1)
    hashes = np.zeros(len(words.hashes) + config.side * (len(count) + 1), np.uint64)
    hashes[np.arange(len(words.hashes)) + np.repeat(shift, count)] = words.hashes
    tags = [zlib.crc32(data[a:b].tobytes()) & ((1 << 22) - 1) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    none = np.zeros(0, np.int64)
    return Marked(words, shift, hashes, none, none, none, tags, words.first[:-1] + shift)


def mark(data: np.ndarray, at: np.ndarray, config: SubstringConfig) -> Marked:
    """The words in their layout, with all windows and their anchors."""
    out = lay_out(data, at, config)
    out.grams = grams(out.hashes, config.anchor)
    spare = np.maximum(np.diff(out.words.first) - config.window + 1, 0)
    ends = np.cumsum(spare)
    out.windows = out.anchors = np.arange(ends[-1] if len(ends) else 0) + np.repeat(out.first - (ends - spare), spare)
    if len(out.windows):
        view = np.lib.stride_tricks.sliding_window_view(out.grams, config.side + 1)
        out.anchors = out.windows + view.argmin(axis=1)[out.windows]
    return out


def _sketch(docs: DataFrame, config: SubstringConfig) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for batch in batches:
            for _, _, data, at in groups(batch.column(1)):
                m = mark(data, at, config)
                sketch.add(m.grams[np.unique(m.anchors)])
        parts = list(sketch.parts())
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], ["block", "counts"])

    return docs.mapInArrow(run, PART)


def _seeds(docs: DataFrame, crowded: np.ndarray, config: SubstringConfig) -> DataFrame:
    """``anchor, doc_id, place, around, hot`` of every anchor of every text."""
    packed, mask = np.packbits(crowded), np.uint64(len(crowded) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(packed).astype(bool)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, data, at in groups(batch.column(1)):
                m = mark(data, at, config)
                places = np.unique(m.anchors)
                around = grams(m.hashes, 2 * config.side + config.anchor, seed=3)[places - config.side]
                text = m.text_of(places)
                keys = m.grams[places]
                tags = np.array(m.tags, np.int64)[text] << PLACE_BITS
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(keys)), pa.array(ids[low:high][text].astype(np.int64)), pa.array(tags | (places - m.first[text])),
                    pa.array(signed(around)), pa.array(hot[(keys & mask).astype(np.int64)])],
                    ["anchor", "doc_id", "place", "around", "hot"])

    return docs.mapInArrow(run, "anchor bigint, doc_id bigint, place bigint, around bigint, hot boolean")


def with_first(df: DataFrame, keys: list[str], around: Column) -> DataFrame:
    """Add the first ``(doc_id, place)`` of each key, its ``around``, and whether those of the key differ.

    Keys with one row are left out. Rows with ``hot`` are aggregated first and
    joined over salted keys; the others meet in one group for each key.
    """
    df = df.withColumn("_around", around)
    first, low, high = F.min(F.struct("doc_id", "place", "_around")), F.min("_around"), F.max("_around")
    group = Window.partitionBy(*keys)
    cold = df.where("not hot").withColumns(
        {"first": first.over(group), "low": low.over(group), "high": high.over(group), "size": F.count("*").over(group)}
    ).where("size > 1")
    hot = stage_table(df.where("hot"), "crowded").withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int"))
    total = hot.groupBy(*keys).agg(first.alias("first"), low.alias("low"), high.alias("high"), F.count("*").alias("size"))
    copies = stage_table(total.where("size > 1"), "first").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = cold.unionByName(hot.join(copies, [*keys, "salt"]).drop("salt"))
    return out.withColumns({
        "is_first": (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.place") == F.col("place")),
        "same": F.col("first._around") == F.col("_around"),
        "differ": F.col("low") != F.col("high"),
    })


#: What a code says of its place: it is an anchor whose surroundings match, or a window's start.
ANCHOR, WINDOW = 0, 1


def _codes(places: DataFrame) -> DataFrame:
    """``doc_id, codes``: a document's places, doubled, plus their kind."""
    return places.groupBy("doc_id").agg(F.collect_list(F.col("place") * 2 + F.col("kind")).alias("codes"))


def _own(codes: list[int] | None, tag: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Layout places of the codes with this text's tag, and their kinds."""
    codes = np.array(codes or [], np.int64)
    codes = codes[codes >> (PLACE_BITS + 1) == tag]
    return ((codes >> 1) & ((1 << PLACE_BITS) - 1)) + first, codes & 1


def _windows(docs: DataFrame, codes: DataFrame, crowded: np.ndarray, config: SubstringConfig) -> DataFrame:
    """Hashes of the windows whose anchor's surroundings differ somewhere, unless another seed covers them."""
    packed, mask = np.packbits(crowded), np.uint64(len(crowded) - 1)
    names = ["h1", "h2", "doc_id", "place", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(packed).astype(bool)
        for batch in batches:
            ids, listed = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            for low, high, data, at in groups(batch.column(1)):
                m = mark(data, at, config)
                open_anchor, matched = np.zeros(len(m.hashes) + 1, bool), np.zeros(len(m.hashes) + 1, np.int64)
                for i in range(high - low):
                    places, kinds = _own(listed[low + i], m.tags[i], int(m.first[i]))
                    open_anchor[places[kinds == WINDOW]] = True
                    matched[places[kinds == ANCHOR] + 1] = 1
                sums = np.cumsum(matched)
                pick = open_anchor[m.anchors] & (sums[m.windows + config.side + 1] == sums[m.windows])
                windows, anchors = m.windows[pick], m.anchors[pick]
                text = m.text_of(windows)
                tags = np.array(m.tags, np.int64)[text] << PLACE_BITS
                hashes = [signed(grams(m.hashes, config.window, seed)[windows]) for seed in (5, 7)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes[0]), pa.array(hashes[1]), pa.array(ids[low:high][text].astype(np.int64)),
                    pa.array(tags | (windows - m.first[text])), pa.array(hot[(m.grams[anchors] & mask).astype(np.int64)])], names)

    joined = docs.join(codes.where(F.exists("codes", lambda c: c % 2 == WINDOW)), "doc_id").select("doc_id", "text", "codes")
    return joined.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, place bigint, hot boolean")


def _gathered(m: Marked, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words, each with a blank behind it, and the end of every text in them."""
    size = np.where(keep, m.words.ends - m.words.starts + 1, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(ends[-1]), 0x20, np.uint8)
    lengths = np.maximum(size - 1, 0)
    total = np.cumsum(lengths)
    step = np.arange(total[-1] if len(total) else 0) - np.repeat(total - lengths, lengths)
    out[step + np.repeat(ends[:-1], lengths)] = m.words.data[step + np.repeat(m.words.starts, lengths)]
    return out, ends[m.words.first]


def _kept(docs: DataFrame, codes: DataFrame, config: SubstringConfig) -> DataFrame:
    """``doc_id, n_words, spans, kept`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(2).to_pylist()
            for low, high, data, at in groups(batch.column(1)):
                m = lay_out(data, at, config)
                cover = np.zeros(len(m.hashes) + 1, np.int64)
                for i in range(high - low):
                    if not listed[low + i]:
                        continue
                    places, kinds = _own(listed[low + i], m.tags[i], int(m.first[i]))
                    end = int(m.first[i]) + int(m.words.first[i + 1] - m.words.first[i])
                    starts = np.maximum(places - np.where(kinds == ANCHOR, config.side, 0), m.first[i])
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, np.minimum(places + config.window, end), -1)
                inside = np.cumsum(cover) > 0
                count = np.diff(m.words.first)
                removed = inside[np.arange(len(m.words.hashes)) + np.repeat(m.shift, count)]
                out, ends = _gathered(m, ~removed)
                sums = np.concatenate([[0], np.cumsum(removed)])[m.words.first]
                kept = [out[a : max(a, b - 1)].tobytes().decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                spans = []
                for i in range(high - low):
                    flags = np.diff(np.concatenate([[0], removed[m.words.first[i] : m.words.first[i + 1]].view(np.int8), [0]]))
                    spans.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(flags == 1).tolist(), np.flatnonzero(flags == -1).tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), pa.array(count.astype(np.int64)), pa.array(np.diff(sums).astype(np.int64)),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "spans", "kept"])

    joined = docs.join(codes, "doc_id", "left").select("doc_id", "text", "codes")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept string")


def remove_repeats(docs: DataFrame, config: SubstringConfig | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` for every row of ``docs``.

    ``spans`` are the maximal repeats as word numbers, ends exclusive: the
    words covered by windows that also start earlier, in a smaller doc_id or
    earlier in the same document. ``kept`` joins the other words by blanks.
    A null, empty or blank text has no words. Rows that repeat a doc_id with
    its text are one document and get the same result; different texts of one
    doc_id are ordered by a checksum. Rows without a doc_id have no order, so
    they are returned whole and repeat nothing. Other columns are ignored.
    """
    config = config or SubstringConfig()
    docs = texts(docs)
    small_batches(docs.sparkSession)
    known = docs.where("doc_id is not null")
    crowded = bucket_levels(_sketch(known, config)) >= CROWDED
    seeds = with_first(_seeds(known, crowded, config), ["anchor"], F.col("around"))
    # The first place differs from no other, so only its windows matter; an equal other place is matched.
    kind = F.when(F.col("is_first"), F.when(F.col("differ"), WINDOW)).otherwise(F.when(F.col("same"), ANCHOR).otherwise(WINDOW))
    places = stage_table(_codes(seeds.withColumn("kind", kind).where("kind is not null").select("doc_id", "place", "kind")), "seeds")
    windows = with_first(_windows(known, places, crowded, config), ["h1", "h2"], F.lit(0).cast("bigint"))
    again = windows.where("not is_first").select("doc_id", (F.col("place") * 2 + WINDOW).alias("code"))
    matched = places.select("doc_id", F.explode(F.filter("codes", lambda c: c % 2 == ANCHOR)).alias("code"))
    codes = matched.unionByName(again).groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
    return _kept(docs, stage_table(codes, "codes"), config)
