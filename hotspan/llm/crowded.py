"""Which keys are crowded: a count sketch of fixed size over all keys.

Every task counts its keys in 2^bits buckets; the counts are summed block by
block. A bucket is crowded if its count is far above the mean. The sketch
decides only how a key is handled (split or not, earlier or later in an
order), never whether: results do not depend on it. The driver receives one
byte per bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.session import stage_table

BITS = 20
BLOCK = 1 << 14
PART = "block int, counts binary"
#: The least level of a crowded bucket.
CROWDED = 64


def level(counts: np.ndarray, mean: float) -> np.ndarray:
    """Levels of bucket counts; chance alone does not lift a bucket off level 0."""
    noise = mean**0.5
    over = counts - mean
    out = np.where(over > 4 * noise + 3, 1 + np.log2(np.maximum(over, 1)).astype(np.int64).clip(0, CROWDED - 2), 0)
    return np.where(over > 8 * noise + 50, np.maximum(out + CROWDED - 1, CROWDED), out).astype(np.uint8)


class Sketch:
    """Counts of one task."""

    def __init__(self, bits: int = BITS) -> None:
        self.counts, self.mask = np.zeros(1 << bits, np.int64), np.uint64((1 << bits) - 1)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append((keys & self.mask).astype(np.int64))
        self.size += len(keys)
        if self.size >= len(self.counts):
            self._count()

    def _count(self) -> None:
        if self.waiting:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=len(self.counts))
        self.waiting, self.size = [], 0

    def parts(self) -> Iterator[tuple[int, bytes]]:
        self._count()
        for block, counts in enumerate(self.counts.reshape(-1, min(BLOCK, len(self.counts)))):
            if counts.any():
                yield block, zlib.compress(counts.tobytes(), 1)


def bucket_levels(parts: DataFrame, bits: int = BITS) -> np.ndarray:
    """A level for every bucket, from the ``(block, counts)`` rows of all tasks.

    0 is a bucket like most; above it, the level is the logarithm of what its
    count exceeds the mean by. From ``CROWDED`` on a bucket is crowded.
    """
    size = min(BLOCK, 1 << bits)

    def add(block: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.int64)
        for counts in block["counts"]:
            total += np.frombuffer(zlib.decompress(counts), np.int64)
        packed = zlib.compress(total.tobytes(), 1)
        return pd.DataFrame({"block": [int(block["block"].iloc[0])], "n": [int(total.sum())], "counts": [packed]})

    # First sums of a few parts each, so that no task gathers the counts of all tasks.
    schema = "block int, n bigint, counts binary"
    few = parts.withColumn("few", F.pmod(F.xxhash64("counts"), F.lit(16)))
    rows = few.groupBy("block", "few").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    staged = stage_table(rows, "sketch")
    mean = sum(r["n"] for r in staged.select("n").collect()) / (1 << bits)
    found = np.zeros(1 << bits, np.uint8)

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = [level(np.frombuffer(zlib.decompress(c.as_py()), np.int64), mean) for c in batch.column("counts")]
            packed = pa.array([zlib.compress(x.tobytes(), 1) for x in levels], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("block"), packed], ["block", "levels"])

    for r in staged.mapInArrow(hot, "block int, levels binary").collect():
        found[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return found
