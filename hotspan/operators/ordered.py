"""Ordered running values in two levels.

A plain window over one sequence puts the whole sequence on one task. Here
the rows of a sequence are cut into blocks by a value derived from the row
itself. A window inside each block and a second one over the block totals
(one row per block) give the same running value, with no task that holds a
whole sequence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotspan.session import stage_table

_MERGE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: list[str],
    values: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Add running sum / max / min columns to ``df``.

    ``block`` must rise (or stay) when ``order`` rises within ``keys``.
    ``values`` maps a new column to (``sum`` | ``max`` | ``min``, input).
    With ``reverse`` the values run from the last row to the first.
    """
    def ordering(names: list[str]) -> list[Column]:
        return [F.col(n).desc() if reverse else F.col(n).asc() for n in names]

    last = 0 if inclusive else -1
    inner = (
        Window.partitionBy(*keys, block)
        .orderBy(*ordering(order))
        .rowsBetween(Window.unboundedPreceding, last)
    )
    outer = (
        Window.partitionBy(*keys).orderBy(*ordering([block])).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = df.groupBy(*keys, block).agg(
        *[_MERGE[kind][0](col).alias(f"_all_{name}") for name, (kind, col) in values.items()]
    )
    carried = totals.select(
        *keys,
        block,
        *[_MERGE[kind][0](f"_all_{name}").over(outer).alias(f"_carry_{name}")
          for name, (kind, _) in values.items()],
    )
    local = df.withColumns(
        {f"_here_{name}": _MERGE[kind][0](col).over(inner) for name, (kind, col) in values.items()}
    )
    return local.join(carried, [*keys, block]).select(
        *[F.col(c) for c in df.columns],
        *[_MERGE[kind][1](F.col(f"_here_{name}"), F.col(f"_carry_{name}")).alias(name)
          for name, (kind, _) in values.items()],
    )


#: Rows that one task sorts or groups, about.
ROWS_PER_TASK = 500_000


def tasks_for(rows: int, per_task: int = ROWS_PER_TASK) -> int:
    """How many tasks ``rows`` rows are dealt to, so that the memory of one task does not
    grow with the table; shuffles of a fixed number of partitions would let it."""
    return max(1, -(-rows // per_task))


def row_index(
    df: DataFrame, keys: list[str], block: str, order: list[str], name: str = "idx"
) -> DataFrame:
    """Add the 0-based position of each row within ``keys``."""
    out = running(df, keys, block, order, {name: ("sum", F.lit(1).cast("bigint"))})
    return out.withColumn(name, F.col(name) - 1)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based rank of every row in one global order.

    The rows are dealt out by ranges of ``order`` and sorted there, once; a
    rank is the place in the range plus the sizes of the ranges before it.
    The table is written in between, so that a lost task cannot deal equal
    rows out anew. Rows that are equal in ``order`` take ranks of their own;
    add a distinguishing column where they must be spread over tasks.
    """
    bits = 33  # monotonically_increasing_id holds the task above, the row below
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage_table(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, row = F.shiftright("_at", bits).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << bits) - 1))
    sizes = placed.groupBy(part).agg((F.max(row) + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(offsets, "_part").select(
        *[F.col(c) for c in df.columns], (F.col("_before") + row + 1).alias(name))


def range_sums(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add the sum of the whole-numbered ``value`` over all rows up to each one.

    The rows are dealt out by ranges of ``order``, which must tell rows apart
    where their sums matter, and summed in place; the totals of the ranges
    before are added afterwards. The table is written in between. One shuffle
    of the rows, one of a row for each range.
    """
    names = df.columns
    schema = T.StructType([*df.schema, T.StructField("_here", T.LongType()), T.StructField("_part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            here = before + np.cumsum(batch.column(names.index(value)).to_numpy(zero_copy_only=False), dtype=np.int64)
            before = int(here[-1]) if len(here) else before
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(here), pa.array(np.full(len(here), part, np.int32))], [*names, "_here", "_part"])

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage_table(dealt.mapInArrow(run, schema), "ranges")
    sizes = placed.groupBy("_part").agg(F.max("_here").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").select(*names, (F.col("_before") + F.col("_here")).alias(name))


def split_points(df: DataFrame, col: str, blocks: int) -> list[float]:
    """At most ``blocks`` rising values that cut ``col`` into like-sized parts.

    Runs one small aggregate; the driver receives ``blocks`` numbers at most.
    """
    shares = [i / blocks for i in range(1, blocks)]
    row = df.agg(F.percentile_approx(col, shares, max(10_000, 10 * blocks)).alias("s")).first()
    return sorted({float(v) for v in (row["s"] or []) if math.isfinite(v)})


def cut(df: DataFrame, col: str, points: list[float], name: str) -> DataFrame:
    """Add the number of ``points`` that are <= ``col`` (binary search in the JVM)."""
    if not points:
        return df.withColumn(name, F.lit(0).cast("int"))
    edges = [float("-inf"), *points, float("inf")]
    out = Bucketizer(splits=edges, inputCol=col, outputCol=name, handleInvalid="keep").transform(df)
    return out.withColumn(name, F.col(name).cast("int"))


def hash_unit(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends only on the values and the seed."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])
    return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def md5_unit(*cols: Column | str, seed: int = 0) -> Column:
    """As ``hash_unit``, from the first 52 bits of the md5 of ``seed:col:col...``:
    slower, but any SQL engine draws the same number."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def join_per_key(df: DataFrame, per_key: DataFrame, keys: list[str], salt: Column, salts: int = 32) -> DataFrame:
    """Inner join with a table of one row per key, such as totals per sequence.

    One sequence may hold a large share of ``df``: its rows are spread over
    ``salts`` join keys by ``salt`` (a hash), and the small table is copied to
    each. If the small table turns out small enough, Spark broadcasts it.
    """
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    return keyed.join(copies, [*keys, "_salt"]).drop("_salt")
