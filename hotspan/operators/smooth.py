"""Moving sums of counts, expectations and exposures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotspan.functions.numeric import sanitize
from hotspan.operators.ordered import row_index

RATE_MIN = 1e-9
RATE_MAX = 1e6
INDEX_BLOCK_BP = 10_000_000
TILE = 1 << 14


def rolling_rate(
    rows: DataFrame,
    width: int,
    rate_max: float = RATE_MAX,
    segment: str = "seg_id",
    offset: str = "off",
) -> DataFrame:
    """Replace lam, y and kb by their sums over the last ``width`` bins of the
    segment (lam: expected sum over summed exposure). ``width`` <= 1 changes
    nothing. A segment is short, so one window per segment is enough.
    """
    if width <= 1:
        return rows
    w = Window.partitionBy(segment).orderBy(offset).rowsBetween(-(width - 1), 0)
    lam = sanitize("lam", pos_inf=RATE_MAX, low=RATE_MIN, high=rate_max)
    y = sanitize("y", pos_inf=RATE_MAX, low=0.0)
    kb = sanitize("kb", pos_inf=RATE_MAX, low=0.0)
    exposure = F.greatest(F.sum(kb).over(w), F.lit(1e-12))
    rate = F.sum(lam * kb).over(w) / exposure
    return rows.withColumns({
        "lam": F.least(F.greatest(rate, F.lit(RATE_MIN)), F.lit(float(rate_max))),
        "y": F.sum(y).over(w),
        "kb": exposure,
    })


def presmooth(bins: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """Centred moving sums over each sequence: obs is summed over ``width``
    bins and lam becomes the expected sum over the summed exposure.

    Needs chrom, start, lam, obs, kb; coordinates stay. Rows are numbered in
    order and cut into tiles; each tile also receives the few rows beyond its
    ends that its frames reach, so no task holds a whole sequence.
    """
    if width <= 1:
        return bins
    before, after = width // 2, (width - 1) // 2
    if tile < width:
        raise ValueError("a tile must hold at least one frame")
    numbered = row_index(
        bins.withColumn("_blk", F.floor(F.col("start") / INDEX_BLOCK_BP)), ["chrom"], "_blk", ["start"], "_i"
    ).drop("_blk")
    i = F.col("_i")
    low = F.greatest(F.floor((i - after) / tile), F.lit(0)).cast("bigint")
    high = F.floor((i + before) / tile).cast("bigint")
    tiled = numbered.withColumn("_tile", F.explode(F.sequence(low, high)))
    w = Window.partitionBy("chrom", "_tile").orderBy("_i").rowsBetween(-before, after)
    smooth = tiled.withColumns({
        "_mu": F.sum(F.col("lam") * F.col("kb")).over(w),
        "_kb": F.sum("kb").over(w),
        "_obs": F.sum("obs").over(w),
    }).where(F.floor(i / tile) == F.col("_tile"))
    return smooth.withColumns({
        "lam": F.col("_mu") / F.greatest("_kb", F.lit(1e-12)),
        "obs": F.col("_obs"),
    }).select(*bins.columns)
