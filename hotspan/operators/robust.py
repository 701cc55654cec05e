"""Segment losses, residuals, robust weights and scale calibration.

Rows are one per (segment, bin) with seg_id, y, lam and kb.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.functions.numeric import sanitize
from hotspan.functions.scores import huber_weight
from hotspan.operators.ordered import cut, running, split_points
from hotspan.session import merged, stage_table

RATE_MIN = 1e-9
RATE_MAX = 1e6
#: Distinct values that one task orders, about; the number of tasks is bounded.
ROWS_PER_BLOCK = 200_000
MOST_BLOCKS = 10_000


def _clean(rows: DataFrame, low: float = RATE_MIN) -> DataFrame:
    return rows.withColumns({
        "lam": sanitize("lam", nan=low, neg_inf=low, pos_inf=RATE_MAX, low=low, high=RATE_MAX),
        "y": sanitize("y", low=0.0),
        "kb": sanitize("kb", low=0.0),
    })


def segment_nll(rows: DataFrame) -> DataFrame:
    """Per segment: negative Poisson log-likelihood and total exposure."""
    return (
        _clean(rows)
        .groupBy("seg_id")
        .agg(
            sanitize(
                F.sum(F.col("lam") * F.col("kb") - F.col("y") * F.log("lam")),
                pos_inf=1e6, neg_inf=1e6,
            ).alias("nll"),
            F.sum("kb").alias("kb"),
        )
    )


def mean_nll(rows: DataFrame) -> DataFrame:
    """One row: the mean of ``segment_nll``."""
    return segment_nll(rows).agg(F.avg("nll").alias("nll"))


def lookup_weights(segments: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Add ``w`` by seg_id, 1 where unknown."""
    if weights is None:
        return segments.withColumn("w", F.lit(1.0))
    found = weights.select("seg_id", F.col("w").alias("_w"))
    return segments.join(merged(found), "seg_id", "left").withColumn(
        "w", sanitize(F.coalesce("_w", F.lit(1.0)), nan=1.0, pos_inf=1.0, neg_inf=1.0)
    ).drop("_w")


def weighted_nll(rows: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row: weighted mean over segments of 30 * nll per unit of exposure."""
    per_kb = F.col("nll") / F.greatest("kb", F.lit(1e-12)) * 30.0
    scored = lookup_weights(segment_nll(rows).withColumn("loss", per_kb), weights)
    return scored.agg(
        (F.sum(F.col("w") * F.col("loss")) / F.greatest(F.sum("w"), F.lit(1e-12))).alias("loss")
    )


def segment_residual(rows: DataFrame) -> DataFrame:
    """Mean of observed minus expected over the bins of each segment."""
    return rows.groupBy("seg_id").agg(F.avg(F.col("y") - F.col("lam") * F.col("kb")).alias("residual"))


def exact_percentiles(
    df: DataFrame, col: str, shares: list[float], rows_per_block: int = ROWS_PER_BLOCK
) -> list[float]:
    """Exact percentiles with linear interpolation between neighbours.

    The distinct values are counted and written once, then cut into blocks of
    about ``rows_per_block`` values; running counts over blocks and inside
    them give every value's rank, so no task orders more than a block. NaN
    and null are left out, infinities are values like others.
    """
    values = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    distinct = stage_table(values.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "distinct")
    row = distinct.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).first()
    n = row["n"] or 0
    if n == 0:
        return [math.nan] * len(shares)
    blocks = min(MOST_BLOCKS, -(-row["d"] // rows_per_block))
    placed = cut(distinct, "x", split_points(distinct, "x", blocks) if blocks > 1 else [], "blk")
    ranked = running(placed, [], "blk", ["x"], {"upto": ("sum", F.col("n"))})
    wanted = sorted({int(r) for q in shares for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    hit = F.lit(False)
    for r in wanted:
        hit = hit | ((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r))
    rows = ranked.where(hit).collect()
    at = {r: next(x["x"] for x in rows if x["upto"] - x["n"] <= r < x["upto"]) for r in wanted}
    out = []
    for q in shares:
        h = q * (n - 1)
        lo, hi = at[math.floor(h)], at[math.ceil(h)]
        out.append(lo if lo == hi else lo + (hi - lo) * (h - math.floor(h)))
    return out


def mad_scale(df: DataFrame, col: str, rows_per_block: int = ROWS_PER_BLOCK) -> float:
    """1.4826 times the median distance from the median, at least 1e-9."""
    (median,) = exact_percentiles(df, col, [0.5], rows_per_block)
    apart = df.select(F.abs(F.col(col) - F.lit(median)).alias("d"))
    (mad,) = exact_percentiles(apart, "d", [0.5], rows_per_block)
    return max(1.4826 * mad, 1e-9)


def iqr_scale(df: DataFrame, col: str, rows_per_block: int = ROWS_PER_BLOCK) -> float:
    """Distance between the quartiles, at least 1e-9."""
    low, high = exact_percentiles(df, col, [0.25, 0.75], rows_per_block)
    return max(high - low, 1e-9)


def huber_delta(residuals: DataFrame, factor: float = 3.0, use_mad: bool = False) -> float:
    """Residual size up to which a segment keeps its full weight."""
    scale = (mad_scale if use_mad else iqr_scale)(residuals, "residual")
    if not math.isfinite(scale) or scale <= 0:
        scale = 1.0
    return max(factor * scale, 1e-6)


def huber_weights(
    residuals: DataFrame, factor: float = 3.0, use_mad: bool = False, eps: float = 1e-9
) -> DataFrame:
    """Add the robust weight ``w`` of each segment residual.

    The residuals, one row per segment, are written once: the percentiles
    behind the limit read them several times.
    """
    residuals = stage_table(residuals, "residuals")
    delta = huber_delta(residuals, factor, use_mad)
    return residuals.withColumn("w", huber_weight("residual", delta, eps))


def calibrate_scale(
    rows: DataFrame, c: float = 1.0, factor: float = 3.0, use_mad: bool = False
) -> DataFrame:
    """One row (c_new, num, den): the scale at which the weighted observed and
    expected totals agree; ``c`` stays if either total is too small.

    Rates in ``rows`` already carry the scale ``c``. For rolled rates pass the
    output of ``rolling_rate``.
    """
    weights = huber_weights(segment_residual(rows), factor, use_mad, eps=1e-8)
    sums = rows.groupBy("seg_id").agg(
        F.sum("y").alias("y"), F.sum(F.col("lam") / F.lit(max(c, 1e-8)) * F.col("kb")).alias("mu")
    )
    totals = lookup_weights(sums, weights).agg(
        F.sum(F.col("w") * F.col("y")).alias("num"), F.sum(F.col("w") * F.col("mu")).alias("den")
    )
    num, den = F.col("num"), F.col("den")
    usable = (
        ~F.isnan(num) & ~F.isnan(den) & (num > 1e-8) & (den > 1e-8)
        & (num != float("inf")) & (den != float("inf"))
    )
    new = F.when(usable, F.greatest(num / den, F.lit(1e-8))).otherwise(F.lit(float(c)))
    return totals.select(new.alias("c_new"), "num", "den")


def apply_scale(rows: DataFrame, c_new: float, c: float = 1.0) -> DataFrame:
    return rows.withColumn("lam", F.col("lam") * F.lit(c_new / max(c, 1e-8)))


def robust_objective(rows: DataFrame, factor: float = 3.0, use_mad: bool = False) -> DataFrame:
    """One row: robustly weighted loss over all bins with exposure."""
    valid = _clean(rows, low=1e-8).where(F.col("kb") > 0).withColumn("kb", F.greatest("kb", F.lit(1e-8)))
    weights = huber_weights(segment_residual(valid), factor, use_mad)
    per_seg = valid.groupBy("seg_id").agg(
        F.sum(F.col("lam") * F.col("kb") - F.col("y") * F.log("lam")).alias("nll"), F.sum("kb").alias("kb")
    )
    loss = F.col("nll") / F.greatest("kb", F.lit(1e-8)) * 30.0
    scored = lookup_weights(per_seg.withColumn("loss", loss), weights)
    return scored.agg(
        (F.sum(F.col("w") * F.col("loss")) / F.greatest(F.sum("w"), F.lit(1e-8))).alias("objective")
    )
