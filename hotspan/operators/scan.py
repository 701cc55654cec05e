"""Scoring every bounded interval of consecutive bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspan.functions.numeric import interval_length, length_kb, sanitize_count, sanitize_rate
from hotspan.functions.scores import llr_norm, llr_poisson
from hotspan.operators.ordered import hash_unit, join_per_key, running

POSITIVE = 1e-6


def per_bin(predictions: DataFrame, order: str | None = None) -> DataFrame:
    """One row per (chrom, start, end): mean of lam_pred and the observed count.

    The count belongs to the bin, so all its rows agree and the maximum is
    taken; with ``order`` it is the first non-null one in that order. NaN
    counts as missing. Both aggregates merge before the shuffle.
    """
    lam = F.when(~F.isnan("lam_pred"), F.col("lam_pred"))
    obs = F.when(~F.isnan(F.col("obs_count").cast("double")), F.col("obs_count"))
    if order is None:
        pick = F.max(obs)
    else:
        pick = F.min_by("obs_count", F.when(obs.isNotNull(), F.col(order)))
    return predictions.groupBy("chrom", "start", "end").agg(
        F.avg(lam).alias("lam_pred"), pick.alias("obs_count")
    )


def scan_input(bins: DataFrame, unit: float = 1000.0) -> DataFrame:
    """Clean per-bin rows: finite lam and obs, length and exposure."""
    return bins.select(
        "chrom",
        "start",
        "end",
        sanitize_rate("lam_pred").alias("lam"),
        sanitize_count("obs_count").alias("obs"),
        length_kb(interval_length("start", "end"), unit).alias("kb"),
    )


def prefix_sums(bins: DataFrame, block_bp: int = 10_000_000) -> DataFrame:
    """Running observed and expected sums along each sequence, this bin
    included (cum_obs, cum_exp) and excluded (pre_obs, pre_exp)."""
    out = running(
        bins.withColumn("_blk", F.floor(F.col("start") / block_bp)),
        ["chrom"],
        "_blk",
        ["start"],
        {"cum_obs": ("sum", F.col("obs")), "cum_exp": ("sum", F.col("lam") * F.col("kb"))},
    ).drop("_blk")
    return out.withColumns({
        "pre_obs": F.col("cum_obs") - F.col("obs"),
        "pre_exp": F.col("cum_exp") - F.col("lam") * F.col("kb"),
    })


def _tile_range(first: Column, width: int, overlap: int) -> tuple[Column, Column]:
    step = width - overlap
    low = F.greatest(F.ceil((F.col("start") - first - width + 1) / step), F.lit(0)).cast("bigint")
    high = F.floor((F.col("end") - first) / step).cast("bigint")
    return low, high


def _check_tiles(width: int, overlap: int) -> None:
    if not 0 <= overlap < width:
        raise ValueError("the overlap of tiles must be smaller than their width")


def _with_first_start(bins: DataFrame) -> DataFrame:
    starts = bins.groupBy("chrom").agg(F.min("start").alias("_first"))
    return join_per_key(bins, starts, ["chrom"], F.xxhash64("start"))


def chunk_windows(bins: DataFrame, width: int, overlap: int) -> DataFrame:
    """Each bin once per overlapping tile it touches.

    Tile k of a sequence covers ``width`` positions from first start +
    k * (width - overlap). Adds tile and tile_start.
    """
    _check_tiles(width, overlap)
    low, high = _tile_range(F.col("_first"), width, overlap)
    return (
        _with_first_start(bins)
        .where(low <= high)
        .withColumn("tile", F.explode(F.sequence(low, high)))
        .withColumn("tile_start", F.col("_first") + F.col("tile") * (width - overlap))
        .drop("_first")
    )


def scan_partitions(bins: DataFrame, max_bp: int, per_task: int = 1_000_000) -> int:
    """How many tasks the scan of ``bins`` should have.

    The scan turns each bin into about max_bp / bin length intervals, so the
    size of its input says little about its work. Runs one small aggregate.
    """
    row = bins.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("end") - F.col("start") + 1).alias("size")
    ).first()
    pairs = row["n"] * max(1.0, max_bp / max(row["size"] or 1.0, 1.0))
    return max(bins.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / per_task))


def scan_pairs(
    bins: DataFrame,
    max_bp: int = 100_000,
    min_bp: int = 0,
    tiles: tuple[int, int] | None = None,
    repeat: bool = False,
    keep_all: bool = False,
    partitions: int | None = None,
    bucket_bp: int = 0,
) -> DataFrame:
    """Every interval from bin i to bin j of a sequence with end_j - start_i
    <= ``max_bp``, scored against its expectation; needs scan_input columns.

    Gives chrom, bucket, start_bp, end_bp, len_bp, obs, exp, LLR_raw. Only
    intervals with an excess stay, unless ``keep_all``.

    Start positions are cut into buckets one position wider than the span, so
    j lies in the bucket of i or in the next one. The right side is copied to
    its own bucket and, where it is still in reach, to the one before; the
    join is then an equi-join on (chrom, bucket) and its output stays
    partitioned by the bucket of i. A bucket has at most max_bp + 1 positions,
    hence at most (max_bp + 1) / bin size bins. Sums come from prefixes inside
    the bucket, so no value depends on the length of the sequence.

    ``tiles`` = (width, overlap) keeps only pairs that share a tile, as a
    tiled scan finds them; ``repeat`` gives a pair once per shared tile.
    ``partitions`` (see scan_partitions) fixes the number of tasks, which the
    adaptive planner would otherwise choose by the size of the bins.
    ``bucket_bp`` widens the buckets for a later step that needs it.
    """
    width = max(max_bp + 1, bucket_bp)
    source = bins.select("chrom", "start", "end", "obs", (F.col("lam") * F.col("kb")).alias("mu"))
    if tiles:
        _check_tiles(*tiles)
        low, high = _tile_range(F.col("_first"), *tiles)
        source = _with_first_start(source).withColumns({"k0": low, "k1": high}).drop("_first")
    extra = ["k0", "k1"] if tiles else []
    run = Window.partitionBy("chrom", "bucket").orderBy("start", "end")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    def spread(df: DataFrame) -> DataFrame:
        return df.repartition(partitions, "chrom", "bucket") if partitions else df

    summed = spread(source.withColumn("bucket", F.floor(F.col("start") / width))).withColumns({
        "c_obs": F.sum("obs").over(upto),
        "c_mu": F.sum("mu").over(upto),
        "t_obs": F.sum("obs").over(whole),
        "t_mu": F.sum("mu").over(whole),
    })
    left = summed.select(
        "chrom",
        "bucket",
        F.col("start").alias("start_bp"),
        F.col("end").alias("i_end"),
        (F.col("c_obs") - F.col("obs")).alias("before_obs"),
        (F.col("c_mu") - F.col("mu")).alias("before_mu"),
        "t_obs",
        "t_mu",
        *[F.col(c).alias(f"i_{c}") for c in extra],
    )
    home = F.col("home")
    reach = F.when(
        F.col("end") - home * width < max_bp, F.array(home, home - 1)
    ).otherwise(F.array(home))
    right = (
        summed.withColumnRenamed("bucket", "home")
        .withColumn("bucket", F.explode(reach))
        .select(
            "chrom", "bucket", "home", F.col("start").alias("j_start"), F.col("end").alias("end_bp"),
            F.col("c_obs").alias("j_obs"), F.col("c_mu").alias("j_mu"), *extra,
        )
    )
    ordered = (F.col("start_bp") < F.col("j_start")) | (
        (F.col("start_bp") == F.col("j_start")) & (F.col("i_end") <= F.col("end_bp"))
    )
    in_span = (F.col("end_bp") - F.col("start_bp") <= max_bp) & (
        F.col("end_bp") - F.col("start_bp") + 1 >= min_bp
    )
    pairs = left.join(spread(right), ["chrom", "bucket"]).where(ordered & in_span)
    if tiles:
        shared = F.least("k1", "i_k1") - F.greatest("k0", "i_k0") + 1
        pairs = pairs.where(shared >= 1)
        if repeat:
            pairs = pairs.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), shared)))
    same = F.col("home") == F.col("bucket")
    # the next bucket begins where the totals of this one end
    obs = F.col("j_obs") - F.col("before_obs") + F.when(same, 0.0).otherwise(F.col("t_obs"))
    exp = F.col("j_mu") - F.col("before_mu") + F.when(same, 0.0).otherwise(F.col("t_mu"))
    scored = pairs.select(
        "chrom",
        "bucket",
        "start_bp",
        "end_bp",
        (F.col("end_bp") - F.col("start_bp") + 1).alias("len_bp"),
        obs.alias("obs"),
        exp.alias("exp"),
    ).withColumn("LLR_raw", llr_poisson("obs", "exp"))
    # the condition of the score itself, cheaper in the join than its logarithm
    return scored if keep_all else scored.where((F.col("obs") > F.col("exp")) & (F.col("exp") > 1e-12))


def scan_summary(candidates: DataFrame) -> DataFrame:
    """Per sequence: intervals above the positive threshold, and the rest.

    The rest is complete only for candidates made with ``keep_all``; a score
    that is missing, for want of an excess, is not above.
    """
    above = F.coalesce(F.col("LLR_raw") > POSITIVE, F.lit(False))
    return candidates.groupBy("chrom").agg(F.count_if(above).alias("n_pos"), F.count_if(~above).alias("n_zero"))


def selection_summary(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """Per sequence: how many candidates there were and how many were selected."""
    made = candidates.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_candidates"))
    kept = selected.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_selected"))
    return made.join(kept, "chrom", "left").na.fill(0, ["n_selected"])


def sample_scores(
    candidates: DataFrame,
    fraction: float = 0.01,
    seed: int = 0,
    unit: float = 1000.0,
    key: Column | None = None,
) -> DataFrame:
    """Normalised scores of a repeatable share of the positive candidates.

    The draw depends only on the interval and the seed. ``key`` replaces it
    by another number in [0, 1).
    """
    draw = hash_unit("chrom", "start_bp", "end_bp", seed=seed) if key is None else key
    return candidates.where((F.col("LLR_raw") > POSITIVE) & (draw < fraction)).select(
        llr_norm("LLR_raw", length_kb("len_bp", unit)).alias("score")
    )
