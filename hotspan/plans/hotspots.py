"""From predicted rates to annotated, non-overlapping hotspots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.functions.numeric import length_kb, sanitize
from hotspan.functions.scores import llr_norm, weight_of
from hotspan.functions.tail import Mixture, mixture_tail
from hotspan.operators.annotate import attach_event_stats, event_groups, interval_obs_exp
from hotspan.operators.fdr import fdr, lambda_grid
from hotspan.operators.mixture import mixture_policy
from hotspan.operators.scan import per_bin, sample_scores, scan_input, scan_pairs, scan_partitions
from hotspan.operators.select import select_intervals
from hotspan.operators.smooth import presmooth
from hotspan.session import stage_table


@dataclass(frozen=True)
class HotspotConfig:
    """Options of ``run_hotspots``. ``mixture`` and ``pi0`` replace the fits."""

    unit: float = 1000.0
    min_bp: int = 0
    max_bp: int = 100_000
    presmooth_bins: int = 1
    sample_frac: float = 0.01
    gmm_k: int = 3
    gmm_auto: bool = False
    gmm_max_iter: int = 100
    mixture: Mixture | None = None
    beta: float = 1.0
    gamma: float = 0.0
    gap_bp: int = 0
    tiles: tuple[int, int] | None = None
    fdr_method: str = "storey"
    pi0: float | None = None
    bootstrap: int = 200
    lambda_start: float = 0.05
    lambda_end: float = 0.95
    lambda_step: float = 0.01
    pi0_floor: float = 0.01
    pi0_ceil: float = 1.0
    dedup_sample: bool = True
    gini_compat: bool = False
    #: A column for each event type, or one map that takes any number of types.
    types_as: str = "columns"
    seed: int = 0


def presmooth_width(explicit: int | None, label_roll: bool = False, label_roll_width: int = 1) -> int:
    """The given width; else that of the training labels if they were rolled."""
    if explicit is not None:
        return max(0, int(explicit))
    return int(label_roll_width) if label_roll and label_roll_width > 1 else 1


def with_scores(candidates: DataFrame, mixture: Mixture, cfg: HotspotConfig) -> DataFrame:
    """Add p_val, neglog10_p and LLR_weighted to candidate intervals."""
    kb = length_kb("len_bp", cfg.unit)
    positive = F.col("LLR_raw") > 0
    clean = candidates.withColumn("LLR_raw", F.coalesce("LLR_raw", F.lit(0.0)))
    scored = mixture_tail(clean.withColumn("_norm", llr_norm("LLR_raw", kb)), "_norm", mixture)
    return (
        scored.withColumns({
            "p_val": F.when(positive, F.col("p_val")).otherwise(1.0),
            "neglog10_p": F.when(positive, F.col("neglog10_p")).otherwise(0.0),
        })
        .withColumn("_w", weight_of("LLR_raw", "neglog10_p", kb, cfg.beta, cfg.gamma))
        .withColumn("LLR_weighted", sanitize("_w"))
        .drop("_norm", "_w")
    )


def _bucket_bp(cfg: HotspotConfig) -> int:
    """Buckets of the scan that the selection can use as its blocks."""
    return max(cfg.max_bp + 1, cfg.max_bp + cfg.gap_bp)


def candidates_of(bins: DataFrame, cfg: HotspotConfig) -> DataFrame:
    """Scored excess intervals of clean per-bin rows, smoothed if asked."""
    smooth = presmooth(bins, cfg.presmooth_bins)
    tasks = scan_partitions(bins, cfg.max_bp)
    return scan_pairs(
        smooth, cfg.max_bp, cfg.min_bp, cfg.tiles, partitions=tasks, bucket_bp=_bucket_bp(cfg)
    )


def run_hotspots(
    predictions: DataFrame, events: DataFrame | None = None, cfg: HotspotConfig | None = None
) -> DataFrame:
    """Hotspots of a prediction table, with event statistics if ``events``
    (chrom, pos, event_type, sample) is given.

    Written once to the shared folder: the per-bin table, the selected
    intervals, and the events inside them. The candidate intervals, far more
    than the bins, are never written: they are scored once for the mixture
    sample and once for the selection.
    """
    cfg = cfg or HotspotConfig()
    bins = stage_table(scan_input(per_bin(predictions), cfg.unit), "per_bin")
    candidates = candidates_of(bins, cfg)
    mixture = cfg.mixture or mixture_policy(
        sample_scores(candidates, cfg.sample_frac, cfg.seed, cfg.unit),
        cfg.gmm_k, cfg.gmm_auto, cfg.seed, cfg.gmm_max_iter,
    )
    picked = select_intervals(
        with_scores(candidates, mixture, cfg),
        gap_bp=cfg.gap_bp,
        max_span=cfg.max_bp,
        carry=["LLR_raw"],
        bucket=("bucket", _bucket_bp(cfg)),
    ).withColumn("len_bp", F.col("end_bp") - F.col("start_bp") + 1)
    selected = stage_table(
        with_scores(picked, mixture, cfg).select(
            "chrom", "start_bp", "end_bp", "len_bp", "LLR_raw", F.col("p_val").alias("p_post")
        ),
        "selected",
    )
    scored = fdr(
        selected, cfg.fdr_method, "p_post", "fdr", cfg.pi0,
        lambda_grid(cfg.lambda_start, cfg.lambda_end, cfg.lambda_step),
        cfg.bootstrap, cfg.seed, cfg.pi0_floor, cfg.pi0_ceil,
    )
    sums = interval_obs_exp(bins, selected, cfg.max_bp + 1)
    result = scored.join(sums, ["chrom", "start_bp", "end_bp"], "left").select(
        "chrom", "start_bp", "end_bp", "len_bp", "LLR_raw",
        F.coalesce("obs_sum", F.lit(0.0)).alias("obs_sum"),
        F.coalesce("exp_sum", F.lit(0.0)).alias("exp_sum"),
        "p_post", F.col("fdr").alias("fdr_post"), "fdr",
    )
    groups = None
    if events is not None:
        groups = stage_table(event_groups(events, selected, cfg.max_bp + 1), "events_inside")
    annotated = attach_event_stats(
        result, groups, dedup_sample=cfg.dedup_sample, gini_compat=cfg.gini_compat, types_as=cfg.types_as
    )
    return annotated.withColumnsRenamed({"start_bp": "start", "end_bp": "end"}).orderBy("chrom", "start")
