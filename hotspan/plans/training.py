"""From bins, vectors and events to predicted rates."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.functions.numeric import interval_length, length_kb
from hotspan.operators.rate import RateModel, add_rate, fit_rate, predict_rate
from hotspan.operators.robust import (
    apply_scale,
    calibrate_scale,
    huber_weights,
    lookup_weights,
    robust_objective,
    segment_residual,
)
from hotspan.operators.segments import make_segments, residual_sampler, split_train_val, swapped_runs
from hotspan.operators.smooth import rolling_rate
from hotspan.session import merged, stage_table


@dataclass(frozen=True)
class TrainingConfig:
    unit: float = 1000.0
    segment_lengths: tuple[int, ...] = (10, 50, 100)
    overlap: float = 0.0
    discard_leftover: bool = False
    train_frac: float = 0.9
    huber_factor: float = 3.0
    use_mad: bool = False
    roll_width: int = 1
    rounds: int = 2
    reg: float = 1e-3
    max_iter: int = 25
    seed: int = 42
    #: From this round on segments are drawn by their residuals; 0 for never.
    resample_from: int = 3
    len_alpha: float = 0.7
    res_beta: float = 1.0
    tau: float = 1.0
    tau_decay: float = 0.999
    #: Share of the batches in which two segments exchange a run; 0 for none.
    cutmix_p: float = 0.0
    batch_size: int = 16


def _bin_weights(
    placed: DataFrame, weights: DataFrame | None, drawn: DataFrame | None = None, runs: DataFrame | None = None
) -> DataFrame:
    """Weight of each bin in the loss: every training segment that holds it
    adds its robust weight over its total exposure.

    ``drawn`` (seg_id, n_drawn) counts a segment as often as it was drawn, and
    segments it does not name not at all. ``runs`` (see ``swapped_runs``) puts
    the bins of a run into the other segment. Both change weights only: no
    bin, and no vector, is copied.
    """
    placed = placed.select("seg_id", "chrom", "w_idx", "off", "kb")
    if runs is not None:
        inside = (F.col("off") >= F.col("at")) & (F.col("off") < F.col("at") + F.col("cut"))
        placed = placed.join(merged(runs), "seg_id", "left").withColumn(
            "seg_id", F.when(inside, F.col("other")).otherwise(F.col("seg_id"))).drop("other", "at", "cut")
    totals = lookup_weights(placed.groupBy("seg_id").agg(F.sum("kb").alias("_kb")), weights)
    if drawn is not None:
        totals = totals.join(merged(drawn.select("seg_id", "n_drawn")), "seg_id").withColumn("w", F.col("w") * F.col("n_drawn"))
    share = totals.select("seg_id", (F.col("w") / F.greatest("_kb", F.lit(1e-12))).alias("_share"))
    return (
        placed.select("seg_id", "chrom", "w_idx").join(merged(share), "seg_id")
        .groupBy("chrom", "w_idx").agg(F.sum("_share").alias("weight"))
    )


def _round_weights(
    train: DataFrame, sizes: DataFrame, weights: DataFrame | None, number: int, cfg: TrainingConfig
) -> DataFrame:
    """The bin weights of one round: draws follow the residuals of the round
    before and get more even as tau decays; every round has its own seed."""
    drawn = runs = None
    if cfg.resample_from and number >= cfg.resample_from and weights is not None:
        tau = cfg.tau * cfg.tau_decay ** (number - cfg.resample_from)
        known = sizes.join(merged(weights.select("seg_id", "residual")), "seg_id")
        drawn = stage_table(
            residual_sampler(known, tau, cfg.len_alpha, cfg.res_beta, cfg.seed + number).select("seg_id", "n_drawn"), "drawn")
    if cfg.cutmix_p > 0:
        taking_part = sizes if drawn is None else sizes.join(merged(drawn), "seg_id")
        runs = swapped_runs(taking_part, cfg.cutmix_p, cfg.batch_size, cfg.seed + number)
    return _bin_weights(train, weights, drawn, runs)


class Training(NamedTuple):
    """``history`` has the robust objective of each (round, split)."""

    predictions: DataFrame
    model: RateModel
    history: DataFrame


def fit_and_predict(bins: DataFrame, cfg: TrainingConfig | None = None) -> Training:
    """Predictions per (split, segment, bin), the calibrated model and the objectives.

    ``bins`` has chrom, w_idx, start, end, y and the vector ``features``. The
    model sees one bin at a time, so the vectors stay in the bin table and
    only narrow rows are copied into segments; a bin's weight in the fit is
    the sum over the training segments that hold it. Fit and robust weights
    alternate ``rounds`` times; the model of the round with the least objective
    on the validation segments (on the training ones if there are no others)
    is kept, and its scale is calibrated on all segments. From round
    ``resample_from`` on the training segments are drawn anew each round, and
    with ``cutmix_p`` some exchange runs of bins.
    """
    cfg = cfg or TrainingConfig()
    source = stage_table(
        bins.withColumn("kb", length_kb(interval_length("start", "end"), cfg.unit)), "bins"
    )
    narrow = source.select("chrom", "w_idx", "start", "end", "y", "kb")
    segments = make_segments(narrow, list(cfg.segment_lengths), cfg.overlap, cfg.discard_leftover)
    ids = segments.where(F.col("off") == 0).select("seg_id", "chrom")
    split = split_train_val(ids, cfg.train_frac, cfg.seed).select("seg_id", "split")
    placed = stage_table(segments.join(merged(split), "seg_id"), "segments")
    train = placed.where(F.col("split") == "train")

    sizes = stage_table(
        train.groupBy("seg_id").agg(
            F.count(F.lit(1)).alias("n_bins"), length_kb(interval_length(F.min("start"), F.max("end")), cfg.unit).alias("len_kb")),
        "sizes")
    weights, models, rated, seen = None, [], [], []
    for number in range(1, max(1, cfg.rounds) + 1):
        weighted = source.join(merged(_round_weights(train, sizes, weights, number, cfg)), ["chrom", "w_idx"])
        # every step of the fit reads its input again; written, it is not joined again
        design = stage_table(weighted.select("features", "kb", "y", "weight"), "design")
        model = fit_rate(design, "weight", cfg.reg, cfg.max_iter)
        # objectives and weights read the rated rows five times; the vectors are read once
        rates = add_rate(model, source).select("chrom", "w_idx", "lam")
        rated.append(stage_table(placed.join(merged(rates), ["chrom", "w_idx"]), "rates"))
        models.append(model)
        rows = rolling_rate(rated[-1].where(F.col("split") == "train"), cfg.roll_width)
        for name in ("train", "val"):
            part = rows if name == "train" else rolling_rate(rated[-1].where(F.col("split") == name), cfg.roll_width)
            objective = robust_objective(part, cfg.huber_factor, cfg.use_mad).first()["objective"]
            seen.append((number, name, objective))
        weights = stage_table(huber_weights(segment_residual(rows), cfg.huber_factor, cfg.use_mad), "weights")

    known = [s for s in seen if s[1] == "val" and s[2] is not None] or [s for s in seen if s[1] == "train"]
    best = min(known, key=lambda s: math.inf if s[2] is None else s[2])[0] - 1
    model, everything = models[best], rated[best]
    rolled = rolling_rate(everything, cfg.roll_width)
    scale = calibrate_scale(rolled, 1.0, cfg.huber_factor, cfg.use_mad).first()["c_new"]
    model = replace(model, scale=scale)
    predicted = predict_rate(apply_scale(everything, scale), cfg.roll_width)
    whole = predicted.withColumn("split", F.lit("all"))
    history = bins.sparkSession.createDataFrame(seen, "round int, split string, objective double")
    return Training(predicted.unionByName(whole), model, history)
