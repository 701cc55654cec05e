"""Command line: score predictions, or train first.

    spark-submit -m hotspan.plans.job score --predictions P --events E --out O
    spark-submit -m hotspan.plans.job train --bins B --features F --events E --out O
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspan.functions.vectors import fuse_vectors
from hotspan.operators.segments import join_features
from hotspan.plans.hotspots import HotspotConfig, presmooth_width, run_hotspots
from hotspan.plans.labels import build_labels
from hotspan.plans.training import TrainingConfig, fit_and_predict
from hotspan.session import SETTINGS
from hotspan.sources.readers import (
    read_bins_features,
    read_points,
    read_predictions,
    read_typed_points,
)
from hotspan.sources.writers import write_predictions, write_stage


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="hotspan")
    parser.add_argument("mode", choices=["score", "train"])
    data = parser.add_argument_group("data")
    data.add_argument("--predictions")
    data.add_argument("--bins")
    data.add_argument("--features")
    data.add_argument("--events")
    data.add_argument("--out", required=True)
    data.add_argument("--format", choices=["parquet", "csv"], default="parquet")

    train = parser.add_argument_group("training")
    train.add_argument("--segment-lengths", nargs="+", type=int, default=[10, 50, 100])
    train.add_argument("--overlap", type=float, default=0.0)
    train.add_argument("--discard-leftover", action="store_true")
    train.add_argument("--huber-factor", type=float, default=3.0)
    train.add_argument("--use-mad", action="store_true")
    train.add_argument("--label-roll-width", type=int, default=1)
    train.add_argument("--rounds", type=int, default=2)
    train.add_argument("--resample-from", type=int, default=3, help="first round with drawn segments, 0 for none")
    train.add_argument("--len-alpha", type=float, default=0.7)
    train.add_argument("--res-beta", type=float, default=1.0)
    train.add_argument("--cutmix-p", type=float, default=0.2)
    train.add_argument("--batch-size", type=int, default=16)
    train.add_argument("--fuse", action="store_true", help="layer-normalise and add cls and feat")
    train.add_argument("--no-score", action="store_true", help="stop after the predictions")

    score = parser.add_argument_group("scoring")
    score.add_argument("--unit", type=float, default=1000.0)
    score.add_argument("--min-bp", type=int, default=0)
    score.add_argument("--max-bp", type=int, default=100_000)
    score.add_argument("--presmooth-bins", type=int, default=None)
    score.add_argument("--sample-frac", type=float, default=0.01)
    score.add_argument("--gmm-k", type=int, default=3)
    score.add_argument("--gmm-auto", action="store_true")
    score.add_argument("--beta", type=float, default=1.5)
    score.add_argument("--gamma", type=float, default=0.5)
    score.add_argument("--gap-bp", type=int, default=0)
    score.add_argument("--fdr-method", choices=["storey", "bh"], default="storey")
    score.add_argument("--bootstrap", type=int, default=200)
    score.add_argument("--lambda-start", type=float, default=0.05)
    score.add_argument("--lambda-end", type=float, default=0.95)
    score.add_argument("--lambda-step", type=float, default=0.01)
    score.add_argument("--pi0-floor", type=float, default=0.01)
    score.add_argument("--pi0-ceil", type=float, default=1.0)
    score.add_argument("--gini-compat", action="store_true")
    score.add_argument("--seed", type=int, default=42)
    return parser


def _score(spark: SparkSession, args: argparse.Namespace, predictions: DataFrame) -> None:
    rolled = args.label_roll_width > 1
    cfg = HotspotConfig(
        unit=args.unit, min_bp=args.min_bp, max_bp=args.max_bp,
        presmooth_bins=presmooth_width(args.presmooth_bins, rolled, args.label_roll_width),
        sample_frac=args.sample_frac, gmm_k=args.gmm_k, gmm_auto=args.gmm_auto,
        beta=args.beta, gamma=args.gamma, gap_bp=args.gap_bp, fdr_method=args.fdr_method,
        bootstrap=args.bootstrap, lambda_start=args.lambda_start, lambda_end=args.lambda_end,
        lambda_step=args.lambda_step, pi0_floor=args.pi0_floor, pi0_ceil=args.pi0_ceil,
        gini_compat=args.gini_compat, seed=args.seed,
    )
    events = read_typed_points(spark, args.events) if args.events else None
    write_stage(run_hotspots(predictions, events, cfg), f"{args.out}/final_result", args.format)


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    if args.mode == "score":
        if not args.predictions:
            raise ValueError("score needs --predictions")
        _score(spark, args, read_predictions(spark, args.predictions, args.format))
        return
    if not args.bins or not args.features:
        raise ValueError("train needs --bins and --features")
    bins, features = read_bins_features(spark, args.bins, args.features)
    joined = join_features(bins, features)
    vector = fuse_vectors("cls", "feat") if args.fuse else F.concat("cls", "feat")
    ready = joined.withColumn("features", vector).drop("cls", "feat")
    if args.events:
        ready = build_labels(ready, read_points(spark, args.events))
    cfg = TrainingConfig(
        unit=args.unit, segment_lengths=tuple(args.segment_lengths), overlap=args.overlap,
        discard_leftover=args.discard_leftover, huber_factor=args.huber_factor, use_mad=args.use_mad,
        roll_width=args.label_roll_width, rounds=args.rounds, seed=args.seed,
        resample_from=args.resample_from, len_alpha=args.len_alpha, res_beta=args.res_beta,
        cutmix_p=args.cutmix_p, batch_size=args.batch_size,
    )
    trained = fit_and_predict(ready, cfg)
    path = f"{args.out}/predictions"
    write_predictions(trained.predictions, path, args.format)
    write_stage(trained.history, f"{args.out}/training_history", args.format)
    if not args.no_score:
        _score(spark, args, read_predictions(spark, f"{path}/split=all", args.format))


def main() -> None:
    builder = SparkSession.builder.appName("hotspan")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    run(builder.getOrCreate())


if __name__ == "__main__":
    main()
