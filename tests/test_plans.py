import os

import pandas as pd
import pytest

import __spark_entry__ as contract
from hotspan.functions.tail import Mixture
from hotspan.plans import training
from hotspan.plans.hotspots import HotspotConfig, presmooth_width, run_hotspots
from hotspan.plans.job import run
from hotspan.plans.training import TrainingConfig, _bin_weights, fit_and_predict
from hotspan.session import stage_table
from hotspan.workload import rates
from hotspan.workload.tables import DAY, typed_events

SF = "/root/testdata/sf0.001"
MIX = Mixture((0.7, 0.3), (0.4, 1.0), (0.3, 0.4))


def test_presmooth_width():
    assert presmooth_width(None) == 1
    assert presmooth_width(None, True, 3) == 3
    assert presmooth_width(0, True, 3) == 0


def test_hotspots_do_not_overlap_and_ignore_partitions(spark):
    predictions = rates.predictions(spark, SF)
    events = typed_events(spark, SF).select("chrom", "pos", "event_type", "sample")
    cfg = HotspotConfig(max_bp=DAY, mixture=MIX, gap_bp=3600, presmooth_bins=2, pi0=0.5, beta=1.5, gamma=0.5)
    first = run_hotspots(predictions, events, cfg).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        second = run_hotspots(predictions, events, cfg).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    pd.testing.assert_frame_equal(first, second, rtol=1e-9)
    assert len(first) > 3
    for _, part in first.groupby("chrom"):
        assert (part.end.to_numpy()[:-1] + 3600 < part.start.to_numpy()[1:]).all()
    assert first.columns[:10].tolist() == [
        "chrom", "start", "end", "len_bp", "LLR_raw", "obs_sum", "exp_sum", "p_post", "fdr_post", "fdr"]
    assert ((first.fdr >= 0) & (first.fdr <= 1)).all()


def test_training_predicts_every_bin(spark):
    bins = rates._feature_bins(spark, SF).drop("kb")
    cfg = TrainingConfig(segment_lengths=(24,), overlap=0.5, rounds=2, roll_width=2)
    predictions, model, history = fit_and_predict(bins, cfg)
    seen = history.collect()
    assert {(r["round"], r["split"]) for r in seen} == {(i + 1, s) for i in range(cfg.rounds) for s in ("train", "val")}
    assert all(r["objective"] is not None for r in seen if r["split"] == "train")
    whole = predictions.where("split = 'all'")
    assert whole.select("chrom", "start", "end").distinct().count() == bins.count()
    assert 0.5 < model.scale < 2.0
    parts = predictions.where("split <> 'all'")
    assert parts.count() == whole.count()


def test_training_broadcasts_no_bins_or_segments(spark, monkeypatch):
    """Written, a table of few distinct values is far smaller than in the driver's memory."""
    plans = {}

    def staged(df, name):
        if name in ("design", "rates"):
            plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return stage_table(df, name)

    monkeypatch.setattr(training, "stage_table", staged)
    rows = [("a", w, w * 10, w * 10 + 9, float(w % 2), [0.0, 1.0]) for w in range(60)]
    bins = spark.createDataFrame(rows, "chrom string, w_idx long, start long, end long, y double, features array<double>")
    fit_and_predict(bins, TrainingConfig(segment_lengths=(6,), rounds=1))
    placed = stage_table(spark.createDataFrame([(0, "a", 0, 0, 1.0)], "seg_id long, chrom string, w_idx long, off long, kb double"), "placed")
    weights = stage_table(spark.createDataFrame([(0, 1.0)], "seg_id long, w double"), "weights")
    plans["weights"] = _bin_weights(placed, weights)._jdf.queryExecution().executedPlan().toString()
    assert len(plans) == 3
    for plan in plans.values():
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_bin_weights_of_drawn_segments_and_runs(spark):
    rows = [(s, "a", w, w - lo, 0.5 + w % 3) for s, lo, hi in ((0, 0, 6), (1, 3, 9), (2, 8, 12), (3, 0, 4)) for w in range(lo, hi)]
    placed = spark.createDataFrame(rows, "seg_id bigint, chrom string, w_idx bigint, off bigint, kb double")
    robust = {0: 1.0, 1: 0.5, 2: 0.25}
    drawn = {0: 2, 1: 1, 2: 3}
    runs = {0: (1, 2, 2), 1: (0, 2, 2)}
    where = [(runs[s][0] if s in runs and runs[s][1] <= off < sum(runs[s][1:]) else s, w, kb) for s, _, w, off, kb in rows]
    total = {s: sum(kb for t, _, kb in where if t == s) for s in range(4)}
    want = {}
    for s, w, _ in where:
        if s in drawn:
            want[w] = want.get(w, 0.0) + drawn[s] * robust[s] / total[s]
    got = _bin_weights(
        placed, spark.createDataFrame(list(robust.items()), "seg_id bigint, w double"),
        spark.createDataFrame(list(drawn.items()), "seg_id bigint, n_drawn bigint"),
        spark.createDataFrame([(s, *r) for s, r in runs.items()], "seg_id bigint, other bigint, at bigint, cut bigint"))
    assert {r.w_idx: r.weight for r in got.collect()} == pytest.approx(want)


def test_training_with_drawn_segments_and_runs(spark):
    bins = rates._feature_bins(spark, SF).drop("kb")
    cfg = TrainingConfig(segment_lengths=(24,), overlap=0.5, rounds=2, resample_from=2, cutmix_p=1.0)
    plain = TrainingConfig(segment_lengths=(24,), overlap=0.5, rounds=2)
    mine, other = (
        {(r["round"], r["split"]): r["objective"] for r in fit_and_predict(bins, c).history.collect()} for c in (cfg, plain))
    assert set(mine) == set(other) and None not in mine.values()
    # equal weights in the first round, where nearly all segments are of one size; draws in the second
    assert mine[(2, "train")] != other[(2, "train")]
    assert mine[(2, "val")] == pytest.approx(other[(2, "val")], rel=0.2)


def test_job_modes(spark, tmp_path):
    bins = rates._feature_bins(spark, SF).select("chrom", "w_idx", "start", "end", "y", "features")
    bins.withColumnRenamed("features", "cls").write.parquet(str(tmp_path / "bins"))
    bins.select("chrom", "w_idx", bins.features.alias("feat")).write.parquet(str(tmp_path / "feats"))
    typed_events(spark, SF).drop("event_id", "value").write.csv(str(tmp_path / "events"), header=True)
    run(spark, ["train", "--bins", str(tmp_path / "bins"), "--features", str(tmp_path / "feats"), "--fuse",
                "--events", str(tmp_path / "events"), "--out", str(tmp_path / "out"), "--segment-lengths", "24",
                "--rounds", "1", "--max-bp", str(DAY), "--fdr-method", "bh", "--gmm-k", "1"])
    assert {"split=train", "split=val", "split=all"} <= set(os.listdir(tmp_path / "out" / "predictions"))
    result = spark.read.parquet(str(tmp_path / "out" / "final_result"))
    assert "n_evt_click" in result.columns
    with pytest.raises(ValueError):
        run(spark, ["score", "--out", str(tmp_path / "none")])


def test_contract(spark):
    names, checks = contract.queries(), contract.oracle_sql()
    assert set(checks) <= set(names)
    assert len(names) > 90
    assert contract.entry(spark).count() > 0
