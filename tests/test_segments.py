import contextlib
import io
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hotspan.operators import grid as gr
from hotspan.operators import segments as sg
from hotspan.operators.ordered import hash_unit
from hotspan.operators.smooth import presmooth, rolling_rate


def bins(spark, sizes):
    rows = [(c, i * 3, i * 10, i * 10 + 9) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["chrom", "w_idx", "start", "end"]))


@pytest.mark.parametrize("discard", [False, True])
@pytest.mark.parametrize("block", [4, 1 << 16])
def test_make_segments(spark, monkeypatch, discard, block):
    monkeypatch.setattr(sg, "INDEX_BLOCK", block)
    got = sg.make_segments(bins(spark, {"chr2": 25, "chr10": 7, "chrX": 10}), [10, 4], 0.3, discard).toPandas()
    want, number = {}, 0
    for length in (10, 4):
        step = max(1, int(length * 0.7))
        for c, n in (("chr2", 25), ("chr10", 7), ("chrX", 10)):
            for start in range(0, n, step):
                if discard and start + length > n:
                    break
                want[number] = (c, length, start, [i * 3 for i in range(start, min(n, start + length))])
                number += 1
    assert set(got.seg_id) == set(want)
    for number, part in got.groupby("seg_id"):
        part = part.sort_values("off")
        c, length, start, idx = want[number]
        assert (part.chrom.iloc[0], part.seg_len.iloc[0], part.seg_start.iloc[0]) == (c, length, start)
        assert list(part.off) == list(range(len(part))) and list(part.w_idx) == idx


def test_pack_and_pad(spark):
    rows = sg.make_segments(bins(spark, {"chr1": 7}), [5])
    zero = F.lit(0).cast("bigint")
    packed = sg.pack_segments(rows, {"start": zero, "end": zero}, pad=True, unit=10).orderBy("seg_id").collect()
    assert [r.start for r in packed] == [[0, 10, 20, 30, 40], [50, 60, 0, 0, 0]]
    assert packed[1].mask == [True, True, False, False, False]
    assert packed[1].length_kb == [1.0, 1.0, 0.0, 0.0, 0.0]


def test_split_is_exact(spark):
    ids = spark.range(1000).select(
        F.col("id").alias("seg_id"), F.when(F.col("id") < 730, "a").otherwise("b").alias("chrom")
    )
    got = sg.split_train_val(ids, 0.9, seed=1).groupBy("chrom", "split").count().collect()
    assert {(r.chrom, r.split): r["count"] for r in got} == {
        ("a", "train"): 657, ("a", "val"): 73, ("b", "train"): 243, ("b", "val"): 27}


def test_split_by_bin_keeps_runs_together(spark):
    got = sg.split_by_bin(bins(spark, {"chr1": 400}), 0.8, block=30).toPandas()
    assert (got.groupby(got.w_idx // 30).split.nunique() == 1).all()
    assert set(got.split) == {"train", "val"}


def test_sampler(spark):
    segs = spark.range(400).select(
        F.col("id").alias("seg_id"), (F.col("id") % 4).cast("double").alias("residual"), F.lit(2.0).alias("len_kb")
    )
    weights = sg.sampler_weights(segs, tau=1.0).toPandas()
    assert weights.p.sum() == pytest.approx(1.0)
    raw = np.exp(-weights.residual / (1 + 1e-8))
    assert weights.p.to_numpy() == pytest.approx((raw / raw.sum()).to_numpy())
    drawn = sg.residual_sampler(segs, tau=1.0, n_draws=20_000, per_block=700).toPandas()
    assert drawn.n_drawn.sum() == 20_000
    share = drawn.groupby("residual").n_drawn.sum() / 20_000
    want = weights.groupby("residual").p.sum()
    assert share.to_numpy() == pytest.approx(want.to_numpy(), abs=0.02)
    again = sg.residual_sampler(segs.repartition(7), tau=1.0, n_draws=20_000, per_block=10**6).toPandas()
    assert dict(zip(again.seg_id, again.n_drawn)) == dict(zip(drawn.seg_id, drawn.n_drawn))
    heavy = segs.withColumn("residual", F.when(F.col("seg_id") == 5, 0.0).otherwise(60.0))
    assert [tuple(r) for r in sg.residual_sampler(heavy, tau=1.0).select("seg_id", "n_drawn").collect()] == [(5, 400)]
    assert sg.residual_sampler(segs.limit(0), tau=1.0).count() == 0
    broken = segs.withColumn("residual", F.when(F.col("seg_id") == 3, float("nan")).otherwise(F.col("residual")))
    assert set(sg.sampler_weights(broken, 1.0).toPandas().p) == {1 / 400}


def test_cutmix_only_exchanges(spark):
    rows = sg.make_segments(bins(spark, {"chr1": 300}), [10, 25], 0.2)
    zero = F.lit(0).cast("bigint")
    packed = sg.pack_segments(rows, {"start": zero, "end": zero})
    mixed = sg.cutmix_pairs(packed, ["start", "end"], probability=1.0, batch_size=4, seed=2).toPandas()
    before = packed.toPandas().set_index("seg_id")
    assert mixed.mixed.sum() >= 2 and not mixed.mixed.all()
    assert sorted(x for a in mixed.start for x in a) == sorted(x for a in before.start for x in a)
    for r in mixed.itertuples():
        old = before.loc[r.seg_id]
        assert len(r.start) == len(old.start)
        moved = np.flatnonzero(np.asarray(r.start) != np.asarray(old.start))
        if not r.mixed:
            assert not len(moved)
        elif len(moved):
            assert moved[-1] - moved[0] < max(1, len(old.start) // 2) + 1
        assert (np.asarray(r.end) - np.asarray(r.start) == 9).all()
    calm = sg.cutmix_pairs(packed, ["start", "end"], probability=0.0)
    assert calm.where("mixed").count() == 0


def test_features_default_to_zero(spark):
    feats = spark.createDataFrame([("chr1", 0, [1.0, 2.0])], "chrom string, w_idx bigint, feat array<float>")
    got = sg.join_features(bins(spark, {"chr1": 2}), feats).orderBy("w_idx").collect()
    assert [r.feat for r in got] == [[1.0, 2.0], [0.0, 0.0]]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5])
def test_presmooth(spark, width):
    rng = np.random.default_rng(width)
    pdf = pd.DataFrame({"chrom": np.repeat(["a", "b"], [57, 40])})
    pdf["start"] = np.r_[np.arange(57) * 10, np.arange(40) * 10]
    pdf["lam"], pdf["obs"], pdf["kb"] = rng.random(97), rng.integers(0, 5, 97).astype(float), rng.random(97) + 0.1
    got = presmooth(spark.createDataFrame(pdf), width, tile=8).toPandas()
    for c, part in pdf.groupby("chrom"):
        mine = got[got.chrom == c].sort_values("start")
        box = np.ones(width)
        mu, kb = (np.convolve(v, box, mode="same") for v in (part.lam * part.kb, part.kb))
        assert mine.obs.to_numpy() == pytest.approx(np.convolve(part.obs, box, mode="same"))
        assert mine.lam.to_numpy() == pytest.approx(mu / kb)


def test_rolling_rate(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 1.0, 1.0), (1, 1, 4.0, 2.0, 3.0)], "seg_id int, off int, lam double, y double, kb double")
    rows = rolling_rate(df, 2).orderBy("off").collect()
    assert [(r.lam, r.y, r.kb) for r in rows] == [(2.0, 1.0, 1.0), (3.5, 3.0, 4.0)]
    assert rolling_rate(df, 1) is df


def test_grid(spark):
    grid = spark.createDataFrame(
        [("1", 1, 1000), ("chr1", 1, 1000), ("chr1", 1001, 2000), ("chr1", 2001, 2500)],
        "chrom string, start bigint, end bigint",
    )
    clean = gr.distinct_grid(grid)
    assert clean.count() == 3
    assert tuple(gr.infer_grid(clean).first()) == (1000, 1)
    points = spark.createDataFrame(
        [("chr1", 1000, "a"), ("chr1", 1001, "a"), ("chr1", 1500, "a"), ("chr1", 1500, "b"), ("chr1", 0, "a"), ("chr1", -7, "a")],
        "chrom string, pos bigint, sample string",
    )
    placed = gr.assign_points_to_grid(points, clean).collect()
    assert sorted((r.pos, r.start) for r in placed) == [(1000, 1), (1001, 1001), (1500, 1001), (1500, 1001)]
    labels = gr.bin_labels(points, clean)
    assert {(r.start, r.y) for r in labels.collect()} == {(1, 1), (1001, 2)}
    done = gr.attach_labels(grid, labels)
    assert sorted((r.chrom, r.start, r.y) for r in done.collect()) == [
        ("1", 1, 1.0), ("chr1", 1, 1.0), ("chr1", 1001, 2.0), ("chr1", 2001, 0.0)]
    assert tuple(gr.unmatched_bins(done).first()) == (1, 4)


def test_hash_unit_is_uniform(spark):
    row = spark.range(20_000).select(hash_unit("id", seed=4).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert row[0] == pytest.approx(0.5, abs=0.01) and 0 <= row[1] < 0.001 and 0.999 < row[2] < 1


def test_ragged_vectors_are_refused(spark):
    bins = spark.createDataFrame([("chr1", 0), ("chr1", 1)], "chrom string, w_idx int")
    ragged = spark.createDataFrame([("chr1", 0, [1.0, 2.0]), ("chr1", 1, [1.0])], "chrom string, w_idx int, feat array<float>")
    with pytest.raises(ValueError, match="from 1 to 2"):
        sg.join_features(bins, ragged)


def test_swapped_runs_are_those_of_the_pairs(spark):
    rows = [(i, [100 * i + j for j in range(3 + i % 7)]) for i in range(60)]
    packed = spark.createDataFrame(rows, "seg_id bigint, y array<bigint>")
    mixed = {r.seg_id: r.y for r in sg.cutmix_pairs(packed, ["y"], 0.6, 4, seed=5).collect()}
    want = dict(rows)
    sizes = packed.selectExpr("seg_id", "size(y) AS n_bins")
    runs = sg.swapped_runs(sizes, 0.6, 4, seed=5).collect()
    assert len(runs) > 4 and {(r.seg_id, r.other) for r in runs} == {(r.other, r.seg_id) for r in runs}
    before = dict(rows)
    for r in runs:
        want[r.other] = want[r.other][:r["at"]] + before[r.seg_id][r["at"]:r["at"] + r.cut] + want[r.other][r["at"] + r.cut:]
    assert mixed == want


def _widths(df):
    """Partitions of the shuffles in the plan that were asked for by number."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return [int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", out.getvalue())]


def test_tasks_follow_the_rows(spark, monkeypatch):
    rows = spark.range(300).select(
        F.lit("chr1").alias("chrom"), F.col("id").alias("w_idx"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 9).alias("end"))
    zero = F.lit(0).cast("bigint")
    monkeypatch.setattr(sg, "tasks_for", lambda rows: -(-rows // 20))
    rows = sg.make_segments(rows, [10], 0.5)
    assert 30 in _widths(rows)  # 300 bins, two segments each
    packed = sg.pack_segments(rows, {"start": zero, "end": zero}, pad=True)
    assert 30 in _widths(packed)  # 595 rows
    assert packed.count() == 60 and packed.where(F.size("start") != 10).count() == 0
