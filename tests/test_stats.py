import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hotspan.operators import annotate as an
from hotspan.operators import robust as rb
from hotspan.operators.ordered import running

KEYS = ["chrom", "start_bp", "end_bp"]


def crowd(seed=1):
    """Events of two sequences; a third of them at one position."""
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        pos = 105 if i % 3 == 0 else rng.randint(0, 400)
        rows.append((rng.choice(["a", "b"]), pos, rng.choice(["tra", "DEL", "del", "xtra"]), f"s{rng.randint(0, 20)}"))
    intervals = [(c, s, s + w - 1) for c in "ab" for s, w in ((0, 90), (100, 10), (150, 1), (200, 180), (900, 5))]
    return rows, intervals


@pytest.fixture(scope="module")
def both(spark):
    rows, intervals = crowd()
    points = spark.createDataFrame(pd.DataFrame(rows, columns=["chrom", "pos", "event_type", "sample"]))
    return points, spark.createDataFrame(pd.DataFrame(intervals, columns=KEYS))


@pytest.mark.parametrize("tile,salts", [(50, 1), (50, 8), (1000, 3)])
def test_points_in_intervals(both, tile, salts):
    points, intervals = both
    got = an.points_in_intervals(points, intervals, tile, salts).groupBy(*KEYS).count().toPandas()
    rows, ivs = crowd()
    want = {(c, s, e): sum(r[0] == c and s <= r[1] <= e for r in rows) for c, s, e in ivs}
    assert dict(zip(zip(got.chrom, got.start_bp, got.end_bp), got["count"])) == {k: v for k, v in want.items() if v}


def test_all_statistics(both):
    points, intervals = both
    out = an.attach_event_stats(intervals, an.event_groups(points, intervals, 60)).toPandas()
    compat = an.attach_event_stats(intervals, an.event_groups(points, intervals, 60), gini_compat=True).toPandas()
    rows, ivs = crowd()
    frame = pd.DataFrame(rows, columns=["chrom", "pos", "event_type", "sample"])
    frame["event_type"] = frame.event_type.str.lower()
    assert len(out) == len(ivs)
    for r in out.itertuples():
        sub = frame[(frame.chrom == r.chrom) & frame.pos.between(r.start_bp, r.end_bp)]
        assert r.n_evt_all == len(sub)
        assert r.n_samp_all == sub["sample"].nunique()
        for t in ("del", "tra", "xtra"):
            mine = sub[sub.event_type == t]
            assert getattr(r, f"n_evt_{t}") == len(mine)
            assert getattr(r, f"n_samp_{t}") == mine["sample"].nunique()
        if sub.empty:
            assert (r.max_junc_per_sample, r.median_junc_per_sample, r.gini_junc, r.frac_TRA) == (0, 0, 0, 0)
            continue
        x = np.sort(sub.groupby("sample").size().to_numpy())
        n = len(x)
        assert r.max_junc_per_sample == x.max()
        assert r.median_junc_per_sample == np.median(x)
        assert r.gini_junc == pytest.approx(((2 * np.arange(1, n + 1) - n - 1) * x).sum() / (n * x.sum()))
        assert r.frac_TRA == pytest.approx(sub.event_type.str.contains("tra").mean())
        assert r.event_type_diversity == sub.event_type.nunique()
        variant = n + 1 - 2 * (np.cumsum(x) / x.sum()).sum() / n
        same = compat[(compat.chrom == r.chrom) & (compat.start_bp == r.start_bp)].gini_junc.iloc[0]
        assert same == pytest.approx(min(max(variant, 0), 1))


def test_map_form(both):
    points, intervals = both
    groups = an.event_groups(points, intervals, 60)
    maps = an.types_as_map(groups).toPandas()
    wide = an.events_by_type(groups, ["del", "tra", "xtra"]).toPandas().set_index(KEYS)
    for r in maps.itertuples():
        for t, n in r.n_evt.items():
            assert wide.loc[(r.chrom, r.start_bp, r.end_bp), f"n_evt_{t}"] == n
    out = an.attach_event_stats(intervals, groups, types_as="map").toPandas()
    assert len(out) == intervals.count()
    for r in out.itertuples():
        assert sum(r.n_evt.values()) == r.n_evt_all


def test_any_number_of_types(spark):
    points = spark.createDataFrame([(i, "chr1", 5, f"t{i}", "s") for i in range(1200)], "event_id int, chrom string, pos int, event_type string, sample string")
    intervals = spark.createDataFrame([("chr1", 1, 9)], "chrom string, start_bp int, end_bp int")
    groups = an.event_groups(points, intervals, 60)
    assert len(an.event_types(groups)) == 1200
    row = an.attach_event_stats(intervals, groups, types_as="map").first()
    assert row["event_type_diversity"] == len(row["n_samp"]) == 1200


def test_percentiles_with_infinities(spark):
    x = np.arange(1000.0)
    x[::10] = np.inf
    x[5] = -np.inf
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    for rows in (50, 10**6):
        assert rb.exact_percentiles(df, "x", [0.0, 0.25, 0.5, 1.0], rows) == [-np.inf, 277.75, 555.5, np.inf]


def test_no_events(both):
    _, intervals = both
    out = an.attach_event_stats(intervals, None)
    assert out.columns == [*KEYS, *an.STAT_DEFAULTS]
    assert out.agg(F.sum("n_evt_all")).first()[0] == 0


def test_bins_in_intervals(spark):
    bins = spark.createDataFrame(
        [("a", s, s + 9, 1.0, 2.0, 0.01) for s in range(0, 200, 10)],
        "chrom string, start bigint, end bigint, lam double, obs double, kb double",
    )
    intervals = spark.createDataFrame([("a", 20, 59), ("a", 95, 120)], "chrom string, start_bp bigint, end_bp bigint")
    got = {r.start_bp: (r.obs_sum, round(r.exp_sum, 9)) for r in an.interval_obs_exp(bins, intervals, 30).collect()}
    assert got == {20: (8.0, 0.04), 95: (4.0, 0.02)}


@pytest.mark.parametrize("rows", [5, 10**6])
@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_percentiles(spark, rows, n):
    x = np.random.default_rng(n).normal(size=n).round(1)
    x[: n // 3] = 0.5
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    shares = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    assert rb.exact_percentiles(df, "x", shares, rows) == pytest.approx(np.quantile(x, shares))
    assert rb.iqr_scale(df, "x", rows) == pytest.approx(max(np.subtract(*np.percentile(x, [75, 25])), 1e-9))
    mad = 1.4826 * np.median(np.abs(x - np.median(x)))
    assert rb.mad_scale(df, "x", rows) == pytest.approx(max(mad, 1e-9))


def segments(spark, n=12):
    rng = np.random.default_rng(2)
    rows = [(s, o, float(rng.poisson(2)), float(rng.random() + 0.5), 1.0 + o % 2) for s in range(n) for o in range(6)]
    return pd.DataFrame(rows, columns=["seg_id", "off", "y", "lam", "kb"])


def test_losses_and_calibration(spark):
    pdf = segments(spark)
    df = spark.createDataFrame(pdf)
    nll = (pdf.lam * pdf.kb - pdf.y * np.log(pdf.lam)).groupby(pdf.seg_id).sum()
    kb = pdf.groupby("seg_id").kb.sum()
    assert rb.mean_nll(df).first().nll == pytest.approx(nll.mean())
    assert rb.weighted_nll(df).first().loss == pytest.approx((nll / kb * 30).mean())
    res = (pdf.y - pdf.lam * pdf.kb).groupby(pdf.seg_id).mean()
    iqr = np.subtract(*np.percentile(res, [75, 25]))
    w = np.where(res.abs() <= iqr, 1.0, iqr / (res.abs() + 1e-9))
    got = rb.huber_weights(rb.segment_residual(df), factor=1.0).toPandas().sort_values("seg_id")
    assert got.w.to_numpy() == pytest.approx(w)
    row = rb.calibrate_scale(df, c=4.0, factor=1.0).first()
    y, mu = pdf.groupby("seg_id").y.sum(), (pdf.lam * pdf.kb).groupby(pdf.seg_id).sum()
    assert row.c_new == pytest.approx((w * y).sum() / (w * mu / 4.0).sum())
    scaled = rb.apply_scale(df, row.c_new, 4.0)
    assert rb.calibrate_scale(scaled, c=row.c_new, factor=1e9).first().num == pytest.approx(y.sum())
    empty = df.withColumn("y", F.lit(0.0))
    assert rb.calibrate_scale(empty, c=1.5).first().c_new == 1.5


def test_objective_ignores_empty_bins(spark):
    pdf = segments(spark)
    padded = pd.concat([pdf, pdf.assign(kb=0.0, y=99.0)])
    a = rb.robust_objective(spark.createDataFrame(pdf)).first().objective
    b = rb.robust_objective(spark.createDataFrame(padded)).first().objective
    assert a == pytest.approx(b)


@pytest.mark.parametrize("reverse,inclusive", [(False, True), (False, False), (True, True)])
def test_running_equals_one_window(spark, reverse, inclusive):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 300), "t": rng.permutation(300), "v": rng.normal(size=300)})
    df = spark.createDataFrame(pdf).withColumn("b", F.floor(F.col("t") / 17))
    out = running(df, ["k"], "b", ["t"], {
        "s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))},
        inclusive=inclusive, reverse=reverse).toPandas()
    for _, part in out.groupby("k"):
        part = part.sort_values("t", ascending=not reverse)
        shift = 0 if inclusive else 1
        for name, want in (("s", part.v.cumsum()), ("hi", part.v.cummax()), ("lo", part.v.cummin())):
            assert part[name].to_numpy() == pytest.approx(want.shift(shift).to_numpy(), nan_ok=True)


def disjoint(rng, n, longest):
    """Intervals of two sequences that do not overlap; some long, some of one position."""
    rows = []
    for chrom in ("a", "b"):
        at = int(rng.integers(0, 50))
        for _ in range(n):
            end = at + int(rng.integers(0, longest)) * int(rng.integers(0, 2))
            rows.append((chrom, at, end))
            at = end + 1 + int(rng.integers(0, 30)) * int(rng.integers(0, 2))
    return pd.DataFrame(rows, columns=["chrom", "start_bp", "end_bp"])


@pytest.mark.parametrize("longest,parts", [(5, 3), (400, 40)])
def test_asof_equals_the_containment_join(spark, longest, parts):
    rng = np.random.default_rng(longest)
    intervals = disjoint(rng, 60, longest)
    top = int(intervals.end_bp.max()) + 60
    points = pd.DataFrame({
        "chrom": rng.choice(["a", "b", "c"], 800), "pos": rng.integers(-20, top, 800), "_row": rng.integers(0, 3, 800), "start_bp_x": 1.5})
    points.loc[:300, ["chrom", "pos"]] = ["a", int(intervals.start_bp[30])]  # a crowded position
    frame = spark.createDataFrame(points).union(spark.sql("SELECT null, 5L, 1L, 0.5 UNION ALL SELECT 'a', null, 1L, 0.5"))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = an.points_in_disjoint_intervals(frame, spark.createDataFrame(intervals)).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    both = points.merge(intervals, on="chrom")
    want = both[(both.start_bp <= both.pos) & (both.pos <= both.end_bp)]
    cols = list(want.columns)
    assert sorted(map(tuple, got[cols].to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist())) and len(want) > 200


def test_asof_without_rows(spark):
    points = spark.createDataFrame([("a", 3)], "chrom string, pos bigint")
    intervals = spark.createDataFrame([("a", 1, 5), ("a", 1, 5)], "chrom string, start_bp bigint, end_bp bigint")
    assert [tuple(r) for r in an.points_in_disjoint_intervals(points, intervals).collect()] == [("a", 3, 1, 5)]
    assert an.points_in_disjoint_intervals(points.limit(0), intervals).count() == 0
    assert an.points_in_disjoint_intervals(points, intervals.limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 1000, 10**7])
def test_sums_by_differences(spark, block):
    rng = np.random.default_rng(block % 11)
    starts = np.cumsum(rng.integers(10, 16, 200))
    bins = pd.DataFrame({"chrom": np.repeat(["a", "b"], 100), "start": starts, "end": starts + 9,
                         "obs": rng.integers(0, 5, 200).astype(float), "lam": rng.random(200), "kb": 0.01})
    bins.loc[50, ["end"]] = bins.start[51] - 1
    low = rng.integers(0, int(starts[-1]), 150)
    intervals = pd.DataFrame({"chrom": rng.choice(["a", "b", "c"], 150), "start_bp": low, "end_bp": low + rng.integers(0, 900, 150)})
    inner = [("a", int(bins.start[4]) + 2, int(bins.start[4]) + 5)]  # inside one bin: holds none
    frame = spark.createDataFrame(pd.concat([intervals, intervals[:20], pd.DataFrame(inner, columns=intervals.columns)]))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in an.interval_sums(spark.createDataFrame(bins), frame, block).collect()}
    want = {tuple(r)[:3]: tuple(r)[3:] for r in an.interval_obs_exp(spark.createDataFrame(bins), frame, 50).collect()}
    assert got.keys() == want.keys() and inner[0] not in got and len(got) > 50
    assert all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
