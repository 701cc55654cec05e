import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hotspan.operators import fdr as fd
from hotspan.operators.ordered import md5_unit


def frame(spark, p):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(p)), "p": p}))


def plain_q(p, pi0=1.0):
    p = np.clip(np.asarray(p, float), 0, 1)
    order = np.argsort(p, kind="stable")
    q = pi0 * len(p) * p[order] / np.arange(1, len(p) + 1)
    q = np.clip(np.minimum.accumulate(q[::-1])[::-1], 0, 1)
    out = np.empty_like(q)
    out[order] = q
    return out


def values(seed, n=500):
    rng = np.random.default_rng(seed)
    p = rng.random(n) ** 2
    p[: n // 3] = 1.0  # a third of all rows share one value
    p[n // 3: n // 2] = np.round(p[n // 3: n // 2], 1)
    return rng.permutation(p)


def test_small_case(spark):
    got = fd.bh_qvalues(frame(spark, [0.01, 0.04, 0.03, 0.005])).toPandas().sort_values("id")
    assert got.q.to_numpy() == pytest.approx([0.02, 0.04, 0.04, 0.02])


@pytest.mark.parametrize("rows", [3, 70, 10**6])
def test_equals_plain(spark, rows):
    p = values(1)
    got = fd.bh_qvalues(frame(spark, p), rows_per_block=rows).toPandas().sort_values("id")
    assert len(got) == len(p)
    assert got.q.to_numpy() == pytest.approx(plain_q(p))
    got = fd.storey_qvalues(frame(spark, p), 0.3, rows_per_block=rows).toPandas().sort_values("id")
    assert got.q.to_numpy() == pytest.approx(plain_q(p, 0.3))


def test_lambda_grid():
    assert len(fd.lambda_grid()) == 91
    assert len(fd.lambda_grid(0.20)) == 76
    assert fd.lambda_grid(1.0, 2.0, 0.5) == [0.5]


def test_pi0_grid(spark):
    p, grid = values(2), fd.lambda_grid(0.1, 0.9, 0.1)
    p[:20] = grid[3]  # exactly on a grid point: not above it
    got = {round(r["lambda"], 6): r.pi0 for r in fd.pi0_grid(frame(spark, p), grid).collect()}
    for x in grid:
        assert got[round(x, 6)] == pytest.approx(np.clip(np.mean(p > x) / (1 - x), 0.01, 1.0))


def test_pi0_of_nothing(spark):
    rows = fd.pi0_grid(frame(spark, [0.5]).limit(0)).collect()
    assert [(r["lambda"], r.pi0) for r in rows] == [(0.5, 1.0)]
    assert fd.pi0_bootstrap(frame(spark, [0.5]).limit(0)).first().pi0 == 1.0


def test_bootstrap_follows_expectation(spark):
    df = frame(spark, np.random.default_rng(3).random(400) ** 3)
    grid = fd.lambda_grid(0.1, 0.8, 0.1)
    drawn = fd.pi0_mse(df, grid, replicates=4000, seed=1, floor=0.0, ceil=9.0).toPandas().sort_values("lambda")
    exact = fd.pi0_mse(df, grid, closed_form=True, floor=0.0, ceil=9.0).toPandas().sort_values("lambda")
    assert drawn.mse.to_numpy() == pytest.approx(exact.mse.to_numpy(), rel=0.15)
    again = fd.pi0_mse(df, grid, replicates=4000, seed=1, floor=0.0, ceil=9.0).toPandas().sort_values("lambda")
    assert again.mse.to_numpy() == pytest.approx(drawn.mse.to_numpy())
    best = fd.pi0_bootstrap(df, grid, closed_form=True, floor=0.0, ceil=9.0).first()
    assert best["lambda"] == exact.loc[exact.mse.idxmin(), "lambda"]


@pytest.mark.parametrize("n,share", [(0, 0.5), (7, 0.0), (7, 1.0), (1, 0.3), (12, 0.25), (40, 0.97), (900, 0.004)])
def test_binomial_by_inverse_distribution(n, share):
    chance = [math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1)]
    upto = np.cumsum(chance)
    for unit in np.linspace(0.0005, 0.9995, 400):
        assert fd._binomial(n, share, float(unit)) == int(np.searchsorted(upto, unit - 1e-13))


def test_binomial_of_many():
    for n, share in ((10**9, 0.3), (10**12, 1e-11), (10**7, 1 - 1e-6)):
        got = [fd._binomial(n, share, u) for u in (0.02275013, 0.5, 0.97724987)]
        mean, dev = n * share, math.sqrt(n * share * (1 - share))
        assert np.abs((np.array(got) - mean) / dev - [-2, 0, 2]).max() < (0.3 if dev < 10 else 0.01)


def test_resampled_tails_add_up(spark):
    cells = [5, 0, 3, 0, 0, 9, 0]
    tails = [fd._drawn_tails(cells, 3, b) for b in range(3000)]
    assert all(a >= b >= 0 for row in tails for a, b in zip([sum(cells), *row], row))
    assert np.mean(tails, axis=0) == pytest.approx(np.cumsum(cells[::-1])[::-1][1:], abs=0.15)
    assert {row[-1] for row in tails} == {0}
    unit = spark.range(1).select(md5_unit(F.lit(4), F.lit(91), seed=7)).first()[0]
    assert unit == fd._unit(7, 4, 91)


def test_fdr_methods(spark):
    p = values(4)
    bh = fd.fdr(frame(spark, p), "bh").toPandas().sort_values("id").fdr.to_numpy()
    storey = fd.fdr(frame(spark, p), "storey", replicates=50, seed=2).toPandas().sort_values("id").fdr.to_numpy()
    assert bh == pytest.approx(plain_q(p))
    assert (storey <= bh + 1e-12).all()
    order = np.argsort(p, kind="stable")
    assert (np.diff(storey[order]) >= -1e-12).all()


def test_missing_p_counts_as_one(spark):
    p = [0.01, 0.04, None, float("nan"), 0.5, float("inf"), float("-inf")]
    df = spark.createDataFrame(list(enumerate(p)), "id int, p double")
    want = plain_q([0.01, 0.04, 1, 1, 0.5, 1, 1])
    assert [r["q"] for r in fd.bh_qvalues(df).orderBy("id").collect()] == pytest.approx(want)
    assert [r["fdr"] for r in fd.fdr(df, pi0=1.0).orderBy("id").collect()] == pytest.approx(want)
    qq = fd.qq_table(df).orderBy("rank").collect()
    assert [r["observed"] for r in qq] == pytest.approx(-np.log10([0.01, 0.04, 0.5, 1, 1, 1, 1]))
    (share,) = [r["pi0"] for r in fd.pi0_grid(df, [0.5]).collect()]
    assert share == 1.0


def test_more_crowded_values_than_any_list(spark):
    p = np.repeat(np.arange(1, 1501) / 2000, 3)
    got = fd.bh_qvalues(frame(spark, p), rows_per_block=100).toPandas().sort_values("id")
    assert got.q.to_numpy() == pytest.approx(plain_q(p))


@pytest.mark.parametrize("rows", [7, 1 << 20])
def test_qq(spark, rows, monkeypatch):
    monkeypatch.setattr(fd, "RANKS_PER_ROW", rows)
    p = values(5)
    got = fd.qq_table(frame(spark, p)).toPandas().sort_values("rank")
    assert list(got["rank"]) == list(range(1, len(p) + 1))
    assert got.observed.to_numpy() == pytest.approx(-np.log10(np.clip(np.sort(p), 1e-300, 1)))
    assert got.expected.iloc[0] == pytest.approx(-math.log10(0.5 / len(p)))
    thin = fd.qq_table(frame(spark, p), per_decade=7).toPandas().sort_values("rank")
    wanted = {math.ceil(10 ** (k / 7) - 1e-9) for k in range(80)} | {len(p)}
    assert list(thin["rank"]) == [r for r in got["rank"] if r in wanted]
    assert thin.merge(got, on=["rank", "expected", "observed"]).shape == thin.shape


def test_qq_shuffles_and_empty_tables(spark):
    plan = fd.qq_table(frame(spark, values(5)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3
    assert fd.qq_table(frame(spark, np.array([0.5])).limit(0)).count() == 0
    assert fd.qq_table(frame(spark, np.array([0.5])).limit(0), per_decade=5).count() == 0
