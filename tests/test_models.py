import contextlib
import io
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hotspan.operators import mixture as mx
from hotspan.operators.scan import sample_scores, scan_pairs
from hotspan.session import stage_table
from hotspan.functions.tail import Mixture
from hotspan.operators.mixture import (
    EMPTY_MIXTURE,
    drop_spikes,
    fit_mixture,
    fit_mixture_auto,
    mixture_policy,
)
from hotspan.operators.rate import add_rate, add_rate_by, fit_rate, predict_rate, rate_baseline


def scores(spark, parts):
    rng = np.random.default_rng(0)
    z = np.concatenate([rng.normal(mu, sig, n) for mu, sig, n in parts])
    return spark.createDataFrame(pd.DataFrame({"score": np.expm1(np.maximum(z, 0))}))


def test_two_components(spark):
    mix = fit_mixture(scores(spark, [(0.8, 0.1, 600), (2.0, 0.2, 1400)]), 2, seed=1, max_iter=60)
    assert mix.mu == pytest.approx((0.8, 2.0), abs=0.05)
    assert mix.w == pytest.approx((0.3, 0.7), abs=0.05)
    assert mix.sig == pytest.approx((0.1, 0.2), abs=0.05)


def test_size_by_bic(spark):
    one = fit_mixture_auto(scores(spark, [(1.0, 0.2, 800)]), k_max=2, n_init=1, max_iter=40)
    assert one.k == 1 and one.mu[0] == pytest.approx(1.0, abs=0.03)
    two = fit_mixture_auto(scores(spark, [(0.8, 0.1, 400), (2.0, 0.1, 400)]), k_max=2, n_init=1, max_iter=40)
    assert two.k == 2


def test_spikes():
    mix = drop_spikes(Mixture((0.5, 0.25, 0.25), (0.01, 0.3, 0.02), (0.01, 0.2, 0.2)))
    assert mix.w == (0.5, 0.5) and mix.mu == (0.3, 0.02)
    alone = Mixture((1.0,), (0.01,), (0.01,))
    assert drop_spikes(alone) == alone


def test_degenerate_samples(spark):
    empty = scores(spark, [(1.0, 0.1, 5)]).limit(0)
    assert fit_mixture_auto(empty) == EMPTY_MIXTURE
    stand_in = mixture_policy(empty, 3)
    assert stand_in.w == pytest.approx((0.5, 0.5))
    assert stand_in.mu == pytest.approx((math.log1p(0.1), math.log1p(0.2)), abs=1e-4)
    equal = scores(spark, [(1.0, 0.0, 50)])
    assert fit_mixture(equal, 3).mu == pytest.approx((1.0,), abs=1e-4)
    assert mixture_policy(equal, 3, auto=True).k == 1


def test_rate_model_recovers_rates(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2))
    kb = rng.random(3000) + 0.5
    y = rng.poisson(np.exp(0.5 + x @ [0.8, -0.4]) * kb).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"features": list(x), "kb": kb, "y": y, "w": 1.0}))
    model = fit_rate(df, "w", reg=0.0)
    assert list(model.model.coefficients) == pytest.approx([0.8, -0.4], abs=0.05)
    got = add_rate(model, df).toPandas()
    want = np.exp(0.5 + np.stack(got.features) @ [0.8, -0.4])
    assert np.median(np.abs(got.lam / want - 1)) < 0.05


def test_user_model(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "features array<double>")
    def make():
        return lambda batch: batch.sum(axis=1)
    assert sorted(r.lam for r in add_rate_by(make, df).collect()) == [3.0, 7.0]


def test_baseline_and_prediction(spark):
    bins = spark.createDataFrame([("a", 0, 999, 3.0), ("a", 1000, 2999, 0.0), ("b", 0, 499, 1.0)],
                                 "chrom string, start bigint, end bigint, y double")
    got = {(r.chrom, r.start): r.lam_pred for r in rate_baseline(bins).collect()}
    assert got == {("a", 0): 1.0, ("a", 1000): 1.0, ("b", 0): 2.0}
    rows = bins.withColumns({"lam": F.lit(2.0), "kb": F.lit(1.5), "seg_id": F.lit(1), "off": F.col("start")})
    first = predict_rate(rows.where("chrom = 'a'"), 2).orderBy("start").collect()
    assert [r.obs_count for r in first] == [3.0, 0.0]
    assert first[0].bin_loglike == pytest.approx(3 * math.log(2) - 3)


def test_mixture_queries_use_the_defaults_and_return_components(spark, monkeypatch):
    from hotspan.workload import QUERIES, load

    load()
    from hotspan.workload import rates

    asked, found = [], Mixture((0.25, 0.75), (0.5, 2.0), (0.1, 0.3))
    monkeypatch.setattr(rates, "candidates", lambda *_: None)
    monkeypatch.setattr(rates, "sample_scores", lambda *_: None)
    for name in ("fit_mixture_auto", "mixture_policy"):
        monkeypatch.setattr(rates, name, lambda sample, **given: asked.append(given) or found)
    for name in ("G2_fit_mixture_auto", "G3_mixture_policy_auto", "G2_fit_mixture_auto_components", "G3_mixture_policy_auto_components"):
        out = QUERIES[name](spark, "")
    assert asked == [{"keep_spikes": True}, {"auto": True, "keep_spikes": True}] * 2
    assert [tuple(r) for r in out.orderBy("component").collect()] == [(2, 0, 0.25, 0.5, 0.1), (2, 1, 0.75, 2.0, 0.3)]


def test_prepared_scores_are_finite(spark):
    scores = [0.5, 0.5, 0.0, -0.2, -3.0, math.inf, -math.inf, math.nan, None]
    found = mx._prepare(spark.createDataFrame([(s,) for s in scores], "score double"), 1e-4).collect()
    assert sorted((round(r["z"], 4), r["n"]) for r in found) == [(0.0, 1.0), (0.4055, 2.0)]


def test_code_of_the_sampled_scan_is_short_enough_to_be_compiled(spark, monkeypatch):
    rows = [("a", i * 10, i * 10 + 9, 1.0, 0.5, 0.01) for i in range(50)]
    bins = stage_table(spark.createDataFrame(rows, "chrom string, start long, end long, obs double, lam double, kb double"), "bins")
    plans = []
    monkeypatch.setattr(mx, "stage_table", lambda df, name: plans.append(df) or df)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mx._prepare(sample_scores(scan_pairs(bins, 100, partitions=4), 0.05), 1e-4)
        with contextlib.redirect_stdout(io.StringIO()) as out:
            plans[0].explain("codegen")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000  # the JVM interprets longer methods
