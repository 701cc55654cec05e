import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hotspan.operators.poisson import LinearRate, add_linear_rate, fit_wide, tree_sum
from hotspan.operators.rate import add_rate, fit_rate

EMBEDDINGS = "/root/testdata/sf0.01/embeddings.parquet"


def sample(spark, n=2000, d=5, seed=0, scale=0.4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * scale
    kb, w = rng.uniform(0.5, 4, n), rng.uniform(0.2, 2, n)
    y = rng.poisson(kb * np.exp(0.3 + x @ np.linspace(-1, 1, d))).astype(float)
    frame = pd.DataFrame({"features": list(x), "y": y, "kb": kb, "w": w})
    return spark.createDataFrame(frame).repartition(5)


@pytest.mark.parametrize("reg", [0.0, 1e-3, 0.1])
def test_equals_least_squares(spark, reg):
    rows = sample(spark)
    wide = fit_rate(rows, "w", reg, solver="lbfgs")
    known = fit_rate(rows, "w", reg, max_iter=60, tol=1e-12, solver="irls").model
    assert np.allclose(wide.coefficients, known.coefficients.toArray(), atol=1e-6)
    assert wide.intercept == pytest.approx(known.intercept, abs=1e-6)
    pairs = add_rate(wide, rows).select(F.col("lam").alias("a"), "features", "kb", "y", "w")
    assert np.allclose(*zip(*[(r["a"], r["lam"]) for r in add_rate(fit_rate(rows, "w", reg, 60, 1e-12), pairs).collect()]), rtol=1e-6)


def test_equals_least_squares_on_embeddings(spark):
    rows = spark.read.parquet(EMBEDDINGS).select(
        F.col("embedding").alias("features"), (F.col("vec_id") % 7).cast("double").alias("y"), (1 + F.col("vec_id") % 3).cast("double").alias("kb"))
    wide, known = fit_rate(rows, solver="lbfgs"), fit_rate(rows, max_iter=100, tol=1e-12, solver="irls").model
    assert len(wide.coefficients) == 64 and wide.gradient < 1e-8
    assert np.allclose(wide.coefficients, known.coefficients.toArray(), atol=1e-6)


def test_one_hot_groups_give_their_means(spark):
    rows = spark.range(600).select(
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("id") % 10).cast("float")).alias("features"),
        (F.col("id") % 4 + 1).cast("double").alias("y"), (1 + F.col("id") % 3).cast("double").alias("kb"), (F.col("id") % 10).alias("g"))
    model = fit_wide(rows, reg=0.0)
    got = add_rate(model, rows).groupBy("g").agg(F.max("lam").alias("lam"), (F.sum("y") / F.sum("kb")).alias("want")).collect()
    assert all(r["lam"] == pytest.approx(r["want"], rel=1e-6) for r in got)


def test_ten_thousand_columns(spark):
    n, d = 100, 10_000
    rows = spark.range(n).select(
        F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(i % n == F.col("id"), 1.0).otherwise(0.0)).alias("features"),
        (F.col("id") % 5 + 1).cast("double").alias("y"), F.lit(2.0).alias("kb")).repartition(3)
    model = fit_rate(rows, reg=1e-4)
    assert isinstance(model, LinearRate) and len(model.coefficients) == d and model.gradient < 1e-8 and model.passes < 100
    lam = {r["y"]: r["lam"] for r in add_rate(model, rows).select("y", "lam").collect()}
    assert lam[1.0] < lam[3.0] < lam[5.0]


def test_odd_rows(spark):
    rows = sample(spark, 300, 2).select("features", "y", "kb", "w")
    odd = spark.createDataFrame([([1.0, 2.0], 5.0, 0.0, 1.0), ([1.0, 2.0], None, 1.0, 1.0), (None, 1.0, 1.0, 1.0), ([9.0, 9.0], 3.0, 1.0, 0.0)], rows.schema)
    a, b = fit_wide(rows, "w"), fit_wide(rows.union(odd), "w")
    assert np.allclose(a.coefficients, b.coefficients, atol=1e-7)
    assert [r["lam"] for r in add_linear_rate(a, odd).collect()][2] is None
    assert fit_wide(rows.limit(0)).coefficients.size == 0
    assert fit_wide(rows.withColumn("y", F.lit(0.0))).intercept < -40
    ragged = spark.createDataFrame([([1.0], 1.0, 1.0, 1.0), ([1.0, 2.0], 1.0, 1.0, 1.0)], rows.schema)
    with pytest.raises(Exception, match="one width"):
        fit_wide(ragged.coalesce(1))
    with pytest.raises(ValueError):
        fit_rate(rows, solver="newton")


def test_sums_in_a_tree(spark):
    parts = spark.range(0, 5000, 1, 50).select(F.col("id").cast("int").alias("slot"), F.lit(np.arange(3.0).tobytes()).alias("sums"))
    assert tree_sum(parts, 5000).tolist() == [0.0, 5000.0, 10000.0]
