"""The expected rate per unit of length."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotspan.functions.numeric import interval_length, length_kb
from hotspan.functions.scores import bin_loglike
from hotspan.operators.ordered import join_per_key
from hotspan.operators.poisson import LinearRate, add_linear_rate, fit_wide
from hotspan.operators.smooth import rolling_rate

#: Widest vectors that the normal equations are solved for.
WIDEST = 4096

def rate_baseline(bins: DataFrame, unit: float = 1000.0) -> DataFrame:
    """Constant rate per sequence: all observed over all exposure.

    Needs chrom, start, end, y; adds lam_pred.
    """
    kb = length_kb(interval_length("start", "end"), unit)
    rates = bins.groupBy("chrom").agg((F.sum("y") / F.sum(kb)).alias("lam_pred"))
    return join_per_key(bins, rates, ["chrom"], F.xxhash64("start"))


@dataclass(frozen=True)
class RateModel:
    """A fitted Poisson regression and the scale its rates are multiplied by."""

    model: GeneralizedLinearRegressionModel
    scale: float = 1.0


def _design(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "_vec": array_to_vector(F.transform("features", lambda x: x.cast("double"))),
        "_log_kb": F.log("kb"),
    })


def fit_rate(
    rows: DataFrame,
    weight: str | None = None,
    reg: float = 1e-3,
    max_iter: int = 25,
    tol: float = 1e-6,
    solver: str = "auto",
) -> RateModel | LinearRate:
    """Log-linear rate of ``features`` by weighted Poisson likelihood, with
    exposure ``kb`` as offset and ``y`` as the count.

    ``solver`` is ``irls``, ``lbfgs``, or ``auto``: the first for vectors up to
    ``WIDEST``, the second beyond. Both end at the same coefficients.
    """
    if solver not in ("auto", "irls", "lbfgs"):
        raise ValueError(f"unknown solver {solver}")
    if solver == "auto":
        first = rows.select(F.size("features").alias("n")).first()
        solver = "lbfgs" if first is not None and first["n"] > WIDEST else "irls"
    if solver == "lbfgs":
        return fit_wide(rows, weight, reg)
    glm = GeneralizedLinearRegression(
        family="poisson", link="log", featuresCol="_vec", labelCol="y", offsetCol="_log_kb",
        predictionCol="_mu", regParam=reg, maxIter=max_iter, tol=tol,
    )
    if weight:
        glm = glm.setWeightCol(weight)
    keep = ["_vec", "_log_kb", "y"] + ([weight] if weight else [])
    data = _design(rows.where(F.col("kb") > 0)).select(*keep)
    return RateModel(glm.fit(data))


def add_rate(model: RateModel | LinearRate, rows: DataFrame) -> DataFrame:
    """Add ``lam``, the modelled rate per unit of length."""
    if isinstance(model, LinearRate):
        return add_linear_rate(model, rows)
    out = model.model.transform(_design(rows))
    rate = F.col("_mu") / F.col("kb") * F.lit(float(model.scale))
    return out.withColumn(
        "lam", F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1e6))
    ).drop("_vec", "_log_kb", "_mu")


def add_rate_by(make_predict: Callable, rows: DataFrame, batch_size: int = 4096) -> DataFrame:
    """Add ``lam`` from a user model. ``make_predict`` loads the model once per
    worker and returns a function from a batch of vectors to rates."""
    width = rows.select(F.size("features").alias("n")).first()["n"]
    rate = predict_batch_udf(
        make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    return rows.withColumn("lam", F.least(F.greatest(rate("features"), F.lit(1e-9)), F.lit(1e6)))


def predict_rate(rows: DataFrame, roll_width: int = 1) -> DataFrame:
    """Prediction rows of (segment, bin) rows that carry ``lam``: the rate,
    rolled if asked, the raw count, and the log-likelihood of the raw rate."""
    scored = rows.withColumns({
        "bin_loglike": bin_loglike("y", "lam", "kb"),
        "obs_count": F.col("y"),
    })
    rolled = rolling_rate(scored, roll_width)
    keep = [c for c in ("seg_id", "split") if c in rows.columns]
    return rolled.select(
        *keep, "chrom", "start", "end", F.col("lam").alias("lam_pred"), "obs_count", "bin_loglike"
    )
