"""Weighted Poisson regression for vectors of any width.

The normal equations of iteratively reweighted least squares are as large as
the square of the width. Here only gradients are computed: one pass over the
rows gives loss and gradient together, summed inside each task and then in a
tree of bounded fan-in, and limited-memory BFGS takes the steps. The driver
holds a few dozen vectors of the width, whatever the number of rows.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums that one task of the tree, and at last the driver, adds up.
FAN_IN = 32
#: Steps whose changes the approximation of the curvature remembers.
MEMORY = 10
#: Exponents are held below this, so that a bad step has a large but finite loss.
MOST = 50.0
_PART = "slot int, sums binary"


@dataclass(frozen=True)
class LinearRate:
    """exp(intercept + coefficients . features), the rate per unit of exposure."""

    coefficients: np.ndarray
    intercept: float
    scale: float = 1.0
    #: Passes over the rows, and the largest gradient component left, as a share of all counts.
    passes: int = 0
    gradient: float = 0.0


def _matrix(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Equally long lists as rows of a matrix."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if lists.null_count or (len(sizes) and (sizes != (sizes[0] if width is None else width)).any()):
        raise ValueError("vectors must have one width and no nulls")
    flat = lists.flatten()
    if flat.null_count:
        raise ValueError("vectors must not hold nulls")
    width = width if width is not None else int(sizes[0]) if len(sizes) else 0
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(sizes), width)


def tree_sum(parts: DataFrame, tasks: int) -> np.ndarray | None:
    """The sum of the double vectors in ``sums``; ``slot`` is below ``tasks``."""
    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in rows.column("sums"))
        return pa.table({"slot": pa.array([rows.column("slot")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    while tasks > FAN_IN:
        parts = parts.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("int")).groupBy("slot").applyInArrow(add, _PART)
        tasks = -(-tasks // FAN_IN)
    rows = parts.orderBy("slot").select("sums").collect() if tasks > 1 else parts.select("sums").collect()
    return sum(np.frombuffer(r["sums"]) for r in rows) if rows else None


def _pass(data: DataFrame, tasks: int, of_batch: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of a vector computed from (vectors, y, log kb, weight)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y, offset, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                part = of_batch(_matrix(batch.column(0)), y, offset, weight)
                if total is not None and len(total) != len(part):
                    raise ValueError("vectors must have one width")
                total = part if total is None else total + part
        if total is not None:
            slot = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([slot, pa.array([total.tobytes()], pa.binary())], ["slot", "sums"])

    return tree_sum(data.mapInArrow(run, _PART), tasks)


def _direction(gradient: np.ndarray, scaling: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The two loops of L-BFGS, started from a diagonal inverse curvature."""
    q, alphas = gradient.copy(), []
    for s, t in reversed(steps):
        alpha = (s @ q) / (s @ t)
        q -= alpha * t
        alphas.append(alpha)
    q *= scaling
    if steps:
        s, t = steps[-1]
        q *= (s @ t) / (t @ (scaling * t))
    for (s, t), alpha in zip(steps, reversed(alphas)):
        q += (alpha - (t @ q) / (s @ t)) * s
    return -q


def fit_wide(
    rows: DataFrame,
    weight: str | None = None,
    reg: float = 1e-3,
    max_passes: int = 200,
    tol: float = 1e-9,
) -> LinearRate:
    """Coefficients of ``features`` by weighted Poisson likelihood, with
    exposure ``kb`` as offset and ``y`` as the count.

    ``reg`` is the penalty of iteratively reweighted least squares: the square
    of the coefficients times half of reg times all weighted counts. The fit
    ends when no gradient component is above ``tol`` times all weighted
    counts; a warning says so if ``max_passes`` come first. Rows without
    exposure, with a null or without weight do not count. Without counts the
    rate is zero, at the least exponent.
    """
    weights = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = rows.select(
        F.col("features").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"),
        F.log(F.col("kb").cast("double")).alias("o"), weights.alias("w"),
    ).where((F.col("kb") > 0) & (weights > 0)).dropna()
    tasks = data.rdd.getNumPartitions()

    def moments(x, y, offset, w):
        exposure = w * np.exp(offset)
        return np.concatenate([[w @ y, exposure.sum()], exposure @ (x * x)])

    found = _pass(data, tasks, moments)
    if found is None or not found[0] > 0:
        return LinearRate(np.zeros(0 if found is None else len(found) - 2), -MOST)
    counts, exposure, squares = found[0], found[1], found[2:]
    penalty = reg * counts
    beta = np.zeros(len(squares) + 1)
    beta[-1] = math.log(counts / exposure)
    scaling = 1.0 / np.append(squares * (counts / exposure) + penalty + 1e-12 * counts, counts)

    def evaluate(at: np.ndarray) -> tuple[float, np.ndarray]:
        def loss(x, y, offset, w):
            eta = np.minimum(x @ at[:-1] + at[-1] + offset, MOST)
            rest = w * (np.exp(eta) - y)
            return np.concatenate([[w @ (np.exp(eta) - y * eta)], rest @ x, [rest.sum()]])

        total = _pass(data, tasks, loss)
        slope = total[1:].copy()
        slope[:-1] += penalty * at[:-1]
        return total[0] + 0.5 * penalty * float(at[:-1] @ at[:-1]), slope

    value, gradient = evaluate(beta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    passes = 2
    while passes < max_passes and np.abs(gradient).max() > tol * counts:
        move = _direction(gradient, scaling, steps)
        slope = float(move @ gradient)
        if slope >= 0:  # rounding has spoilt the memory
            steps, move = [], -scaling * gradient
            slope = float(move @ gradient)
        size = 1.0
        while passes < max_passes:
            new_value, new_gradient = evaluate(beta + size * move)
            passes += 1
            if new_value <= value + 1e-4 * size * slope + 1e-13 * abs(value):
                break
            size *= 0.5 if size > 1e-3 else 0.1
            if size < 1e-12:
                new_value, new_gradient, size = value, gradient, 0.0
                break
        if size == 0.0 or new_value > value + 1e-12 * abs(value):
            break
        s, t = size * move, new_gradient - gradient
        if s @ t > 1e-12 * np.linalg.norm(s) * np.linalg.norm(t):
            steps = [*steps, (s, t)][-MEMORY:]
        beta, value, gradient = beta + s, new_value, new_gradient
    left = float(np.abs(gradient).max() / counts)
    if left > tol:
        logging.getLogger(__name__).warning("the fit ended after %d passes with a gradient of %.1e", passes, left)
    return LinearRate(beta[:-1], float(beta[-1]), passes=passes, gradient=left)


def add_linear_rate(model: LinearRate, rows: DataFrame) -> DataFrame:
    """Add ``lam``, the modelled rate per unit of length. A null vector has a null rate."""
    shared = rows.sparkSession.sparkContext.broadcast((model.coefficients, model.intercept))

    @F.arrow_udf("double")
    def exponent(vectors: pa.Array) -> pa.Array:
        beta, intercept = shared.value
        known = vectors.drop_null()
        values = np.full(len(vectors), np.nan)
        values[vectors.is_valid().to_numpy(zero_copy_only=False)] = _matrix(known, len(beta)) @ beta + intercept
        return pa.array(values, mask=vectors.is_null().to_numpy(zero_copy_only=False))

    eta = exponent(F.col("features").cast("array<double>"))
    rate = F.exp(F.least(eta, F.lit(MOST))) * F.lit(float(model.scale))
    return rows.withColumn("lam", F.when(F.col("features").isNotNull(), F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1e6))))
