"""Gaussian mixture of normalised scores."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.functions.tail import Mixture
from hotspan.session import stage_table

# Stand-in scores for an empty sample, and the stand-in mixture.
EMPTY_SAMPLE = (0.05, 0.10, 0.20)
EMPTY_MIXTURE = Mixture((1.0,), (0.0,), (0.5,))
MIN_SIGMA = 1e-3
SPIKE = 0.05


def _prepare(sample: DataFrame, resolution: float) -> DataFrame:
    """log1p scores on a fine grid with their counts.

    The fit then costs the same for any sample size: the number of distinct
    grid values does not grow with the rows.
    """
    z = F.log1p("score")
    counts = (
        sample.where(F.col("score") >= 0)
        .groupBy((F.round(z / resolution) * resolution).alias("z"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    # every step of the fit reads it again. Infinities and NaN, which compares greater still, go
    # only now: the planner writes the score out at each use in the scan, and with a third one
    # the generated code is too long to be compiled
    return stage_table(counts, "scores").where(F.col("z") < float("inf"))


def drop_spikes(mixture: Mixture) -> Mixture:
    """Without the narrow components next to zero; all stay if none is left."""
    keep = [i for i in range(mixture.k) if not (mixture.mu[i] < SPIKE and mixture.sig[i] < SPIKE)]
    keep = keep or list(range(mixture.k))
    total = sum(mixture.w[i] for i in keep)
    return Mixture(
        tuple(mixture.w[i] / total for i in keep),
        tuple(mixture.mu[i] for i in keep),
        tuple(mixture.sig[i] for i in keep),
    )


def _points(values: list[tuple[float, float]]) -> Mixture:
    total = sum(n for _, n in values)
    return Mixture(
        tuple(n / total for _, n in values), tuple(z for z, _ in values), (MIN_SIGMA,) * len(values)
    )


@dataclass(frozen=True)
class Fit:
    """One start of one size, after some steps."""

    w: np.ndarray
    mu: np.ndarray
    sig: np.ndarray
    #: Log-likelihood of the sample before the last step, and the steps made.
    log_likelihood: float = -math.inf
    steps: int = 0
    done: bool = False

    def mixture(self) -> Mixture:
        order = np.lexsort((self.sig, self.mu))
        return Mixture(*(tuple(map(float, v[order])) for v in (self.w, self.mu, self.sig)))


def _starts(data: DataFrame, sizes: list[int], n_init: int, seed: int) -> list[Fit]:
    """Where the fits of all sizes begin: means at evenly spaced quantiles of
    the sample, all widths those of the sample over the size, equal weights.

    The first start of a size has the plain quantiles; the others move them
    by up to half a step, by a random number of seed, size and start.
    """
    plan = [(k, i) for k in sizes for i in range(n_init if k > 1 else 1)]
    shares = {}
    for k, i in plan:
        moved = np.random.default_rng([seed, k, i]).uniform(-0.5, 0.5, k) if i else np.zeros(k)
        shares[k, i] = [float(x) for x in (np.arange(k) + 0.5 + moved) / k]
    asked = sorted({x for v in shares.values() for x in v})
    n, z = F.col("n"), F.col("z")
    # The grid of scores is bounded, so an exact percentile of it is, too.
    row = data.agg(
        F.expr(f"percentile(z, array({', '.join(f'{x!r}D' for x in asked)}), CAST(n AS BIGINT))").alias("q"),
        F.sum(n).alias("n"), F.sum(n * z).alias("s"), F.sum(n * z * z).alias("ss"),
    ).first()
    at = dict(zip(asked, row["q"]))
    sd = math.sqrt(max(row["ss"] / row["n"] - (row["s"] / row["n"]) ** 2, MIN_SIGMA**2))
    return [
        Fit(np.full(k, 1.0 / k), np.array([at[x] for x in shares[k, i]]), np.full(k, max(sd / k, MIN_SIGMA)))
        for k, i in plan
    ]


def _statistics(data: DataFrame, fits: list[Fit]) -> list[tuple[np.ndarray, float]]:
    """For every fit: (weight, sum and sum of squares of each component), and
    the log-likelihood. One pass over the sample for all fits together."""
    shared = [(f.w, f.mu, f.sig) for f in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((4, len(w))) for w, _, _ in shared]
        for batch in batches:
            z, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for out, (w, mu, sig) in zip(total, shared):
                with np.errstate(divide="ignore"):
                    log_p = np.log(w) - np.log(sig) - 0.5 * math.log(2 * math.pi) - 0.5 * ((z[:, None] - mu) / sig) ** 2
                top = log_p.max(axis=1, keepdims=True)
                share = np.exp(log_p - top)
                norm = share.sum(axis=1, keepdims=True)
                share *= n[:, None] / norm
                out[0] += share.sum(axis=0)
                out[1] += z @ share
                out[2] += (z * z) @ share
                out[3, 0] += n @ (np.log(norm) + top)[:, 0]
        rows = [(i, j, *t[:, j]) for i, t in enumerate(total) for j in range(t.shape[1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*rows)], ["fit", "part", "s0", "s1", "s2", "ll"])

    parts = data.select("z", "n").mapInArrow(run, "fit bigint, part bigint, s0 double, s1 double, s2 double, ll double")
    found = parts.groupBy("fit", "part").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "s2", "ll")]).collect()
    out = [(np.zeros((3, len(f.w))), 0.0) for f in fits]
    for r in found:
        sums, ll = out[r["fit"]]
        sums[:, r["part"]] = r["s0"], r["s1"], r["s2"]
        out[r["fit"]] = sums, ll + r["ll"]
    return out


def _advance(fit: Fit, sums: np.ndarray, log_likelihood: float, n: float, tol: float) -> Fit:
    """The fit after a step; done if its mean log-likelihood grew by less than ``tol``."""
    weight = np.maximum(sums[0], 1e-300)
    mu = np.where(sums[0] > 0, sums[1] / weight, fit.mu)
    var = np.where(sums[0] > 0, sums[2] / weight - mu * mu, fit.sig**2)
    sig = np.sqrt(np.maximum(var, MIN_SIGMA**2))
    done = (log_likelihood - fit.log_likelihood) / n < tol
    return Fit(sums[0] / sums[0].sum(), mu, sig, log_likelihood, fit.steps + 1, done)


def joint_fit(
    data: DataFrame, sizes: list[int], n_init: int, seed: int, max_iter: int, tol: float
) -> dict[int, tuple[Mixture, float]]:
    """For every size the mixture of its best start and its log-likelihood.

    All sizes and starts advance together: a step is one aggregate for all
    that still move, so there are ``max_iter`` jobs at most, however many
    sizes and starts there are. A start ends when its mean log-likelihood
    grows by less than ``tol`` in a step.
    """
    fits = _starts(data, sizes, n_init, seed)
    n = float(data.agg(F.sum("n")).first()[0])
    for _ in range(max(1, max_iter)):
        moving = [i for i, f in enumerate(fits) if not f.done]
        if not moving:
            break
        for i, (sums, ll) in zip(moving, _statistics(data, [fits[i] for i in moving])):
            fits[i] = _advance(fits[i], sums, ll, n, tol)
            if len(fits[i].w) == 1 and fits[i].steps == 2:  # exact after its first step
                fits[i] = replace(fits[i], done=True)
    best: dict[int, Fit] = {}
    for f in fits:
        if len(f.w) not in best or f.log_likelihood > best[len(f.w)].log_likelihood:
            best[len(f.w)] = f
    return {k: (f.mixture(), f.log_likelihood) for k, f in best.items()}


def _few(data: DataFrame, k: int) -> list[tuple[float, float]] | None:
    """The distinct values if there are at most ``k`` of them: the fit is then
    known, one component at each value with the least width."""
    rows = data.select("z", "n").limit(k + 1).collect()
    return sorted((r["z"], r["n"]) for r in rows) if len(rows) <= k else None


def _fixed(data: DataFrame, k: int, seed: int, max_iter: int, tol: float) -> Mixture:
    few = _few(data, k)
    if few is not None:
        return _points(few) if few else EMPTY_MIXTURE
    return joint_fit(data, [k], 1, seed, max_iter, tol)[k][0]


def _automatic(data: DataFrame, k_min: int, k_max: int, seed: int, n_init: int, max_iter: int, tol: float) -> Mixture:
    n = data.agg(F.sum("n")).first()[0]
    if not n:
        return EMPTY_MIXTURE
    few = _few(data, 1)
    if few is not None:
        return _points(few)
    sizes = list(range(max(1, k_min), max(k_min, min(k_max, max(1, int(n // 10)))) + 1))
    fits = joint_fit(data, sizes, n_init, seed, max_iter, tol)
    bic = {k: -2.0 * ll + (3 * k - 1) * math.log(n) for k, (_, ll) in fits.items()}
    return fits[min(sizes, key=lambda k: (bic[k], k))][0]


def fit_mixture(
    sample: DataFrame,
    k: int = 3,
    seed: int = 0,
    max_iter: int = 100,
    tol: float = 1e-6,
    resolution: float = 1e-4,
    keep_spikes: bool = False,
) -> Mixture:
    """Mixture of ``k`` components on log1p(score), without spikes at zero unless they are kept.

    A sample of at most ``k`` distinct values has one component at each.
    ``resolution`` is the grid that scores are rounded to; ``tol`` is the least
    growth of the mean log-likelihood in a step.
    """
    found = _fixed(_prepare(sample, resolution), k, seed, max_iter, tol)
    return found if keep_spikes else drop_spikes(found)


def fit_mixture_auto(
    sample: DataFrame,
    k_min: int = 1,
    k_max: int = 8,
    seed: int = 0,
    n_init: int = 3,
    max_iter: int = 500,
    tol: float = 1e-6,
    resolution: float = 1e-4,
    keep_spikes: bool = False,
) -> Mixture:
    """The number of components with the least BIC, best of ``n_init`` starts.

    A sample of one distinct value has one component there. See ``joint_fit``.
    """
    found = _automatic(_prepare(sample, resolution), k_min, k_max, seed, n_init, max_iter, tol)
    return found if keep_spikes else drop_spikes(found)


def mixture_policy(
    sample: DataFrame,
    k: int = 3,
    auto: bool = False,
    seed: int = 0,
    max_iter: int = 100,
    tol: float = 1e-6,
    resolution: float = 1e-4,
    keep_spikes: bool = False,
) -> Mixture:
    """The mixture the scoring uses: automatic size up to max(3, k) with the
    fixed size as fallback, or the fixed size; an empty sample is replaced.

    The scores are computed once, for the histogram. Only a fit that rejects
    its data falls back, with a message; any other failure is raised. Samples
    of very few distinct values are handled as in the two functions above.
    """
    data = _prepare(sample, resolution)
    if data.isEmpty():
        replaced = sample.sparkSession.createDataFrame([(v,) for v in EMPTY_SAMPLE], "score double")
        data = _prepare(replaced, resolution)
    if auto:
        try:
            found = _automatic(data, 1, max(3, k), seed, 3, 500, tol)
            return found if keep_spikes else drop_spikes(found)
        except (ValueError, ZeroDivisionError) as error:
            logging.getLogger(__name__).warning("fixed mixture size instead of an automatic one: %s", error)
    found = _fixed(data, k, seed, max_iter, tol)
    return found if keep_spikes else drop_spikes(found)
