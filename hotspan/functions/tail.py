"""Tail probability of a Gaussian mixture."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.functions.numeric import sanitize

# Coefficients of the published Chebyshev fit of erfc
# (fractional error below 1.2e-7), from t^0 upwards.
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


@dataclass(frozen=True)
class Mixture:
    """Weights, means and deviations of the components, on the log1p scale."""

    w: tuple[float, ...]
    mu: tuple[float, ...]
    sig: tuple[float, ...]

    @property
    def k(self) -> int:
        return len(self.w)


def _sure(col: Column) -> Column:
    """Tell the planner that a value is never null.

    Logarithms and quotients count as nullable, and every nullable step adds
    branches to the generated code, until it is too long to be compiled.
    """
    return F.coalesce(col, F.lit(0.0))


def _log_normal_sf(z: Column, t: Column) -> Column:
    """Natural log of P(Z >= z), with t = 1 / (1 + |z| / sqrt(8)); it does not
    underflow far in the tail."""
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = poly * t + F.lit(c)
    return _sure(F.log(t)) - 0.5 * z * z + poly


def mixture_tail(
    df: DataFrame,
    score: str,
    mixture: Mixture,
    neglog10: str = "neglog10_p",
    p: str = "p_val",
    min_p: float = 1e-300,
) -> DataFrame:
    """Add -log10 p and p of a normalised score, where p is the chance of that
    score or more under the mixture, floored at ``min_p``. A null or NaN score
    has p = 1.

    Each intermediate value is a column of its own: it is used many times, and
    as one nested expression it would be written out again at every use.
    """
    parts = [(w, mu, sig) for w, mu, sig in zip(mixture.w, mixture.mu, mixture.sig) if w > 0]
    ks = range(len(parts))
    out = df.withColumn("_l", _sure(F.log1p(F.greatest(sanitize(score), F.lit(0.0)))))
    out = out.withColumns({
        f"_z{k}": (F.col("_l") - F.lit(float(mu))) * F.lit(1.0 / sig) for k, (_, mu, sig) in enumerate(parts)
    })
    out = out.withColumns({f"_t{k}": _sure(1.0 / (1.0 + F.abs(f"_z{k}") * F.lit(math.sqrt(0.125)))) for k in ks})
    out = out.withColumns({f"_e{k}": _log_normal_sf(F.col(f"_z{k}"), F.col(f"_t{k}")) for k in ks})
    out = out.withColumns({
        f"_c{k}": F.lit(math.log(w)) + F.when(F.col(f"_z{k}") >= 0, F.col(f"_e{k}") - F.lit(math.log(2.0)))
        .otherwise(_sure(F.log1p(-0.5 * F.exp(f"_e{k}"))))
        for k, (w, _, _) in enumerate(parts)
    })
    if len(parts) == 1:
        out = out.withColumn("_s", F.col("_c0"))
    else:
        out = out.withColumn("_m", F.greatest(*[F.col(f"_c{k}") for k in ks]))
        total = sum((F.exp(F.col(f"_c{k}") - F.col("_m")) for k in ks[1:]), F.exp(F.col("_c0") - F.col("_m")))
        out = out.withColumn("_s", F.col("_m") + _sure(F.log(total)))
    out = out.withColumn("_lp", F.least(F.greatest(F.col("_s"), F.lit(math.log(min_p))), F.lit(0.0)))
    missing = F.col(score).isNull() | F.isnan(score)
    return out.select(
        *df.columns,
        F.when(missing, 0.0).otherwise(F.abs("_lp") * F.lit(1.0 / math.log(10.0))).alias(neglog10),
        F.when(missing, 1.0).otherwise(F.exp("_lp")).alias(p),
    )
