"""Scores of bins, intervals and segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hotspan.functions.numeric import _col, sanitize


def llr_poisson(obs: Column | str, exp: Column | str) -> Column:
    """Log-likelihood ratio of an excess over expectation; null without excess."""
    y, e = _col(obs), _col(exp)
    ratio = (y + 1) / (e + 1)
    return F.when((y > e) & (e > 1e-12), y * F.log(ratio) + (1 - ratio) * e)


def llr_norm(llr: Column | str, kb: Column | str) -> Column:
    """Score per square root of the length."""
    return _col(llr) / F.greatest(F.sqrt(_col(kb)), F.lit(1e-8))


def weight_of(
    llr: Column | str,
    neglog10_p: Column | str,
    kb: Column | str,
    beta: float = 1.0,
    gamma: float = 0.0,
) -> Column:
    """Score x significance^beta x length^gamma, not yet checked for infinities."""
    score = _col(llr)
    strength = F.when(score > 0, _col(neglog10_p)).otherwise(0.0)
    weight = score
    if beta != 0:
        weight = weight * (strength if beta == 1 else F.pow(strength, F.lit(float(beta))))
    if gamma != 0:
        weight = weight * F.pow(_col(kb), F.lit(float(gamma)))
    return weight


def interval_weight(
    llr: Column | str,
    neglog10_p: Column | str,
    kb: Column | str,
    beta: float = 1.0,
    gamma: float = 0.0,
) -> Column:
    """Selection weight of an interval; 0 where it is not finite."""
    return sanitize(weight_of(llr, neglog10_p, kb, beta, gamma))


def bin_loglike(y: Column | str, lam: Column | str, kb: Column | str) -> Column:
    """Poisson log-likelihood of one bin, without the factorial."""
    rate = F.least(F.greatest(_col(lam), F.lit(1e-9)), F.lit(1e4))
    return _col(y) * F.log(rate) - rate * _col(kb)


def huber_weight(residual: Column | str, delta: Column | float, eps: float = 1e-9) -> Column:
    """1 up to ``delta``, then falling as delta / |residual|."""
    size = F.abs(_col(residual))
    limit = F.lit(float(delta)) if isinstance(delta, (int, float)) else delta
    weight = F.when(size <= limit, F.lit(1.0)).otherwise(limit / (size + F.lit(eps)))
    return sanitize(weight, low=0.0, high=1e3)
