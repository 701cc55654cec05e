"""Coordinates, lengths and numeric guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_KB = 1e-8
INF = float("inf")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sanitize(
    col: Column | str,
    *,
    nan: float = 0.0,
    pos_inf: float = 0.0,
    neg_inf: float = 0.0,
    low: float | None = None,
    high: float | None = None,
) -> Column:
    """Replace null, NaN and infinities by constants, then clip.

    NaN is tested first: in Spark it compares greater than any number, so a
    bare ``greatest`` would let it through.
    """
    x = _col(col).cast("double")
    out = (
        F.when(x.isNull() | F.isnan(x), F.lit(float(nan)))
        .when(x == INF, F.lit(float(pos_inf)))
        .when(x == -INF, F.lit(float(neg_inf)))
        .otherwise(x)
    )
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return out


def sanitize_rate(col: Column | str, low: float = 1e-10, high: float = 1e8) -> Column:
    return sanitize(col, nan=low, neg_inf=low, pos_inf=high, low=low, high=high)


def sanitize_count(col: Column | str, high: float = 1e12) -> Column:
    return sanitize(col, low=0.0, high=high)


def to_int_strict(col: Column | str) -> Column:
    """Parse a number (``1e3`` too) and truncate it; malformed text fails the job."""
    text = _col(col).cast("string")
    bad = F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(text, F.lit("null"))))
    return F.coalesce(
        text.try_cast("bigint"),
        text.try_cast("double").try_cast("bigint"),
        bad.cast("bigint"),
    )


def point_position(start: Column | str, end: Column | str, use_midpoint: bool = True) -> Column:
    """Midpoint rounded down (also below zero), or the start."""
    if not use_midpoint:
        return _col(start)
    return F.shiftright(_col(start) + _col(end), 1)


def interval_length(start: Column | str, end: Column | str) -> Column:
    """Positions covered, both ends included; at least 1. Null if an end is null."""
    length = _col(end) - _col(start) + 1
    return F.when(length < 1, F.lit(1)).otherwise(length)


def length_kb(len_bp: Column | str, unit: float = 1000.0) -> Column:
    """Exposure: length in units, never zero. Null stays null."""
    kb = _col(len_bp) / F.lit(float(unit))
    return F.when(kb < MIN_KB, F.lit(MIN_KB)).otherwise(kb)
