"""Data checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.functions.names import CANONICAL

INF = float("inf")


def finite_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: counts of null, NaN and infinite values, and the
    minimum, maximum and mean of the rest. One pass, one aggregate."""
    def stats(c: str):
        x = F.col(c).cast("double")
        good = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF), x)
        return F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(x.isNull()).alias("n_null"),
            F.count_if(F.isnan(x)).alias("n_nan"),
            F.count_if(F.abs(x) == INF).alias("n_inf"),
            F.min(good).alias("min"),
            F.max(good).alias("max"),
            F.avg(good).alias("mean"),
        )

    wide = df.agg(*[stats(c).alias(f"c{i}") for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cols))])))


def first_nonfinite(df: DataFrame, col: str, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows whose ``col`` is null, NaN or infinite."""
    x = F.col(col).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == INF)
    return df.where(bad).orderBy(*order).limit(n)


def canonical_only(df: DataFrame, col: str = "chrom", names: list[str] | None = None) -> DataFrame:
    """Keep the rows of the canonical sequences."""
    return df.where(F.col(col).isin(names or CANONICAL))


def canonical_report(df: DataFrame, col: str = "chrom", names: list[str] | None = None) -> DataFrame:
    """How many rows ``canonical_only`` keeps and drops."""
    known = F.coalesce(F.col(col).isin(names or CANONICAL), F.lit(False))
    return df.agg(F.count_if(known).alias("kept"), F.count_if(~known).alias("dropped"))
