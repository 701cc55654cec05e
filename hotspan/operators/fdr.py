"""False discovery rate over a table of p-values."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.functions.numeric import sanitize
from hotspan.operators.ordered import cut, range_sums, running, split_points
from hotspan.session import stage_table

#: Distinct values that one task orders, about; the number of tasks is bounded.
ROWS_PER_BLOCK = 200_000
MOST_BLOCKS = 10_000


def clean_p(col: Column | str) -> Column:
    """A p-value in [0, 1]; a missing or infinite one is 1."""
    return sanitize(col, nan=1.0, pos_inf=1.0, neg_inf=1.0, low=0.0, high=1.0)


def _ranked(df: DataFrame, p: Column, rows_per_block: int) -> DataFrame:
    """Distinct p with the number of rows that have it (n) or less (upto); written once."""
    distinct = stage_table(df.groupBy(p.alias("_p")).agg(F.count(F.lit(1)).alias("_n")), "distinct_p")
    blocks = min(MOST_BLOCKS, -(-distinct.count() // rows_per_block))
    points = split_points(distinct, "_p", blocks) if blocks > 1 else []
    placed = cut(distinct, "_p", points, "_blk")
    return stage_table(running(placed, [], "_blk", ["_p"], {"_upto": ("sum", F.col("_n"))}), "ranked_p")


def _qvalues(df: DataFrame, p: str, out: str, pi0: float, rows_per_block: int) -> DataFrame:
    ranked = _ranked(df, clean_p(p), rows_per_block)
    m = ranked.agg(F.max("_upto")).scalar()
    raw = F.lit(float(pi0)) * m * F.col("_p") / F.col("_upto")
    q = running(ranked.withColumn("_raw", raw), [], "_blk", ["_p"], {"_q": ("min", F.col("_raw"))}, reverse=True)
    # A written table and plain rows: both sides are shuffled, so a value that
    # a large share of the rows has is split by the planner.
    table = stage_table(q.select("_p", F.least(F.col("_q"), F.lit(1.0)).alias(out)), "q_by_p")
    return df.drop(out).withColumn("_p", clean_p(p)).join(table, "_p").drop("_p")


def bh_qvalues(df: DataFrame, p: str = "p", out: str = "q", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Benjamini-Hochberg q-value of each row.

    The q-value depends on p alone, so it is computed on the distinct
    p-values: rank and running minimum go over blocks of them. Missing
    p-values count as 1.
    """
    return _qvalues(df, p, out, 1.0, rows_per_block)


def storey_qvalues(
    df: DataFrame, pi0: float, p: str = "p", out: str = "q", rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """As ``bh_qvalues``, times the share of true nulls."""
    return _qvalues(df, p, out, pi0, rows_per_block)


def lambda_grid(start: float = 0.05, end: float = 0.95, step: float = 0.01) -> list[float]:
    """Grid points start + i * step up to ``end``, those in [0, 1) only."""
    points = [start + i * step for i in range(max(0, int(np.ceil((end + 1e-12 - start) / step))))]
    points = [x for x in points if 0.0 <= x < 1.0]
    return points or [0.5]


def _tail_histogram(df: DataFrame, p: str, grid: list[float]) -> DataFrame:
    """Rows per cell of the grid: ``cell`` = number of grid points below p."""
    edges = [float(np.nextafter(x, 2.0)) for x in grid]  # p > x, not p >= x
    return cut(df.select(clean_p(p).alias("_p")), "_p", edges, "cell").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n")
    )


def pi0_grid(
    df: DataFrame,
    grid: list[float] | None = None,
    p: str = "p",
    floor: float = 0.01,
    ceil: float = 1.0,
) -> DataFrame:
    """Per grid point x: share of p above x over 1 - x, clipped (lambda, pi0).

    One pass over the p-values; the rest works on the histogram. Without any
    p-value the result is (0.5, 1).
    """
    grid = grid or lambda_grid()
    cells = _tail_histogram(df, p, grid)
    spark = df.sparkSession
    points = spark.range(len(grid)).select(
        F.col("id").cast("int").alias("cell"), F.element_at(F.array(*[F.lit(x) for x in grid]), (F.col("id") + 1).cast("int")).alias("lambda")
    )
    tail = F.array(*[
        F.coalesce(F.sum(F.when(F.col("cell") > i, F.col("n"))), F.lit(0)) for i in range(len(grid))
    ])
    summary = cells.agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("m"), tail.alias("tail")).alias("s")).scalar()
    share = F.element_at("s.tail", F.col("cell") + 1) / F.col("s.m")
    pi0 = F.least(F.greatest(share / F.greatest(1.0 - F.col("lambda"), F.lit(1e-12)), F.lit(floor)), F.lit(ceil))
    full = points.withColumn("s", summary)
    return full.where(F.col("s.m") > 0).select("lambda", pi0.alias("pi0")).unionByName(
        full.where((F.col("s.m") == 0) & (F.col("cell") == 0)).select(
            F.lit(0.5).alias("lambda"), F.lit(1.0).alias("pi0")
        )
    )


def _unit(*parts: object) -> float:
    """The number of ``md5_unit`` for the same values."""
    text = ":".join(map(str, parts))
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / float(1 << 52)


def _binomial(n: int, share: float, unit: float) -> int:
    """The least k with P(X <= k) >= unit, where X counts successes in n trials.

    Terms further than ten deviations and 30 places from the mean weigh less
    than 1e-20 together and are left out.
    """
    if n == 0 or share <= 0.0:
        return 0
    if share >= 1.0:
        return n
    reach = 10.0 * math.sqrt(n * share * (1.0 - share)) + 30.0
    low, high = max(0, math.floor(n * share - reach)), min(n, math.ceil(n * share + reach))
    k = np.arange(low, high, dtype=np.float64)
    logs = np.r_[0.0, np.cumsum(np.log((n - k) / (k + 1.0)) + math.log(share / (1.0 - share)))]
    upto = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(upto, unit * upto[-1], side="left"))


def _drawn_tails(cells: list[int], seed: int, replicate: int) -> list[int]:
    """Numbers of p-values above each grid point in one resample of all of them.

    The counts of the cells are multinomial: the last cell takes a binomial
    share of all draws, the one before a share of what is left, and so on.
    """
    left, upto, tails = sum(cells), np.cumsum(cells).tolist(), []
    total = left
    for cell in range(len(cells) - 1, 0, -1):
        left -= _binomial(left, cells[cell] / upto[cell] if upto[cell] else 0.0, _unit(seed, replicate, cell))
        tails.append(total - left)
    return tails[::-1]


def pi0_mse(
    df: DataFrame,
    grid: list[float] | None = None,
    replicates: int = 200,
    seed: int = 0,
    p: str = "p",
    floor: float = 0.01,
    ceil: float = 1.0,
    closed_form: bool = False,
) -> DataFrame:
    """Per grid point (lambda, pi0, mse): mean squared distance of resampled
    estimates from the smallest estimate.

    A resample of the p-values only matters through its counts per grid cell,
    which are multinomial; each replicate draws those counts from the
    histogram (at most grid + 1 numbers), as a chain of binomials by inverse
    distribution from md5 numbers of (seed, replicate, cell). Work grows with
    the square root of the number of p-values. ``closed_form`` gives the
    expectation of the unclipped estimate instead of drawing.
    """
    grid = grid or lambda_grid()
    spark = df.sparkSession
    estimate = {r["lambda"]: r["pi0"] for r in pi0_grid(df, grid, p, floor, ceil).collect()}
    if list(estimate) == [0.5] and len(grid) != 1:
        return spark.createDataFrame([(0.5, 1.0, 0.0)], "lambda double, pi0 double, mse double")
    pi0s = np.array([estimate[x] for x in grid])
    least = float(pi0s.min())
    cells = [0] * (len(grid) + 1)
    for r in _tail_histogram(df, p, grid).collect():
        cells[r["cell"]] = r["n"]
    m = sum(cells)
    scale = np.maximum(1.0 - np.array(grid), 1e-12)
    if closed_form:
        above = np.cumsum((np.array(cells) / m)[::-1])[::-1][1:]
        mean, var = above / scale, above * (1.0 - above) / m / scale**2
        mse = var + (mean - least) ** 2
        rows = [(float(x), float(a), float(b)) for x, a, b in zip(grid, pi0s, mse)]
        return spark.createDataFrame(rows, "lambda double, pi0 double, mse double")
    points = np.array(grid)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["id"]:
                above = np.array(_drawn_tails(cells, seed, int(b))) / m
                est = np.clip(above / scale, floor, ceil)
                yield pd.DataFrame({"lambda": points, "pi0": pi0s, "err": (est - least) ** 2})

    drawn = spark.range(max(1, int(replicates))).mapInPandas(draw, "lambda double, pi0 double, err double")
    return drawn.groupBy("lambda", "pi0").agg(F.avg("err").alias("mse"))


def pi0_bootstrap(df: DataFrame, grid: list[float] | None = None, **options) -> DataFrame:
    """One row (lambda, pi0): the first grid point with the least ``pi0_mse``,
    to 14 digits, so that the order of summation does not choose."""
    best = F.min_by(F.struct("lambda", "pi0"), F.struct(F.round("mse", 14), F.col("lambda"))).alias("b")
    return pi0_mse(df, grid, **options).agg(best).select("b.lambda", "b.pi0")


def fdr(
    df: DataFrame,
    method: str = "storey",
    p: str = "p",
    out: str = "fdr",
    pi0: float | None = None,
    grid: list[float] | None = None,
    replicates: int = 200,
    seed: int = 0,
    floor: float = 0.01,
    ceil: float = 1.0,
) -> DataFrame:
    """q-values by Storey (pi0 estimated unless given) or by BH."""
    if method.lower() != "storey":
        return bh_qvalues(df, p, out)
    if pi0 is None:
        try:
            pi0 = pi0_bootstrap(
                df, grid, replicates=replicates, seed=seed, p=p, floor=floor, ceil=ceil
            ).first()["pi0"]
        except (ValueError, ZeroDivisionError):
            return bh_qvalues(df, p, out)
    return storey_qvalues(df, pi0, p, out)


#: Ranks of one p-value that a task writes out at once.
RANKS_PER_ROW = 1 << 20


def qq_table(df: DataFrame, p: str = "p", per_decade: int | None = None) -> DataFrame:
    """Per row of ``df``: rank, expected and observed -log10 p.

    A p-value that n rows have takes n ranks in a row, so the rows are only
    counted; ranks come from sums over ranges of the distinct values, and a
    value with very many rows is written out in pieces. Missing p-values count
    as 1. With ``per_decade`` only the ranks ceil(10^(k / per_decade)) for
    k = 0, 1, 2 ... and the last one are kept: as many points for any table
    as a plot can show, made without writing out the others.
    """
    value = F.greatest(clean_p(p), F.lit(1e-300)).alias("_p")
    counts = stage_table(df.select(value).groupBy("_p").agg(F.count(F.lit(1)).alias("_n")), "distinct_p")
    ranked = range_sums(counts, [F.col("_p")], "_n", "_upto")
    m = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("m")).first()["m"]
    first, last = F.col("_upto") - F.col("_n") + 1, F.col("_upto")
    if per_decade is None:
        pieces = ranked.select("_p", last.alias("_upto"), F.explode(F.sequence(first, last, F.lit(RANKS_PER_ROW).cast("bigint"))).alias("_from"))
        # a value with many ranks is spread over tasks before they are written out
        pieces = pieces.repartition("_p", "_from") if m > RANKS_PER_ROW else pieces
        rank = F.explode(F.sequence("_from", F.least("_upto", F.col("_from") + (RANKS_PER_ROW - 1))))
        places = pieces.select("_p", rank.alias("rank"))
    else:
        step = lambda rank: F.floor(F.log10(rank.cast("double")) * per_decade).cast("bigint")
        steps = F.transform(
            F.sequence(step(first), step(last) + 1), lambda k: F.ceil(F.pow(F.lit(10.0), k / float(per_decade)) - 1e-9).cast("bigint"))
        kept = F.array_union(F.filter(steps, lambda r: (r >= first) & (r <= last)), F.when(last == m, F.array(last)).otherwise(F.array().cast("array<bigint>")))
        places = ranked.select("_p", F.explode(kept).alias("rank"))
    return places.select(
        "rank",
        (-F.log10((F.col("rank") - 0.5) / m)).alias("expected"),
        (-F.log10("_p")).alias("observed"),
    )
