"""Bins of fixed width and the events that fall into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.functions.names import norm_chrom

BIN = ["chrom", "start", "end"]


def distinct_grid(bins: DataFrame) -> DataFrame:
    """Distinct (chrom, start, end) with normalised names.

    Names are normalised before duplicates go, so ``1`` and ``chr1`` are one.
    """
    return bins.select(norm_chrom("chrom").alias("chrom"), "start", "end").distinct()


def _most_frequent(values: DataFrame, name: str) -> DataFrame:
    counts = values.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    # highest count, then the smallest value; merges on the map side
    return counts.agg(F.max_by(name, F.struct(F.col("n"), -F.col(name))).alias(name))


def infer_grid(bins: DataFrame) -> DataFrame:
    """One row (bin_size, anchor): the most frequent length and offset."""
    sizes = bins.select((F.col("end") - F.col("start") + 1).alias("bin_size"))
    size = _most_frequent(sizes, "bin_size")
    offsets = bins.select(F.pmod(F.col("start"), size.scalar()).alias("anchor"))
    anchor = _most_frequent(offsets, "anchor")
    return size.select("bin_size", anchor.scalar().alias("anchor"))


def _size_and_anchor(grid: DataFrame, bin_size, anchor) -> tuple[Column, Column]:
    if bin_size is None or anchor is None:
        found = infer_grid(grid)
        bin_size = found.select("bin_size").scalar() if bin_size is None else F.lit(bin_size)
        anchor = found.select("anchor").scalar() if anchor is None else F.lit(anchor)
        return bin_size, anchor
    return F.lit(bin_size), F.lit(anchor)


def _bin_start(size: Column, anchor: Column) -> Column:
    # integer arithmetic only: a division by doubles would lose large positions
    return F.col("pos") - F.pmod(F.col("pos") - anchor, size)


def assign_points_to_grid(
    points: DataFrame, grid: DataFrame, bin_size: int | None = None, anchor: int | None = None
) -> DataFrame:
    """Each point with the bin of the grid it falls into; others are dropped.

    The point-in-interval join becomes an equi-join on (chrom, start).
    """
    size, first = _size_and_anchor(grid, bin_size, anchor)
    placed = points.withColumn("start", _bin_start(size, first))
    return placed.join(grid.select(*BIN), ["chrom", "start"])


def sample_counts(
    points: DataFrame, grid: DataFrame, bin_size: int | None = None, anchor: int | None = None
) -> DataFrame:
    """Distinct samples per (chrom, bin start), on or off the grid.

    Both steps merge before their shuffle, so a bin that holds a large share
    of the points reaches the join with the grid as one row.
    """
    size, first = _size_and_anchor(grid, bin_size, anchor)
    return (
        points.select("chrom", _bin_start(size, first).alias("start"), "sample")
        .distinct()
        .groupBy("chrom", "start")
        .agg(F.count(F.lit(1)).alias("y"))
    )


def bin_labels(
    points: DataFrame, grid: DataFrame, bin_size: int | None = None, anchor: int | None = None
) -> DataFrame:
    """Distinct samples per bin of the grid, for bins with at least one."""
    counts = sample_counts(points, grid, bin_size, anchor)
    return grid.select(*BIN).join(counts, ["chrom", "start"]).select(*BIN, "y")


def attach_labels(bins: DataFrame, labels: DataFrame) -> DataFrame:
    """Give each bin its label, 0 where there is none.

    ``labels`` is keyed by (chrom, start, end), or by (chrom, start) alone.
    """
    keys = [c for c in ("start", "end") if c in labels.columns]
    known = labels.select(F.col("chrom").alias("_chrom"), *keys, F.col("y").alias("_y"))
    cols = [c for c in bins.columns if c != "y"]
    joined = bins.withColumn("_chrom", norm_chrom("chrom")).join(known, ["_chrom", *keys], "left")
    return joined.select(*cols, F.coalesce("_y", F.lit(0)).cast("double").alias("y"))


def unmatched_bins(labelled: DataFrame) -> DataFrame:
    """How many bins have label 0."""
    return labelled.agg(F.count_if(F.col("y") == 0).alias("n_zero"), F.count(F.lit(1)).alias("n"))
