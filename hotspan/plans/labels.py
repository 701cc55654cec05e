"""Counting distinct samples with an event in each bin."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hotspan.operators.grid import attach_labels, distinct_grid, sample_counts


def build_labels(
    bins: DataFrame,
    points: DataFrame,
    bin_size: int | None = None,
    anchor: int | None = None,
) -> DataFrame:
    """``bins`` with ``y``, the number of distinct samples that have a point in
    the bin. The grid's width and offset are inferred unless given."""
    grid = distinct_grid(bins) if bin_size is None or anchor is None else bins
    # a bin is on its own grid, so the counts need not be joined to the grid first
    return attach_labels(bins, sample_counts(points, grid, bin_size, anchor))
