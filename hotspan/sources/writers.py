"""Writing predictions and stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions of one sequence that a file of predictions holds.
STRETCH_BP = 10_000_000

# Columns of a result without selected intervals.
EMPTY_SCHEMA = (
    "chrom string, start bigint, end bigint, len_bp bigint, LLR_raw double, obs_sum double, "
    "exp_sum double, p_post double, fdr_post double, fdr double"
)


def write_predictions(predictions: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """One folder per split (train, val, all), each file ordered by (chrom, start).

    A file holds a stretch of one sequence, so a long one is spread over many.
    """
    stretch = F.floor(F.col("start") / F.lit(STRETCH_BP))
    ordered = predictions.repartition("split", "chrom", stretch).sortWithinPartitions("split", "chrom", "start")
    writer = ordered.write.mode(mode).partitionBy("split").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error",
                order: list[str] | None = None) -> None:
    """Write a stage table (per-bin, candidates or the final result)."""
    out = df.orderBy(*order) if order else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def empty_result(spark: SparkSession) -> DataFrame:
    """The result table when nothing was selected: ten columns, no rows."""
    return spark.createDataFrame([], EMPTY_SCHEMA)
