"""Reading the tables, and what the operators on texts share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds at most, so that long texts do not add up.
BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's number of rows an Arrow batch; never raise it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def map_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict | None]]
) -> DataFrame:
    """Apply a function of column lists, batch by batch.

    ``make`` runs once in each task and returns the function, which takes
    ``{column: list}`` and returns ``{column: list}`` in the order of ``schema``.
    """
    small_batches(df.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]
    types = _arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                out = fn(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[n], types.field(n).type) for n in names], schema=types)

    return df.mapInArrow(run, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def settled(value: Column) -> Column:
    """``value``, as a column that no filter is moved below.

    A filter on a computed column is otherwise moved to the source with the
    whole computation written into it, once for every use, even inside lambdas.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
