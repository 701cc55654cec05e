"""Reading events, bins and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspan.functions.names import norm_chrom
from hotspan.functions.numeric import point_position, to_int_strict
from hotspan.functions.text import norm_event_type, pass_filter
from hotspan.operators.columns import clean_header, guess_sample_column, resolve_columns
from hotspan.operators.quality import canonical_only

# Columns of a prediction table.
PREDICTION_SCHEMA = (
    "chrom string, start bigint, end bigint, lam_pred double, obs_count double, bin_loglike double"
)
REQUIRED = ("chrom", "start", "end", "lam_pred", "obs_count")


def _separator(spark: SparkSession, path: str) -> str:
    """Comma if the header line has one, else tab; reads one line."""
    first = spark.read.text(path).first()
    return "," if first is None or "," in first[0] else "\t"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header, every column as text."""
    sep = _separator(spark, path)
    return clean_header(spark.read.csv(path, header=True, sep=sep, inferSchema=False))


def as_points(
    raw: DataFrame,
    *,
    typed: bool = False,
    use_midpoint: bool = True,
    require_pass: bool = True,
    canonical: bool | None = None,
    sample: str | None = None,
    aliases: dict[str, str] | None = None,
) -> DataFrame:
    """Points (chrom, pos, sample, and event_type if typed) of a raw table.

    Without ``typed`` the sample column is guessed and only canonical
    sequences stay, unless ``canonical`` says otherwise. Positions of all rows
    are parsed, also of those that the filter drops: a malformed one fails.
    """
    if not typed and sample is None:
        sample = guess_sample_column(raw)
    found = resolve_columns(raw, typed=typed, sample=sample)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("nan"))

    pos = point_position(to_int_strict("start"), to_int_strict("end"), use_midpoint)
    if require_pass:
        # the verdict needs the position, so that no row is dropped before it is parsed
        parsed = F.least(to_int_strict("start"), to_int_strict("end")) >= -(1 << 63)
        found = found.where(F.when(parsed, pass_filter("filter")))
    cols = [norm_chrom("chrom").alias("chrom"), pos.alias("pos")]
    if typed:
        cols.append(norm_event_type(text("event_type"), aliases).alias("event_type"))
    out = found.select(*cols, text("sample").alias("sample"))
    keep_canonical = (not typed) if canonical is None else canonical
    return canonical_only(out) if keep_canonical else out


def read_points(spark: SparkSession, path: str, **options) -> DataFrame:
    """Events for labelling: chrom, pos, sample."""
    return as_points(read_table(spark, path), **options)


def read_typed_points(spark: SparkSession, path: str, **options) -> DataFrame:
    """Events for annotation: chrom, pos, event_type, sample."""
    return as_points(read_table(spark, path), typed=True, **options)


def check_predictions(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"prediction table lacks columns {missing}")
    return df


def read_predictions(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Predictions from parquet or from CSV with a header, in any column order."""
    fmt = fmt or ("csv" if path.endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "parquet":
        return check_predictions(spark.read.parquet(path))
    raw = check_predictions(clean_header(spark.read.csv(path, header=True, inferSchema=False)))
    types = dict(part.strip().split(" ") for part in PREDICTION_SCHEMA.split(","))
    return raw.select(*[F.col(c).cast(t).alias(c) for c, t in types.items() if c in raw.columns])


def read_bins_features(spark: SparkSession, bins_path: str, features_path: str) -> tuple[DataFrame, DataFrame]:
    """Bins (chrom, w_idx, start, end, cls, y) and features (chrom, w_idx, feat)."""
    bins = spark.read.parquet(bins_path)
    features = spark.read.parquet(features_path)
    for df, need in ((bins, ("chrom", "w_idx", "start", "end")), (features, ("chrom", "w_idx", "feat"))):
        missing = [c for c in need if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns {missing}")
    return bins, features
