"""Finding the columns of a table whose names vary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted names of each column, in order of preference.
CHROM_NAMES = ("chrom", "chr", "chromosome", "seqnames")
TYPED_CHROM_NAMES = ("chrom", "chr", "seqnames", "chromosome")
START_NAMES = ("start", "pos", "bp")
TYPE_NAMES = (
    "event_type", "type", "svtype", "sv_type", "varianttypes", "variant_type",
    "svclass", "sv_class", "class", "event", "category",
)
SAMPLE_NAMES = ("sample", "sample_id", "donor", "donor_id", "tumor", "tumour")
GUESS_SAMPLE_NAMES = (*SAMPLE_NAMES, "tumor_id", "vcf", "file", "tumor_sample")
SAMPLE_PATTERN = r"(?i)(purple|\.vcf|CPCT|WIDE|OBC)"
MIN_HIT_RATE = 0.2


def clean_header(df: DataFrame) -> DataFrame:
    """Strip byte-order marks and blanks from the column names."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pick_column(df: DataFrame, names: tuple[str, ...], what: str) -> str:
    """First of ``names`` that ``df`` has, in any case."""
    have = {c.lower(): c for c in df.columns}
    for name in names:
        if name in have:
            return have[name]
    raise KeyError(f"no column for '{what}' among {df.columns}")


def resolve_columns(
    df: DataFrame,
    *,
    typed: bool = False,
    sample: str | None = None,
) -> DataFrame:
    """Project a table with free column names to the fixed ones.

    Gives chrom, start, end, sample, filter and, with ``typed``, event_type,
    all still as found. ``end`` falls back to ``start`` and ``filter`` to PASS.
    """
    have = {c.lower(): c for c in df.columns}
    chrom = pick_column(df, TYPED_CHROM_NAMES if typed else CHROM_NAMES, "chrom")
    start = pick_column(df, START_NAMES, "start")
    end = have.get("end", start)
    cols = [quoted(chrom).alias("chrom"), quoted(start).alias("start"), quoted(end).alias("end")]
    if typed:
        cols.append(quoted(pick_column(df, TYPE_NAMES, "event_type")).alias("event_type"))
    cols.append(quoted(sample or pick_column(df, SAMPLE_NAMES, "sample")).alias("sample"))
    cols.append(quoted(have["filter"]).alias("filter") if "filter" in have else F.lit("PASS").alias("filter"))
    return df.select(*cols)


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _hit_rate(name: str) -> Column:
    """Share of the rows with a sample-like value; a null is none."""
    return F.avg(F.coalesce(quoted(name).rlike(SAMPLE_PATTERN), F.lit(False)).cast("double"))


def profile_text_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per text column: share of sample-like values, distinct values.

    A null counts as no hit and is not a value. ``approx`` replaces the exact
    distinct counts, which shuffle every value, by sketches.
    """
    distinct = F.approx_count_distinct if approx else F.count_distinct
    cols = _text_columns(df)
    wide = df.agg(*[
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(_hit_rate(c), F.lit(0.0)).alias("hit_rate"),
            distinct(quoted(c)).alias("n_distinct"),
        ).alias(f"c{i}")
        for i, c in enumerate(cols)
    ])
    return wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cols))])))


def guess_sample_column(df: DataFrame, approx: bool = True) -> str:
    """Name of the sample column: by name, by content, else the most varied.

    Distinct values are counted by sketches unless ``approx`` is off.
    """
    try:
        return pick_column(df, GUESS_SAMPLE_NAMES, "sample")
    except KeyError:
        pass
    cols = _text_columns(df)
    if not cols:
        raise KeyError("no sample-like column")
    rates = df.agg(*[_hit_rate(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    hits = [(rates[f"c{i}"] or 0.0, c) for i, c in enumerate(cols)]
    hits = [pair for pair in hits if pair[0] > MIN_HIT_RATE]
    if hits:
        return max(hits)[1]
    distinct = F.approx_count_distinct if approx else F.count_distinct
    counts = df.agg(*[distinct(quoted(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return max((counts[f"c{i}"], c) for i, c in enumerate(cols))[1]
