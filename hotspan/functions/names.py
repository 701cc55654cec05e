"""Sequence (chromosome) names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical sequences, in their id order.
CANONICAL = [f"chr{n}" for n in range(1, 23)] + ["chrX", "chrY"]

# Fixed value: what counts as a short name.
_SHORT_NAME = r"(?i)^(?:chr)?([0-9]+|x|y|m|mt)$"


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def norm_chrom(col: Column | str) -> Column:
    """``1``, ``CHRx`` and ``mt`` become ``chr1``, ``chrX`` and ``chrM``.

    Names outside the short pattern keep their text, with ``chr`` in front
    unless they already begin with it in any case.
    """
    text = _strip(F.col(col) if isinstance(col, str) else col)
    short = F.upper(F.regexp_extract(text, _SHORT_NAME, 1))
    return (
        F.when(short.isin("M", "MT"), F.lit("chrM"))
        .when(short != "", F.concat(F.lit("chr"), short))
        .when(F.lower(text).startswith("chr"), text)
        .otherwise(F.concat(F.lit("chr"), text))
    )


def chrom_sort_key(col: Column | str) -> Column:
    """Struct that orders names naturally: numbers, X, Y, M, then the rest."""
    text = F.lower(F.col(col) if isinstance(col, str) else col)
    body = F.regexp_replace(text, r"^chr", "")
    number = F.when(body.rlike(r"^[0-9]+$"), body.try_cast("bigint"))
    rank = (
        F.when(number.isNotNull(), 0)
        .when(body == "x", 1)
        .when(body == "y", 2)
        .when(body.isin("m", "mt"), 3)
        .otherwise(4)
    )
    return F.struct(
        rank.alias("kind"),
        F.coalesce(number, F.lit(0)).alias("number"),
        F.when(rank == 4, body).otherwise("").alias("text"),
    )


def chrom_id(col: Column | str, names: list[str] | None = None) -> Column:
    """Position in the list of canonical names; an unknown name gives 0."""
    name = F.col(col) if isinstance(col, str) else col
    known = F.array(*[F.lit(n) for n in (names or CANONICAL)])
    return F.greatest(F.coalesce(F.array_position(known, name), F.lit(0)) - 1, F.lit(0)).cast("int")
