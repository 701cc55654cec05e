"""Text fields of event tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of event types and the short form each one takes.
EVENT_TYPE_ALIASES = {
    "duplication": "dup",
    "deletion": "del",
    "inversion": "inv",
    "translocation": "tra",
    "bnd": "tra",
    "t": "tra",
}


def pass_filter(col: Column | str) -> Column:
    """True for ``PASS``, ``.`` and any text that contains PASS; null is false."""
    text = F.upper(F.col(col) if isinstance(col, str) else col)
    return F.coalesce((text == ".") | text.contains("PASS"), F.lit(False))


def norm_event_type(col: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """First item of a ``;`` list, lower case, with aliases replaced."""
    table = EVENT_TYPE_ALIASES if aliases is None else aliases
    text = F.col(col) if isinstance(col, str) else col
    first = F.substring_index(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), ";", 1)
    if not table:
        return first
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), first), first)
