"""Array expressions for tags and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_list(values: Column) -> Column:
    """Trimmed, non-blank, distinct entries in the order of their first occurrence; null becomes empty."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v.isNotNull() & (v != "")))


def contains_all(values: Column, wanted: list[str]) -> Column:
    """Whether an array holds every wanted entry; blank and repeated ones are ignored, no wanted entry means no filter, null holds none."""
    asked = list(dict.fromkeys(w.strip() for w in wanted if w and w.strip()))
    if not asked:
        return F.lit(True)
    return values.isNotNull() & (F.size(F.array_except(F.array(*map(F.lit, asked)), values)) == 0)
