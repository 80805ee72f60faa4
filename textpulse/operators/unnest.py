"""One row per list entry.

Spark's inner ``explode`` adds a filter that the list is not empty, which works the list out a second
time (for tokens: the regular expression over the whole text). The outer form has no such filter; the
row of an empty list is dropped by its null entry instead. Entries are therefore never null here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, entries: Column, name: str) -> DataFrame:
    """``keep`` and the entry as ``name``."""
    return df.select(*keep, F.explode_outer(entries).alias(name)).where(F.col(name).isNotNull())


def unnest_at(df: DataFrame, keep: list, entries: Column, pos: str, name: str) -> DataFrame:
    """``keep``, the place in the list as ``pos``, and the entry as ``name``."""
    return df.select(*keep, F.posexplode_outer(entries).alias(pos, name)).where(F.col(pos).isNotNull())


def unnest_structs(df: DataFrame, keep: list, entries: Column, present: str) -> DataFrame:
    """``keep`` and the fields of the entry; the field ``present`` is never null."""
    return df.select(*keep, F.inline_outer(entries)).where(F.col(present).isNotNull())
