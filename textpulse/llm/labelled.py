"""Labelled rows for the classifiers, and what both share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier learns from at most, the first by a hash of their ids.
MAX_LABELLED = 40_000


def id_remainder(id: str | Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32((F.col(id) if isinstance(id, str) else id).cast("string").cast("binary")), F.lit(4))


def held_out(id: str | Column) -> Column:
    """Rows never learned from. A null id is not held out; it has no label either."""
    return F.coalesce(id_remainder(id) == 2, F.lit(False))


def training_labels(labels: DataFrame, id: str, label: str, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, label, fold): at most `most` rows with a label that are not held out, in two folds.

    Bounded by the parameter, so it may be broadcast. Rows repeated with one id count once, by their largest label.
    """
    rows = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(id))
    one = rows.groupBy(F.col(id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    mixed = F.xxhash64("doc_id")
    fold = F.pmod(mixed, F.lit(2)).cast("int").alias("fold")
    return one.orderBy(mixed, "doc_id").limit(most).select("doc_id", "label", fold)
