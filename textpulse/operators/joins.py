"""Equi-joins with a unique side that hold when one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame; runs no job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def lookup_join(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner",
    spread: list[str] | None = None, counts: DataFrame | None = None, max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` with a ``table`` of one row per key.

    The table is broadcast only when its estimated size is within ``max_bytes``; else the rows are
    shuffled with their hot keys salted, see ``join_unique``.
    """
    if estimated_bytes(table) <= max_bytes:
        return rows.join(F.broadcast(table), keys, how)
    return join_unique(rows, table, keys, how=how, counts=counts, spread=spread)


def join_unique(
    rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner",
    counts: DataFrame | None = None, spread: list[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Shuffled join of ``rows`` with ``side`` (one row per key), hot keys split over several tasks.

    ``counts`` holds the rows per key as ``n`` (worked out here when absent). A key is hot when it has
    more rows than one of ``parts`` equal parts of all rows (by default the shuffle partitions), and it
    is split into as many tasks as it would fill such parts. So there are fewer hot keys than parts,
    which bounds the marker table that is broadcast, and no key stays whole that a task could not hold.
    A row's salt is a hash of its ``spread`` columns (all but the keys by default): a task that runs
    again gives each row the same salt. The result does not depend on which keys are marked.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = _all_present(keys)
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = F.col("n") * parts / counts.agg(F.sum("n")).scalar()
    hot = counts.where(known & (filled > 1)).select(*keys, F.ceil(filled).cast("int").alias("__hot"))
    spread = spread or [c for c in rows.columns if c not in keys]
    every = F.coalesce("__hot", F.lit(parts))
    salt = F.pmod(F.xxhash64(*spread), every).cast("int") if spread else F.lit(0)
    marked = rows.join(F.broadcast(hot), keys, "left")
    # Rows without a key match nothing: they are spread too instead of filling one task.
    salted = marked.withColumn(
        "__salt", F.when(F.col("__hot").isNotNull() | ~known, salt).otherwise(F.lit(0))
    ).drop("__hot")
    copies = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.col("__hot") - 1)).otherwise(F.array(F.lit(0)))
    replicated = (
        side.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    )
    return salted.join(replicated, [*keys, "__salt"], how).drop("__salt")


def _all_present(keys: list[str]) -> Column:
    present = F.col(keys[0]).isNotNull()
    for key in keys[1:]:
        present = present & F.col(key).isNotNull()
    return present


def name_rows(scores: DataFrame, names: DataFrame, key: str, spread: list[str] | None = None) -> DataFrame:
    """Id to name lookup on result rows."""
    return lookup_join(scores, names, [key], spread=spread)
