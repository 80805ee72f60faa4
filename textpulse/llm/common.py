"""Parts that several operators share: whole texts, staged tables, joins that hold under hot keys, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpulse.session import importable, scratch_path

#: A key is hot from this part of all rows on; so there are never more hot keys than this number.
HOT_PARTS = 1000
#: Copies of a hot key's row on the other side of a join, and parts into which its rows are dealt.
SALTS = 64
#: Prefix of helper columns, so that no column of an input clashes with them.
MARK = "__tp_"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(column: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Rows that several steps read, or whose lineage is to be cut, as a table in the shared folder."""
    importable(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(counts: DataFrame, key: str, n: str) -> list:
    """Keys of at least one HOT_PARTS-th of all rows, from a table of one row per key and its count n.

    At most HOT_PARTS values, by construction; the driver gets no others.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    least = max(2, total // HOT_PARTS)
    return [r[0] for r in counts.filter((F.col(n) >= least) & F.col(key).isNotNull()).select(key).collect()]


def lookup(rows: DataFrame, key: str, unique: DataFrame, hot: list, spread: str, how: str = "left") -> DataFrame:
    """Equi-join with a table of one row per key. Rows of hot keys are dealt over salts by a hash of the
    column spread (never by a random number, which a repeated task would draw anew), the table's row of
    such a key is repeated for each salt; every other key has salt 0."""
    if not hot:
        return rows.join(unique, key, how)
    salt = f"{MARK}salt"
    is_hot = F.col(key).isin(hot)
    dealt = rows.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(unique.withColumn(salt, F.explode(copies)), [key, salt], how).drop(salt)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Adds rank (long, from 0) of each row in its group, in the given order. Staged.

    Rows are range-sorted by (group, order), so that a hot group spreads over many tasks; a row's rank is
    its place in its partition plus the rows of the group in the partitions before. Only one row per
    partition and group enters the running sum.
    """
    spark = rows.sparkSession
    part, place = f"{MARK}part", f"{MARK}place"
    keys = [*group, *order]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = stage(
        dealt.withColumn(place, F.monotonically_increasing_id())
        .withColumn(part, F.shiftright(place, 33))
        .withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1)),
        name,
    )
    first, before, count = f"{MARK}first", f"{MARK}before", f"{MARK}count"
    sums = placed.groupBy(part, *group).agg(F.min(place).alias(first), F.count("*").alias(count))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, *group, first, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before))
    starts = starts.select(F.col(part), F.struct(*group).alias(f"{MARK}group"), first, before)
    on = [part, f"{MARK}group"]
    # One row per partition and group that it holds: as a partition is a range, partitions + groups at most.
    joined = placed.withColumn(f"{MARK}group", F.struct(*group)).join(starts.hint("broadcast"), on)
    rank = F.col(place) - F.col(first) + F.col(before)
    return joined.select(*rows.columns, rank.alias("rank"))
