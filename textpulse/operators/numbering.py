"""Dense row numbers without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.session import local_rows, stage


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """Adds the number of each row, from 0, in the order of the given columns.

    Two passes: rows are range-sorted over all tasks and stored with their place in their part; the driver gets one
    count per part and gives each part its first number. Rows with equal keys are numbered in the order of a hash
    of the whole row, which also spreads a frequent key over several parts; equal rows have no order of their own.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "__tie"]
    dealt = df.withColumn("__tie", F.xxhash64(*df.columns)).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__tie")
    # The upper bits of the id are the part's number, the lower ones the place in it.
    numbered = dealt.withColumn("__id", F.monotonically_increasing_id())
    placed = stage(numbered.withColumn("__part", F.shiftright("__id", 33)).withColumn("__place", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id"), "numbered")
    first, starts = 0, []
    for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect():  # one row per part
        starts.append((r["__part"], first))
        first += r["n"]
    offsets = F.broadcast(local_rows(spark, starts, "__part long, __first long"))
    return placed.join(offsets, "__part").select(*df.columns, (F.col("__first") + F.col("__place")).alias(name))
