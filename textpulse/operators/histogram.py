"""Equal-width histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equal_width_histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Rows ``(bin, edge, n)``, also for empty bins; ``edge`` is the lower one, the last bin is closed.

    When all values are equal there is one bin. Nulls are not counted; a value that is not a number or
    infinite fails, as no bins of equal width hold it. The two ends are a scalar sub-query; then one
    aggregate counts, with a partial count per task.
    """
    values = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    low, high = F.min("v"), F.max("v")
    # Spark orders NaN above every other value.
    bad = F.isnan(high) | (high == float("inf")) | (low == float("-inf"))
    wrong = F.raise_error(F.lit("a histogram needs finite values")).cast("double")
    ends = values.agg(F.when(bad, wrong).otherwise(low).alias("low"), high.alias("high"))
    ends = ends.where(F.col("low").isNotNull())
    both = ends.select(F.struct("low", "high")).scalar()
    held = values.select("v", both.alias("e")).select("v", F.col("e.low").alias("low"), F.col("e.high").alias("high"))
    width = F.col("high") - F.col("low")
    place = F.least(F.floor((F.col("v") - F.col("low")) / width * bins), F.lit(bins - 1))
    bin_ = F.when(width > 0, place).otherwise(F.lit(0)) + 1
    counts = held.select(bin_.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = F.sequence(F.lit(1), F.when(width > 0, F.lit(bins)).otherwise(F.lit(1)))
    grid = ends.select("low", "high", F.explode(every).alias("bin"))
    grid = grid.select("bin", (F.col("low") + (F.col("bin") - 1) * width / bins).alias("edge"))
    # Both sides have at most ``bins`` rows.
    return grid.join(F.broadcast(counts), "bin", "left").select("bin", "edge", F.coalesce("n", F.lit(0)).alias("n"))
