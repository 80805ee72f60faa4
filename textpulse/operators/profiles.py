"""Counts, describes, group profiles, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textpulse.operators.unnest import unnest
from textpulse.session import stage

QUARTILES = (0.25, 0.5, 0.75)
ACCURACY = 10_000


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and of columns."""
    return row_count(df).withColumn("n_columns", F.lit(len(df.columns)))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; null is a value of its own."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value")


def list_counts(df: DataFrame, entries: Column, keep_blank: bool = True) -> DataFrame:
    """Rows per entry of an array column, most frequent first."""
    exploded = unnest(df, [], entries, "value")
    if not keep_blank:
        exploded = exploded.where(F.col("value") != "")
    return category_counts(exploded, "value")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def _moments(value: Column) -> list[Column]:
    return [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stddev"),
        F.min(value).alias("min"),
    ]


def _full_profile(value: Column, accuracy: int) -> list[Column]:
    q = F.percentile_approx(value, list(QUARTILES), accuracy)
    return [
        *_moments(value),
        *(F.get(q, F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))),
        F.max(value).alias("max"),
    ]


def describe(df: DataFrame, columns: list[str], quartiles: bool = False, accuracy: int = ACCURACY) -> DataFrame:
    """One row per numeric column, all in one pass. ``quartiles`` adds the approximate ones."""
    parts = []
    for name in columns:
        value = F.col(name).cast("double")
        stats = _full_profile(value, accuracy) if quartiles else [*_moments(value), F.max(value).alias("max")]
        parts.append(F.struct(F.lit(name).alias("column"), *stats))
    return df.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def group_profile(df: DataFrame, group: str, value: str, accuracy: int = ACCURACY) -> DataFrame:
    """Count, mean, deviation, extremes and approximate quartiles of a measure per group."""
    return df.groupBy(group).agg(*_full_profile(F.col(value).cast("double"), accuracy))


def group_center(df: DataFrame, group: str, value: str, accuracy: int = ACCURACY) -> DataFrame:
    """Mean, deviation and approximate median of a measure per group."""
    v = F.col(value).cast("double")
    return df.groupBy(group).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"), F.percentile_approx(v, 0.5, accuracy).alias("med")
    )


def object_describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, distinct values, most frequent value and its count per text column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Equal counts: the smaller value wins.
    best = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    return counts.groupBy("column").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_unique"), best.alias("top"), F.max("n").alias("freq")
    )


def exact_quantiles(df: DataFrame, columns: list[str], probs: tuple[float, ...] = QUARTILES, linear: bool = True) -> DataFrame:
    """Exact quantiles with linear interpolation, or else values that occur, rows ``(column, prob, quantile)``.

    Values are counted, then dealt by range of column and value, and written once. Rows per part tell
    which part holds a wanted rank; only those parts are gone through in order. A part has about as
    many distinct values as any other, so no task ranks a whole column. NaN and nulls do not count.
    """
    numbered = [
        F.struct(F.lit(i).alias("i"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("v"))
        for i, c in enumerate(columns)
    ]
    values = df.select(F.inline(F.array(*numbered))).where(F.col("v").isNotNull())
    counted = values.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartitionByRange(parts, "i", "v").withColumn("part", F.spark_partition_id())
    placed = stage(dealt, "ranked-values")

    # One row per part and column that it holds.
    sums = placed.groupBy("i", "part").agg(F.sum("n").alias("held"))
    column = W.partitionBy("i")
    before = F.sum("held").over(column.orderBy("part")) - F.col("held")
    sized = sums.select("i", "part", "held", before.alias("before"), F.sum("held").over(column).alias("total"))
    asked = sized.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    place = (F.col("total") - 1) * F.col("prob") if linear else F.greatest(F.ceil(F.col("total") * F.col("prob")) - 1, F.lit(0)).cast("double")
    asked = asked.withColumn("place", place)
    asked = asked.select("*", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    asked = asked.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("held")))

    # Two rows per column and quantile at most.
    own = placed.join(F.broadcast(asked.select("i", "part", "before").distinct()), ["i", "part"])
    last = F.col("before") + F.sum("n").over(W.partitionBy("i", "part").orderBy("v"))
    ranked = own.select("i", "part", "v", (last - F.col("n")).alias("first"), last.alias("end"))
    hits = ranked.join(F.broadcast(asked.select("i", "part", "prob", "place", "rank")), ["i", "part"]).where(
        (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    )
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    share = F.max("place") - F.floor(F.max("place"))
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("i"))
    return hits.groupBy(name.alias("column"), "prob").agg((low + share * (high - low)).alias("quantile"))


def _quartile_rows(df: DataFrame, columns: list[str], linear: bool = True) -> DataFrame:
    """``(column, q25, q50, q75)``."""
    rows = exact_quantiles(df, columns, linear=linear)
    names = ("q25", "q50", "q75")
    return rows.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in zip(QUARTILES, names)]
    )


def numeric_describe(df: DataFrame, columns: list[str], linear: bool = True) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, linear or values that occur, one row per column."""
    # One row per column on both sides.
    joined = describe(df, columns).join(F.broadcast(_quartile_rows(df, columns, linear)), "column", "left")
    return joined.select("column", "n", "mean", "stddev", "min", "q25", "q50", "q75", "max")


def box_plot(df: DataFrame, value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, fences, whisker ends and the number of values outside."""
    quartiles = _quartile_rows(df, [value]).drop("column")
    fences = quartiles.withColumn("lower_fence", F.col("q25") - whisker * (F.col("q75") - F.col("q25"))).withColumn(
        "upper_fence", F.col("q75") + whisker * (F.col("q75") - F.col("q25"))
    )
    box = fences.select(F.struct("*")).scalar()
    values = df.select(F.col(value).cast("double").alias("v"), box.alias("box")).where(F.col("v").isNotNull())
    inside = (F.col("v") >= F.col("box.lower_fence")) & (F.col("v") <= F.col("box.upper_fence"))
    return values.groupBy("box").agg(
        F.min(F.when(inside, F.col("v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outliers"),
    ).select("box.*", "lower_whisker", "upper_whisker", "n_outliers")
