"""Quantile sketches kept as a table: one per group, merged into coarser groups without the values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; see ``rank_error``.
SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """How far the rank of a told quantile lies from the asked one, as a share of all values, in 99 % of cases: the
    bound of KLL sketches of size k. It does not grow with the values or by merging."""
    return 2.296 / k**0.9723


def quantile_sketches(df: DataFrame, groups: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """``(*groups, n, sketch)``: partial sketches before the shuffle, some kilobytes per group. Nulls and NaN count for
    nothing; a group of those only has no row."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*groups, v.alias("__v")).where(F.col("__v").isNotNull())
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("__v", F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, or of all rows with no group."""
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    """``(*groups, n, prob, quantile)``."""
    told = [F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("quantile")) for p in probs]
    return sketches.select(*groups, "n", F.inline(F.array(*told)))


def exact_ranks(df: DataFrame, groups: list[str], value: str, told: DataFrame) -> DataFrame:
    """The rows of ``told`` with ``below`` and ``upto``: the shares of a group's values less than the quantile, and not
    above it. ``told`` holds some rows per group; they are broadcast."""
    v = F.col(value).cast("double")
    asked = told.groupBy(*groups).agg(F.collect_list(F.struct("prob", "quantile")).alias("__asked"))
    rows = df.select(*groups, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")).join(F.broadcast(asked), groups)
    places = rows.select(*groups, "__v", F.inline("__asked"))
    shares = places.groupBy(*groups, "prob", "quantile").agg(
        F.count_if(F.col("__v") < F.col("quantile")).alias("__below"), F.count_if(F.col("__v") <= F.col("quantile")).alias("__upto"), F.count(F.lit(1)).alias("n")
    )
    return shares.select(*groups, "n", "prob", "quantile", (F.col("__below") / F.col("n")).alias("below"), (F.col("__upto") / F.col("n")).alias("upto"))
