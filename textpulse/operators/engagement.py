"""Engagement normalised within its group (for example recommendations within an article)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.functions.engagement import count_class, log_count, share_class, share_of
from textpulse.operators.joins import join_unique


def group_totals(df: DataFrame, group: str, measure: str, out: str = "group_total") -> DataFrame:
    """Sum of the measure and number of rows per group."""
    return df.groupBy(group).agg(F.sum(measure).alias(out), F.count(F.lit(1)).alias("n"))


def positive_totals(df: DataFrame, group: str, measure: str, out: str = "group_total") -> DataFrame:
    # The count is always above 0; reading it here keeps one aggregate for sums and counts alike, which
    # Spark then runs once for both uses in ``normalise_in_group``.
    return group_totals(df, group, measure, out).where((F.col(out) > 0) & (F.col("n") > 0))


def normalise_in_group(
    df: DataFrame, group: str, measure: str, out: str = "group_total", spread: list[str] | None = None
) -> DataFrame:
    """Adds group total, share of it, log scale and both classes; groups without a positive total drop out.

    The totals are a partial aggregate; its row counts also tell which groups to split in the join,
    ``spread`` the columns that deal out their rows (all by default; with fewer, columns that nobody reads drop out).
    """
    totals = positive_totals(df, group, measure, out)
    joined = join_unique(df, totals.select(group, out), [group], counts=totals, spread=spread)
    return (
        joined.withColumn("share", share_of(measure, out))
        .withColumn("log_value", log_count(measure))
        .withColumn("count_class", count_class(measure))
        .withColumn("share_class", share_class("share"))
    )
