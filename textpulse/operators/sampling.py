"""Samples and splits by a hash of the row's key.

A Bernoulli draw per key: whether a row is in the sample depends on its key and the seed only, so a
task that runs again, another partitioning or another engine draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.operators.joins import join_unique

_DIGITS = 13
_RANGE = float(16**_DIGITS)


def draw(key: Column | str, seed: int, purpose: str = "sample") -> Column:
    """A number in [0, 1) from the md5 of ``key:purpose:seed``.

    The purpose keeps draws apart, so that a split of a sample is independent of the sample. Rows
    without a key draw one number together, so that no row is lost.
    """
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("no key")), F.lit(f":{purpose}:{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(_RANGE)


def bernoulli_sample(df: DataFrame, fraction: float, key: str, seed: int) -> DataFrame:
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be in [0, 1]")
    return df.where(draw(key, seed) < fraction)


def rebalance(df: DataFrame, flag: Column, fraction: float, key: str, seed: int) -> DataFrame:
    """All rows with the flag and a sample of the others. A null flag counts as not set."""
    chosen = F.coalesce(flag, F.lit(False))
    return df.where(chosen | (draw(key, seed, "rebalance") < fraction))


def random_preview(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows in random order; a top-n, so no full sort."""
    return df.orderBy(draw(key, seed, "preview"), key).limit(n)


def random_split(df: DataFrame, key: str, seed: int, train: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Disjoint train and test parts that together hold all rows."""
    part = draw(key, seed, "split")
    return df.where(part < train), df.where(part >= train)


def group_flag(df: DataFrame, group: str, flag: Column, out: str = "any_set") -> DataFrame:
    """One row per group: is the flag set on any of its rows? With the row count as ``n``."""
    return df.groupBy(group).agg(F.max(flag).alias(out), F.count(F.lit(1)).alias("n"))


def sample_by_group(
    df: DataFrame, group: str, flag: Column, with_flag: float, without_flag: float, seed: int,
    out: str = "any_set",
) -> DataFrame:
    """Samples whole groups, at one rate with the flag and at another without, and keeps their rows."""
    groups = group_flag(df, group, flag, out)
    rate = F.when(F.col(out), F.lit(with_flag)).otherwise(F.lit(without_flag))
    drawn = groups.where(draw(group, seed, "group") < rate)
    return join_unique(df, drawn.select(group, out), [group], counts=drawn)
