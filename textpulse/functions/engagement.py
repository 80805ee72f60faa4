"""Engagement measures: shares, log scale and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the classes 0, 1, 2, 3; everything above is class 4.
COUNT_CLASS_BOUNDS = (0, 1, 10, 100)
SHARE_CLASS_BOUNDS = (0.0, 0.01, 0.1, 0.5)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _classes(value: Column, bounds: tuple) -> Column:
    zero, *upper = bounds
    out = F.when(value == zero, 0)
    for label, bound in enumerate(upper, start=1):
        out = out.when(value <= bound, label)
    # No otherwise(): a null value must stay null.
    return out.when(value > bounds[-1], len(bounds))


def count_class(count: Column | str) -> Column:
    """Class 0-4 of a count; values below zero fall in class 1."""
    return _classes(_col(count), COUNT_CLASS_BOUNDS)


def share_class(share: Column | str) -> Column:
    """Class 0-4 of a share of the group total."""
    return _classes(_col(share), SHARE_CLASS_BOUNDS)


def share_of(value: Column | str, total: Column | str) -> Column:
    """``value / total`` as double. The caller keeps totals of zero out."""
    return _col(value).cast("double") / _col(total).cast("double")


def log_count(count: Column | str) -> Column:
    """-1 at zero, NaN below, else log10."""
    c = _col(count)
    return F.when(c == 0, F.lit(-1.0)).when(c < 0, F.lit(float("nan"))).otherwise(F.log10(c))


def flag_int(flag: Column | str) -> Column:
    """Boolean to 0/1; null stays null."""
    return _col(flag).cast("int")


def flag_double(flag: Column | str) -> Column:
    return _col(flag).cast("boolean").cast("int").cast("double")
