"""Arithmetic on ``array<double>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def literal_vector(values) -> Column:
    return F.array(*[F.lit(x if x is None else float(x)) for x in values]).cast("array<double>")


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def scale(factor: Column | float, v: Column | str) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(_col(v), lambda x: x * factor)


def multiply(a: Column | str, b: Column | str) -> Column:
    """Element by element."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x * y)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(multiply(a, b), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column | str) -> Column:
    """Length 1; a zero vector has no direction and gives null elements."""
    v = _col(v)
    # The one-element array holds the length, so that it is worked out once and not per element.
    scaled = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.try_divide(x, n)))
    return F.get(scaled, F.lit(0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null when either side is a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    gaps = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
