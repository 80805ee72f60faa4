"""One-way analysis of variance and chi-square test of independence."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.operators.joins import lookup_join
from textpulse.session import stage


def _java_double(cls: str, method: str, *args: Column) -> Column:
    """A static function of the maths library on Spark's class path, on one result row."""
    present = args[0].isNotNull()
    for a in args[1:]:
        present = present & a.isNotNull()
    safe = [F.coalesce(a.cast("double"), F.lit(1.0)) for a in args]
    return F.when(present, F.java_method(F.lit(cls), F.lit(method), *safe).cast("double"))


def f_upper_tail(f: Column, dfb: Column, dfw: Column) -> Column:
    """P(F > f): a regularised beta function."""
    x = F.try_divide(dfw, dfw + dfb * f)
    return _java_double("org.apache.commons.math3.special.Beta", "regularizedBeta", x, dfw / 2, dfb / 2)


def chi_square_upper_tail(statistic: Column, dof: Column) -> Column:
    """P(X > statistic): a regularised gamma function. With no degree of freedom it is 1."""
    tail = _java_double(
        "org.apache.commons.math3.special.Gamma", "regularizedGammaQ", F.greatest(dof, F.lit(1)) / 2, statistic / 2
    )
    return F.when(dof == 0, F.lit(1.0)).otherwise(tail)


def anova(df: DataFrame, category: str, value: str, p_value: bool = True) -> DataFrame:
    """One row ``(dfb, dfw, f_value, eta_sq, omega_sq[, p_value])``, see ``anova_each``."""
    return anova_each(df, category, [value], p_value).drop("measure")


def anova_each(df: DataFrame, category: str, values: list[str], p_value: bool = True) -> DataFrame:
    """One row ``(measure, dfb, dfw, f_value, eta_sq, omega_sq[, p_value])`` per measure.

    One aggregate by measure and category, then one over the categories: the number of categories may
    be large. Rows without category or value are left out. With one category, or no spread within the
    groups, F is null.
    """
    pairs = [F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("v")) for v in values]
    listed = F.inline(F.array(*pairs)) if len(pairs) > 1 else pairs[0].alias("one")
    rows = df.select(F.col(category).alias("cat"), listed)
    if len(pairs) == 1:
        rows = rows.select("cat", "one.*")
    groups = (
        rows.where(F.col("cat").isNotNull() & F.col("v").isNotNull())
        .groupBy("measure", "cat")
        .agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("spread"))
        # Always true; with it both uses below read the same columns, and Spark aggregates once.
        .where(F.col("spread") >= 0)
    )
    means = groups.groupBy("measure").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    gap = F.col("mean") - F.col("grand")
    # ``means`` has one row per measure; a single one is a scalar, as a join on a constant has no key.
    if len(values) == 1:
        centred = groups.withColumn("grand", means.select("grand").scalar())
    else:
        centred = groups.join(F.broadcast(means), "measure")
    sums = centred.groupBy("measure").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * gap * gap).alias("ssb"),
        F.sum("spread").alias("ssw"),
    ).select("measure", "ssb", "ssw", (F.col("k") - 1).alias("dfb"), (F.col("n") - F.col("k")).cast("double").alias("dfw"))
    between, within = F.try_divide(F.col("ssb"), F.col("dfb")), F.try_divide(F.col("ssw"), F.col("dfw"))
    result = sums.withColumn("msw", within).select(
        "measure",
        "dfb",
        "dfw",
        F.try_divide(between, F.col("msw")).alias("f_value"),
        F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta_sq"),
        F.try_divide(F.col("ssb") - F.col("dfb") * F.col("msw"), F.col("ssb") + F.col("ssw") + F.col("msw")).alias("omega_sq"),
    )
    if p_value:
        result = result.withColumn("p_value", f_upper_tail(F.col("f_value"), F.col("dfb"), F.col("dfw")))
    return result


def contingency(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows ``(feature, value, label, n)`` of all cross tables, counted in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])
    return (
        df.select(F.col(label).cast("string").alias("label"), F.inline(pairs))
        .where(F.col("label").isNotNull() & F.col("value").isNotNull())
        .groupBy("feature", "value", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def chi_square(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row per feature: statistic, degrees of freedom, p-value of independence from the label.

    Works on the cross tables, whose size is that of the categories; they are written once, so that their
    size is known. Cells without rows add their
    expected count, which is what the filled cells' expected counts leave of the total.
    """
    cells = stage(contingency(df, features, label), "cells")
    by_value = cells.groupBy("feature", "value").agg(F.sum("n").alias("n_value"))
    by_label = cells.groupBy("feature", "label").agg(F.sum("n").alias("n_label"))
    totals = by_value.groupBy("feature").agg(F.sum("n_value").alias("total"), F.count(F.lit(1)).alias("rows"))
    columns = by_label.groupBy("feature").agg(F.count(F.lit(1)).alias("cols"))
    expected = F.col("n_value") * (F.col("n_label") / F.col("total"))
    # Few features and labels: their tables are broadcast while their size allows, so that no feature is one task.
    valued = lookup_join(cells, by_value, ["feature", "value"], spread=["label"])
    labelled = lookup_join(valued, by_label, ["feature", "label"], spread=["value"])
    filled = lookup_join(labelled, totals.join(columns, "feature"), ["feature"], spread=["value"]).withColumn("expected", expected)
    gap = F.col("n") - F.col("expected")
    sums = filled.groupBy("feature", "total", "rows", "cols").agg(
        F.sum(gap * gap / F.col("expected")).alias("chi"),
        F.sum("expected").alias("covered"),
        F.count(F.lit(1)).alias("n_cells"),
    )
    full = F.col("n_cells") == F.col("rows") * F.col("cols")
    result = sums.select(
        "feature",
        (F.col("chi") + F.when(full, F.lit(0.0)).otherwise(F.col("total") - F.col("covered"))).alias("statistic"),
        ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"),
    )
    return result.withColumn("p_value", chi_square_upper_tail(F.col("statistic"), F.col("dof")))


def chi_square_ml(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """The same through Spark ML, rows ``(featureIndex, pValue, degreesOfFreedom, statistic)``."""
    assembled = VectorAssembler(inputCols=features, outputCol="__features").transform(
        df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("string").alias("__label"))
    )
    indexer = StringIndexer(inputCol="__label", outputCol="__index", stringOrderType="alphabetAsc")
    indexed = indexer.fit(assembled).transform(assembled)
    return ChiSquareTest.test(indexed, "__features", "__index", flatten=True)
