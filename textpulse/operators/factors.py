"""Category columns as disjunctive tables, Burt tables and their normalised form."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.operators.joins import lookup_join


def _labels(columns: list[str]) -> Column:
    """``array<struct<variable, modality>>`` of one row; a null value is the modality ``null``."""
    return F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("modality"))
            for c in columns
        ]
    )


def modality_label(variable: Column | str, modality: Column | str) -> Column:
    """``NAME.value``."""
    variable = F.col(variable) if isinstance(variable, str) else variable
    return F.concat_ws(".", F.upper(variable), modality)


def disjunctive(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Long one-hot table ``(row_id, variable, modality)``: the places that hold 1."""
    return df.select(row_id, F.inline(_labels(columns)))


def modalities(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per modality, ``(variable, modality, n)``."""
    return df.select(F.inline(_labels(columns))).groupBy("variable", "modality").agg(F.count(F.lit(1)).alias("n"))


def disjunctive_vectors(df: DataFrame, columns: list[str], out: str = "indicator") -> DataFrame:
    """Adds the one-hot vector over all columns, modalities in alphabetical order."""
    text = df.withColumns({f"__t_{c}": F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns})
    stages = [
        StringIndexer(
            inputCols=[f"__t_{c}" for c in columns],
            outputCols=[f"__i_{c}" for c in columns],
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(
            inputCols=[f"__i_{c}" for c in columns], outputCols=[f"__o_{c}" for c in columns], dropLast=False
        ),
        VectorAssembler(inputCols=[f"__o_{c}" for c in columns], outputCol=out),
    ]
    encoded = Pipeline(stages=stages).fit(text).transform(text)
    return encoded.select(*df.columns, out)


def burt_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long Burt table ``(row_label, col_label, n)``: how often two modalities meet.

    Rows with equal values are counted first; only the distinct profiles are paired, and each gives
    as many pairs as there are columns, squared. No self-join.
    """
    profiles = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("k"))
    labels = F.transform(_labels(columns), lambda s: modality_label(s["variable"], s["modality"]))
    pairs = profiles.select("k", labels.alias("labels")).select(
        "k", "labels", F.explode("labels").alias("row_label")
    ).select("k", "row_label", F.explode("labels").alias("col_label"))
    return pairs.groupBy("row_label", "col_label").agg(F.sum("k").alias("n"))


def burt_matrix(df: DataFrame, columns: list[str], names: list[str] | None = None) -> DataFrame:
    """The same as a square table, one column per modality, empty places 0.

    ``names`` are the labels of the columns; without them they are fetched, as a plan must know its
    columns. ``burt_table`` is the form for any number of modalities.
    """
    table = burt_table(df, columns)
    names = names or [r[0] for r in table.select("col_label").distinct().orderBy("col_label").collect()]
    return table.groupBy("row_label").pivot("col_label", names).agg(F.sum("n")).na.fill(0)


def normalised_indicators(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """``x / p - 1`` of each row and modality, p the modality's share of rows, without its background:
    ``(row_id, variable, modality, value)`` of the places that hold 1. All other places of a row are -1.
    """
    counts = modalities(df, columns)
    total = df.agg(F.count(F.lit(1))).scalar()
    shares = counts.select("variable", "modality", (total / F.col("n") - 1).alias("value"))
    met = lookup_join(disjunctive(df, row_id, columns), shares, ["variable", "modality"], counts=counts, spread=[row_id])
    return met.select(row_id, "variable", "modality", "value")


def affine_rows(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """``(row_id, entries)``: rows of the normalised table as a common background of -1 and what lies above it,
    ``array<struct<label, weight>>`` with weight ``1 / p`` at the row's own modalities."""
    counts = modalities(df, columns)
    total = df.agg(F.count(F.lit(1))).scalar()
    shares = counts.select("variable", "modality", (total / F.col("n")).alias("weight"))
    met = lookup_join(disjunctive(df, row_id, columns), shares, ["variable", "modality"], counts=counts, spread=[row_id])
    entry = F.struct(modality_label("variable", "modality").alias("label"), "weight")
    return met.groupBy(row_id).agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def affine_values(rows: DataFrame, row_id: str, labels: list[str]) -> DataFrame:
    """Full rows for a few of the columns: ``(row_id, label, value)``, background included."""
    held = F.map_from_entries("entries")
    told = [F.struct(F.lit(name).alias("label"), (F.coalesce(F.try_element_at(held, F.lit(name)), F.lit(0.0)) - 1).alias("value")) for name in labels]
    return rows.select(row_id, F.inline(F.array(*told)))


def affine_products(rows: DataFrame, row_id: str, value, width: int) -> DataFrame:
    """``(row_id, product)``: dot product of every row with one of them over all ``width`` columns, from the sparse parts:
    sum of the weights both have, multiplied, less the weights of either, plus one per column."""
    found = rows.where(F.col(row_id) == F.lit(value)).select("entries").take(1)
    if not found:
        raise KeyError(value)
    own = {e["label"]: e["weight"] for e in found[0]["entries"]}
    mine = F.create_map(*[x for name, weight in own.items() for x in (F.lit(name), F.lit(weight))])
    met = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["weight"] * (F.coalesce(F.try_element_at(mine, e["label"]), F.lit(0.0)) - 1))
    return rows.select(row_id, (met - sum(own.values()) + width).alias("product"))


def normalised_gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(row_label, col_label, value)``: Z'Z of the normalised table for all pairs of modalities, worked out from the Burt
    table: ``n^2 B / (n_j n_k) - n``, so -n where two modalities never meet. Rows are not gone through again."""
    counts = modalities(df, columns)
    total = df.agg(F.count(F.lit(1))).scalar()
    sizes = counts.select(modality_label("variable", "modality").alias("label"), "n")
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct(F.col("label").alias("col_label"), F.col("n").alias("n_col"))))).scalar()
    # As many rows as the result has: the modalities are one value, each row of them is unnested with it.
    pairs = sizes.select(F.col("label").alias("row_label"), F.col("n").alias("n_row"), listed.alias("listed")).select("row_label", "n_row", F.inline("listed"))
    met = pairs.join(burt_table(df, columns).withColumnRenamed("n", "b"), ["row_label", "col_label"], "left")
    weight = total.cast("double") * total / (F.col("n_row").cast("double") * F.col("n_col"))
    return met.select("row_label", "col_label", (weight * F.coalesce("b", F.lit(0)) - total).alias("value"))
