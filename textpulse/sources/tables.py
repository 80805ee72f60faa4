"""Parquet, XML pages, word lists and vectors in; Parquet, histograms and tables out."""

from __future__ import annotations

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_START = "<page>"
PAGE_END = "</page>"


def read_prepared(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A prepared table. Give ``partitions`` only before training on few large files."""
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions else df


def write_prepared(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a scan out evenly by key before heavy work per row, in as many parts as a shuffle has. A scan that
    has as many splits already stays as it is: only few large files need the shuffle."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts, key)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw text of each ``<page>...</page>``, column ``xml``.

    The text source splits large dumps at the start tag, so a dump is read in parallel. What stands
    before the first page, and a page that is cut off, hold no end tag and drop out.
    """
    lines = spark.read.text(path, lineSep=PAGE_START)
    return lines.where(F.col("value").contains(PAGE_END)).select(
        F.concat(F.lit(PAGE_START), F.substring_index("value", PAGE_END, 1), F.lit(PAGE_END)).alias("xml")
    )


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines, column ``word``."""
    return spark.read.text(path).select(F.col("value").alias("word")).distinct()


def read_word_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """``(word, vector array<float>)`` from word2vec text: a header ``records dims``, then one word per line."""
    lines = spark.read.text(path).select(F.rtrim("value").alias("value"))
    header = F.col("value").rlike(rf"^\d+ {dims}$")
    if dims == 1:
        # A word that is a number looks like a header; the header tells how many other lines there are.
        header = header & (F.substring_index("value", " ", 1) == (lines.agg(F.count(F.lit(1))).scalar() - 1).cast("string"))
    parts = lines.where(~header).select(F.split("value", " ").alias("p"))
    rows = parts.select(
        F.get("p", F.lit(0)).alias("word"), F.slice("p", F.lit(2), F.size("p") - 1).cast("array<float>").alias("vector")
    )
    wrong = F.raise_error(F.concat(F.lit(f"not {dims} dimensions: "), F.col("word")))
    return rows.select("word", F.when(F.size("vector") == dims, F.col("vector")).otherwise(wrong).alias("vector"))


def save_word_model(model: Word2VecModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_word_model(path: str) -> Word2VecModel:
    return Word2VecModel.load(path)


def save_word_vectors(vectors: DataFrame, path: str) -> None:
    """``(word, vector)`` as a table, each task its own words."""
    vectors.select("word", F.col("vector").cast("array<float>").alias("vector")).write.mode("overwrite").parquet(path)


def load_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, vector array<float>").parquet(path)


def register(df: DataFrame, name: str) -> None:
    """A session view for SQL."""
    df.createOrReplaceTempView(name)


def write_histogram(histogram: DataFrame, path: str) -> None:
    """Lines ``edge n`` in order of the bins, which are few."""
    ordered = histogram.orderBy("bin").select(F.col("edge").cast("string"), F.col("n").cast("string"))
    ordered.coalesce(1).write.mode("overwrite").csv(path, sep=" ")


def write_document_frequencies(frequencies: DataFrame, path: str) -> None:
    """Lines ``term<tab>df``."""
    frequencies.select("term", F.col("df").cast("string")).write.mode("overwrite").csv(path, sep="\t", quote="")


def write_burt_matrix(matrix: DataFrame, path: str) -> None:
    """A header of modality labels, then the rows in the same order, without their labels."""
    labels = [c for c in matrix.columns if c != "row_label"]
    matrix.orderBy("row_label").select(*[F.col(f"`{c}`") for c in labels]).coalesce(1).write.mode("overwrite").csv(
        path, header=True
    )
