"""Article tables from CSV files whose columns may come in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The article schema, the columns that files may hold besides, the time format.
ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("articleID", T.StringType()),
        T.StructField("articleWordCount", T.IntegerType()),
        T.StructField("byline", T.StringType()),
        T.StructField("documentType", T.StringType()),
        T.StructField("headline", T.StringType()),
        T.StructField("keywords", T.StringType()),
        T.StructField("newDesk", T.StringType()),
        T.StructField("printPage", T.IntegerType()),
        T.StructField("pubDate", T.TimestampType()),
        T.StructField("sectionName", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("typeOfMaterial", T.StringType()),
        T.StructField("webURL", T.StringType()),
    ]
)
IGNORED = ("abstract", "multimedia")
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One file, or one folder of files with the same header. All columns are strings.

    A record with too few or too many fields fails.
    """
    return spark.read.csv(
        path, header=True, quote='"', escape='"', mode="FAILFAST", multiLine=multi_line,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def shape_articles(raw: DataFrame) -> DataFrame:
    """Drop what is ignored, type the rest, order the columns; other columns than expected fail."""
    df = raw.toDF(*[c.strip() for c in raw.columns]).drop(*IGNORED)
    expected = sorted(ARTICLE_SCHEMA.fieldNames())
    if sorted(df.columns) != expected:
        raise ValueError(f"an article has {len(expected)} fields: {', '.join(expected)}")
    typed = []
    for name in expected:
        dtype = ARTICLE_SCHEMA[name].dataType
        if isinstance(dtype, T.TimestampType):
            typed.append(_or_fail(name, F.try_to_timestamp(name, F.lit(TIME_FORMAT)), "timestamp"))
        elif isinstance(dtype, T.IntegerType):
            typed.append(_or_fail(name, F.col(name).try_cast("int"), "int"))
        else:
            # Text is never null: an empty field is the empty string.
            typed.append(F.coalesce(name, F.lit("")).alias(name))
    return df.select(*typed)


def _or_fail(name: str, value: Column, kind: str) -> Column:
    """A bad value fails, whatever the session's ANSI setting."""
    wrong = F.raise_error(F.concat(F.lit(f"{name} is no {kind}: "), F.coalesce(name, F.lit("null"))))
    return F.when(value.isNotNull(), value).otherwise(wrong.cast(kind)).alias(name)


def read_articles(spark: SparkSession, paths: list[str], multi_line: bool = False) -> DataFrame:
    """All files as one table; columns are matched by each file's own header."""
    out = None
    for path in paths:
        part = shape_articles(read_csv(spark, path, multi_line))
        out = part if out is None else out.unionByName(part)
    return out


def read_csv_concat(spark: SparkSession, paths: list[str], time_column: str = "pubDate") -> DataFrame:
    """Files whose columns differ, put together: missing columns are null, names in order, time parsed."""
    out = None
    for path in paths:
        part = spark.read.csv(path, header=True, quote='"', escape='"', mode="FAILFAST")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    df = out.select(*[F.col(c) for c in sorted(out.columns)])
    return df.withColumn(time_column, F.to_timestamp(time_column, TIME_FORMAT))
