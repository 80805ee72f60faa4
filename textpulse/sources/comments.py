"""Comments from Kafka: reader options, and the decoding of the value."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The comment schema, spelled as in the data.
COMMENT_SCHEMA = T.StructType(
    [
        T.StructField("commentID", T.IntegerType()),
        T.StructField("commentBody", T.StringType()),
        T.StructField("commentType", T.StringType()),
        T.StructField("createDate", T.TimestampType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("editorsSelection", T.BooleanType()),
        T.StructField("recommandations", T.IntegerType()),
        T.StructField("replyCount", T.IntegerType()),
        T.StructField("sharing", T.IntegerType()),
        T.StructField("userDisplayName", T.StringType()),
        T.StructField("userLocation", T.StringType()),
        T.StructField("articleID", T.StringType()),
        T.StructField("newDesk", T.StringType()),
        T.StructField("articleWordCount", T.IntegerType()),
        T.StructField("printPage", T.IntegerType()),
        T.StructField("typeOfMaterial", T.StringType()),
    ]
)
SERVERS = "localhost:9092"
TOPIC = "comments"


def kafka_options(servers: str = SERVERS, group: str | None = None) -> dict[str, str]:
    """Settings shared by batch and stream reads. Progress of a stream is kept by its checkpoint.

    Spark names a group of its own for each query; give one only where the server asks for it.
    """
    named = {} if group is None else {"kafka.group.id": group}
    return {"kafka.bootstrap.servers": servers, "startingOffsets": "earliest", **named}


def offset_range_options(
    topic: str, partitions: int, start: int, end: int, **settings
) -> dict[str, str]:
    """A batch read of ``start`` to ``end`` (left out) of each partition."""
    def offsets(at: int) -> str:
        return json.dumps({topic: {str(p): at for p in range(partitions)}})

    return {
        **kafka_options(**settings),
        "subscribe": topic,
        "startingOffsets": offsets(start),
        "endingOffsets": offsets(end),
    }


def topic_options(topic: str = TOPIC, **settings) -> dict[str, str]:
    """A batch read of all that a topic holds, of all its partitions."""
    return {**kafka_options(**settings), "subscribe": topic, "endingOffsets": "latest"}


def read_comment_records(spark: SparkSession, options: dict[str, str] | None = None) -> DataFrame:
    """Raw records, all of the topic unless options say otherwise; needs the Kafka connector on the class path."""
    return spark.read.format("kafka").options(**(options or topic_options())).load()


def decode_records(records: DataFrame, schema: T.StructType = COMMENT_SCHEMA) -> DataFrame:
    """The value, JSON in bytes, as columns. A value that is no JSON fails."""
    parsed = F.from_json(F.col("value").cast("string"), schema, {"mode": "FAILFAST"})
    return records.select(parsed.alias("c")).select("c.*")


def comments_from_rows(spark: SparkSession, rows) -> DataFrame:
    """A small in-memory table with the comment schema."""
    return spark.createDataFrame(rows, COMMENT_SCHEMA)
