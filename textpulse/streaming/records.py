"""Streams of keyed text records: count and values per batch, written as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from textpulse.sources.comments import kafka_options

TOPIC = "test"
INTERVAL = "10 seconds"


def kafka_stream(spark: SparkSession, topic: str = TOPIC, **settings) -> DataFrame:
    """``(key, value)`` as text; needs the Kafka connector on the class path."""
    source = spark.readStream.format("kafka").options(**kafka_options(**settings)).option("subscribe", topic)
    return text_records(source.load())


def text_records(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.format("parquet").schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def write_batches(
    stream: DataFrame, counts_path: str, values_path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Per batch: ``(batch_id, n)`` to one folder and the values to another.

    Each batch has a folder of its own that is overwritten, so a batch that runs again after a
    failure leaves its rows once. The checkpoint keeps the progress.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            batch.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{counts_path}/batch_id={batch_id}")
            batch.select("value").write.mode("overwrite").parquet(f"{values_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=INTERVAL)
    return writer.start()


def read_counts(spark: SparkSession, counts_path: str) -> DataFrame:
    """``(batch_id, n)`` of all batches written so far."""
    return spark.read.schema("n long, batch_id long").parquet(counts_path).select("batch_id", "n")
