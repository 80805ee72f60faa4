"""From documents to packed sequences in five stages; each reads the Parquet that the one before has written.

toxicity: documents scored toxic go. exact_dedup: of equal texts the one with the smallest doc_id stays. near_dedup:
of each class of near-duplicates one stays. mixing: rows in the order of slots in which sources meet their target
weights. packing: one row per piece of a document with its place in a sequence; sequences are numbered in the order
in which mixing has written their first documents, told by file and row and not by how the table is read. Nulls, empty texts, repeated rows,
empty tables and further columns are treated as each operator says; all but the last stage return the columns that
they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textpulse.llm.common import stage, table
from textpulse.llm.exact import distinct_texts
from textpulse.llm.mixing import mixed_rows
from textpulse.llm.near import distinct_classes
from textpulse.llm.packing import pack_documents
from textpulse.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_texts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_classes(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, in_order=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# Tokenising, sketches and fitted scores are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
