"""Sparse TF-IDF vectors of all terms, without a vocabulary on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.functions.tokens import term_runs
from textpulse.operators.embeddings import ALL_KEYS, BLOCK, in_blocks
from textpulse.operators.numbering import row_numbers
from textpulse.operators.terms import n_docs, smoothed_idf
from textpulse.operators.unnest import unnest, unnest_structs
from textpulse.session import stage


def term_indices(cells: DataFrame) -> DataFrame:
    """``(term, df, blocks, index)`` from counts per block and term ``(block, term, n)``: terms numbered from 0, the most
    frequent first, equally frequent ones in their order."""
    table = cells.groupBy("term").agg(F.sum("n").alias("df"), F.collect_list(BLOCK).alias("blocks"))
    return row_numbers(table.withColumn("__rare", -F.col("df")), ["__rare", "term"], "index").drop("__rare")


def sparse_tfidf(df: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """``keys`` and the row's vectors, stored: ``indices`` in ascending order, with the ``counts`` and the smoothed ``tfidf``
    of those terms. ``keys`` name a row, the first of them alone; ``df`` is best a stored table.

    Every term of the rows has its index, whatever their number: the table of terms stays on the executors. Rows are
    dealt in blocks, as by ``embeddings.tfidf_vectors``: a block gets the index and weight of its terms once, and
    postings never leave their block.
    """
    dealt = in_blocks(df.select(*keys, F.sort_array(F.array_compact(tokens)).alias("tokens")), keys[0])
    cells = unnest(dealt, [BLOCK], F.array_distinct("tokens"), "term").groupBy(BLOCK, "term").agg(F.count(F.lit(1)).alias("n"))
    table = term_indices(cells).select("index", "term", "blocks", smoothed_idf("df", n_docs(df)).alias("idf"))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = table.select(F.explode("blocks").alias(BLOCK), "term", "index", "idf").repartition(parts, BLOCK)
    mine = unnest_structs(dealt, [BLOCK, *keys], term_runs("tokens"), "term")
    entry = F.struct("index", F.col("tf").cast("double").alias("tf"), (F.col("tf") * F.col("idf")).alias("tfidf"))
    # A block's terms fit a hash table, so postings need not be sorted.
    rows = mine.join(needed.hint("shuffle_hash"), [BLOCK, "term"]).groupBy(BLOCK, *keys).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    held = rows.select(*keys, F.col("e.index").alias("indices"), F.col("e.tf").alias("counts"), F.col("e.tfidf").alias("tfidf"))
    # Else Spark would deal both sides anew, by block and term.
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        held = stage(held, "sparse")
    finally:
        spark.conf.set(ALL_KEYS, before)
    # Rows without a term are not in any join.
    present = F.coalesce(F.exists(tokens, lambda t: t.isNotNull()), F.lit(False))
    empty = [F.array().cast(held.schema[c].dataType).alias(c) for c in ("indices", "counts", "tfidf")]
    return held.unionByName(df.where(~present).select(*keys, *empty))
