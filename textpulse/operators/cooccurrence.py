"""Word vectors from windowed co-occurrence: counts, shifted mutual information and its leading directions, as tables.

Nothing that grows with the vocabulary comes to the driver: counts and weights are rows, and the factors are those of
``subspace.truncated_svd``. Pairs are stored in cells, see ``paircells``; a table of counts or weights that this module made
knows its cells, and the next step goes on from them instead of from its rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.functions.vectors import multiply
from textpulse.operators import paircells
from textpulse.operators.embeddings import part_numbers
from textpulse.operators.joins import lookup_join
from textpulse.operators.paircells import PACKED, Cells, Weights
from textpulse.operators.subspace import MAX_HELD, OVERSAMPLE, ROUNDS, iterated_svd, truncated_svd
from textpulse.session import discard, importable, stage

WINDOW = 3
#: Attribute of a table with its cells.
CELLS = "_pair_cells"


def cooccurrences(df: DataFrame, tokens: str, window: int = WINDOW) -> DataFrame:
    """``(word, context, n)``: how often two tokens stand at most ``window`` places apart, both ways round.

    Pairs are made and summed within a task, in the order of their words, before the only shuffle; n tokens make n times
    the window of them. Counts are the same both ways round, so one way is stored and the other told from it. ``df`` is
    read twice, so it is best a stored table.
    """
    spark = df.sparkSession
    importable(spark)
    n_tokens = df.agg(F.sum(F.greatest(F.size(tokens), F.lit(0)))).first()[0] or 0
    groups = paircells.groups_for(n_tokens * window, spark.sparkContext.defaultParallelism)
    numbers = part_numbers(spark, groups * (groups + 1) // 2)
    found = df.select(tokens).mapInArrow(partial(paircells.counted, window=window, groups=groups, numbers=numbers, chunk=paircells.CHUNK), PACKED)
    cells = stage(found.repartition(len(numbers), "cell").mapInArrow(paircells.merged, PACKED), "pairs")
    return _with_cells(cells.mapInArrow(paircells.pair_rows, "word string, context string, n long"), Cells(cells, groups, numbers))


def _with_cells(df: DataFrame, cells) -> DataFrame:
    setattr(df, CELLS, cells)
    return df


def shifted_pmi(counts: DataFrame, shift: float = 1.0, least: int = 1) -> DataFrame:
    """``(word, context, weight)``: the positive part of ln(n N / (n_word n_context)) - ln(shift).

    Words with fewer than ``least`` neighbours in all are left out of words and contexts before anything is weighed.
    """
    cells = getattr(counts, CELLS, None)
    if cells is not None:
        return _shifted_pmi_of_cells(cells, shift, least)
    margins = counts.groupBy("word").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n")).where(F.col("total") >= least)
    margins = stage(margins, "margins")
    words = margins.select("word", F.col("total").alias("n_word"))
    contexts = margins.select(F.col("word").alias("context"), F.col("total").alias("n_context"))
    met = lookup_join(counts, words, ["word"], spread=["context"], counts=margins.select("word", "n"))
    met = lookup_join(met, contexts, ["context"], spread=["word"], counts=margins.select(F.col("word").alias("context"), "n"))
    every = stage(met, "pairs")
    total = every.agg(F.sum("n")).scalar()
    weight = F.log(F.col("n") * total / (F.col("n_word") * F.col("n_context"))) - F.log(F.lit(float(shift)))
    return every.select("word", "context", weight.alias("weight")).where(F.round("weight", 12) > 0)


def _shifted_pmi_of_cells(cells: Cells, shift: float, least: int) -> DataFrame:
    """The same with a word's total sent to the cells of its group; counts are stored, weights told from them."""
    totals = cells.rows.mapInArrow(paircells.word_totals, "word string, total long")
    margins = totals.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("total").alias("total")).where(F.col("total") >= least)
    margins = stage(margins, "margins")
    met = stage(cells.dealt(margins, "total").mapInArrow(paircells.of_kept, PACKED), "met")
    weights = Weights(met.agg(F.sum("met")).first()[0] or 0, float(shift))
    discard(margins)
    rows = met.mapInArrow(weights.rows, "word string, context string, weight double")
    return _with_cells(rows, (Cells(met, cells.groups, cells.numbers), weights))


def pmi_vectors(
    weights: DataFrame, size: int, rounds: int = ROUNDS, oversample: int = OVERSAMPLE, seed: int = 1, max_held: int = MAX_HELD
) -> tuple[DataFrame, list[float]]:
    """``(word, vector)`` and the singular values: words along the leading directions of the table of weights, each scaled
    by the root of its singular value. Words without a weight have no vector. Over ``max_held`` words weights that are in
    cells stay there."""
    found = _factors_of_cells(weights, size, rounds, oversample, seed, max_held)
    if found is None:
        kept = stage(weights.select("word", "context", "weight"), "weights")
        found = truncated_svd(kept, "word", "context", size, rounds, oversample, seed, max_held)
    rows, s, _ = found
    roots = F.array(*[F.lit(float(x) ** 0.5) for x in s])
    return rows.withColumn("vector", multiply("vector", roots)), s


def _factors_of_cells(weights: DataFrame, size: int, rounds: int, oversample: int, seed: int, max_held: int):
    """The same iteration; the weights are their own transpose. A round sends each vector to the cells of its word's
    group and a sum per word and cell back; what is shuffled goes before the next one."""
    if (held := getattr(weights, CELLS, None)) is None:
        return None
    cells, weigh = held
    words = stage(cells.rows.mapInArrow(weigh.words, "word string").distinct(), "weighed-words")
    n = words.count()
    if n <= max_held:
        return None
    width = min(size + oversample, n)

    def times(factor: DataFrame) -> DataFrame:
        parts = cells.dealt(factor, "vector").mapInArrow(partial(weigh.product, width=width), "word string, vector array<double>")
        sums = [F.expr(f"sum(vector[{i}]) AS s{i}") for i in range(width)]
        return parts.groupBy("word").agg(*sums).select("word", F.array(*[f"s{i}" for i in range(width)]).alias("vector"))

    return iterated_svd(words, times, times, "word", size, width, rounds, seed)
