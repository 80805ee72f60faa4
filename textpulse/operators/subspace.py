"""Truncated singular value decomposition of sparse rows by subspace iteration, as joins and sums.

The matrix is a table of postings ``(row, column, weight)``; factors are tables ``(key, vector)`` of a few numbers per
key. A round multiplies a block of vectors by the matrix and by its transpose, one join and one sum each, and makes
the block orthonormal by its Gram matrix. The driver holds Gram matrices, width x width numbers, a block of up to
``MAX_HELD`` columns, and nothing that grows with the rows or with more columns. The start block is drawn from the columns' names, so that the same table gives the
same factors under any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.operators.joins import lookup_join
from textpulse.operators.lsa import CONCEPTS, Factors
from textpulse.operators.sampling import draw
from textpulse.operators.terms import NUM_TERMS, document_frequencies, plain_idf, term_counts, term_table
from textpulse.session import discard, local_rows, stage

#: Rounds of multiplication, vectors carried besides those asked for, and steps of the small eigenproblem.
ROUNDS, OVERSAMPLE, STEPS = 5, 4, 200
#: Columns whose block the driver holds: some 10 MB.
MAX_HELD = 100_000


def orthonormal_weights(gram: np.ndarray) -> np.ndarray:
    """Columns w with w' G w = 1 that make a block with Gram matrix ``G`` orthonormal: Gram-Schmidt on the coordinates.
    A vector that depends on those before it gets zeros."""
    n = len(gram)
    out = np.zeros((n, n))
    for j in range(n):
        u = np.zeros(n)
        u[j] = 1.0
        u = u - out @ (out.T @ gram[j])
        square = u @ gram @ u
        if square > 1e-12 * gram[j, j]:
            out[:, j] = u / np.sqrt(square)
    return out


def small_eigen(matrix: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and vectors of a small symmetric matrix by orthogonal iteration from the unit vectors."""
    n = len(matrix)
    q = np.eye(n)
    for _ in range(steps):
        done = np.zeros((n, n))
        for j, y in enumerate((matrix @ q).T):
            u = y - done @ (done.T @ y)
            length = np.sqrt(u @ u)
            done[:, j] = u / length if length > 0 else 0.0
        q = done
    values = np.array([q[:, j] @ matrix @ q[:, j] for j in range(n)])
    order = np.argsort(-values, kind="stable")
    return values[order], q[:, order]


def times(postings: DataFrame, factor: DataFrame, on: str, to: str, width: int, counts: DataFrame | None = None) -> DataFrame:
    """``(to, vector)``: the matrix, or its transpose, times a factor ``(on, vector)``.

    The sums are partial before the shuffle. Keys of ``on`` with many postings are split, see ``lookup_join``.
    """
    met = lookup_join(postings, factor, [on], spread=[to], counts=counts)
    sums = [F.expr(f"sum(weight * vector[{i}]) AS s{i}") for i in range(width)]
    return met.groupBy(to).agg(*sums).select(to, F.array(*[f"s{i}" for i in range(width)]).alias("vector"))


def gram(factor: DataFrame, width: int) -> np.ndarray:
    """Products of all pairs of columns of a factor, in one pass: one group per pair."""
    pairs = F.expr("flatten(transform(vector, (x, i) -> transform(slice(vector, 1, i + 1), y -> x * y)))")
    sums = factor.select(F.posexplode(pairs).alias("pair", "x")).groupBy("pair").agg(F.sum("x").alias("s"))
    out = np.zeros((width, width))
    places = [(i, j) for i in range(width) for j in range(i + 1)]
    for r in sums.collect():  # width * (width + 1) / 2 rows
        i, j = places[r["pair"]]
        out[i, j] = out[j, i] = r["s"]
    return out


def combine(vector: str, weights: np.ndarray) -> Column:
    """The row vector times a small matrix."""
    columns = ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in w) + ")" for w in weights.T)
    return F.expr(f"transform(array({columns}), w -> aggregate(zip_with({vector}, w, (x, y) -> x * y), 0D, (s, x) -> s + x))")


def start_block(columns: DataFrame, key: str, width: int, seed: int) -> DataFrame:
    """``(key, vector)`` of numbers in [-0.5, 0.5), each drawn from the key, its place and the seed."""
    return columns.select(key, F.array(*[draw(key, seed, f"start{i}") - 0.5 for i in range(width)]).alias("vector"))


def truncated_svd(
    postings: DataFrame, row: str, column: str, k: int, rounds: int = ROUNDS, oversample: int = OVERSAMPLE, seed: int = 1,
    max_held: int = MAX_HELD,
) -> tuple[DataFrame, list[float], DataFrame]:
    """``(row, vector)``, singular values in falling order, ``(column, vector)`` of the ``k`` leading directions.

    ``postings`` is a stored table ``(row, column, weight)``, one row per place. There are as many directions as
    the matrix has, if those are fewer. Signs are set so that each direction's largest entry over the columns is
    positive. A block over at most ``max_held`` columns is held by the driver and goes to the rows, which then lie in
    one list each and are not shuffled again.
    """
    counts = stage(postings.groupBy(column).agg(F.count(F.lit(1)).alias("n")), "column-counts")
    n_columns = counts.count()
    width = min(k + oversample, n_columns)
    if n_columns <= max_held:
        return _svd_of_few_columns(postings, counts, row, column, k, width, rounds, seed)
    forth, back = partial(times, postings, on=column, to=row, width=width, counts=counts), partial(times, postings, on=row, to=column, width=width)
    return iterated_svd(counts.select(column), forth, back, column, k, width, rounds, seed)


def iterated_svd(
    columns: DataFrame, forth: Callable[[DataFrame], DataFrame], back: Callable[[DataFrame], DataFrame], column: str,
    k: int, width: int, rounds: int, seed: int,
) -> tuple[DataFrame, list[float], DataFrame]:
    """The iteration over a stored table of the columns, with the products of a factor with the matrix and with its transpose."""
    held = stage(start_block(columns, column, width, seed), "block")
    block = held.withColumn("vector", combine("vector", orthonormal_weights(gram(held, width))))
    for _ in range(rounds):
        rows = stage(forth(block), "rows")
        discard(held)
        held = stage(back(rows), "block")
        discard(rows)
        block = held.withColumn("vector", combine("vector", orthonormal_weights(gram(held, width))))
    rows = stage(forth(block), "rows")
    values, turn = small_eigen(gram(rows, width))
    kept = [j for j in range(min(k, width)) if values[j] > 1e-12 * max(values[0], 1e-300)]
    s = np.sqrt(values[kept])
    turned = stage(block.withColumn("vector", combine("vector", turn[:, kept])), "columns")
    discard(held)
    largest = [F.expr(f"max_by(vector[{i}], struct(abs(vector[{i}]), `{column}`))") for i in range(len(kept))]
    signs = np.array([1.0 if x >= 0 else -1.0 for x in turned.agg(*largest).first()]) if kept else np.zeros(0)
    flipped = turned.withColumn("vector", combine("vector", np.diag(signs)))
    return rows.withColumn("vector", combine("vector", turn[:, kept] * signs / s)), [float(x) for x in s], flipped


def _products(batches, block: np.ndarray, transposed: bool):
    """Batches ``(row, entries)`` times a block: ``(row, vector)``, or their transpose times that: ``(place, vector)``."""
    n, width = block.shape
    total = np.zeros((n, width))
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        entries = batch.column(1).flatten()
        place, weight = entries.field("place").to_numpy(), entries.field("weight").to_numpy()
        of = np.repeat(np.arange(len(lengths)), lengths)
        # One column after the other, so that only one number per entry is held.
        sums = [np.bincount(of, weight * block[place, c], len(lengths)) for c in range(width)]
        if transposed:
            for c, y in enumerate(sums):
                total[:, c] += np.bincount(place, weight * y[of], n)
        else:
            ends = pa.array(np.arange(len(lengths) + 1) * width, pa.int32())
            vectors = pa.ListArray.from_arrays(ends, pa.array(np.array(sums).T.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[batch.schema.names[0], "vector"])
    if transposed and total.any():
        ends = pa.array(np.arange(n + 1) * width, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], names=["place", "vector"])


def _svd_of_few_columns(
    postings: DataFrame, counts: DataFrame, row: str, column: str, k: int, width: int, rounds: int, seed: int
) -> tuple[DataFrame, list[float], DataFrame]:
    """The same iteration with the block on the driver: a round is one pass over the rows, each a list of its entries;
    what is shuffled is a sum per column and task."""
    spark = postings.sparkSession
    kind = counts.schema[column].dataType.simpleString()
    start = start_block(counts.where(F.col(column).isNotNull()), column, width, seed).orderBy(column).collect()
    names, block = [r[0] for r in start], np.array([r["vector"] for r in start]).reshape(len(start), width)
    places = local_rows(spark, list(zip(names, range(len(names)))), f"`{column}` {kind}, place int")
    entry = F.struct("place", F.col("weight").cast("double").alias("weight"))
    found = postings.where(F.col(row).isNotNull() & F.col("weight").isNotNull()).join(F.broadcast(places), column)
    rows = stage(found.groupBy(row).agg(F.collect_list(entry).alias("entries")), "entries")

    def around(block: np.ndarray) -> np.ndarray:
        parts = rows.select(row, "entries").mapInArrow(lambda it: _products(it, block, True), "place int, vector array<double>")
        sums = parts.groupBy("place").agg(F.array(*[F.expr(f"sum(vector[{i}])") for i in range(block.shape[1])]).alias("vector"))
        out = np.zeros(block.shape)
        for r in sums.collect():  # a row per column
            out[r["place"]] = r["vector"]
        return out

    block = block @ orthonormal_weights(block.T @ block)
    for _ in range(rounds):
        block = around(block)
        block = block @ orthonormal_weights(block.T @ block)
    product = block.T @ around(block)
    values, turn = small_eigen((product + product.T) / 2)
    kept = [j for j in range(min(k, width)) if values[j] > 1e-12 * max(values[0], 1e-300)]
    s, turned = np.sqrt(values[kept]), block @ turn[:, kept]
    largest = [max(range(len(names)), key=lambda i: (abs(turned[i, c]), names[i])) for c in range(len(kept))]
    turned = turned * np.array([1.0 if turned[i, c] >= 0 else -1.0 for c, i in enumerate(largest)])
    schema = T.StructType([rows.schema[row], T.StructField("vector", T.ArrayType(T.DoubleType()))])
    u = rows.select(row, "entries").mapInArrow(lambda it: _products(it, turned / s, False), schema)
    return u, [float(x) for x in s], local_rows(spark, list(zip(names, turned.tolist())), f"`{column}` {kind}, vector array<double>")


def factorise_postings(
    df: DataFrame, row_id: str, tokens: str, num_terms: int | None = NUM_TERMS, k: int = CONCEPTS,
    rounds: int = ROUNDS, oversample: int = OVERSAMPLE, seed: int = 1,
) -> Factors:
    """Latent semantic factors of the term-document matrix, of the ``num_terms`` most frequent terms or of all.

    ``df`` is best a stored table with one row per document. Documents without any of the terms have a zero vector.
    """
    if num_terms is None:
        n = df.agg(F.count(F.lit(1))).scalar()
        table = document_frequencies(df, tokens).withColumn("idf", plain_idf("df", n))
    else:
        table = term_table(df, tokens, num_terms)
    table = stage(table.select("term", "df", "idf"), "terms")
    weight = F.col("tf") / F.col("n_terms") * F.col("idf")
    frequencies = table.select("term", F.col("df").alias("n"))
    met = lookup_join(term_counts(df, row_id, tokens), table.select("term", "idf"), ["term"], spread=[row_id], counts=frequencies)
    postings = stage(met.select(row_id, "term", weight.alias("weight")), "postings")
    rows, s, columns = truncated_svd(postings, row_id, "term", k, rounds, oversample, seed)
    zero = F.array_repeat(F.lit(0.0), len(s))
    documents = df.select(row_id).join(rows, row_id, "left").select(row_id, F.coalesce("vector", zero).alias("vector"))
    terms = table.join(columns, "term").select("term", "vector", "idf")
    return Factors(stage(documents, "documents"), stage(terms, "terms"), s)
