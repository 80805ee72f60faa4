"""Latent semantic analysis over term-document rows, and queries on the factors.

Factors are frames ``(key, vector array<double>)`` with the real key of each row, one for documents
(U) and one for terms (V); the singular values are a short list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textpulse.functions.vectors import as_doubles, dot, literal_vector, multiply, unit
from textpulse.operators.embeddings import vector_of
from textpulse.operators.joins import lookup_join
from textpulse.operators.terms import NUM_TERMS, term_counts, term_document_vectors
from textpulse.session import local_rows

CONCEPTS = 10
TOP = 10


@dataclass
class Factors:
    documents: DataFrame  # (row_id, vector)
    terms: DataFrame  # (term, vector, idf)
    singular_values: list[float]


def factorise(
    df: DataFrame, row_id: str, tokens: str, num_terms: int = NUM_TERMS, k: int = CONCEPTS
) -> Factors:
    """Truncated SVD of the term-document matrix.

    V and s come from Spark's solver for every number of terms. U is then a sum over each
    document's postings, ``weight * V[term] / s``, keyed by the document, so no row order is relied
    on. V has ``num_terms`` rows. The tokens are read four times, so ``df`` is best a stored table. Signs are set so that each concept's largest entry in V is positive.
    """
    spark = df.sparkSession
    rows, terms = term_document_vectors(df.select(row_id, tokens), tokens, num_terms)
    features = MLUtils.convertVectorColumnsFromML(rows.select("features"), "features")
    features = features.persist()
    try:
        # No more concepts than terms.
        svd = RowMatrix(features).computeSVD(min(k, terms.count()), computeU=False)
    finally:
        features.unpersist()
    s, v = [float(x) for x in svd.s], svd.V.toArray().copy()
    for c in range(len(s)):
        if v[abs(v[:, c]).argmax(), c] < 0:
            v[:, c] = -v[:, c]
    named = terms.select("term_id", "term", "idf").collect()  # num_terms rows
    factor_v = local_rows(
        spark,
        [(r["term"], [float(x) for x in v[r["term_id"]]], r["idf"]) for r in named],
        "term string, vector array<double>, idf double",
    )
    return Factors(project_documents(df, row_id, tokens, factor_v, s), factor_v, s)


def project_documents(
    df: DataFrame, row_id: str, tokens: str, terms: DataFrame, singular_values: list[float]
) -> DataFrame:
    """U: ``(row_id, vector)``, also for documents without any of the terms (zero vector)."""
    weight = F.col("tf") / F.col("n_terms") * F.col("idf")
    postings = term_counts(df, row_id, tokens)
    met = lookup_join(postings, terms, ["term"], how="inner", spread=[row_id]).select(row_id, weight.alias("w"), "vector")
    sums = met.groupBy(row_id).agg(
        *[F.sum(F.col("w") * F.get("vector", F.lit(i))).alias(f"c{i}") for i in range(len(singular_values))]
    )
    every = df.select(row_id).join(sums, row_id, "left")
    parts = [F.coalesce(F.col(f"c{i}"), F.lit(0.0)) / F.lit(s) for i, s in enumerate(singular_values)]
    return every.select(row_id, F.array(*parts).alias("vector"))


def top_per_concept(factor: DataFrame, key: str, concepts: int = CONCEPTS, k: int = TOP, digits: int | None = None) -> DataFrame:
    """``(concept, rank, key, weight)``: the ``k`` largest entries of each column.

    The rank filter is pushed below the shuffle as a group limit, so each task sends ``k`` rows per
    concept. With ``digits``, weights are rounded before they are ranked, so that rows that differ by
    errors of the last places only are ranked by their key.
    """
    long = factor.select(key, F.posexplode("vector").alias("concept", "weight")).where(F.col("concept") < concepts)
    long = long if digits is None else long.withColumn("weight", F.round("weight", digits))
    rank = F.row_number().over(W.partitionBy("concept").orderBy(F.desc("weight"), key))
    return long.withColumn("rank", rank).where(F.col("rank") <= k).select("concept", "rank", key, "weight")


def matrix_row(factor: DataFrame, key: str, value) -> DataFrame:
    """The row of a factor by its key."""
    return factor.where(F.col(key) == F.lit(value))


def scale_columns(factor: DataFrame, diagonal: list[float], vector: str = "vector") -> DataFrame:
    """Each row times a diagonal matrix."""
    weights = F.array(*[F.lit(float(x)) for x in diagonal])
    return factor.withColumn(vector, multiply(as_doubles(vector), weights))


def normalise_rows(factor: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows of length 1; the elements of a zero row become null."""
    return factor.withColumn(vector, unit(as_doubles(vector)))


def _top_scores(factor: DataFrame, key: str, query: Column, k: int, vector: str = "vector", digits: int | None = None) -> DataFrame:
    valid = F.nanvl(dot(as_doubles(vector), query), F.lit(None).cast("double"))
    valid = valid if digits is None else F.round(valid, digits)
    scored = factor.select(key, valid.alias("score"))
    # Filtered after the limit, so that the score is worked out once per row.
    return scored.orderBy(F.desc_nulls_last("score"), key).limit(k).where(F.col("score").isNotNull())


def terms_like_term(unit_vs: DataFrame, term, k: int = TOP, key: str = "term") -> DataFrame:
    """Terms by dot product on normalised V·S. The query row is fetched, not joined."""
    return _top_scores(unit_vs, key, vector_of(unit_vs, key, term), k)


def docs_like_doc(unit_us: DataFrame, doc, k: int = TOP, key: str = "doc_id", digits: int | None = None) -> DataFrame:
    """Documents by dot product on normalised U·S; zero rows have no score and drop out. ``digits`` as above."""
    return _top_scores(unit_us, key, vector_of(unit_us, key, doc), k, digits=digits)


def docs_for_term(us: DataFrame, v: DataFrame, term, k: int = TOP, key: str = "doc_id", term_key: str = "term") -> DataFrame:
    """Documents by U·S against the term's row of V."""
    return _top_scores(us, key, vector_of(v, term_key, term), k)


def term_query(v: DataFrame, terms: list[str], size: int, term_key: str = "term", idf: str = "idf") -> Column:
    """``V' q`` for a query of terms weighed by idf, as a literal. Unknown terms raise."""
    wanted = sorted(set(terms))
    sums = [F.sum(F.col(idf) * F.get(as_doubles("vector"), F.lit(i))) for i in range(size)]
    n, *query = v.where(F.col(term_key).isin(wanted)).agg(F.count(F.lit(1)), *sums).first()
    if n != len(wanted):
        raise KeyError("a query term is not in the vocabulary")
    return literal_vector(query)


def docs_for_terms(
    us: DataFrame, v: DataFrame, terms: list[str], size: int, k: int = TOP, key: str = "doc_id",
    term_key: str = "term", idf: str = "idf",
) -> DataFrame:
    """Documents by U·S against the query vector of several terms."""
    return _top_scores(us, key, term_query(v, terms, size, term_key, idf), k)
