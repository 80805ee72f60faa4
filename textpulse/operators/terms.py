"""Document frequencies, TF-IDF postings and the term-document matrix."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, Interaction
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.functions.tokens import term_runs
from textpulse.operators.joins import lookup_join
from textpulse.operators.unnest import unnest, unnest_structs
from textpulse.session import local_rows

NUM_TERMS = 1000


def term_counts(df: DataFrame, row_id: str, tokens: str) -> DataFrame:
    """Postings ``(row_id, term, tf, n_terms)``; one row of ``df`` is one document. No shuffle."""
    ordered = df.select(row_id, F.sort_array(tokens).alias("__sorted"))
    keep = [row_id, F.size("__sorted").cast("long").alias("n_terms")]
    return unnest_structs(ordered, keep, term_runs("__sorted"), "term").select(row_id, "term", "tf", "n_terms")


def document_frequencies(df: DataFrame, tokens: str) -> DataFrame:
    """``(term, df)`` of all terms."""
    return unnest(df, [], F.array_distinct(tokens), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def top_terms(frequencies: DataFrame, n: int = NUM_TERMS, by: str = "df") -> DataFrame:
    """The ``n`` most frequent terms; equal counts in order of the term."""
    return frequencies.orderBy(F.desc(by), "term").limit(n)


def trim_terms(frequencies: DataFrame, n: int, keep: str = "least", by: str = "df") -> DataFrame:
    """Keep the ``n`` least or most frequent terms."""
    if keep not in ("least", "most"):
        raise ValueError("keep must be 'least' or 'most'")
    return top_terms(frequencies, n, by) if keep == "most" else frequencies.orderBy(by, "term").limit(n)


def plain_idf(df: Column | str, n_docs: Column) -> Column:
    """ln(N / df)."""
    return F.log(n_docs / (F.col(df) if isinstance(df, str) else df))


def smoothed_idf(df: Column | str, n_docs: Column) -> Column:
    """ln((N + 1) / (df + 1))."""
    return F.log((n_docs + 1) / ((F.col(df) if isinstance(df, str) else df) + 1))


def n_docs(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def term_table(df: DataFrame, tokens: str, num_terms: int = NUM_TERMS) -> DataFrame:
    """``(term, df, idf)`` of the top terms. N counts rows, not distinct names."""
    top = top_terms(document_frequencies(df, tokens), num_terms)
    return top.withColumn("idf", plain_idf("df", n_docs(df)))


def term_document_matrix(df: DataFrame, row_id: str, tokens: str, num_terms: int = NUM_TERMS) -> DataFrame:
    """Coordinate form ``(row_id, term, weight)``, ``weight = tf / n_terms * ln(N / df)``.

    ``n_terms`` counts all terms of the document, also those that are not among the top terms. The
    term table has ``num_terms`` rows at most; it is broadcast while its size allows, so that the
    postings stay in place.
    """
    table = term_table(df, tokens, num_terms).select("term", "idf")
    weight = F.col("tf") / F.col("n_terms") * F.col("idf")
    met = lookup_join(term_counts(df, row_id, tokens), table, ["term"], spread=[row_id])
    return met.select(row_id, "term", weight.alias("weight"))


def smoothed_tfidf(
    df: DataFrame, row_id: str, tokens: str, postings: DataFrame | None = None
) -> DataFrame:
    """Postings ``(row_id, term, tf, tfidf)`` with the smoothed idf.

    Every term of the documents has its row. Give the staged ``term_counts`` as ``postings`` to work
    them out once; they are read twice here.
    """
    postings = term_counts(df, row_id, tokens) if postings is None else postings
    frequencies = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    table = frequencies.select("term", smoothed_idf("n", n_docs(df)).alias("idf"))
    met = lookup_join(postings, table, ["term"], spread=[row_id], counts=frequencies)
    return met.select(row_id, "term", "tf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def non_empty(postings: DataFrame, row_id: str, weight: str = "tfidf") -> DataFrame:
    """Documents whose weights do not all vanish (L1 norm above zero)."""
    norms = postings.groupBy(row_id).agg(F.sum(F.abs(weight)).alias("l1"))
    return norms.where(F.col("l1") > 0)


def tfidf_pipeline(vocabulary: int, tokens: str = "tokens", counts: str = "token_count", tfidf: str = "tfidf") -> Pipeline:
    """Count vectoriser of the given width and smoothed IDF as Spark ML stages; see ``fit_tfidf``."""
    return Pipeline(
        stages=[
            CountVectorizer(inputCol=tokens, outputCol=counts, vocabSize=vocabulary),
            IDF(inputCol=counts, outputCol=tfidf),
        ]
    )


def fit_tfidf(df: DataFrame, vocabulary: int, tokens: str = "tokens", **names: str) -> PipelineModel:
    """The fitted stages. The driver holds the vocabulary, so its width must be given; more terms than that
    are an error, as a vectoriser would leave the rarer ones out without a word. ``sparse.sparse_tfidf`` has no such limit."""
    found = document_frequencies(df, tokens).count()
    if found > vocabulary:
        raise ValueError(f"{found} terms do not fit a vocabulary of {vocabulary}")
    return tfidf_pipeline(vocabulary, tokens, **names).fit(df)


def term_document_vectors(
    df: DataFrame, tokens: str, num_terms: int = NUM_TERMS, out: str = "features"
) -> tuple[DataFrame, DataFrame]:
    """Adds the sparse row of the term-document matrix; also returns ``(term_id, term, df, idf)``.

    The top terms come to the driver, ``num_terms`` rows at most, to set up the vectoriser. The idf
    scales its columns and one over the document's length its rows.
    """
    table = term_table(df, tokens, num_terms).collect()
    terms = local_rows(
        df.sparkSession,
        [(i, r["term"], r["df"], r["idf"]) for i, r in enumerate(table)],
        "term_id int, term string, df long, idf double",
    )
    if not table:
        raise ValueError("no terms")
    vectoriser = CountVectorizerModel.from_vocabulary([r["term"] for r in table], inputCol=tokens, outputCol="__tf")
    per_length = Interaction(inputCols=["__per_length", "__tf"], outputCol="__share")
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in table]), inputCol="__share", outputCol=out
    )
    counted = vectoriser.transform(df).withColumn(
        "__per_length", F.coalesce(F.try_divide(F.lit(1.0), F.size(tokens)), F.lit(0.0))
    )
    return weigh.transform(per_length.transform(counted)).select(*df.columns, out), terms
