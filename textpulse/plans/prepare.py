"""Data preparation end to end: sample, tokens and sentiment, TF-IDF, text vectors, target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.functions.engagement import flag_int
from textpulse.operators.embeddings import tfidf_vectors
from textpulse.operators.engagement import normalise_in_group
from textpulse.operators.lemmas import text_lemmas
from textpulse.operators.sampling import sample_by_group
from textpulse.operators.sentiment import sentiment_profile
from textpulse.session import discard, stage


@dataclass
class Columns:
    """Names of the input columns."""

    row_id: str = "commentID"
    text: str = "commentBody"
    group: str = "articleID"
    flag: str = "editorsSelection"
    measure: str = "recommandations"


def prepare(
    comments: DataFrame, word_vectors: DataFrame, size: int, polarity: DataFrame, stop: list[str],
    names: Columns = Columns(), seed: int = 1, rate_selected: float = 1.0, rate_others: float = 1.0,
    lemmas: DataFrame | None = None, negators: list[str] | None = None,
) -> DataFrame:
    """The prepared table: comments of all articles, or of those sampled at the given rates, with tokens, sentiment shares, text vector,
    normalised target and label. Comments whose TF-IDF vanishes drop out.

    ``row_id`` is unique. Text features are made from ``(row_id, text)`` only and joined back once,
    so the wide comment rows are not carried through the text steps. What several steps read (the
    sampled rows, tokens, features) is written once to the shared folder.
    """
    sampled = stage(
        sample_by_group(comments, names.group, F.col(names.flag), rate_selected, rate_others, seed, out="selectionDone"),
        "sampled",
    )
    texts = sampled.select(names.row_id, names.text)
    tokens = stage(text_lemmas(texts, names.row_id, names.text, stop, lemmas), "tokens")
    profile = sentiment_profile(texts, names.row_id, names.text, polarity, negators=negators).select(
        names.row_id, F.array("positive", "negative", "neutral").alias("sentiment")
    )
    vectors = tfidf_vectors(tokens, names.row_id, "tokens", word_vectors, size).where(F.col("l1") > 0).drop("l1")
    featured = stage(
        sampled.join(tokens, names.row_id).join(profile, names.row_id).join(vectors, names.row_id), "featured"
    )
    for done in (sampled, vectors):  # with the tokens
        discard(done)
    target = normalise_in_group(featured, names.group, names.measure, out=f"sum_{names.measure}", spread=[names.row_id])
    return target.withColumn("label", flag_int(names.flag))
