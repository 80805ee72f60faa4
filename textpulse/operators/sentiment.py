"""Sentence sentiment of documents: word polarities learned from labelled sentences, negation, classes, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.functions.tokens import scoped_words, sentences
from textpulse.operators.joins import lookup_join
from textpulse.operators.unnest import unnest_at, unnest_structs
from textpulse.session import stage


#: Words that turn what follows them, up to the next mark.
NEGATORS = ["not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "cannot", "without", "hardly"]


def sentence_words(df: DataFrame, keep: list[str], text: str, negators: list[str] | None = None) -> DataFrame:
    """``(*keep, sentence, word, negated)`` of all words."""
    parts = unnest_at(df, keep, sentences(text), "sentence", "part")
    return unnest_structs(parts, [*keep, "sentence"], scoped_words("part", NEGATORS if negators is None else negators), "word")


def learn_polarity(
    df: DataFrame, text: str, positive: str, negators: list[str] | None = None, prior: float = 1000.0, least: float = 1.96
) -> DataFrame:
    """``(word, score, z)`` of the words that lean to the sentences of one class: log-odds with a Dirichlet prior.

    ``positive`` is the class of a row's sentences; rows without one teach nothing. A negated word counts for the
    other class. The prior is ``prior`` words dealt as in both classes together, so that rare words lean to neither
    side; ``z`` is the log-odds over its standard deviation, and words below ``least`` have no polarity.
    """
    listed = sentence_words(df.where(F.col(positive).isNotNull()), [positive], text, negators)
    up = F.col(positive) != F.col("negated")
    counts = stage(listed.groupBy("word").agg(F.count_if(up).alias("up"), F.count_if(~up).alias("down")), "word-classes")
    totals = counts.agg(F.sum("up").alias("up"), F.sum("down").alias("down")).first()
    n_up, n_down = totals["up"] or 0, totals["down"] or 0
    share = prior * (F.col("up") + F.col("down")) / F.lit(float(max(n_up + n_down, 1)))
    above, below = F.col("up") + F.col("share"), F.col("down") + F.col("share")
    odds = F.log(above / (n_up + prior - above)) - F.log(below / (n_down + prior - below))
    scored = counts.withColumn("share", share).select("word", odds.alias("score"), (odds / F.sqrt(1 / above + 1 / below)).alias("z"))
    return scored.where(F.abs(F.round("z", 9)) >= least)


def polar_sentences(df: DataFrame, row_id: str, text: str, polarity: DataFrame, negators: list[str] | None = None) -> DataFrame:
    """``(row_id, sentence, score)`` of the sentences with a word of ``polarity(word, score)``; negated words count with
    the opposite sign. Scores are rounded to nine digits, so that those that cancel out are 0.

    Most words have no polarity, so the inner join drops them before anything is grouped.
    """
    listed = sentence_words(df, [row_id], text, negators)
    scored = lookup_join(listed, polarity.select("word", "score"), ["word"], spread=[row_id, "sentence"])
    return scored.groupBy(row_id, "sentence").agg(F.round(F.sum(F.when(F.col("negated"), -F.col("score")).otherwise(F.col("score"))), 9).alias("score"))


def sentence_labels(scores: DataFrame, strong: float | None = None, weak: float = 0.0) -> DataFrame:
    """Adds ``label``: beyond ``weak`` a score is "Positive" or "Negative", from ``strong`` on "Very positive" or
    "Very negative"."""
    score = F.col("score")
    label = F.when(score > weak, "Positive").when(score < -weak, "Negative").otherwise("Neutral")
    if strong is not None:
        label = F.when(score >= strong, "Very positive").when(score <= -strong, "Very negative").otherwise(label)
    return scores.withColumn("label", label)


def profile_from_labels(labels: DataFrame, row_id: str) -> DataFrame:
    """Shares of positive, negative and neutral sentences from ``(row_id, sentence_id, label)``.

    The "very" labels count for nothing. With none of the three the shares are 0.
    """
    counts = labels.groupBy(row_id).agg(
        *[F.count_if(F.col("label") == name).alias(name.lower()) for name in ("Positive", "Negative", "Neutral")]
    )
    return _shares(counts)


def sentiment_profile(
    df: DataFrame, row_id: str, text: str, polarity: DataFrame, strong: float | None = None, weak: float = 0.0,
    negators: list[str] | None = None,
) -> DataFrame:
    """Every row of ``df`` with its ``positive``, ``negative`` and ``neutral`` share of sentences.

    ``row_id`` is unique in ``df``. Sentences without a polar word are neutral and are only counted.
    """
    labels = sentence_labels(polar_sentences(df, row_id, text, polarity, negators), strong, weak)
    found = labels.groupBy(row_id).agg(
        F.count_if(F.col("label") == "Positive").alias("positive"),
        F.count_if(F.col("label") == "Negative").alias("negative"),
        F.count_if(F.col("label") != "Neutral").alias("not_neutral"),
    )
    counted = df.withColumn("n_sentences", F.coalesce(F.size(sentences(text)), F.lit(0)))
    joined = counted.join(found, row_id, "left").na.fill(0, ["positive", "negative", "not_neutral"])
    neutral = (F.col("n_sentences") - F.col("not_neutral")).alias("neutral")
    return _shares(joined.select(*df.columns, "n_sentences", "positive", "negative", neutral))


def _shares(counts: DataFrame) -> DataFrame:
    total = F.col("positive") + F.col("negative") + F.col("neutral")
    shares = {c: F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) for c in ("positive", "negative", "neutral")}
    return counts.withColumns(shares)


def nlp_result(tokens: str, shares: list[str]) -> Column:
    """Tokens and sentiment shares of a text as one struct."""
    return F.struct(F.col(tokens).alias("tokens"), F.array(*shares).alias("sentiments"))


def nlp_parts(df: DataFrame, nlp: str, size: int = 3) -> DataFrame:
    """``df`` with the struct's fields as ``tokens`` and ``sentiments``; a row with another number of shares is an error."""
    found = F.col(f"{nlp}.sentiments")
    message = F.concat(F.lit(f"expected {size} sentiment shares, found "), F.coalesce(F.size(found).cast("string"), F.lit("none")))
    checked = F.when(F.size(found) == size, found).otherwise(F.raise_error(message).cast(df.select(found.alias("x")).schema["x"].dataType))
    return df.withColumn("tokens", F.col(f"{nlp}.tokens")).withColumn("sentiments", checked)
