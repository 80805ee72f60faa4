"""Token lists through lemma and stem tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.functions.stem import with_stem
from textpulse.functions.tokens import MIN_LEMMA_CHARS, drop_words, keep_lemmas, only_letters, words
from textpulse.operators.joins import lookup_join
from textpulse.operators.unnest import unnest


def replace_tokens(
    df: DataFrame, row_id: str, tokens: str, table: DataFrame, lower_default: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``(row_id, tokens)`` with each token replaced by ``table(word, replacement)``, order kept.

    Unknown tokens stay as they are, or lower-cased. A token that is very frequent is split over
    tasks in the join; each list is put together again within its own row's group. ``counts(word, n)``
    holds the occurrences of the tokens if they are known.
    """
    listed = df.select(row_id, F.posexplode_outer(tokens).alias("pos", "word"))
    replaced = lookup_join(listed, table.select("word", "replacement"), ["word"], how="left", spread=[row_id, "pos"], counts=counts)
    default = F.lower("word") if lower_default else F.col("word")
    pair = F.when(F.col("word").isNotNull(), F.struct("pos", F.coalesce("replacement", default).alias("token")))
    grouped = replaced.groupBy(row_id).agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    return grouped.select(row_id, F.col("pairs.token").alias(tokens))


def text_lemmas(
    df: DataFrame, row_id: str, text: str, stop: list[str] | None, lemmas: DataFrame | None = None,
    letters_only: bool = False, out: str = "tokens",
) -> DataFrame:
    """``(row_id, tokens)``: lemmas of three characters or more, no stop words, lower-case.

    Without a lemma table ``(word, replacement)`` the lemma is the lower-cased token and all happens
    within the row.
    """
    if lemmas is None:
        kept = drop_words(words(text, lower=True, min_chars=MIN_LEMMA_CHARS), stop)
        return df.select(row_id, (F.filter(kept, only_letters) if letters_only else kept).alias(out))
    found = replace_tokens(df.select(row_id, words(text).alias(out)), row_id, out, lemmas, lower_default=True)
    return found.withColumn(out, keep_lemmas(out, stop, letters_only))


def vocabulary(df: DataFrame, tokens: str) -> DataFrame:
    """Distinct tokens, column ``word``."""
    return unnest(df, [], F.array_distinct(tokens), "word").distinct()


def word_counts(df: DataFrame, tokens: str) -> DataFrame:
    """``(word, n)``: occurrences of each token."""
    return unnest(df, [], F.col(tokens), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def stem_table(counts: DataFrame) -> DataFrame:
    """``(word, n, replacement)``: each distinct token is stemmed once."""
    return with_stem(counts, "word", "replacement")


def stemmed_words(df: DataFrame, row_id: str, text: str, stop: list[str] | None, out: str = "tokens") -> DataFrame:
    """``(row_id, tokens)``: word tokens, stop words dropped with respect to case, then stemmed."""
    kept = df.select(row_id, drop_words(words(text), stop).alias(out))
    counts = word_counts(kept, out)
    return replace_tokens(kept, row_id, out, stem_table(counts), counts=counts)


def lower_words(df: DataFrame, row_id: str, text: str, stop: list[str] | None, out: str = "tokens") -> DataFrame:
    """``(row_id, tokens)``: lower-case word tokens without stop words, within the row."""
    return df.select(row_id, drop_words(words(text, lower=True), stop).alias(out))
