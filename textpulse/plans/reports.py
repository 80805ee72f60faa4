"""Reports as named frames. Each frame is built when it is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import partial

from pyspark.sql import DataFrame

from textpulse.functions.names import parse_byline, parse_keywords
from textpulse.functions.tokens import token_count
from textpulse.operators.engagement import normalise_in_group
from textpulse.operators.factors import burt_matrix
from textpulse.operators.histogram import equal_width_histogram
from textpulse.operators.profiles import category_counts, describe, group_center, group_profile, list_counts, row_count
from textpulse.operators.tests_stat import anova, anova_each

# The columns that the reports look at.
ARTICLE_NUMBERS = ["articleWordCount", "printPage"]
ARTICLE_CATEGORIES = ["documentType", "newDesk", "sectionName", "source", "typeOfMaterial"]
TYPOLOGY = ["documentType", "newDesk", "source", "typeOfMaterial"]
BINS = 20


class Report(Mapping):
    """Named frames, built on first use."""

    def __init__(self, parts: dict[str, Callable[[], DataFrame]]):
        self._parts, self._built = parts, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._parts[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


def article_report(
    articles: DataFrame, numbers: list[str] = ARTICLE_NUMBERS, categories: list[str] = ARTICLE_CATEGORIES,
    byline: str = "byline", keywords: str = "keywords",
) -> Report:
    """Count, describe, histograms, category counts, authors and keywords with their numbers."""
    authors = list_counts(articles, parse_byline(byline))
    words = list_counts(articles, parse_keywords(keywords), keep_blank=False)
    parts = {"count": lambda: row_count(articles), "describe": lambda: describe(articles, numbers)}
    parts.update({f"histogram_{c}": partial(equal_width_histogram, articles, c, BINS) for c in numbers})
    parts.update({f"counts_{c}": partial(category_counts, articles, c) for c in categories})
    parts.update(
        {
            "authors": lambda: authors,
            "author_number": lambda: row_count(authors),
            "keywords": lambda: words,
            "keyword_number": lambda: row_count(words),
        }
    )
    return Report(parts)


def article_typology(articles: DataFrame, columns: list[str] = TYPOLOGY) -> DataFrame:
    """Burt table of the category columns."""
    return burt_matrix(articles, columns)


def comment_report(
    comments: DataFrame, flag: str = "editorsSelection", count: str = "recommandations",
    measures: list[str] = ("recommandations", "normRecommandations", "logRecommandations"), tokens: str = "tokens",
) -> Report:
    """Count, counts by selection, summaries of the measures and of the number of tokens."""
    lengths = comments.select(token_count(tokens).alias("tokens_count"))
    return Report(
        {
            "count": lambda: row_count(comments),
            "selection": lambda: category_counts(comments, flag),
            f"summary_{count}": lambda: describe(comments, [count], quartiles=True),
            "summary_measures": lambda: describe(comments, list(measures), quartiles=True),
            "summary_tokens": lambda: describe(lengths, ["tokens_count"], quartiles=True),
        }
    )


def target_report(comments: DataFrame, group: str = "articleID", measure: str = "recommandations") -> Report:
    """Normalised target, both class counts, summary and the three histograms."""
    rows = normalise_in_group(comments, group, measure)
    return Report(
        {
            "rows": lambda: rows,
            "count_classes": lambda: category_counts(rows, "count_class"),
            "share_classes": lambda: category_counts(rows, "share_class"),
            "summary": lambda: describe(rows, [measure, "share", "log_value"], quartiles=True),
            "histogram_log": lambda: equal_width_histogram(rows, "log_value", BINS),
            "histogram_count": lambda: equal_width_histogram(rows, measure, BINS),
            "histogram_share": lambda: equal_width_histogram(rows, "share", BINS),
        }
    )


def relation_report(
    comments: DataFrame, flag: str = "editorsSelection", words: str = "articleWordCount", page: str = "printPage",
    count: str = "recommandations",
) -> Report:
    """Selection against article length, page and recommendations."""
    return Report(
        {
            "selection": lambda: category_counts(comments, flag),
            "words": lambda: group_profile(comments, flag, words),
            "page": lambda: group_profile(comments, flag, page),
            "recommendations": lambda: group_center(comments, flag, count),
            "anova_words": lambda: anova(comments, flag, words),
            "anova_page": lambda: anova(comments, flag, page),
        }
    )


def sentiment_anova(comments: DataFrame, flag: str = "editorsSelection") -> DataFrame:
    """One row per sentiment share: does it differ by selection?"""
    return anova_each(comments, flag, ["positive", "negative", "neutral"])
