"""Page tables: article texts, paragraphs, the document contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.functions.wiki import page_fields, paragraphs, plain_text
from textpulse.operators.sampling import bernoulli_sample
from textpulse.operators.unnest import unnest

DISAMBIGUATION_TITLE = "(disambiguation)"
CONTENT_TYPE = "text/html"


def page_table(xml: DataFrame, column: str = "xml") -> DataFrame:
    """One flat row per page."""
    return xml.select(*[c.alias(name) for name, c in page_fields(column).items()])


def article_texts(xml: DataFrame, column: str = "xml") -> DataFrame:
    """``(page_id, title, content)`` of articles that hold text, are no redirect and no disambiguation."""
    pages = page_table(xml, column).where(
        ~F.col("is_empty") & F.col("is_article") & ~F.col("is_redirect") & ~F.col("title").contains(DISAMBIGUATION_TITLE)
    )
    return pages.select("page_id", "title", plain_text("title", "markup").alias("content"))


def article_paragraphs(articles: DataFrame, fraction: float = 1.0, key: str = "page_id", seed: int = 1) -> DataFrame:
    """``(title, line)`` of the non-empty lines, of a sample of the pages if ``fraction`` is below 1."""
    rows = articles if fraction >= 1.0 else bernoulli_sample(articles, fraction, key, seed)
    return unnest(rows, ["title"], paragraphs("content"), "line")


def indexable(df: DataFrame, doc_id: str, text: str, content_type: str = CONTENT_TYPE) -> DataFrame:
    """``(doc_id, text, content_type)``."""
    return df.select(
        F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"), F.lit(content_type).alias("content_type")
    )
