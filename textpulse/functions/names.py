"""Name lists held in one string: bylines and keyword lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The input formats.
KEYWORD_BRACKETS = r"(^\[)|(\]$)"
KEYWORD_SEPARATOR = "', '"
KEYWORD_QUOTE = "'"
BYLINE_PREFIX = "^By "
BYLINE_SEPARATOR = ",|( and )"
# Blanks and control characters at both ends.
OUTER_BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column) -> Column:
    return F.regexp_replace(text, OUTER_BLANKS, "")


def split_names(text: Column, separator: str) -> Column:
    """Split without the empty strings at the end of the list; inner ones stay."""
    parts = F.split(text, separator, -1)
    filled = F.transform(parts, lambda part, i: F.when(part != "", i + 1).otherwise(0))
    kept = F.slice(parts, F.lit(1), F.array_max(filled))
    return F.when(text == "", F.array(F.lit(""))).otherwise(kept)


def parse_keywords(text: Column | str) -> Column:
    """``['A', 'B, C']`` to its entries. Quotes vanish everywhere, also inside an entry."""
    inner = F.regexp_replace(_col(text), KEYWORD_BRACKETS, "")
    entries = split_names(inner, KEYWORD_SEPARATOR)
    return F.transform(entries, lambda e: strip(F.replace(e, F.lit(KEYWORD_QUOTE), F.lit(""))))


def parse_byline(text: Column | str) -> Column:
    """``By A, B and C`` to its names. ``A, B, and C`` holds an empty name, which stays."""
    names = split_names(F.regexp_replace(_col(text), BYLINE_PREFIX, ""), BYLINE_SEPARATOR)
    return F.transform(names, strip)
