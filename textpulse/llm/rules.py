"""Quality rules as a short-circuit cascade, in column expressions only.

Base counts are worked out for every text. The further rules are ordered by rejected rows per second, both
estimated on a sample, and asked in that order; the first that rejects a text ends its row's evaluation. The
order moves the cost, never the verdict.

Null texts have no words. Each row stands for itself: repeated rows and ids, ties and null ids change nothing.
Windows and lines are compared as text, so a count never rests on a hash.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import MARK, stage, table, whole

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the sample on which rules are timed, and how thin it is drawn.
SAMPLE_ROWS, SAMPLE_PART = 2000, 16


@dataclass(frozen=True)
class Rule:
    """A condition that rejects a text, over its text (as `body`) and base counts; and the same in SQL."""

    name: str
    rejects: Callable[[], Column]
    sql: str


def _above(left: Column, percent: int) -> Column:
    return left * 100 > F.col("n_words") * percent


def _pattern(name: str, pattern: str, percent: int) -> Rule:
    """Rejects where the pattern occurs more than so many times per hundred words."""
    return Rule(
        name,
        lambda: _above(F.regexp_count("body", F.lit(pattern)), percent),
        f"len(regexp_extract_all(body, '{pattern}')) * 100 > n_words * {percent}",
    )


_LETTERS = r"[a-zA-ZÀ-ÖØ-öø-ÿ][^\x20\x09-\x0D]*"


def rules() -> list[Rule]:
    """The default cascade. Counts are compared as whole numbers."""
    chars, words = (lambda: F.col("word_chars")), (lambda: F.col("n_words"))
    return [
        Rule("symbols", lambda: _above(F.col("n_symbols"), 20), "n_symbols * 100 > n_words * 20"),
        Rule("short words", lambda: chars() < words() * 2, "word_chars < n_words * 2"),
        Rule("long words", lambda: chars() > words() * 20, "word_chars > n_words * 20"),
        Rule(
            "repeated lines",
            lambda: F.col("n_dup_lines") * 100 > F.size(F.split("body", "\n")) * 50,
            "n_dup_lines * 100 > len(string_split(body, chr(10))) * 50",
        ),
        _pattern("shouted", "[A-ZÀ-ÖØ-Þ]{2,}", 50),
        _pattern("doubled marks", r"!!|\?\?", 30),
        _pattern("table bars", r" \| ", 30),
        Rule(
            "few letters",
            lambda: F.regexp_count("body", F.lit(_LETTERS)) * 100 < words() * 50,
            f"len(regexp_extract_all(body, '{_LETTERS}')) * 100 < n_words * 50",
        ),
    ]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once, even where the optimiser merges projections or pushes a
    filter below them: a variable of a lambda is never replaced by its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, body, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    # Steps are columns of their own, each read twice or more by the next, so that none is worked out twice.
    words, windows, pairs = f"{MARK}words", f"{MARK}windows", f"{MARK}pairs"
    rows = docs.select(F.col(id).alias("doc_id"), whole(text).alias("body"))
    rows = rows.withColumn(words, F.array_remove(F.split("body", r"[\x20\x09-\x0D]+"), ""))
    n = F.size(words)
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3))
    window = _let(F.col(words), lambda w: F.transform(places, lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    held = F.filter(F.split("body", "\n"), lambda line: line.rlike(WORD))
    rows = rows.select(
        "doc_id",
        "body",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        held.alias(f"{MARK}lines"),
        window.alias(windows),
    )
    lines = F.col(f"{MARK}lines")
    some_twice = F.size(F.array_distinct(windows)) < F.size(windows)
    paired = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.select(
        "doc_id", "body", "n_words", "word_chars", "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(some_twice, paired).alias(pairs),
    )

    def covered(p: Column) -> Column:
        def beside(i: Column) -> Column:
            return F.coalesce(F.get(p, i)["w"], F.lit(""))

        again = F.filter(p, lambda x, i: (x["w"] == beside(i - 1)) | (x["w"] == beside(i + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    rows = rows.withColumn("n_repeat_words", F.coalesce(_let(F.col(pairs), covered), F.lit(0)).cast("long"))
    # size() of null is -1 or null, by setting.
    rows = rows.withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0).cast("long"))).drop(pairs)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.withColumn("base_failed", failed)


def order_rules(docs: DataFrame, cascade: list[Rule], id: str = "doc_id", text: str = "text") -> list[Rule]:
    """The rules by falling rejections per second, from a sample of the texts that pass the base rule."""
    thin = docs.filter(F.pmod(F.xxhash64(id), F.lit(SAMPLE_PART)) == 0).limit(SAMPLE_ROWS)
    sample = stage(base_counts(thin, id, text), "rule-sample").filter(~F.col("base_failed"))

    def ask(condition: Column) -> tuple[float, float]:
        start = time.perf_counter()
        share = sample.agg(F.avg(condition.cast("double"))).first()[0] or 0.0
        return time.perf_counter() - start, share

    ask(F.length("body") < 0)
    idle = min(ask(F.length("body") < 0)[0] for _ in range(2))
    worth = []
    for rule in cascade:
        took, share = min(ask(rule.rejects()) for _ in range(2))
        worth.append(share / max(took - idle, 1e-4))
    return [cascade[k] for k in sorted(range(len(cascade)), key=lambda k: (-worth[k], k))]


def verdicts(docs: DataFrame, cascade: list[Rule] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts of every row of docs, base_failed, and kept."""
    ordered = order_rules(docs, rules() if cascade is None else cascade, id, text)
    kept = F.when(F.col("base_failed"), False)
    for rule in ordered:
        kept = kept.when(rule.rejects(), False)
    return base_counts(docs, id, text).withColumn("kept", kept.otherwise(True))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(table(spark, folder, "documents")).drop("body")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, body, regexp_extract_all(body, '{WORD}') AS words,
  list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, unnest(words[:-3]) AS a, unnest(words[2:-2]) AS b, unnest(words[3:]) AS c
  FROM w WHERE len(words) >= 3),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
p AS (SELECT DISTINCT doc_id, i + k AS place FROM t, (VALUES (0), (1), (2)) v(k) WHERE n > 1),
r AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
b AS (SELECT w.doc_id, body, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"({r.sql})" for r in rules())}) AS kept FROM f
"""
