"""Shared parts: table access, stand-in tables in both engines, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.operators import sentiment
from textpulse.session import stage
from textpulse.sources.tables import spread_rows

DIGITS = 6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c: Column | str, digits: int = DIGITS) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Stop words of the registered queries: frequent words of the documents. Negators of their languages.
STOP = ["the", "and", "that", "with", "are", "und", "der", "die", "les", "que", "los", "una"]
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
NEGATORS = [*sentiment.NEGATORS, "nicht", "kein", "keine", "nie", "ohne", "pas", "jamais", "sans", "nunca", "sin"]
NEGATORS_SQL = "(" + ", ".join(f"'{w}'" for w in NEGATORS) + ")"
WORD_SQL = r"[\p{L}\p{N}_]+"
TOKENS_SQL = f"regexp_extract_all(lower(text), '{WORD_SQL}')"


def scoped_words_sql(name: str, source: str) -> str:
    """Words of sentences (doc_id, sid, s) with whether a negator before them turns them."""
    return f"""{name}_w AS (SELECT *, coalesce(list_position(list_transform(w, lambda x: x IN {NEGATORS_SQL}), true), 0) AS first_neg FROM (
  SELECT * EXCLUDE (c), regexp_extract_all(c, '{WORD_SQL}') AS w FROM (
    SELECT *, unnest(string_split_regex(regexp_replace(lower(s), 'n[''’]t', ' not', 'g'), '[,;:.!?()]+')) AS c FROM {source}))),
{name} AS MATERIALIZED (SELECT * EXCLUDE (w, first_neg, s), unnest(w) AS word, first_neg > 0 AND generate_subscripts(w, 1) > first_neg AS negated FROM {name}_w)"""


# Written so that a query may put other rows in the place of the documents whose sentences are judged, not of those taught.
POLARITY_SQL = rf"""lesson AS (SELECT toxic = 0 AS positive, unnest(string_split_regex(text, '[.!?\n]+')) AS s from documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
{scoped_words_sql("taught", "lesson")},
seen AS (SELECT word, count(*) FILTER (positive <> negated) AS up, count(*) FILTER (positive = negated) AS down FROM taught GROUP BY 1),
told AS (SELECT sum(up)::DOUBLE AS n_up, sum(down)::DOUBLE AS n_down FROM seen),
leaning AS (SELECT word, n_up, n_down, up + 1000.0::DOUBLE * (up + down) / (n_up + n_down) AS a, down + 1000.0::DOUBLE * (up + down) / (n_up + n_down) AS b FROM seen, told),
odds AS (SELECT word, a, b, ln(a / (n_up + 1000.0::DOUBLE - a)) - ln(b / (n_down + 1000.0::DOUBLE - b)) AS score FROM leaning),
pol AS MATERIALIZED (SELECT word, score, score / sqrt(1 / a + 1 / b) AS z FROM odds WHERE abs(round(score / sqrt(1 / a + 1 / b), 9)) >= 1.96)"""


def polarity(spark: SparkSession, folder: str) -> DataFrame:
    """Learned from the sentences of labelled documents: those of toxic ones are negative. Staged."""
    labels = table(spark, folder, "labels").select("doc_id", (F.col("toxic") == 0).alias("positive"))
    taught = table(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id")
    return stage(sentiment.learn_polarity(taught, "text", "positive", NEGATORS), "polarity")


_SHARED: dict[tuple[str, str, str], object] = {}


def shared(spark: SparkSession, folder: str, name: str, build):
    """What several queries of a session read from the same tables is fitted once; it lies in stored tables."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def draw_sql(key: str, purpose: str, seed: int) -> str:
    return f"(('0x' || substr(md5({key} || ':{purpose}:{seed}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


# --- articles: orders in the article schema ------------------------------------------------------

ARTICLES_SQL = """articles AS (
  SELECT 'a' || o_orderkey AS "articleID",
    CAST(floor(o_totalprice / 100) AS INTEGER) AS "articleWordCount",
    'By CLERK ' || (o_custkey % 40) || ', DESK ' || substr(o_orderpriority, 1, 1)
      || CASE WHEN o_orderstatus = 'P' THEN ', and GUEST' WHEN o_orderstatus = 'F' THEN ' and AUTHOR ' || (o_custkey % 7) ELSE ',' END AS "byline",
    o_orderstatus AS "documentType",
    'Order "' || o_orderkey || '", priced' AS "headline",
    '[''' || o_orderpriority || ''', ''' || 'Status, ' || o_orderstatus || ''', ''' || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'Client''s ' || (o_custkey % 50) END || ''']' AS "keywords",
    o_orderpriority AS "newDesk",
    CAST(o_custkey % 30 AS INTEGER) AS "printPage",
    o_orderdate AS "pubDate",
    'section ' || (o_custkey % 5) AS "sectionName",
    'a short, "quoted" view of ' || o_orderkey AS "snippet",
    CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS "source",
    CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'type ' || (o_custkey % 4) END AS "typeOfMaterial",
    'https://example.org/' || o_orderkey AS "webURL"
  FROM orders)"""


def articles(spark: SparkSession, folder: str) -> DataFrame:
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey")

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def mod(n: int) -> Column:
        return (cust % n).cast("string")

    tail = (
        F.when(F.col("o_orderstatus") == "P", ", and GUEST")
        .when(F.col("o_orderstatus") == "F", text(" and AUTHOR ", mod(7)))
        .otherwise(",")
    )
    client = F.when(cust % 3 == 0, "").otherwise(text("Client's ", mod(50)))
    return table(spark, folder, "orders").select(
        text("a", key).alias("articleID"),
        F.floor(F.col("o_totalprice") / 100).cast("int").alias("articleWordCount"),
        text("By CLERK ", mod(40), ", DESK ", F.substring("o_orderpriority", 1, 1), tail).alias("byline"),
        F.col("o_orderstatus").alias("documentType"),
        text('Order "', key, '", priced').alias("headline"),
        text("['", F.col("o_orderpriority"), "', '", "Status, ", F.col("o_orderstatus"), "', '", client, "']").alias("keywords"),
        F.col("o_orderpriority").alias("newDesk"),
        (cust % 30).cast("int").alias("printPage"),
        F.col("o_orderdate").alias("pubDate"),
        text("section ", mod(5)).alias("sectionName"),
        text('a short, "quoted" view of ', key).alias("snippet"),
        F.when(F.col("o_totalprice") > 250000, "large").otherwise("small").alias("source"),
        F.when(cust % 4 == 0, F.lit(None)).otherwise(text("type ", mod(4))).alias("typeOfMaterial"),
        text("https://example.org/", key).alias("webURL"),
    )


# --- comments: documents with their labels; quality 0 is the rare class --------------------------

COMMENTS_SQL = """comments AS (
  SELECT d.doc_id AS "commentID", d.text AS "commentBody", d.source || '-' || d.lang AS "articleID",
    (l.quality = 0) AS "editorsSelection", CAST(floor(d.n_chars / 100) AS INTEGER) AS "recommandations",
    d.n_chars AS "articleWordCount", coalesce(l.toxic, 0) AS "printPage"
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def comments(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return spread_rows(documents, "doc_id").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("commentID"),
        F.col("text").alias("commentBody"),
        F.concat_ws("-", "source", "lang").alias("articleID"),
        (F.col("quality") == 0).alias("editorsSelection"),
        F.floor(F.col("n_chars") / 100).cast("int").alias("recommandations"),
        F.col("n_chars").alias("articleWordCount"),
        F.coalesce("toxic", F.lit(0)).alias("printPage"),
    )
