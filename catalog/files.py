"""Sources, sinks and streams: data derived from the tables is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import ARTICLES_SQL, COMMENTS_SQL, TOKENS_SQL, articles, comments, rounded, table
from catalog.texts import FIELDS_SQL, TF_SQL, _page_xml, _tokens
from catalog.tables import _histogram_sql
from textpulse.functions.tokens import words
from textpulse.operators import factors, terms, wikipages
from textpulse.operators.histogram import equal_width_histogram
from textpulse.session import scratch_path
from textpulse.sources import articles as article_source
from textpulse.sources import comments as comment_source
from textpulse.sources import tables as io
from textpulse.streaming import records

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


TIME = "yyyy-MM-dd HH:mm:ss"


def _csv_parts(spark, d):
    """Articles as one CSV folder per document type, each with its own column order."""
    rows = articles(spark, d).select(
        "*", F.lit("about, it").alias("abstract"), F.lit(1).alias("multimedia")
    ).withColumn("pubDate", F.date_format("pubDate", TIME))
    paths = []
    for turn, kind in enumerate(("P", "F", "O")):
        order = rows.columns[turn * 5 :] + rows.columns[: turn * 5]
        path = scratch_path(spark, "articles")
        rows.where(F.col("documentType") == kind).select(*order).write.csv(path, header=True, escape='"')
        paths.append(path)
    return paths


@query(
    "article_csv_load",
    f"""WITH {ARTICLES_SQL} SELECT "articleID", "articleWordCount", "byline", "documentType", "headline", "keywords", "newDesk", "printPage",
    strftime("pubDate", '%Y-%m-%d %H:%M:%S') AS "pubDate", "sectionName", "snippet", "source", coalesce("typeOfMaterial", '') AS "typeOfMaterial", "webURL" FROM articles""",
)
def article_csv_load(spark, d):
    loaded = article_source.read_articles(spark, _csv_parts(spark, d))
    return loaded.withColumn("pubDate", F.date_format("pubDate", TIME))


@query(
    "article_csv_concat",
    f"""WITH {ARTICLES_SQL} SELECT "articleID", CASE WHEN "documentType" = 'P' THEN "byline" END AS "byline", strftime("pubDate", '%Y-%m-%d %H:%M:%S') AS "pubDate",
    CASE WHEN "documentType" <> 'P' THEN "sectionName" END AS "sectionName" FROM articles""",
)
def article_csv_concat(spark, d):
    rows = articles(spark, d).withColumn("pubDate", F.date_format("pubDate", TIME))
    first, second = scratch_path(spark, "first"), scratch_path(spark, "second")
    is_p = F.col("documentType") == "P"
    rows.where(is_p).select("byline", "articleID", "pubDate").write.csv(first, header=True, escape='"')
    rows.where(~is_p).select("pubDate", "sectionName", "articleID").write.csv(second, header=True, escape='"')
    return article_source.read_csv_concat(spark, [first, second]).withColumn("pubDate", F.date_format("pubDate", TIME))


@query(
    "kafka_comment_records",
    f"""WITH {COMMENTS_SQL} SELECT "commentID"::INTEGER AS "commentID", md5("commentBody") AS digest, "editorsSelection"::VARCHAR AS "editorsSelection", "recommandations", "articleID",
    "articleWordCount"::INTEGER AS "articleWordCount", "printPage"::INTEGER AS "printPage" FROM comments""",
)
def kafka_comment_records(spark, d):
    sent = comments(spark, d).select(
        F.col("articleID").alias("key"), F.to_json(F.struct("*")).cast("binary").alias("value")
    )
    decoded = comment_source.decode_records(sent)
    return decoded.select(
        "commentID", F.md5(F.col("commentBody").cast("binary")).alias("digest"),
        F.col("editorsSelection").cast("string").alias("editorsSelection"), "recommandations", "articleID",
        "articleWordCount", "printPage",
    )


@query("wiki_page_records", f"WITH {FIELDS_SQL} SELECT page_id, title, is_article, is_redirect, length(xml)::INTEGER AS n_raw FROM pg")
def wiki_page_records(spark, d):
    path = scratch_path(spark, "wiki")
    _page_xml(spark, d).select(F.concat(F.lit("  "), "xml")).write.text(path)
    pages = wikipages.page_table(io.read_pages(spark, path))
    return pages.select("page_id", "title", "is_article", "is_redirect", F.length("raw_xml").alias("n_raw"))


@query(
    "word_vector_text",
    """SELECT 'w' || vec_id AS word, len(embedding)::INTEGER AS dims, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings""",
)
def word_vector_text(spark, d):
    path = scratch_path(spark, "vectors")
    rows = table(spark, d, "embeddings")
    size = rows.agg(F.count(F.lit(1))).scalar().cast("string")
    lines = rows.select(
        F.concat(F.lit("w"), "vec_id", F.lit(" "), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value")
    )
    header = spark.range(1).select(F.concat(size, F.lit(" 64")).alias("value"))
    header.unionByName(lines).write.text(path)
    loaded = io.read_word_vectors(spark, path, 64)
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return rounded(loaded.select("word", F.size("vector").alias("dims"), total.alias("total")), "total", digits=5)


@query("prepared_parquet", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def prepared_parquet(spark, d):
    path = scratch_path(spark, "prepared")
    io.write_prepared(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), path)
    back = io.read_prepared(spark, path, partitions=8)
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    "stop_word_file",
    f"""WITH stop AS (SELECT DISTINCT unnest({TOKENS_SQL}) AS word FROM benchmark), tok AS (SELECT unnest({TOKENS_SQL}) AS word FROM documents)
    SELECT word, count(*) AS n FROM tok WHERE word NOT IN (SELECT word FROM stop) GROUP BY 1""",
)
def stop_word_file(spark, d):
    path = scratch_path(spark, "stop")
    table(spark, d, "benchmark").select(F.explode(words("text", lower=True)).alias("value")).write.text(path)
    stop = io.read_stop_words(spark, path)
    # Equal words are counted before the anti-join, so a frequent word is one row in it.
    counted = (
        table(spark, d, "documents").select(F.explode(words("text", lower=True)).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.join(stop, "word", "left_anti")


@query("temp_view_sql", "SELECT event_type, count(*) AS effectif FROM events GROUP BY event_type")
def temp_view_sql(spark, d):
    io.register(table(spark, d, "events"), "textpulse_events")
    return spark.sql("SELECT event_type, COUNT(*) AS effectif FROM textpulse_events GROUP BY event_type")


@query("histogram_file", f"SELECT edge, n FROM ({_histogram_sql('lineitem', 'l_quantity')})")
def histogram_file(spark, d):
    path = scratch_path(spark, "histogram")
    io.write_histogram(equal_width_histogram(table(spark, d, "lineitem"), "l_quantity"), path)
    return rounded(spark.read.schema("edge double, n long").csv(path, sep=" "), "edge")


@query("document_frequency_file", f"WITH {TF_SQL} SELECT term, df FROM freq ORDER BY df DESC, term LIMIT 1000")
def document_frequency_file(spark, d):
    path = scratch_path(spark, "docfreqs")
    io.write_document_frequencies(terms.top_terms(terms.document_frequencies(_tokens(spark, d), "tokens")), path)
    return spark.read.schema("term string, df long").csv(path, sep="\t", quote="")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "burt_file",
    "SELECT " + ", ".join(f"""count(*) FILTER (c_mktsegment = '{s}') AS "C_MKTSEGMENT.{s}" """ for s in SEGMENTS) + " FROM customer GROUP BY c_mktsegment",
)
def burt_file(spark, d):
    path = scratch_path(spark, "burt")
    io.write_burt_matrix(factors.burt_matrix(table(spark, d, "customer"), ["c_mktsegment"]), path)
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(f"`{c}`").cast("long").alias(c) for c in raw.columns])


# --- streams -------------------------------------------------------------------------------------


def _stream(spark, d):
    """The events as a stream of keyed records, drained once."""
    schema = table(spark, d, "events").schema
    stream = records.text_records(
        records.file_stream(spark, d, schema, pattern="events.parquet").select(
            F.col("user_id").alias("key"), F.col("props").alias("value")
        )
    )
    counts, values = scratch_path(spark, "counts"), scratch_path(spark, "values")
    run = records.write_batches(stream, counts, values, scratch_path(spark, "progress"), available_now=True)
    run.awaitTermination()
    return counts, values


@query("stream_record_counts", "SELECT 0::BIGINT AS batch_id, count(*) AS n FROM events")
def stream_record_counts(spark, d):
    return records.read_counts(spark, _stream(spark, d)[0])


@query("stream_record_values", "SELECT props AS value, count(*) AS n FROM events GROUP BY 1")
def stream_record_values(spark, d):
    values = spark.read.schema("value string").parquet(_stream(spark, d)[1])
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


