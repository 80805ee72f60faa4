"""Readers, writers and streams on temporary files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from textpulse.operators.wikipages import article_paragraphs, article_texts, page_table
from textpulse.sources import articles, comments, tables
from textpulse.streaming import records

HEADER = sorted(articles.ARTICLE_SCHEMA.fieldNames())


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def article(**values):
    base = {name: name for name in HEADER}
    base.update(articleWordCount="10", printPage="0", pubDate="2017-01-02 03:04:05")
    base.update(values)
    return base


def csv_file(path, header, *found):
    def quote(x):
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"') else x

    return write(path, ",".join(header), *[",".join(quote(r.get(h, "1")) for h in header) for r in found])


def test_articles_of_different_column_order(spark, tmp_path):
    a = csv_file(tmp_path / "a.csv", [*HEADER, "abstract", "multimedia"], article(headline='He said "no", twice', byline=""))
    b = csv_file(tmp_path / "b.csv", HEADER[::-1], article(articleID="b"))
    df = articles.read_articles(spark, [a, b])
    assert df.columns == HEADER
    first = df.where("articleID <> 'b'").first()
    assert first["headline"] == 'He said "no", twice' and first["articleWordCount"] == 10 and first["byline"] == ""
    assert first["pubDate"] == datetime.datetime(2017, 1, 2, 3, 4, 5) and df.count() == 2


@pytest.mark.parametrize("bad", [{"printPage": "x"}, {"printPage": ""}, {"pubDate": "2017"}])
def test_bad_values_fail(spark, tmp_path, bad):
    path = csv_file(tmp_path / "a.csv", HEADER, article(**bad))
    with pytest.raises(Exception):
        articles.read_articles(spark, [path]).collect()


def test_missing_columns_fail(spark, tmp_path):
    path = csv_file(tmp_path / "a.csv", HEADER[:-1], article())
    with pytest.raises(ValueError, match="14 fields"):
        articles.read_articles(spark, [path])


def test_short_records_fail(spark, tmp_path):
    path = write(tmp_path / "a.csv", ",".join(HEADER), "1,2,3")
    with pytest.raises(Exception):
        articles.read_articles(spark, [path]).collect()


def test_multi_line_fields(spark, tmp_path):
    path = csv_file(tmp_path / "a.csv", HEADER, article(snippet="one,\ntwo"))
    assert articles.read_articles(spark, [path], multi_line=True).first()["snippet"] == "one,\ntwo"


def test_concat_fills_missing_columns(spark, tmp_path):
    a = write(tmp_path / "a.csv", "pubDate,z", "2017-01-02 03:04:05,1")
    b = write(tmp_path / "b.csv", "a,pubDate", "x,2018-01-02 03:04:05")
    df = articles.read_csv_concat(spark, [a, b])
    assert df.columns == ["a", "pubDate", "z"]
    assert sorted((r["a"] or "", r["z"] or "", r["pubDate"].year) for r in df.collect()) == [("", "1", 2017), ("x", "", 2018)]


def test_kafka_options():
    options = comments.offset_range_options("comments", 4, 0, 10_000)
    assert json.loads(options["startingOffsets"]) == {"comments": {str(p): 0 for p in range(4)}}
    assert json.loads(options["endingOffsets"]) == {"comments": {str(p): 10000 for p in range(4)}}
    assert options["subscribe"] == "comments" and options["kafka.bootstrap.servers"] == "localhost:9092"
    assert comments.kafka_options()["startingOffsets"] == "earliest"


def test_decode_records(spark):
    body = {"commentID": 1, "commentBody": "x", "editorsSelection": True, "createDate": "2018-01-02T03:04:05Z"}
    df = spark.createDataFrame([("k", json.dumps(body).encode())], "key string, value binary")
    row = comments.decode_records(df).first()
    assert row["commentID"] == 1 and row["editorsSelection"] is True and row["recommandations"] is None
    assert row["createDate"] == datetime.datetime(2018, 1, 2, 3, 4, 5)
    with pytest.raises(Exception):
        comments.decode_records(spark.createDataFrame([("k", b"{no")], "key string, value binary")).collect()
    assert comments.comments_from_rows(spark, [row]).first() == row


def test_pages_of_a_dump(spark, tmp_path):
    def page(title, text):
        return f'  <page>\n<title>{title}</title><ns>0</ns><id>1</id>\n<text xml:space="preserve">{text}</text>\n  </page>\n'

    dump = "<mediawiki><siteinfo/>\n" + page("A", "one\n\n two ") + page("B", "#REDIRECT [[A]]") + page(
        "C (disambiguation)", "x"
    ) + "<page>\n<title>cut off</title>"
    (tmp_path / "d.xml").write_text(dump)
    xml = tables.read_pages(spark, str(tmp_path / "d.xml"))
    assert sorted(r["title"] for r in page_table(xml).collect()) == ["A", "B", "C (disambiguation)"]
    assert xml.where(~F.col("xml").startswith("<page>") | ~F.col("xml").endswith("</page>")).count() == 0
    texts = article_texts(xml)
    assert [r["title"] for r in texts.collect()] == ["A"]
    assert [r["line"] for r in article_paragraphs(texts).collect()] == ["A", "one", "two"]
    assert article_paragraphs(texts, fraction=0.0).count() == 0


def test_word_vectors(spark, tmp_path):
    path = write(tmp_path / "v.txt", "2 3", "a 1 2 3", "b 0.5 -1 2e-1 ")
    got = {r["word"]: r["vector"] for r in tables.read_word_vectors(spark, path, 3).collect()}
    assert got["a"] == [1.0, 2.0, 3.0] and [round(x, 6) for x in got["b"]] == [0.5, -1.0, 0.2]
    with pytest.raises(Exception, match="not 4 dimensions"):
        tables.read_word_vectors(spark, path, 4).collect()


def test_stop_words_are_distinct(spark, tmp_path):
    path = write(tmp_path / "s.txt", "its", "were", "its")
    assert sorted(r["word"] for r in tables.read_stop_words(spark, path).collect()) == ["its", "were"]


def test_histogram_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.5, 0), (1, 1.0, 4)], "bin int, edge double, n long")
    tables.write_histogram(df, str(tmp_path / "h"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "h")).collect()] == ["1.0 4", "1.5 0"]


def test_frequency_and_burt_lines(spark, tmp_path):
    tables.write_document_frequencies(spark.createDataFrame([('a"b', 3)], "term string, df long"), str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).first()[0] == 'a"b\t3'
    matrix = spark.createDataFrame([("A.y", 0, 2), ("A.x", 1, 0)], ["row_label", "A.x", "A.y"])
    tables.write_burt_matrix(matrix, str(tmp_path / "b"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "b")).collect()] == ["A.x,A.y", "1,0", "0,2"]


def test_prepared_round_trip(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.write_prepared(spark.range(5), path)
    tables.write_prepared(spark.range(7), path)
    assert tables.read_prepared(spark, path, partitions=3).count() == 7


def test_small_scans_are_spread(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert tables.spread_rows(df, "doc_id").rdd.getNumPartitions() == 8
    many = df.repartition(20)
    assert tables.spread_rows(many, "doc_id") is many


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select(
        F.col("user_id").alias("key"), F.col("props").alias("value")
    )
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = records.text_records(records.file_stream(spark, source, events.schema, files_per_batch=1))
    counts, values, progress = (str(tmp_path / n) for n in ("counts", "values", "progress"))
    for _ in range(2):  # the second run finds nothing new
        run = records.write_batches(stream, counts, values, progress, available_now=True)
        run.awaitTermination()
    got = records.read_counts(spark, counts).collect()
    assert sorted(r["batch_id"] for r in got) == [0, 1, 2] and sum(r["n"] for r in got) == events.count()
    written = spark.read.parquet(values).select("value")
    assert written.exceptAll(events.select("value")).count() == 0 and written.count() == events.count()
