"""Tokens, sentiment, terms, vectors and wiki pages over the documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog.common import (
    COMMENTS_SQL, NEGATORS, POLARITY_SQL, STOP, STOP_SQL, TOKENS_SQL, WORD_SQL, comments, draw_sql, polarity, rounded,
    scoped_words_sql, table,
)
from catalog.stem_sql import stem_ctes
from textpulse.functions import wiki
from textpulse.functions.tokens import token_count, words
from textpulse.functions.vectors import as_doubles
from textpulse.operators import embeddings, lemmas, lsa, sentiment, terms, wikipages
from textpulse.operators.learning import total_inertia
from textpulse.operators.unnest import unnest, unnest_structs
from textpulse.plans import prepare, reports
from textpulse.session import stage
from textpulse.sources.tables import spread_rows

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def _documents(spark, d):
    return spread_rows(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _tokens(spark, d):
    """Lower-case lemmas without stop words of every document."""
    return lemmas.text_lemmas(_documents(spark, d), "doc_id", "text", STOP)


# --- tokens --------------------------------------------------------------------------------------

LEMMAS_SQL = f"""raw AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents),
tok AS (SELECT doc_id, term FROM raw WHERE length(term) > 2 AND term NOT IN {STOP_SQL})"""


def _per_document(tokens: DataFrame) -> DataFrame:
    """Number of tokens and a digest of the list in order."""
    return tokens.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.concat_ws(" ", "tokens").cast("binary")).alias("digest")
    )


def _per_document_sql(source: str) -> str:
    return f"""SELECT doc_id, len(ts)::BIGINT AS n_tokens, md5(array_to_string(ts, ' ')) AS digest FROM ({source})"""


@query(
    "article_lemmas",
    _per_document_sql(
        f"SELECT doc_id, [t for t in {TOKENS_SQL} if length(t) > 2 and not list_contains({STOP}, t)] AS ts FROM documents"
    ),
)
def article_lemmas(spark, d):
    return _per_document(_tokens(spark, d))


LETTERS_SQL = r"regexp_matches(t, '^\p{L}*$')"


@query(
    "letter_lemmas",
    _per_document_sql(
        f"SELECT doc_id, [t for t in {TOKENS_SQL} if length(t) > 2 and not list_contains({STOP}, t) and {LETTERS_SQL}] AS ts FROM documents"
    ),
)
def letter_lemmas(spark, d):
    return _per_document(lemmas.text_lemmas(_documents(spark, d), "doc_id", "text", STOP, letters_only=True))


# A lemma table from the data: words that end in "ing" or "ed", cut to the stem if that is a word too.
LEMMA_TABLE_SQL = f"""seen AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD_SQL}')) AS word FROM documents),
cut AS (SELECT word, regexp_replace(word, '(ing|ed)$', '') AS replacement FROM seen WHERE regexp_matches(word, '.(ing|ed)$')),
lem AS (SELECT cut.word, cut.replacement FROM cut JOIN seen ON seen.word = cut.replacement)"""


@query(
    "table_lemmas",
    f"""WITH {LEMMA_TABLE_SQL},
    pos AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD_SQL}')) AS word, generate_subscripts(regexp_extract_all(text, '{WORD_SQL}'), 1) AS p FROM documents),
    got AS (SELECT doc_id, p, coalesce(replacement, lower(word)) AS lemma FROM pos LEFT JOIN lem USING (word)),
    kept AS (SELECT doc_id, list(lower(lemma) ORDER BY p) FILTER (length(lemma) > 2 AND lemma NOT IN {STOP_SQL}) AS ts FROM got GROUP BY 1)
    SELECT d.doc_id, coalesce(len(ts), 0)::BIGINT AS n_tokens, md5(coalesce(array_to_string(ts, ' '), '')) AS digest FROM documents d LEFT JOIN kept USING (doc_id)""",
)
def table_lemmas(spark, d):
    documents = _documents(spark, d)
    seen = lemmas.vocabulary(documents.select(words("text").alias("tokens")), "tokens")
    cut = seen.where(F.col("word").rlike(".(ing|ed)$")).select(
        "word", F.regexp_replace("word", "(ing|ed)$", "").alias("replacement")
    )
    pairs = cut.join(seen.withColumnRenamed("word", "replacement"), "replacement", "left_semi")
    return _per_document(lemmas.text_lemmas(documents, "doc_id", "text", STOP, lemmas=pairs))


@query(
    "lower_words",
    _per_document_sql(f"SELECT doc_id, [t for t in {TOKENS_SQL} if not list_contains({STOP}, t)] AS ts FROM documents"),
)
def lower_words(spark, d):
    return _per_document(lemmas.lower_words(_documents(spark, d), "doc_id", "text", STOP))


@query(
    "stemmed_words",
    f"""WITH pos AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD_SQL}')) AS word, generate_subscripts(regexp_extract_all(text, '{WORD_SQL}'), 1) AS p FROM documents),
    kept AS (SELECT * FROM pos WHERE word NOT IN {STOP_SQL}), voc AS (SELECT DISTINCT word FROM kept), {stem_ctes("voc")},
    lists AS (SELECT doc_id, list(stem ORDER BY p) AS ts FROM kept JOIN stemmed USING (word) GROUP BY 1)
    SELECT d.doc_id, coalesce(len(ts), 0)::BIGINT AS n_tokens, md5(coalesce(array_to_string(ts, ' '), '')) AS digest FROM documents d LEFT JOIN lists USING (doc_id)""",
)
def stemmed_words(spark, d):
    return _per_document(lemmas.stemmed_words(_documents(spark, d), "doc_id", "text", STOP))


@query(
    "token_count_filters",
    f"""WITH t AS (SELECT doc_id, len({TOKENS_SQL}) AS n FROM documents)
    SELECT count(*) FILTER (n > 5) AS longer_5, count(*) FILTER (n > 10) AS longer_10 FROM t""",
)
def token_count_filters(spark, d):
    listed = _documents(spark, d).select("doc_id", words("text", lower=True).alias("tokens"))
    corpus = embeddings.longer_than(listed, "tokens", embeddings.MIN_CORPUS_TOKENS)
    return corpus.agg(
        F.count(F.lit(1)).alias("longer_5"), F.count_if(token_count("tokens") > embeddings.MIN_LSA_TOKENS).alias("longer_10")
    )


@query(
    "training_corpus",
    f"""WITH t AS (SELECT len({TOKENS_SQL}) AS n FROM documents UNION ALL SELECT len({TOKENS_SQL}) FROM conversations)
    SELECT count(*) AS n_texts, sum(n)::BIGINT AS n_tokens FROM t WHERE n > 5""",
)
def training_corpus(spark, d):
    frames = [
        table(spark, d, name).select(words("text", lower=True).alias("tokens")) for name in ("documents", "conversations")
    ]
    return embeddings.training_corpus(frames).agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.size("tokens")).alias("n_tokens")
    )


@query(
    "token_count_summary",
    f"""WITH t AS (SELECT len({TOKENS_SQL})::DOUBLE AS v FROM documents)
    SELECT 'tokens_count' AS "column", count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev, min(v) AS min, quantile_disc(v, 0.25) AS q25,
    quantile_disc(v, 0.5) AS q50, quantile_disc(v, 0.75) AS q75, max(v) AS max FROM t""",
)
def token_count_summary(spark, d):
    rows = comments(spark, d).withColumn("tokens", words("commentBody", lower=True))
    report = reports.comment_report(rows, measures=["recommandations"])
    return rounded(report["summary_tokens"], "mean", "stddev")


@query(
    "measure_summary",
    f"""WITH {COMMENTS_SQL} SELECT 'recommandations' AS "column", count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev, min(v) AS min, quantile_disc(v, 0.25) AS q25,
    quantile_disc(v, 0.5) AS q50, quantile_disc(v, 0.75) AS q75, max(v) AS max FROM (SELECT "recommandations"::DOUBLE AS v FROM comments)""",
)
def measure_summary(spark, d):
    rows = comments(spark, d).withColumn("tokens", words("commentBody", lower=True))
    return rounded(reports.comment_report(rows, measures=["recommandations"])["summary_recommandations"], "mean", "stddev")


# --- sentiment -----------------------------------------------------------------------------------

@query("polarity_table", f"WITH {POLARITY_SQL} SELECT word, round(score, 6) AS score, round(z, 6) AS z FROM pol")
def polarity_table(spark, d):
    return rounded(polarity(spark, d), "score", "z")


SENTENCES_SQL = rf"""{POLARITY_SQL},
parts AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?\n]+')) AS s FROM documents),
sent AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS sid, s FROM parts WHERE regexp_matches(s, '{WORD_SQL}')),
{scoped_words_sql("spoken", "sent")},
scored AS (SELECT doc_id, sid, round(sum(coalesce(CASE WHEN negated THEN -score ELSE score END, 0)), 9) AS score FROM spoken LEFT JOIN pol USING (word) GROUP BY 1, 2)"""
STRONG, WEAK = 1.0, 0.1


def _sentiment_sql(strong: float | None = None, weak: float = 0.0, digits: int | None = 6) -> str:
    very = "false" if strong is None else f"abs(score) >= {strong}"

    def share(part: str) -> str:
        value = f"coalesce({part} / nullif(p + n + z, 0), 0)"
        return value if digits is None else f"round({value}, {digits})"

    return f"""WITH {SENTENCES_SQL},
lab AS (SELECT doc_id, CASE WHEN {very} THEN 'very' WHEN score > {weak} THEN 'p' WHEN score < -{weak} THEN 'n' ELSE 'z' END AS l FROM scored),
c AS (SELECT doc_id, count(*) AS all_s, count(*) FILTER (l = 'p') AS p, count(*) FILTER (l = 'n') AS n, count(*) FILTER (l = 'z') AS z FROM lab GROUP BY 1)
SELECT d.doc_id, coalesce(all_s, 0)::INTEGER AS n_sentences, {share("p")} AS positive, {share("n")} AS negative, {share("z")} AS neutral
FROM documents d LEFT JOIN c USING (doc_id)"""


def _sentiment(spark, d, **classes) -> DataFrame:
    out = sentiment.sentiment_profile(_documents(spark, d), "doc_id", "text", polarity(spark, d), negators=NEGATORS, **classes)
    return rounded(out.drop("text"), "positive", "negative", "neutral")


@query("sentiment_profile", _sentiment_sql())
def sentiment_profile(spark, d):
    return _sentiment(spark, d)


@query("sentiment_profile_strong", _sentiment_sql(STRONG, WEAK))
def sentiment_profile_strong(spark, d):
    return _sentiment(spark, d, strong=STRONG, weak=WEAK)


@query(
    "sentiment_from_labels",
    """WITH c AS (SELECT conv_id, count(*) FILTER (length(text) % 4 = 0) AS p, count(*) FILTER (length(text) % 4 = 1) AS n, count(*) FILTER (length(text) % 4 = 2) AS z FROM conversations GROUP BY 1)
    SELECT conv_id, round(coalesce(p / nullif(p + n + z, 0), 0), 6) AS positive, round(coalesce(n / nullif(p + n + z, 0), 0), 6) AS negative, round(coalesce(z / nullif(p + n + z, 0), 0), 6) AS neutral FROM c""",
)
def sentiment_from_labels(spark, d):
    names = F.array(*[F.lit(x) for x in ("Positive", "Negative", "Neutral", "Very positive")])
    labels = table(spark, d, "conversations").select("conv_id", F.get(names, F.length("text") % 4).alias("label"))
    return rounded(sentiment.profile_from_labels(labels, "conv_id"), "positive", "negative", "neutral")


# --- terms ---------------------------------------------------------------------------------------

TF_SQL = f"""{LEMMAS_SQL}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT doc_id, count(*) AS n_terms FROM tok GROUP BY 1), freq AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS occ FROM tf GROUP BY 1),
nd AS (SELECT count(*) AS nn FROM documents)"""


@query("term_counts", f"WITH {TF_SQL} SELECT doc_id, term, tf, n_terms FROM tf JOIN len USING (doc_id)")
def term_counts(spark, d):
    return terms.term_counts(_tokens(spark, d), "doc_id", "tokens")


@query("document_frequencies", f"WITH {TF_SQL} SELECT term, df FROM freq")
def document_frequencies(spark, d):
    return terms.document_frequencies(_tokens(spark, d), "tokens")


@query("top_terms", f"WITH {TF_SQL} SELECT term, df, round(ln(nn / df), 6) AS idf FROM freq, nd ORDER BY df DESC, term LIMIT 1000")
def top_terms(spark, d):
    return rounded(terms.term_table(_tokens(spark, d), "tokens"), "idf")


@query("least_frequent_terms", f"WITH {TF_SQL} SELECT term, df FROM freq ORDER BY df, term LIMIT 500")
def least_frequent_terms(spark, d):
    return terms.trim_terms(terms.document_frequencies(_tokens(spark, d), "tokens"), 500, keep="least")


@query(
    "term_document_matrix",
    f"""WITH {TF_SQL}, best AS (SELECT term, ln(nn / df) AS idf FROM freq, nd ORDER BY df DESC, term LIMIT 1000)
    SELECT doc_id, term, round(tf / n_terms * idf, 6) AS weight FROM tf JOIN best USING (term) JOIN len USING (doc_id)""",
)
def term_document_matrix(spark, d):
    return rounded(terms.term_document_matrix(_tokens(spark, d), "doc_id", "tokens"), "weight")


SMOOTH_SQL = f"""{TF_SQL}, voc AS (SELECT term, ln((nn + 1) / (df + 1)) AS idf FROM freq, nd),
post AS (SELECT doc_id, term, tf, tf * idf AS tfidf FROM tf JOIN voc USING (term))"""


@query("smoothed_tfidf", f"WITH {SMOOTH_SQL} SELECT doc_id, term, tf, round(tfidf, 6) AS tfidf FROM post")
def smoothed_tfidf(spark, d):
    return rounded(terms.smoothed_tfidf(_tokens(spark, d), "doc_id", "tokens"), "tfidf")


@query(
    "non_empty_documents",
    f"WITH {SMOOTH_SQL} SELECT doc_id, round(sum(abs(tfidf)), 4) AS l1 FROM post GROUP BY 1 HAVING sum(abs(tfidf)) > 0",
)
def non_empty_documents(spark, d):
    postings = terms.smoothed_tfidf(_tokens(spark, d), "doc_id", "tokens")
    return rounded(terms.non_empty(postings, "doc_id"), "l1", digits=4)


# --- vectors -------------------------------------------------------------------------------------

DIMS = 64

# Word vectors: each term takes the embedding at a slot drawn from its md5; half of the slots are empty.
WORDS_SQL = f"""{SMOOTH_SQL}, slots AS (SELECT term, ('0x' || substr(md5(term), 1, 8))::BIGINT % (SELECT 2 * count(*) FROM embeddings) AS vec_id FROM freq),
wv AS (SELECT term, embedding::DOUBLE[] AS vector FROM slots JOIN embeddings USING (vec_id))"""


def _word_vectors(spark, d, vocabulary: DataFrame) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = vectors.agg(F.count(F.lit(1))).scalar()
    slot = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 8), 16, 10).cast("long") % (2 * n)
    return vocabulary.select("word", slot.alias("vec_id")).join(vectors, "vec_id").select("word", "vector")


@query(
    "text_vectors",
    f"""WITH {WORDS_SQL}, hit AS (SELECT doc_id, tfidf, vector FROM post JOIN wv USING (term)),
    flat AS (SELECT doc_id, generate_subscripts(vector, 1) - 1 AS dim, tfidf, unnest(vector) AS x FROM hit),
    mean AS (SELECT doc_id, dim, sum(tfidf * x) / nullif(sum(tfidf), 0) AS value FROM flat GROUP BY 1, 2)
    SELECT p.doc_id, CAST(g.dim AS INTEGER) AS dim, round(coalesce(mean.value, 0), 6) AS value
    FROM (SELECT DISTINCT doc_id FROM post) p CROSS JOIN range({DIMS}) g(dim) LEFT JOIN mean ON mean.doc_id = p.doc_id AND mean.dim = g.dim""",
)
def text_vectors(spark, d):
    tokens = stage(_tokens(spark, d), "tokens")
    known = stage(_word_vectors(spark, d, lemmas.vocabulary(tokens, "tokens")), "words")
    some = tokens.where(F.size("tokens") > 0).select("doc_id").distinct()
    out = embeddings.tfidf_vectors(tokens, "doc_id", "tokens", known, DIMS, documents=some)
    return rounded(out.select("doc_id", F.posexplode("vector").alias("dim", "value")), "value")


def _embeddings(spark, d, key: str = "vec_id") -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias(key), as_doubles("embedding").alias("vector"))


COS_SQL = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(
    "nearest_vectors",
    f"""SELECT e.vec_id, round({COS_SQL}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    ORDER BY {COS_SQL} DESC, e.vec_id LIMIT 10""",
)
def nearest_vectors(spark, d):
    vectors = _embeddings(spark, d)
    out = embeddings.nearest(vectors, "vec_id", embeddings.vector_of(vectors, "vec_id", 0))
    return rounded(out, "similarity")


@query(
    "nearest_words",
    f"""WITH w AS (SELECT 'w' || vec_id AS word, embedding FROM embeddings)
    SELECT e.word, round({COS_SQL}, 6) AS similarity FROM w e, (SELECT embedding FROM w WHERE word = 'w7') q WHERE e.word <> 'w7'
    ORDER BY {COS_SQL} DESC, e.word LIMIT 10""",
)
def nearest_words(spark, d):
    named = _embeddings(spark, d).select(F.concat(F.lit("w"), "vec_id").alias("word"), "vector")
    return rounded(embeddings.nearest_to_word(named, "w7"), "similarity")


# Singular values 64, 63, ..., 1 for the queries on given factors.
DIAGONAL = [float(DIMS - i) for i in range(DIMS)]
US_SQL = f"us AS (SELECT vec_id AS doc_id, [v * ({DIMS} + 1 - i) for v, i in embedding::DOUBLE[]] AS v, label FROM embeddings)"
UNIT_SQL = US_SQL + ", nus AS (SELECT doc_id, [x / sqrt(list_inner_product(v, v)) for x in v] AS v FROM us)"


def _scaled(spark, d, key: str = "doc_id") -> DataFrame:
    return lsa.scale_columns(_embeddings(spark, d, key), DIAGONAL)


@query("matrix_row", f"SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings WHERE vec_id = 3")
def matrix_row(spark, d):
    row = lsa.matrix_row(_embeddings(spark, d), "vec_id", 3)
    return rounded(row.select(F.posexplode("vector").alias("dim", "value")), "value")


@query("scaled_rows", f"WITH {US_SQL} SELECT doc_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim, round(unnest(v), 6) AS value FROM us")
def scaled_rows(spark, d):
    return rounded(_scaled(spark, d).select("doc_id", F.posexplode("vector").alias("dim", "value")), "value")


@query("normalised_rows", f"WITH {UNIT_SQL} SELECT doc_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim, round(unnest(v), 6) AS value FROM nus")
def normalised_rows(spark, d):
    unit_rows = lsa.normalise_rows(_scaled(spark, d))
    return rounded(unit_rows.select("doc_id", F.posexplode("vector").alias("dim", "value")), "value")


def _top_sql(prefix: str, table_: str, target: str, key: str = "doc_id") -> str:
    return f"""WITH {prefix} SELECT e.doc_id AS {key}, round(list_inner_product(e.v, q.v), 6) AS score FROM {table_} e, ({target}) q
    ORDER BY list_inner_product(e.v, q.v) DESC, e.doc_id LIMIT 10"""


@query("terms_like_term", _top_sql(UNIT_SQL, "nus", "SELECT v FROM nus WHERE doc_id = 5", "term_id"))
def terms_like_term(spark, d):
    unit_rows = lsa.normalise_rows(_scaled(spark, d, "term_id"))
    return rounded(lsa.terms_like_term(unit_rows, 5, key="term_id"), "score")


@query("docs_like_doc", _top_sql(UNIT_SQL, "nus", "SELECT v FROM nus WHERE doc_id = 11"))
def docs_like_doc(spark, d):
    return rounded(lsa.docs_like_doc(lsa.normalise_rows(_scaled(spark, d)), 11), "score")


@query("docs_for_term", _top_sql(US_SQL, "us", "SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 9"))
def docs_for_term(spark, d):
    out = lsa.docs_for_term(_scaled(spark, d), _embeddings(spark, d, "term_id"), 9, term_key="term_id")
    return rounded(out, "score")


@query(
    "docs_for_terms",
    _top_sql(
        US_SQL
        + """, parts AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE * (label + 1) AS x FROM embeddings WHERE vec_id IN (2, 4, 8)),
        sums AS (SELECT i, sum(x) AS x FROM parts GROUP BY 1)""",
        "us",
        "SELECT list(x ORDER BY i) AS v FROM sums",
    ),
)
def docs_for_terms(spark, d):
    v = table(spark, d, "embeddings").select(
        F.concat(F.lit("t"), "vec_id").alias("term"), as_doubles("embedding").alias("vector"), (F.col("label") + 1.0).alias("idf")
    )
    return rounded(lsa.docs_for_terms(_scaled(spark, d), v, ["t2", "t4", "t8"], DIMS), "score")


@query(
    "top_per_concept",
    """WITH flat AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS concept, unnest(embedding)::DOUBLE AS weight FROM embeddings),
    r AS (SELECT concept, CAST(row_number() OVER (PARTITION BY concept ORDER BY weight DESC, vec_id) AS INTEGER) AS rank, vec_id, round(weight, 6) AS weight FROM flat WHERE concept < 10)
    SELECT * FROM r WHERE rank <= 10""",
)
def top_per_concept(spark, d):
    return rounded(lsa.top_per_concept(_embeddings(spark, d), "vec_id"), "weight")


CONCEPTS = 10


@query(
    "projected_documents",
    f"""WITH {WORDS_SQL}, best AS (SELECT term, ln(nn / df) AS idf FROM freq, nd ORDER BY df DESC, term LIMIT 1000),
    hit AS (SELECT doc_id, tf / n_terms * idf AS w, vector FROM tf JOIN best USING (term) JOIN len USING (doc_id) JOIN wv USING (term)),
    flat AS (SELECT doc_id, generate_subscripts(vector, 1) - 1 AS dim, w, unnest(vector) AS x FROM hit),
    sums AS (SELECT doc_id, dim, sum(w * x) AS s FROM flat WHERE dim < {CONCEPTS} GROUP BY 1, 2)
    SELECT d.doc_id, CAST(g.dim AS INTEGER) AS dim, round(coalesce(s, 0) / ({CONCEPTS} - g.dim), 6) AS value
    FROM documents d CROSS JOIN range({CONCEPTS}) g(dim) LEFT JOIN sums ON sums.doc_id = d.doc_id AND sums.dim = g.dim""",
)
def projected_documents(spark, d):
    tokens = stage(_tokens(spark, d), "tokens")
    table_ = terms.term_table(tokens, "tokens")
    vectors = _word_vectors(spark, d, table_.select(F.col("term").alias("word")))
    factor = table_.join(vectors.withColumnRenamed("word", "term"), "term").select(
        "term", F.slice(as_doubles("vector"), 1, CONCEPTS).alias("vector"), "idf"
    )
    values = [float(CONCEPTS - i) for i in range(CONCEPTS)]
    out = lsa.project_documents(tokens, "doc_id", "tokens", stage(factor, "factor"), values)
    return rounded(out.select("doc_id", F.posexplode("vector").alias("dim", "value")), "value")


@query(
    "single_cluster_cost",
    """WITH flat AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT round(sum(s), 4) AS cost FROM (SELECT var_pop(x) * count(*) AS s FROM flat GROUP BY i)""",
)
def single_cluster_cost(spark, d):
    return rounded(total_inertia(_embeddings(spark, d), "vector", DIMS), "cost", digits=4)


# --- wiki pages ----------------------------------------------------------------------------------

# Page XML around every document; its kind depends on language, source and labels.
PAGES_SQL = """xmls AS (SELECT d.doc_id, '<page>' || chr(10) || '<title>Caf&eacute; &amp;amp; ' || d.lang || ' ' || d.doc_id || CASE WHEN d.source = 'src3' THEN ' (disambiguation)' ELSE '' END || '</title>'
  || CASE WHEN d.lang = 'en' THEN '<ns> 0 </ns>' WHEN d.lang = 'de' THEN '<ns>4</ns>' ELSE '' END || '<id>' || d.doc_id || '</id>'
  || CASE WHEN d.source = 'src5' THEN '' ELSE '<text xml:space="preserve">'
    || CASE WHEN l.toxic = 1 THEN '#REDIRECT [[A]] ' WHEN d.source = 'src6' THEN '#redirect [[A]] ' WHEN d.source = 'src7' THEN '#Redirect [[A]] ' ELSE '' END
    || CASE WHEN l.quality = 0 THEN '{{Disambig}} ' ELSE '' END
    || CASE WHEN d.lang = 'fr' THEN '{{bio-stub}} ' WHEN d.source = 'src8' THEN 'Wikipedia:Stub ' ELSE '' END
    || '[[' || d.source || '#part|the ' || d.lang || ']] [[File:x.png]] [[' || d.lang || ']] [[#top]] [[]] [[de:Haus ' || d.source || ']] == ''''''Head'''''' ==' || chr(10)
    || '&lt;ref&gt;note&lt;/ref&gt; &lt;!-- gone --&gt; http://x.org/a {{box}} &lt;b&gt;' || d.text || '&lt;/b&gt;</text>' END || chr(10) || '</page>' AS xml
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _page_xml(spark, d) -> DataFrame:
    documents = spread_rows(table(spark, d, "documents"), "doc_id")
    rows = documents.join(table(spark, d, "labels"), "doc_id", "left")
    key, lang, source = F.col("doc_id").cast("string"), F.col("lang"), F.col("source")

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    lead = (
        F.when(F.col("toxic") == 1, "#REDIRECT [[A]] ").when(source == "src6", "#redirect [[A]] ")
        .when(source == "src7", "#Redirect [[A]] ").otherwise("")
    )
    body = text(
        wiki.TEXT_TAG, lead,
        F.when(F.col("quality") == 0, "{{Disambig}} ").otherwise(""),
        F.when(lang == "fr", "{{bio-stub}} ").when(source == "src8", "Wikipedia:Stub ").otherwise(""),
        "[[", source, "#part|the ", lang, "]] [[File:x.png]] [[", lang, "]] [[#top]] [[]] [[de:Haus ", source, "]] == '''Head''' ==\n",
        "&lt;ref&gt;note&lt;/ref&gt; &lt;!-- gone --&gt; http://x.org/a {{box}} &lt;b&gt;", F.col("text"), "&lt;/b&gt;</text>",
    )
    xml = text(
        "<page>\n<title>Caf&eacute; &amp;amp; ", lang, " ", key,
        F.when(source == "src3", " (disambiguation)").otherwise(""), "</title>",
        F.when(lang == "en", "<ns> 0 </ns>").when(lang == "de", "<ns>4</ns>").otherwise(""),
        "<id>", key, "</id>", F.when(source == "src5", "").otherwise(body), "\n</page>",
    )
    return rows.select("doc_id", xml.alias("xml"))


FIELDS_SQL = PAGES_SQL + """, fields AS (SELECT doc_id, xml, regexp_extract(xml, '(?s)<id>(.*?)</id>', 1) AS page_id,
    replace(replace(regexp_extract(xml, '(?s)<title>(.*?)</title>', 1), '&eacute;', 'é'), '&amp;', '&') AS title,
    CASE WHEN xml LIKE '%<ns>%' THEN trim(regexp_extract(xml, '(?s)<ns>(.*?)</ns>', 1)) = '0' ELSE true END AS is_article,
    strpos(xml, '<text xml:space="preserve">') = 0 AS is_empty, regexp_matches(xml, '(?i)\\{\\{disambig[A-Za-z0-9_]*\\}\\}') AS is_disambiguation,
    CASE WHEN xml LIKE '%<text xml:space="preserve">%' THEN regexp_extract(xml, '(?s)<text xml:space="preserve">(.*?)</text>', 1) END AS markup FROM xmls),
pg AS (SELECT *, coalesce(starts_with(markup, '#REDIRECT') OR starts_with(markup, '#redirect'), false) AS is_redirect,
    strpos(xml, 'stub}}') > 0 OR strpos(xml, 'Wikipedia:Stub') > 0 AS is_stub FROM fields)"""


@query(
    "wiki_page_fields",
    f"""WITH {FIELDS_SQL} SELECT page_id, title, is_article, is_empty, is_redirect, is_disambiguation, is_stub, 'en' AS "language", coalesce(length(markup), -1)::INTEGER AS n_markup, length(xml)::INTEGER AS n_raw FROM pg""",
)
def wiki_page_fields(spark, d):
    rows = wikipages.page_table(_page_xml(spark, d))
    return rows.select(
        "page_id", "title", "is_article", "is_empty", "is_redirect", "is_disambiguation", "is_stub", "language",
        F.coalesce(F.length("markup"), F.lit(-1)).alias("n_markup"), F.length("raw_xml").alias("n_raw"),
    )


CONTENT_SQL = FIELDS_SQL + r""", art AS (SELECT doc_id, title, markup FROM pg WHERE NOT is_empty AND is_article AND NOT is_redirect AND NOT contains(title, '(disambiguation)')),
ren AS (SELECT doc_id, title, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(markup,
   '\[\[[a-z\-]+:[^\]]+\]\]', ' ', 'g'), '\[\[[^\[\]|]*\|([^\[\]]*)\]\]', '\1', 'g'), '\[\[([^\[\]]*)\]\]', '\1', 'g'), '\[https?://[^ \]]+ ([^\]]*)\]', '\1', 'g'),
   '''{2,5}', '', 'g'), '(?m)^=+ *(.*?) *=+ *$', '\1', 'g'), '(?m)^[*#:;]+ *', '', 'g') AS body FROM art),
dec AS (SELECT doc_id, title, replace(replace(replace(replace(replace(replace(title || chr(10) || body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&'), '&amp;', '&') AS s FROM ren),
content AS (SELECT doc_id, title, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '<ref>.*?</ref>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), 'http://[^ <]+', ' ', 'g'), '\{\{.*?\}\}', ' ', 'g'), '<[^!][^>]*>', ' ', 'g') AS content FROM dec)"""


def _articles_text(spark, d) -> DataFrame:
    return wikipages.article_texts(_page_xml(spark, d))


@query("wiki_article_texts", f"WITH {CONTENT_SQL} SELECT title, length(content)::INTEGER AS n_chars, md5(content) AS digest FROM content")
def wiki_article_texts(spark, d):
    return _articles_text(spark, d).select(
        "title", F.length("content").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest")
    )


@query(
    "wiki_paragraphs",
    f"""WITH {CONTENT_SQL}, p AS (SELECT title, unnest(string_split(content, chr(10))) AS l FROM content),
    s AS (SELECT title, regexp_replace(l, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS line FROM p) SELECT title, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM s WHERE line <> '' GROUP BY 1""",
)
def wiki_paragraphs(spark, d):
    lines = wikipages.article_paragraphs(_articles_text(spark, d))
    return lines.groupBy("title").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


LINKS_SQL = PAGES_SQL + r""", inner_ AS (SELECT doc_id, unnest(regexp_extract_all(xml, '(?s)\[\[(.*?)\]\]', 1)) AS t FROM xmls),
plain AS (SELECT doc_id, t, string_split(string_split(t, '|')[1], '#')[1] AS target FROM inner_ WHERE NOT contains(t, ':'))"""


@query(
    "wiki_links",
    f"""WITH {LINKS_SQL} SELECT doc_id, CASE WHEN contains(t, '|') THEN substr(t, strpos(t, '|') + 1) ELSE target END AS anchor, target FROM plain WHERE target <> ''""",
)
def wiki_links(spark, d):
    return unnest_structs(_page_xml(spark, d), ["doc_id"], wiki.links("xml"), "target")


@query(
    "wiki_language_links",
    f"""WITH {PAGES_SQL}, x AS (SELECT doc_id, regexp_extract(xml, '(?s)\\[\\[de:(.*?)\\]\\]', 1) AS title FROM xmls)
    SELECT doc_id, CASE WHEN title <> '' AND NOT contains(title, chr(10)) THEN title END AS title FROM x""",
)
def wiki_language_links(spark, d):
    return _page_xml(spark, d).select("doc_id", wiki.language_link("xml", "de").alias("title"))


@query(
    "document_contract",
    "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS digest, 'text/html' AS content_type FROM documents",
)
def document_contract(spark, d):
    return wikipages.indexable(_documents(spark, d), "doc_id", "text").select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "content_type"
    )


PAGE_TEXT_SQL = r"""plain AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<ref>.*?</ref>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), 'http://[^ <]+', ' ', 'g'), '\{\{.*?\}\}', ' ', 'g'), '<[^!][^>]*>', ' ', 'g') AS content FROM pages)"""


@query(
    "page_paragraphs",
    f"""WITH {PAGE_TEXT_SQL}, p AS (SELECT page_id, regexp_replace(unnest(string_split(content, chr(10))), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS line FROM plain)
    SELECT page_id, line FROM p WHERE line <> ''""",
)
def page_paragraphs(spark, d):
    plain = spread_rows(table(spark, d, "pages"), "page_id").select("page_id", wiki.without_markup("html").alias("content"))
    return unnest(plain, ["page_id"], wiki.paragraphs("content"), "line")


# --- preparation ---------------------------------------------------------------------------------


def _prepared_sql() -> str:
    """The whole job over the comments of sampled articles."""
    sampled = f"""{COMMENTS_SQL}, groups AS (SELECT "articleID", bool_or("editorsSelection") AS "selectionDone" FROM comments GROUP BY 1),
    drawn AS (SELECT * FROM groups WHERE {draw_sql('"articleID"', "group", 1)} < CASE WHEN "selectionDone" THEN 1.0 ELSE 0.5 END),
    sampled AS (SELECT c.*, d."selectionDone", c."commentID" AS doc_id, c."commentBody" AS text FROM comments c JOIN drawn d USING ("articleID"))"""
    words_ = WORDS_SQL.replace("FROM documents", "FROM sampled")
    moods = _sentiment_sql().replace("FROM documents", "FROM sampled").replace("WITH ", "", 1)
    moods, final = moods.rsplit("\nSELECT ", 1)
    return f"""WITH {sampled}, {words_},
    moods AS (WITH {moods} SELECT {final}),
    hit AS (SELECT doc_id, sum(tfidf * list_sum(vector)) / sum(tfidf) AS total FROM post JOIN wv USING (term) GROUP BY 1 HAVING sum(tfidf) <> 0),
    alive AS (SELECT doc_id FROM post GROUP BY 1 HAVING sum(abs(tfidf)) > 0),
    kept AS (SELECT s.*, n_terms, positive, negative, neutral, coalesce(hit.total, 0) AS vector_sum FROM sampled s JOIN alive USING (doc_id) JOIN len USING (doc_id) JOIN moods USING (doc_id) LEFT JOIN hit USING (doc_id)),
    sums AS (SELECT "articleID", sum("recommandations") AS total FROM kept GROUP BY 1 HAVING sum("recommandations") > 0),
    shares AS (SELECT kept.*, total, "recommandations"::DOUBLE / total AS share FROM kept JOIN sums USING ("articleID"))
    SELECT "commentID", "articleID", coalesce("editorsSelection"::INTEGER, -1) AS label, "selectionDone"::VARCHAR AS "selectionDone", n_terms AS n_tokens, round(positive, 6) AS positive, round(negative, 6) AS negative,
      round(neutral, 6) AS neutral, round(vector_sum, 6) AS vector_sum, total::BIGINT AS sum_recommandations, round(share, 6) AS share,
      round(CASE WHEN "recommandations" = 0 THEN -1 ELSE log10("recommandations") END, 6) AS log_value,
      CASE WHEN "recommandations" = 0 THEN 0 WHEN "recommandations" <= 1 THEN 1 WHEN "recommandations" <= 10 THEN 2 WHEN "recommandations" <= 100 THEN 3 ELSE 4 END AS count_class,
      CASE WHEN share = 0 THEN 0 WHEN share <= 0.01 THEN 1 WHEN share <= 0.1 THEN 2 WHEN share <= 0.5 THEN 3 ELSE 4 END AS share_class
    FROM shares"""


@query("prepared_comments", _prepared_sql())
def prepared_comments(spark, d):
    rows = comments(spark, d)
    vectors = stage(_word_vectors(spark, d, lemmas.vocabulary(_tokens(spark, d), "tokens")), "words")
    out = prepare.prepare(rows, vectors, DIMS, polarity(spark, d), STOP, rate_selected=1.0, rate_others=0.5, negators=NEGATORS)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    shares = [F.get("sentiment", F.lit(i)).alias(name) for i, name in enumerate(("positive", "negative", "neutral"))]
    flat = out.select(
        "commentID", "articleID", F.coalesce("label", F.lit(-1)).alias("label"),
        F.col("selectionDone").cast("string").alias("selectionDone"), F.size("tokens").cast("long").alias("n_tokens"),
        *shares, total.alias("vector_sum"), "sum_recommandations", "share", "log_value", "count_class", "share_class",
    )
    return rounded(flat, "positive", "negative", "neutral", "vector_sum", "share", "log_value")
