"""Fitted models over the documents, labels and embeddings.

A fit differs between engines, so its SQL gives what every right fit must have: its words, its margins, flags for
properties that hold exactly. Each query still fits the whole model and goes over all that it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import svd_sql, tree_sql
from catalog.common import COMMENTS_SQL, NEGATORS, STOP, STOP_SQL, TOKENS_SQL, WORD_SQL, comments, draw_sql, polarity, rounded, shared, table
from catalog.tables import _anova_sql
from catalog.texts import DIMS, LEMMAS_SQL, SMOOTH_SQL, _embeddings, _sentiment_sql, _tokens, _word_vectors
from textpulse.functions.tokens import words
from textpulse.operators import cooccurrence, embeddings, learning, lemmas, lsa, sampling, sentiment, skipgram, sparse, subspace, trees
from textpulse.operators.engagement import normalise_in_group
from textpulse.operators.tests_stat import chi_square_ml
from textpulse.plans.reports import sentiment_anova
from textpulse.session import discard, local_rows, scratch_path, stage
from textpulse.sources.tables import load_word_vectors, save_word_vectors

QUERIES = {}
ORACLE = {}
SEED = 1
# Lemmas with their places among those that are kept.
LEMMAS_AT_SQL = f"""placed AS MATERIALIZED (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM (
  SELECT doc_id, [t for t in {TOKENS_SQL} if length(t) > 2 AND t NOT IN {STOP_SQL}] AS w FROM documents))"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def _staged_tokens(spark, d) -> DataFrame:
    """Fits read the tokens several times, so they are worked out once."""
    return stage(_tokens(spark, d), "tokens")


# The vector form agrees with the postings: same number of entries, same sums.
@query(
    "count_vector_tfidf",
    f"WITH {SMOOTH_SQL} SELECT doc_id, round(coalesce(sum(tf), 0), 4)::DOUBLE AS n_counted, round(coalesce(sum(tfidf), 0), 4) AS weight FROM documents LEFT JOIN post USING (doc_id) GROUP BY 1",
)
def count_vector_tfidf(spark, d):
    # Documents may share an id; each has its own vector.
    tokens = stage(_tokens(spark, d).select(F.monotonically_increasing_id().alias("at"), "doc_id", "tokens"), "tokens")
    weighed = sparse.sparse_tfidf(tokens, ["at", "doc_id"])

    def total(column: str):
        return F.aggregate(column, F.lit(0.0), lambda s, x: s + x)

    sums = weighed.select("doc_id", total("counts").alias("n_counted"), total("tfidf").alias("weight"))
    return rounded(sums, "n_counted", "weight", digits=4)


CORPUS_SQL = f"""{LEMMAS_SQL}, size AS (SELECT doc_id FROM tok GROUP BY 1 HAVING count(*) > {embeddings.MIN_CORPUS_TOKENS}),
word AS (SELECT term FROM tok JOIN size USING (doc_id) GROUP BY 1 HAVING count(*) >= 5)"""


def _word_vectors_of_tokens(spark, d) -> DataFrame:
    """The default size and least count."""
    corpus = embeddings.training_corpus([_tokens(spark, d)])
    return skipgram.train_by_blocks(corpus, size=embeddings.VECTOR_SIZE, seed=SEED)


@query("word_vectors_trained", f"WITH {CORPUS_SQL} SELECT term AS word, {embeddings.VECTOR_SIZE} AS dims, true AS finite FROM word")
def word_vectors_trained(spark, d):
    finite = F.forall("vector", lambda x: F.abs(x) < float("inf"))
    return _word_vectors_of_tokens(spark, d).select("word", F.size("vector").alias("dims"), finite.alias("finite"))


@query("word_model_saved", f"WITH {CORPUS_SQL} SELECT count(*) AS n_words, 0::BIGINT AS n_different FROM word")
def word_model_saved(spark, d):
    path = scratch_path(spark, "word-model")
    before = _word_vectors_of_tokens(spark, d)
    save_word_vectors(before, path)
    after = load_word_vectors(spark, path).select("word", F.col("vector").alias("loaded"))
    same = F.coalesce(F.col("vector") == F.col("loaded"), F.lit(False))
    return before.join(after, "word", "full").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(~same).alias("n_different"))


def _factors(spark, d) -> lsa.Factors:
    def fit() -> lsa.Factors:
        long = embeddings.longer_than(_staged_tokens(spark, d), "tokens", embeddings.MIN_LSA_TOKENS)
        return subspace.factorise_postings(long, "doc_id", "tokens")

    return shared(spark, d, "factors", fit)


@query("lsa_top_terms", svd_sql.top_sql("v", "t", "term"))
def lsa_top_terms(spark, d):
    return rounded(lsa.top_per_concept(_factors(spark, d).terms, "term", digits=9), "weight")


@query("lsa_top_documents", svd_sql.top_sql("u", "d", "doc_id"))
def lsa_top_documents(spark, d):
    return rounded(lsa.top_per_concept(_factors(spark, d).documents, "doc_id", digits=9), "weight")


@query("lsa_singular_values", svd_sql.factors_sql() + " SELECT c::INTEGER AS concept, round(s, 6) AS value FROM s")
def lsa_singular_values(spark, d):
    values = enumerate(_factors(spark, d).singular_values)
    return rounded(local_rows(spark, list(values), "concept int, value double"), "value")


@query("lsa_documents_for_document", svd_sql.LIKE_SQL)
def lsa_documents_for_document(spark, d):
    found = _factors(spark, d)
    unit = lsa.normalise_rows(lsa.scale_columns(found.documents, found.singular_values))
    return rounded(lsa.docs_like_doc(unit, 1, digits=9), "score")


def cluster_sql(low: int, high: int, rounds: int) -> str:
    """Lloyd's iterations for each k from low to high: c{rounds} (k, cluster, v), final (vec_id, k, cluster, distance)."""
    parts = [
        "rows AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)",
        f"pick AS (SELECT v, row_number() OVER (ORDER BY {draw_sql('vec_id', 'start', SEED)}, vec_id) - 1 AS place FROM rows)",
        f"c0 AS MATERIALIZED (SELECT k, place AS cluster, v FROM range({low}, {high + 1}) m(k), pick WHERE place < k)",
    ]
    for r in range(rounds + 1):
        near = "min({'d': pow(list_distance(r.v, c.v), 2), 'c': c.cluster})"
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, k, best.c AS cluster, best.d AS distance FROM (SELECT vec_id, k, {near} AS best FROM rows r, c{r} c GROUP BY 1, 2))")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT k, cluster, list(x ORDER BY dim) AS v FROM (SELECT k, cluster, dim, avg(x) AS x FROM (SELECT k, cluster, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM a{r} JOIN rows USING (vec_id)) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, cluster, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (k, cluster))")
    parts += [f"final AS (SELECT * FROM a{rounds})", "sizes AS (SELECT cluster, count(*) AS n FROM final GROUP BY 1)"]
    return "WITH " + ", ".join(parts)


PAIRS_SQL = f"""{LEMMAS_AT_SQL}, near AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.i > a.i AND b.i <= a.i + {cooccurrence.WINDOW} GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT word, context, sum(n)::BIGINT AS n FROM (SELECT a AS word, b AS context, n FROM near UNION ALL SELECT b, a, n FROM near) GROUP BY 1, 2)"""
LEAST = 40
PMI_SQL = f"""{PAIRS_SQL}, margin AS (SELECT word, sum(n) AS total FROM pairs GROUP BY 1 HAVING sum(n) >= {LEAST}),
met AS (SELECT p.word, p.context, p.n, a.total AS n_word, b.total AS n_context FROM pairs p JOIN margin a ON a.word = p.word JOIN margin b ON b.word = p.context),
pmi AS MATERIALIZED (SELECT word, context, ln(n * (SELECT sum(n) FROM met) / (n_word * n_context)) AS weight FROM met)"""


def _pairs(spark, d) -> DataFrame:
    tokens = _staged_tokens(spark, d)
    pairs = cooccurrence.cooccurrences(tokens, "tokens")
    discard(tokens)  # the pairs are stored
    return pairs


@query("cooccurrence_counts", f"WITH {PAIRS_SQL} SELECT word, count(*) AS n_contexts, sum(n)::BIGINT AS n, max(n)::BIGINT AS most FROM pairs GROUP BY 1")
def cooccurrence_counts(spark, d):
    """Per word of the table of pairs."""
    return _pairs(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n_contexts"), F.sum("n").alias("n"), F.max("n").alias("most"))


@query("shifted_pmi", f"WITH {PMI_SQL} SELECT word, context, round(weight, 6) AS weight FROM pmi WHERE round(weight, 12) > 0")
def shifted_pmi(spark, d):
    return rounded(cooccurrence.shifted_pmi(_pairs(spark, d), least=LEAST), "weight")


PMI_POSTINGS_SQL = f"{PMI_SQL}, p AS MATERIALIZED (SELECT word AS d, context AS t, weight AS w FROM pmi WHERE round(weight, 12) > 0)"


@query("pmi_vectors", f"{svd_sql.factors_sql(PMI_POSTINGS_SQL)} SELECT d AS word, c::INTEGER AS dim, round(x * sqrt(s), 5) + 0.0::DOUBLE AS value FROM u JOIN s USING (c)")
def pmi_vectors(spark, d):
    vectors, _ = cooccurrence.pmi_vectors(cooccurrence.shifted_pmi(_pairs(spark, d), least=LEAST), lsa.CONCEPTS)
    # Adding 0 makes a rounded -0 a 0, on both sides.
    return vectors.select("word", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 5) + 0.0)


@query(
    "nlp_result_fields",
    f"""SELECT doc_id, len(regexp_extract_all(lower(text), '{WORD_SQL}'))::INTEGER AS n_tokens, positive, negative, neutral FROM documents JOIN ({_sentiment_sql()}) USING (doc_id)""",
)
def nlp_result_fields(spark, d):
    """Tokens and sentiment shares as one struct, stored, and its fields again, with the check that there are three shares."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    shares = ["positive", "negative", "neutral"]
    profile = sentiment.sentiment_profile(rows, "doc_id", "text", polarity(spark, d), negators=NEGATORS).withColumn("found", words("text", lower=True))
    parts = sentiment.nlp_parts(stage(profile.select("doc_id", sentiment.nlp_result("found", shares).alias("nlp")), "nlp"), "nlp")
    return rounded(parts.select("doc_id", F.size("tokens").alias("n_tokens"), *[F.get("sentiments", F.lit(i)).alias(c) for i, c in enumerate(shares)]), *shares)


ROUNDS = 5


@query("k_means_centers", f"{cluster_sql(10, 10, ROUNDS)} SELECT cluster::INTEGER AS cluster, dim::INTEGER AS dim, round(x, 6) + 0.0::DOUBLE AS value, coalesce(n, 0) AS n FROM (SELECT cluster, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM c{ROUNDS}) LEFT JOIN sizes USING (cluster)")
def k_means_centers(spark, d):
    found = learning.lloyd(_embeddings(spark, d), {10: _start(spark, d, 10)}, DIMS, rounds=ROUNDS)
    return found.select("cluster", F.posexplode("vector").alias("dim", "value"), "n").withColumn("value", F.round("value", 6) + 0.0)


@query("k_means_assignments", f"{cluster_sql(10, 10, ROUNDS)} SELECT vec_id, cluster::INTEGER AS cluster, round(distance, 6) AS distance FROM final")
def k_means_assignments(spark, d):
    found = learning.lloyd(_embeddings(spark, d), {10: _start(spark, d, 10)}, DIMS, rounds=ROUNDS)
    return rounded(learning.assign_clusters(_embeddings(spark, d), found).select("vec_id", "cluster", "distance"), "distance")


@query(
    "k_means_center_words",
    f"""{cluster_sql(5, 5, ROUNDS)}, near AS (SELECT cluster, 'w' || vec_id AS word, round(list_cosine_similarity(r.v, c.v), 9) AS s FROM c{ROUNDS} c, rows r),
    top AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, word) AS rank FROM near)
    SELECT cluster::INTEGER AS cluster, rank::INTEGER AS rank, word, round(s, 6) AS similarity FROM top WHERE rank <= 10""",
)
def k_means_center_words(spark, d):
    found = learning.lloyd(_embeddings(spark, d), {5: _start(spark, d, 5)}, DIMS, rounds=ROUNDS)
    named = _embeddings(spark, d).select(F.concat(F.lit("w"), "vec_id").alias("word"), "vector")
    return rounded(learning.words_of_centers(found, named, digits=9), "similarity")


def _start(spark, d, k: int) -> list[list[float]]:
    return learning.start_rows(_embeddings(spark, d), "vec_id", k, seed=SEED)


@query("inertia_curve", f"{cluster_sql(1, 20, ROUNDS)} SELECT k::INTEGER AS k, round(sum(distance), 4) AS cost FROM final GROUP BY 1")
def inertia_curve(spark, d):
    kept = stage(_embeddings(spark, d), "vectors")
    return rounded(learning.lloyd_curve(kept, "vec_id", DIMS, rounds=ROUNDS, seed=SEED), "cost", digits=4)


@query(
    "chi_square_estimator",
    f"""WITH {COMMENTS_SQL}, base AS (SELECT * FROM comments WHERE "editorsSelection" IS NOT NULL),
    totals AS (SELECT "articleID", sum("recommandations") AS total FROM base GROUP BY 1 HAVING sum("recommandations") > 0),
    n AS (SELECT "editorsSelection"::INTEGER AS y, "recommandations" AS r, "recommandations"::DOUBLE / total AS s FROM base JOIN totals USING ("articleID")),
    f AS (SELECT y, y AS flag, CASE WHEN r = 0 THEN 0 WHEN r <= 1 THEN 1 WHEN r <= 10 THEN 2 WHEN r <= 100 THEN 3 ELSE 4 END AS c,
      CASE WHEN s = 0 THEN 0 WHEN s <= 0.01 THEN 1 WHEN s <= 0.1 THEN 2 WHEN s <= 0.5 THEN 3 ELSE 4 END AS sc FROM n),
    src AS (SELECT 0 AS i, flag AS v, y FROM f UNION ALL SELECT 1, c, y FROM f UNION ALL SELECT 2, sc, y FROM f),
    rv AS (SELECT i, v, count(*) AS nv FROM src GROUP BY 1, 2), lv AS (SELECT i, y, count(*) AS ny FROM src GROUP BY 1, 2),
    cells AS (SELECT i, v, y, count(*) AS o FROM src GROUP BY 1, 2, 3), tt AS (SELECT count(*) AS total FROM f),
    grid AS (SELECT i, v, y, nv * ny / total AS e, coalesce(o, 0) AS o FROM rv JOIN lv USING (i) CROSS JOIN tt LEFT JOIN cells USING (i, v, y))
    SELECT i::INTEGER AS "featureIndex", ((count(DISTINCT v) - 1) * (count(DISTINCT y) - 1))::INTEGER AS "degreesOfFreedom", round(sum((o - e) * (o - e) / e), 6) AS statistic FROM grid GROUP BY 1""",
)
def chi_square_estimator(spark, d):
    rows = comments(spark, d).where(F.col("editorsSelection").isNotNull())
    classed = normalise_in_group(rows, "articleID", "recommandations")
    flagged = classed.withColumn("flag", F.col("editorsSelection").cast("int"))
    tests = chi_square_ml(flagged, ["flag", "count_class", "share_class"], "editorsSelection")
    return rounded(tests.drop("pValue"), "statistic")


def _sentiment_anova_sql() -> str:
    parts = [
        f"""SELECT *, '{share}' AS measure FROM ({_anova_sql("joined", "flag", share)})"""
        for share in ("positive", "negative", "neutral")
    ]
    return f"""WITH shares AS ({_sentiment_sql(digits=None)}),
    joined AS (SELECT (quality = 0)::VARCHAR AS flag, positive, negative, neutral FROM shares LEFT JOIN labels USING (doc_id)) """ + " UNION ALL ".join(parts)


@query("anova_sentiment_by_selection", _sentiment_anova_sql())
def anova_sentiment_by_selection(spark, d):
    rows = comments(spark, d).select("commentID", "commentBody", "editorsSelection")
    found = sentiment_anova(sentiment.sentiment_profile(rows, "commentID", "commentBody", polarity(spark, d), negators=NEGATORS))
    return rounded(found.drop("p_value"), "f_value", "eta_sq", "omega_sq")


def _tree_input(spark, d, labelled: bool = True) -> DataFrame:
    """Comments, all or the labelled ones, with text vector, sentiment, length, page and both classes."""
    rows = comments(spark, d)
    rows = rows.where(F.col("editorsSelection").isNotNull()) if labelled else rows
    texts = rows.select("commentID", "commentBody")
    tokens = stage(lemmas.text_lemmas(texts, "commentID", "commentBody", STOP), "tokens")
    vectors = embeddings.tfidf_vectors(
        tokens, "commentID", "tokens", _word_vectors(spark, d, lemmas.vocabulary(tokens, "tokens")), DIMS
    )
    # Adding 0 makes a rounded -0 a 0.
    vectors = vectors.select("commentID", F.transform("vector", lambda x: F.round(x, 6) + 0.0).alias("text_vector"))
    profile = rounded(
        sentiment.sentiment_profile(texts, "commentID", "commentBody", polarity(spark, d), negators=NEGATORS).drop("commentBody", "n_sentences"),
        "positive", "negative", "neutral",
    )
    joined = rows.drop("commentBody").join(vectors, "commentID").join(profile, "commentID")
    grouped = normalise_in_group(stage(joined, "features"), "articleID", "recommandations")
    return grouped.withColumn("label", F.col("editorsSelection").cast("int").cast("double"))


TREE_FEATURES = [
    "text_vector", "positive", "negative", "neutral", "articleWordCount", "printPage", "count_class", "share_class",
]
DEPTH = 5


def _class_tree(spark, d) -> tuple[trees.Tree, DataFrame]:
    """The tree of the training part, and the test part routed through it."""

    def fit() -> tuple[trees.Tree, DataFrame]:
        rows = sampling.rebalance(_tree_input(spark, d), F.col("editorsSelection"), 0.2, "commentID", SEED)
        train, test = sampling.random_split(rows, "commentID", SEED, 0.7)
        tree = trees.grow_tree(train, TREE_FEATURES, "label", "commentID", depth=DEPTH, seed=SEED)
        return tree, stage(trees.route(test, tree.nodes, TREE_FEATURES, DEPTH).select("commentID", "label", "leaf", "prediction"), "routed")

    return shared(spark, d, "class tree", fit)


def _number_tree(spark, d) -> tuple[trees.Tree, DataFrame]:
    """All comments: the target needs no label."""

    def fit() -> tuple[trees.Tree, DataFrame]:
        train, test = sampling.random_split(_tree_input(spark, d, labelled=False), "commentID", SEED, 0.7)
        inputs = TREE_FEATURES[:5]
        tree = trees.grow_tree(train, inputs, "log_value", "commentID", classes=False, depth=DEPTH, bins=64, max_categories=60, min_rows=2, seed=SEED)
        return tree, stage(trees.route(test, tree.nodes, inputs, DEPTH).select("commentID", "log_value", "prediction"), "routed")

    return shared(spark, d, "number tree", fit)


def _node_rows(tree: trees.Tree) -> DataFrame:
    listed = F.array_join(F.transform("categories", lambda c: F.format_string("%.6f", c)), ", ")
    told = tree.nodes.select("node", "depth", F.coalesce("feature", F.lit(-1)).alias("feature"), "kind", "threshold", listed.alias("categories"), "n", "prediction", "impurity", "gain")
    return rounded(told, "threshold", "prediction", "impurity", "gain")


@query("tree_nodes", f"{tree_sql.CLASS_TREE_SQL} {tree_sql.NODES_SQL}")
def tree_nodes(spark, d):
    return _node_rows(_class_tree(spark, d)[0])


@query("tree_text", f"{tree_sql.CLASS_TREE_SQL} {tree_sql.TEXT_SQL}")
def tree_text(spark, d):
    return trees.tree_text(_class_tree(spark, d)[0])


@query("tree_importances", f"{tree_sql.CLASS_TREE_SQL} {tree_sql.IMPORTANCES_SQL}")
def tree_importances(spark, d):
    return rounded(trees.importances(_class_tree(spark, d)[0]), "importance")


@query(
    "tree_feature_values",
    f"{tree_sql.CLASS_TREE_SQL} SELECT feature::INTEGER AS feature, kind, (generate_subscripts(edges, 1) - 1)::INTEGER AS place, round(unnest(edges), 6) AS value FROM kinds",
)
def tree_feature_values(spark, d):
    """Which features are categories, and their values; of the others the thresholds that were tried."""
    bins = _class_tree(spark, d)[0].bins
    return rounded(bins.select("feature", "kind", F.posexplode("edges").alias("place", "value")), "value")


@query(
    "tree_predictions",
    f"""{tree_sql.CLASS_ROUTED_SQL} SELECT key AS "commentID", label, leaf, prediction::DOUBLE AS prediction, CASE WHEN prediction = 1 THEN 'true' ELSE 'false' END AS "predictedLabel" FROM routed""",
)
def tree_predictions(spark, d):
    back = F.when(F.col("prediction") == 1, "true").otherwise("false")
    return _class_tree(spark, d)[1].select("commentID", "label", "leaf", "prediction", back.alias("predictedLabel"))


@query("tree_confusion_matrix", f"{tree_sql.CLASS_ROUTED_SQL} SELECT label, prediction::DOUBLE AS prediction, count(*) AS n FROM routed GROUP BY 1, 2")
def tree_confusion_matrix(spark, d):
    return learning.confusion_matrix(_class_tree(spark, d)[1], "label")


@query(
    "tree_scores",
    f"""{tree_sql.CLASS_ROUTED_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (label = prediction) AS good, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
    count(*) FILTER (label = 1) AS actual, count(*) FILTER (prediction = 1) AS predicted FROM routed)
    SELECT round(good / n, 6) AS accuracy, round(1 - good / n, 6) AS test_error, round(coalesce(tp / nullif(actual, 0), 0), 6) AS recall, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS precision,
    round(coalesce(2 * tp / nullif(actual + predicted, 0), 0), 6) AS f_measure FROM c""",
)
def tree_scores(spark, d):
    scores = learning.class_scores(_class_tree(spark, d)[1], "label")
    return rounded(scores, "accuracy", "test_error", "recall", "precision", "f_measure")


@query("regression_tree_nodes", f"{tree_sql.NUMBER_TREE_SQL} {tree_sql.NODES_SQL}")
def regression_tree_nodes(spark, d):
    return _node_rows(_number_tree(spark, d)[0])


@query("regression_tree_error", f"{tree_sql.NUMBER_ROUTED_SQL} SELECT count(*) AS n_test, round(sqrt(avg((log_value - prediction) * (log_value - prediction))), 6) AS rmse FROM routed")
def regression_tree_error(spark, d):
    scored = _number_tree(spark, d)[1]
    error = learning.rmse(scored, "log_value").scalar()
    return scored.agg(F.count(F.lit(1)).alias("n_test")).select("n_test", F.round(error, 6).alias("rmse"))
