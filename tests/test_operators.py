"""Operators on small frames: skew, edges, brute force and invariants."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textpulse.operators import embeddings, factors, histogram, joins, lemmas, learning, lsa, profiles, sampling, sentiment, terms
from textpulse.operators.engagement import normalise_in_group
from textpulse.operators.tests_stat import anova, chi_square, chi_square_ml
from textpulse.plans import reports
from textpulse.plans.prepare import prepare
from textpulse.session import local_rows, stage


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- joins and skew ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some have none."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40).cast("int")
    return spark.range(3000).select("id", key.alias("k"), (F.col("id") % 7).alias("v"))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("parts", [1, 3, 100])
def test_join_unique_equals_plain_join(spark, skewed, how, parts):
    side = spark.range(30).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("w"))
    got = joins.join_unique(skewed, side, ["k"], how=how, parts=parts)
    want = skewed.join(side, "k", how)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    pick = ("id", "k", "v", "w")
    assert sorted(map(tuple, got.select(*pick).collect()), key=key) == sorted(map(tuple, want.select(*pick).collect()), key=key)


def test_hot_key_is_split(spark, skewed):
    side = spark.range(30).select(F.col("id").cast("int").alias("k"), F.col("id").alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.join_unique(skewed, side, ["k"], parts=40)
        parts = joined.where("k = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) >= 5 and sum(r["count"] for r in parts) == skewed.where("k = 0").count()


def test_lookup_join_both_ways(spark, skewed):
    side = local_rows(spark, [(i, float(i)) for i in range(30)], "k int, w double")
    assert joins.estimated_bytes(side) < joins.BROADCAST_BYTES
    small = joins.lookup_join(skewed, side, ["k"])
    large = joins.lookup_join(skewed, side, ["k"], max_bytes=0)
    assert rows(small, "id", "w") == rows(large, "id", "w")


def test_normalise_drops_groups_without_total(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 0), ("c", -2), ("c", 1), ("d", None)], "g string, m int")
    got = normalise_in_group(df, "g", "m")
    assert rows(got, "g", "share", "count_class", "share_class") == [("a", 0.25, 1, 3), ("a", 0.75, 2, 4)]


# --- samples -------------------------------------------------------------------------------------


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000)
    a, b = (sampling.bernoulli_sample(df.repartition(n), 0.3, "id", 9) for n in (2, 7))
    assert rows(a, "id") == rows(b, "id")
    assert abs(a.count() - 1500) < 150
    assert rows(sampling.bernoulli_sample(df, 0.3, "id", 10), "id") != rows(a, "id")


def test_split_is_whole_and_independent_of_the_sample(spark):
    df = sampling.bernoulli_sample(spark.range(5000), 0.3, "id", 9)
    train, test = sampling.random_split(df, "id", 9)
    assert train.count() + test.count() == df.count() and train.join(test, "id").count() == 0
    assert abs(train.count() / df.count() - 0.7) < 0.05


def test_sample_by_group_keeps_whole_groups(spark):
    df = spark.range(4000).select("id", (F.col("id") % 200).alias("g"), (F.col("id") % 400 == 0).alias("flag"))
    got = sampling.sample_by_group(df, "g", F.col("flag"), 1.0, 0.25, 2)
    sizes = {r["g"]: r["count"] for r in got.groupBy("g").count().collect()}
    assert set(sizes.values()) == {20} and 0 in sizes and 30 < len(sizes) < 75


def test_rebalance_reads_null_as_unset(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, f boolean")
    assert rows(sampling.rebalance(df, F.col("f"), 0.0, "id", 1), "id") == [(1,)]
    assert rows(sampling.rebalance(df, F.col("f"), 1.0, "id", 1), "id") == [(1,), (2,), (3,)]


# --- profiles ------------------------------------------------------------------------------------


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.lognormal(3, 2, 3000), np.repeat([1.0, 2.0, 2.0, 9.0], 750)
    df = local_rows(spark, [(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    probs = (0.01, 0.25, 0.5, 0.75, 1.0)
    got = {(r["column"], r["prob"]): r["quantile"] for r in profiles.exact_quantiles(df, ["a", "b"], probs).collect()}
    for name, data in (("a", a), ("b", b)):
        for p in probs:
            assert math.isclose(got[name, p], np.quantile(data, p), rel_tol=1e-12)


def test_exact_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "a double")
    assert [r["quantile"] for r in profiles.exact_quantiles(df, ["a"], (0.5,)).collect()] == [2.0]


def test_object_describe_ties_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "t string")
    assert rows(profiles.object_describe(df, ["t"]), "n", "n_unique", "top", "freq") == [(4, 2, "a", 2)]


def test_box_plot_outliers(spark):
    df = local_rows(spark, [(float(x),) for x in [1, 2, 3, 4, 5, 100]], "v double")
    row = profiles.box_plot(df, "v").first()
    assert (row["q25"], row["q50"], row["q75"]) == (2.25, 3.5, 4.75)
    assert (row["lower_whisker"], row["upper_whisker"], row["n_outliers"]) == (1.0, 5.0, 1)


def test_histogram_edges(spark):
    df = local_rows(spark, [(float(x),) for x in [0, 1, 2, 10, 10]], "v double")
    got = rows(histogram.equal_width_histogram(df, "v", 5), "bin", "edge", "n")
    assert got == [(1, 0.0, 2), (2, 2.0, 1), (3, 4.0, 0), (4, 6.0, 0), (5, 8.0, 2)]
    same = local_rows(spark, [(7.0,), (7.0,)], "v double")
    assert rows(histogram.equal_width_histogram(same, "v", 5), "bin", "edge", "n") == [(1, 7.0, 2)]
    empty = spark.createDataFrame([], "v double")
    assert histogram.equal_width_histogram(empty, "v", 5).count() == 0


def test_histogram_equals_rdd_histogram(spark, small):
    df = spark.read.parquet(f"{small}/events.parquet").select("value")
    edges, counts = df.rdd.map(lambda r: r[0]).histogram(20)
    got = rows(histogram.equal_width_histogram(df, "value", 20), "bin", "edge", "n")
    assert [n for _, _, n in got] == counts
    assert np.allclose([e for _, e, _ in got], edges[:-1])


# --- tests ---------------------------------------------------------------------------------------


def test_anova_by_hand(spark):
    data = [("a", 6.0), ("a", 8.0), ("a", 4.0), ("b", 8.0), ("b", 12.0), ("b", 9.0), ("c", 13.0), ("c", 9.0), ("c", 11.0)]
    row = anova(local_rows(spark, data, "c string, v double"), "c", "v").first()
    groups = [np.array([v for c, v in data if c == g]) for g in "abc"]
    mean = np.mean([v for _, v in data])
    ssb = sum(len(g) * (g.mean() - mean) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    f = (ssb / 2) / (ssw / 6)
    assert (row["dfb"], row["dfw"]) == (2, 6.0) and math.isclose(row["f_value"], f)
    assert math.isclose(row["eta_sq"], ssb / (ssb + ssw))
    assert math.isclose(row["omega_sq"], (ssb - 2 * ssw / 6) / (ssb + ssw + ssw / 6))
    # With two degrees of freedom between, the tail is (1 + 2 f / dfw) ^ (-dfw / 2).
    assert math.isclose(row["p_value"], (1 + 2 * f / 6) ** -3)


@pytest.mark.parametrize("data", [[("a", 1.0), ("a", 2.0)], [("a", 1.0), ("b", 1.0)]])
def test_anova_without_ratio(spark, data):
    row = anova(local_rows(spark, data, "c string, v double"), "c", "v").first()
    assert row["f_value"] is None and row["p_value"] is None


def test_anova_leaves_out_nulls(spark):
    data = [("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 6.0)]
    clean = anova(local_rows(spark, data, "c string, v double"), "c", "v").first()
    dirty = spark.createDataFrame([*data, (None, 9.0), ("a", None)], "c string, v double")
    assert anova(dirty, "c", "v").first() == clean


def test_chi_square_equals_estimator(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet").select(
        F.col("l_linenumber").alias("a"), F.floor(F.col("l_quantity") / 20).alias("b"), "l_returnflag"
    )
    ours = {r["feature"]: r for r in chi_square(df, ["a", "b"], "l_returnflag").collect()}
    for r in chi_square_ml(df, ["a", "b"], "l_returnflag").collect():
        mine = ours["ab"[r["featureIndex"]]]
        assert math.isclose(mine["statistic"], r["statistic"], rel_tol=1e-9)
        assert mine["dof"] == r["degreesOfFreedom"] and math.isclose(mine["p_value"], r["pValue"], abs_tol=1e-9)


def test_chi_square_of_the_label_itself_is_n(spark):
    df = local_rows(spark, [("a", "a")] * 3 + [("b", "b")] * 5, "f string, l string")
    row = chi_square(df, ["f"], "l").first()
    assert math.isclose(row["statistic"], 8.0) and row["dof"] == 1


def test_wide_forms(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, "y", None)], "id int, a string, b string")
    vectors = factors.disjunctive_vectors(df, ["a", "b"]).select("id", vector_to_array("indicator").alias("v"))
    # a: x, y; b: null, p.
    assert rows(vectors, "id", "v") == [(1, [1.0, 0.0, 0.0, 1.0]), (2, [0.0, 1.0, 1.0, 0.0])]
    assert factors.burt_matrix(df, ["a"], names=["A.x"]).columns == ["row_label", "A.x"]


# --- tokens and terms ----------------------------------------------------------------------------


def test_lemma_table_keeps_order_and_repeats(spark):
    df = spark.createDataFrame([(1, "Mice ran and mice Ran"), (2, "")], "id int, text string")
    table = local_rows(spark, [("mice", "mouse"), ("ran", "run")], "word string, replacement string")
    got = dict(rows(lemmas.text_lemmas(df, "id", "text", ["and"], lemmas=table), "id", "tokens"))
    assert got == {1: ["mice", "run", "mouse", "ran"], 2: []}


def test_stemmed_words(spark):
    df = spark.createDataFrame([(1, "The cats and the running dogs")], "id int, text string")
    assert lemmas.stemmed_words(df, "id", "text", ["the", "and"]).first()["tokens"] == ["the", "cat", "run", "dog"]


def test_sentiment_profile_by_hand(spark):
    df = spark.createDataFrame(
        [(1, "good day. bad day! a day? very good good"), (2, "..."), (3, None)], "id int, text string"
    )
    table = local_rows(spark, [("good", 1.0), ("bad", -1.0)], "word string, score double")
    got = rows(sentiment.sentiment_profile(df, "id", "text", table), "id", "positive", "negative", "neutral")
    assert got == [(1, 0.5, 0.25, 0.25), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)]
    strong = rows(sentiment.sentiment_profile(df, "id", "text", table, strong=2.0), "id", "positive", "negative", "neutral")
    assert strong[0] == (1, 1 / 3, 1 / 3, 1 / 3)


DOCS = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, ["b", "zz"]), (4, [])]


def test_term_document_vectors_equal_postings(spark):
    df = spark.createDataFrame(DOCS, "id int, tokens array<string>")
    vectors, table = terms.term_document_vectors(df, "tokens", num_terms=3)
    names = {r["term_id"]: r["term"] for r in table.collect()}
    assert sorted(names.values()) == ["a", "b", "c"]
    dense = {}
    for r in vectors.select("id", vector_to_array("features").alias("v")).collect():
        dense.update({(r["id"], names[i]): x for i, x in enumerate(r["v"]) if x})
    postings = {(r["id"], r["term"]): r["weight"] for r in terms.term_document_matrix(df, "id", "tokens", 3).collect() if r["weight"]}
    assert dense.keys() == postings.keys() and all(math.isclose(dense[k], postings[k]) for k in dense)
    # zz is no top term but counts in the length; N counts the empty document.
    assert math.isclose(postings[3, "b"], 1 / 2 * math.log(4 / 3)) and math.isclose(postings[1, "a"], 2 / 3 * math.log(4))


def test_smoothed_tfidf_and_trim(spark):
    df = spark.createDataFrame(DOCS, "id int, tokens array<string>")
    got = {(r["id"], r["term"]): r["tfidf"] for r in terms.smoothed_tfidf(df, "id", "tokens").collect()}
    assert math.isclose(got[1, "a"], 2 * math.log(5 / 2)) and math.isclose(got[2, "b"], math.log(5 / 4))
    frequencies = terms.document_frequencies(df, "tokens")
    assert rows(terms.trim_terms(frequencies, 2), "term", "df") == [("a", 1), ("c", 1)]
    assert rows(terms.trim_terms(frequencies, 1, keep="most"), "term", "df") == [("b", 3)]


def test_target_summary_tells_quartiles_that_occur(spark, tmp_path):
    from catalog.tables import target_summary

    lines = [(1, i, float(q)) for i, q in enumerate((1, 2, 3, 10))] + [(2, 0, 5.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    told = {r["column"]: (r["q25"], r["q50"], r["q75"]) for r in target_summary(spark, str(tmp_path)).collect()}
    assert told["l_quantity"] == (2.0, 3.0, 5.0) and told["share"] == (0.125, 0.1875, 0.625)
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)] + [(None,)], "v double")
    found = {r["prob"]: r["quantile"] for r in profiles.exact_quantiles(df, ["v"], (0.0, 0.25, 0.5, 0.6, 1.0), linear=False).collect()}
    assert found == {0.0: 1.0, 0.25: 1.0, 0.5: 2.0, 0.6: 3.0, 1.0: 10.0}


def test_text_vectors_by_hand(spark):
    postings = spark.createDataFrame(
        [(1, "a", 1.0), (1, "b", 3.0), (1, "no", 9.0), (2, "no", 1.0), (3, "a", 0.0)], "id int, term string, tfidf double"
    )
    known = local_rows(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<double>")
    got = dict(rows(embeddings.text_vectors(postings, known, "id", 2), "id", "vector"))
    assert got == {1: [0.25, 0.75], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_text_vectors_in_waves(spark):
    """The same vectors from waves as at once, with null and repeated ids, null tokens, empty lists and words without a vector."""
    rows = [(i % 37, [f"w{j % 11}" for j in range(i % 7)] + ([None] if i % 5 == 0 else [])) for i in range(60)]
    rows += [(None, ["w1", "w2"]), (100, None), (101, []), (102, ["none"]), (103, ["w1"] * 3)]
    df = stage(spark.createDataFrame(rows, "id long, tokens array<string>"), "test-tokens")
    known = stage(local_rows(spark, [(f"w{j}", [j / 3, -1.0, 2.0]) for j in range(9)], "word string, vector array<double>"), "test-words")
    idf = {t: math.log((len(rows) + 1) / (1 + sum(t in (r[1] or []) for r in rows))) for r in rows for t in r[1] or [] if t}
    once, more = ([r for r in embeddings.tfidf_vectors(df, "id", "tokens", known, 3, waves=n).collect()] for n in (1, 3))
    assert len(once) == len(more) == len(rows)
    for table in (once, more):
        for r in table:
            mine = [t for i, ts in rows if i == r["id"] and i is not None for t in ts or [] if t]
            named = [t for t in mine if t != "none" and int(t[1:]) < 9]
            total = sum(idf[t] for t in named)
            want = [sum(idf[t] * v[k] for t in named for v in [(int(t[1:]) / 3, -1.0, 2.0)]) / total for k in range(3)] if total else [0.0] * 3
            assert np.allclose(r["vector"], want) and math.isclose(r["l1"], sum(idf[t] for t in mine), abs_tol=1e-12)


def test_each_block_has_a_part_of_its_own(spark):
    df = embeddings.in_blocks(spark.range(2000), "id", 12)
    assert df.select(embeddings.BLOCK, F.spark_partition_id().alias("p")).distinct().count() == 12
    assert df.select(F.spark_partition_id()).distinct().count() == 12


def test_sums_of_vectors_stay_in_their_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    lists = [(i, [f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 40)) if x < 60]) for i in range(200)] + [(None, ["w1"]), (7, ["w2", "w2"])]
    df = stage(spark.createDataFrame(lists, "id long, tokens array<string>"), "test-tokens")
    known = stage(local_rows(spark, [(f"w{x}", [float(x), 1.0, -x / 7]) for x in range(0, 60, 2)], "word string, vector array<double>"), "test-words")
    plans = []
    monkeypatch.setattr(embeddings, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, name))
    docs, postings = [x for x in lists if x[0] is not None], {}
    for i, tokens in lists:
        for t in tokens:
            postings.setdefault(i, {}).setdefault(t, 0)
            postings[i][t] += 1
    df_of = {t: sum(t in tokens for _, tokens in lists) for t in {t for _, tokens in lists for t in tokens}}
    idf = {t: math.log((len(lists) + 1) / (n + 1)) for t, n in df_of.items()}
    got = {r["id"]: r for r in embeddings.tfidf_vectors(df, "id", "tokens", known, 3).collect()}
    for i, _ in docs:
        w = {t: n * idf[t] for t, n in postings.get(i, {}).items()}
        mine = {t: x for t, x in w.items() if int(t[1:]) % 2 == 0}
        total = sum(mine.values())
        want = [sum(x * v for x, v in zip(mine.values(), c)) / total for c in zip(*[(float(t[1:]), 1.0, -int(t[1:]) / 7) for t in mine])] if total else [0.0] * 3
        assert np.allclose(got[i]["vector"], want) and math.isclose(got[i]["l1"], sum(map(abs, w.values())), abs_tol=1e-12)
    # What is shuffled after the join would be a row per document and part.
    assert len(plans) == 1 and "hashpartitioning(__block" in plans[0] and ", id#" not in "".join(x for x in plans[0].splitlines() if "hashpartitioning" in x)


def test_nearest_word_leaves_the_word_out(spark):
    known = local_rows(spark, [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 0.0])], "word string, vector array<double>")
    assert [r["word"] for r in embeddings.nearest_to_word(known, "a").collect()] == ["b"]
    assert [r["word"] for r in embeddings.nearest(known, "word", embeddings.vector_of(known, "word", "a")).collect()] == ["a", "b"]


def test_word2vec_round_trip(spark, tmp_path):
    from textpulse.sources.tables import load_word_model, save_word_model

    corpus = spark.createDataFrame([(["x", "y", "x", "z", "y", "x"],)] * 20, "tokens array<string>")
    model = embeddings.train_word_vectors(embeddings.training_corpus([corpus]), size=4, min_count=1, seed=3)
    save_word_model(model, str(tmp_path / "m"))
    again = embeddings.word_table(load_word_model(str(tmp_path / "m")))
    assert rows(again, "word", "vector") == rows(embeddings.word_table(model), "word", "vector")


# --- LSA -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    return stage(lemmas.text_lemmas(documents, "doc_id", "text", None), "test-tokens")


def test_svd_invariants(spark, corpus):
    found = lsa.factorise(corpus, "doc_id", "tokens", num_terms=150, k=5)
    s = np.array(found.singular_values)
    u = np.array([r["vector"] for r in found.documents.collect()])
    v = np.array([r["vector"] for r in found.terms.collect()])
    assert (np.diff(s) <= 1e-9).all()
    assert np.abs(u.T @ u - np.eye(5)).max() < 1e-6 and np.abs(v.T @ v - np.eye(5)).max() < 1e-6
    matrix, table = terms.term_document_vectors(corpus, "tokens", 150)
    a = np.array([r["x"] for r in matrix.select(vector_to_array("features").alias("x")).collect()])
    assert np.allclose(np.linalg.svd(a, compute_uv=False)[:5], s)
    assert (v[np.abs(v).argmax(axis=0), range(5)] > 0).all()


def test_lsa_queries(spark, corpus):
    found = lsa.factorise(corpus, "doc_id", "tokens", num_terms=150, k=5)
    us = lsa.scale_columns(found.documents, found.singular_values)
    vs = lsa.normalise_rows(lsa.scale_columns(found.terms, found.singular_values))
    term = found.terms.first()["term"]
    like = lsa.terms_like_term(vs, term).collect()
    assert like[0]["term"] == term and math.isclose(like[0]["score"], 1.0) and len(like) == 10
    single = lsa.docs_for_term(us, found.terms.select("term", "vector"), term).collect()
    several = lsa.docs_for_terms(us, found.terms, [term], 5).collect()
    idf = found.terms.first()["idf"]
    assert all(math.isclose(a["score"] * idf, b["score"], abs_tol=1e-9) for a, b in zip(single, several))
    with pytest.raises(Exception, match="not in the vocabulary"):
        lsa.docs_for_terms(us, found.terms, [term, "no such term"], 5).collect()
    tops = lsa.top_per_concept(found.terms, "term", k=3)
    assert tops.groupBy("concept").count().select("count").distinct().collect()[0][0] == 3


# --- learning ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark, small):
    return spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label")


def test_k_means_cost_is_the_sum_of_distances(spark, points):
    found = learning.k_means(points, 4, 64, "embedding")
    assigned = learning.assign_clusters(points, found.centers, "embedding")
    assert math.isclose(assigned.agg(F.sum("distance")).first()[0], found.cost, rel_tol=1e-6)
    again = learning.k_means(points, 4, 64, "embedding")
    assert math.isclose(found.cost, again.cost)


def test_inertia_curve_starts_at_total(spark, points):
    curve = {r["k"]: r["cost"] for r in learning.inertia_curve(points, 64, "embedding", ks=(1, 2, 8)).collect()}
    x = np.array([r["embedding"] for r in points.select("embedding").collect()])
    assert math.isclose(curve[1], ((x - x.mean(axis=0)) ** 2).sum(), rel_tol=1e-6)
    assert curve[1] > curve[2] > curve[8]


def test_tree_learns_a_rule(spark):
    df = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("x"), F.xxhash64("id").cast("double").alias("noise"))
    df = df.withColumn("y", F.col("x") > 6)
    found = learning.classify_tree(df, ["x", "noise"], "y", "id", seed=4)
    scores = learning.class_scores(found.predictions).first()
    assert scores["accuracy"] == 1.0 and scores["f_measure"] == 1.0
    assert {r["predictedLabel"] for r in found.predictions.select("predictedLabel").distinct().collect()} == {"true", "false"}
    assert found.importances().first()["feature"] == 0 and "If (feature 0" in found.text()
    matrix = {(r["label"], r["prediction"]): r["n"] for r in learning.confusion_matrix(found.predictions).collect()}
    assert set(matrix) == {(0.0, 0.0), (1.0, 1.0)}


def test_regression_tree(spark):
    df = spark.range(1000).select("id", (F.col("id") % 20).cast("double").alias("x")).withColumn("y", F.floor(F.col("x") / 5) * 2.0)
    found = learning.regress_tree(df, ["x"], "y", "id", seed=4)
    assert learning.rmse(found.predictions, "y").first()[0] < 1e-9


# --- composite jobs ------------------------------------------------------------------------------


def test_prepare(spark, small):
    from catalog.common import comments, polarity

    source = comments(spark, small)
    known = local_rows(spark, [("the", [1.0, 0.0]), ("thand", [0.0, 1.0])], "word string, vector array<double>")
    out = prepare(source, known, 2, polarity(spark, small), ["and"], rate_selected=1.0, rate_others=1.0)
    got = out.collect()
    assert len({r["commentID"] for r in got}) == len(got) > 150
    assert {len(r["vector"]) for r in got} == {2} and {len(r["sentiment"]) for r in got} == {3}
    assert all(abs(sum(r["sentiment"]) - 1) < 1e-9 or sum(r["sentiment"]) == 0 for r in got)
    shares = {}
    for r in got:
        shares[r["articleID"]] = shares.get(r["articleID"], 0) + r["share"]
    assert all(math.isclose(x, 1.0) for x in shares.values())
    none = prepare(source, known, 2, polarity(spark, small), ["and"], rate_selected=0.0, rate_others=0.0)
    assert none.count() == 0


def test_reports_have_their_parts(spark, small):
    from catalog.common import articles

    report = reports.article_report(articles(spark, small))
    assert {"count", "describe", "histogram_printPage", "counts_source", "authors", "keyword_number"} <= set(report)
    assert report["histogram_articleWordCount"].agg(F.sum("n")).first()[0] == report["count"].first()["n"]
    assert reports.article_typology(articles(spark, small)).count() > 5


# --- rows and values at the edges ----------------------------------------------------------------


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_a_histogram_refuses_what_has_no_bin(spark, bad):
    df = local_rows(spark, [(1.0,), (bad,), (5.0,)], "v double")
    with pytest.raises(Exception, match="finite"):
        histogram.equal_width_histogram(df, "v").collect()


def test_rows_without_a_key_are_in_one_part(spark):
    df = spark.createDataFrame([(1, False), (2, True), (None, False), (4, False), (None, True)], "k long, f boolean")
    train, test = sampling.random_split(df, "k", 1)
    assert train.count() + test.count() == 5
    assert sampling.rebalance(df, F.col("f"), 1.0, "k", 1).count() == 5


def test_labels_that_only_test_rows_have_are_counted(spark):
    rows = [(k, float(k % 5), "rare" if k == rare else "common") for rare in (None,) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, x double, y string")
    hidden = sampling.random_split(df, "k", 1)[1].first()["k"]
    df = df.withColumn("y", F.when(F.col("k") == hidden, "rare").otherwise(F.col("y")))
    found = learning.classify_tree(df, ["x"], "y", "k", 1)
    assert found.predictions.count() == sampling.random_split(df, "k", 1)[1].count()


def test_a_vocabulary_too_narrow_is_refused(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "tokens array<string>")
    with pytest.raises(ValueError, match="3 terms"):
        terms.fit_tfidf(df, 2)
    assert len(terms.fit_tfidf(df, 3).stages[0].vocabulary) == 3


def test_all_hot_keys_are_split(spark):
    # 200 keys, each with more rows than one of 400 parts.
    df = spark.range(20_000).select("id", (F.col("id") % 200).alias("k"))
    side = spark.range(200).select(F.col("id").alias("k"), F.col("id").alias("w"))
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    joined = joins.join_unique(df, side, ["k"], counts=counts, parts=400)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 20_000 and "__salt" in plan


def test_all_terms_have_a_weight_without_a_top_list(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"])], "id long, tokens array<string>")
    out = terms.smoothed_tfidf(df, "id", "tokens")
    assert out.count() == 4 and "TakeOrdered" not in out._jdf.queryExecution().executedPlan().toString()
