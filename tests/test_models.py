"""Models as tables: factors, clusters, trees, polarities, sketches, numbers, against NumPy and brute force."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textpulse.operators import cooccurrence, embeddings, factors, learning, numbering, paircells, sentiment, sketches, skipgram, sparse, subspace, terms, trees
from textpulse.session import FREE_SHUFFLES, discard, local_rows, scratch_path, stage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- factors ------------------------------------------------------------------------------------


def matrix_rows(spark, a):
    rows = [(f"r{i}", f"c{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    return stage(spark.createDataFrame(rows, "r string, c string, weight double"), "test-postings")


def test_svd_is_that_of_the_matrix(spark):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((40, 25)) < 0.3, rng.random((40, 25)), 0) + np.outer(np.arange(40) % 3 == 0, np.arange(25) % 2) * 0.8
    u, s, v = subspace.truncated_svd(matrix_rows(spark, a), "r", "c", 3, rounds=8, oversample=10)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False)[:3], rtol=1e-4)
    left = {r["r"]: r["vector"] for r in u.collect()}
    right = {r["c"]: r["vector"] for r in v.collect()}
    lm, rm = np.array([left[f"r{i}"] for i in range(40)]), np.array([right[f"c{j}"] for j in range(25)])
    assert np.abs(lm.T @ lm - np.eye(3)).max() < 1e-8 and np.abs(rm.T @ rm - np.eye(3)).max() < 1e-8
    assert np.allclose(a @ rm, lm * s, atol=1e-8) and (rm[np.abs(rm).argmax(0), range(3)] > 0).all()


def test_svd_of_low_rank_has_no_more_directions(spark):
    a = np.outer([1.0, 2.0, 3.0], [1.0, 0.0, 2.0, 1.0])
    u, s, v = subspace.truncated_svd(matrix_rows(spark, a), "r", "c", 3)
    assert len(s) == 1 and math.isclose(s[0], np.linalg.norm(a), rel_tol=1e-9)
    assert {len(r["vector"]) for r in u.collect()} == {1} and v.count() == 3


def test_few_columns_give_the_same_without_shuffled_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a = np.where(rng.random((50, 20)) < 0.4, rng.random((50, 20)), 0)
    rows = matrix_rows(spark, a)
    u, s, v = subspace.truncated_svd(rows, "r", "c", 3, max_held=0)
    wanted = [{x[0]: x[1] for x in f.collect()} for f in (u, v)]
    # A round that shuffles the rows goes through ``times``.
    monkeypatch.setattr(subspace, "times", None)
    u, found, v = subspace.truncated_svd(rows, "r", "c", 3)
    assert np.allclose(found, s, rtol=1e-9)
    for want, f in zip(wanted, (u, v)):
        got = {x[0]: x[1] for x in f.collect()}
        assert set(got) == set(want) and all(np.allclose(got[x], want[x], atol=1e-7) for x in want)


def test_all_terms_are_factors_without_a_limit(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, ["c", "d", "a"]), (4, [])], "id long, tokens array<string>")
    found = subspace.factorise_postings(docs, "id", "tokens", num_terms=None, k=2)
    assert {r["term"] for r in found.terms.collect()} == set("abcd")
    assert {r["id"]: r["vector"] for r in found.documents.collect()}[4] == [0.0, 0.0]


# --- clusters -----------------------------------------------------------------------------------


def test_lloyd_is_lloyd(spark):
    x = np.random.default_rng(4).random((60, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    start = learning.start_rows(df, "id", 4)
    assert len(start) == 4 and start == learning.start_rows(df.repartition(5), "id", 4)
    got = {(r["model"], r["cluster"]): r for r in learning.lloyd(df, {1: start[:1], 4: start}, 3, rounds=3).collect()}
    for k in (1, 4):
        c = np.array(start[:k])
        for _ in range(3):
            near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
        near = ((x[:, None] - c) ** 2).sum(2)
        for j in range(k):
            r = got[k, j]
            assert np.allclose(r["vector"], c[j]) and r["n"] == (near.argmin(1) == j).sum()
            assert math.isclose(r["cost"], near[near.argmin(1) == j, j].sum(), abs_tol=1e-9)


def test_a_cluster_without_rows_keeps_its_centre(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, vector array<double>")
    got = {r["cluster"]: (r["vector"], r["n"], r["cost"]) for r in learning.lloyd(df, {2: [[0.4], [9.0]]}, 1, rounds=2).collect()}
    assert got == {0: ([0.5], 2, 0.5), 1: ([9.0], 0, 0.0)}


def test_nearest_of_each_query_in_one_scan(spark, small):
    words = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    queries = words.where("vec_id < 3").select(F.col("vec_id").alias("q"), "vector")
    out = embeddings.nearest_each(words, "vec_id", queries, "q", 4)
    for q in range(3):
        want = [r["vec_id"] for r in embeddings.nearest(words, "vec_id", embeddings.vector_of(words, "vec_id", q), 4).collect()]
        assert [r["vec_id"] for r in out.where(F.col("q") == q).orderBy("rank").collect()] == want
    listed = learning.words_of_centers(queries.select(F.col("q").alias("cluster"), "vector"), words.select(F.col("vec_id").alias("word"), "vector"))
    text = plan(listed)
    # One scan of the words, and one of the queries in a sub-query.
    assert "WindowGroupLimit" in text and text.count("FileScan parquet") == 2


# --- trees --------------------------------------------------------------------------------------


def node_rows(tree):
    return tree.nodes.orderBy("node").collect()


def gini(ys):
    p = sum(ys) / len(ys)
    return 2 * p * (1 - p)


def test_first_split_is_the_best_one(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.integers(0, 40)), float(rng.integers(0, 4)), 0.0) for i in range(150)]
    rows = [(i, a, b, float((a > 17 and b != 2) != (rng.random() < 0.1))) for i, a, b, _ in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    tree = trees.grow_tree(df, ["a", "b"], "y", "id", depth=2, bins=200, max_categories=5)
    root = node_rows(tree)[0]
    ys = [r[3] for r in rows]
    best = 0.0
    for cut in {r[1] for r in rows}:
        left, right = [r[3] for r in rows if r[1] <= cut], [r[3] for r in rows if r[1] > cut]
        if left and right:
            best = max(best, gini(ys) - len(left) / 150 * gini(left) - len(right) / 150 * gini(right))
    for mask in range(1, 15):
        left, right = [r[3] for r in rows if mask >> int(r[2]) & 1], [r[3] for r in rows if not mask >> int(r[2]) & 1]
        best = max(best, gini(ys) - len(left) / 150 * gini(left) - len(right) / 150 * gini(right))
    assert math.isclose(root["gain"], best, abs_tol=1e-8) and root["n"] == 150
    assert dict(tree.bins.select("feature", "kind").collect()) == {0: "number", 1: "category"}
    routed = trees.route(df, tree.nodes, ["a", "b"], 2).collect()
    per_leaf = {}
    for r in routed:
        per_leaf.setdefault((r["leaf"], r["prediction"]), []).append(r["y"])
    nodes = {r["node"]: r for r in node_rows(tree)}
    assert all(nodes[leaf]["n"] == len(v) and prediction == float(sum(v) / len(v) > 0.5) for (leaf, prediction), v in per_leaf.items())
    total = trees.importances(tree).agg(F.sum("importance")).first()[0]
    lines = [r["text"] for r in trees.tree_text(tree).orderBy("line").collect()]
    assert math.isclose(total, 1.0) and len(lines) == len(nodes) and lines[0].startswith("if ") and all("predict" in t or "if " in t for t in lines)


def test_numbers_and_edges(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 5.0 if i < 30 else 9.0) for i in range(100)] + [(200, None, 1.0), (201, [1.0, None], 1.0), (202, [1.0, 1.0], None)], "id long, x array<double>, y double")
    tree = trees.grow_tree(df, ["x"], "y", "id", classes=False, depth=3, bins=100, max_categories=2)
    nodes = node_rows(tree)
    assert [(r["node"], r["threshold"], r["prediction"]) for r in nodes] == [(1, 29.0, 7.8), (2, None, 5.0), (3, None, 9.0)]
    assert tree.features == ["x[0]", "x[1]"]
    same = spark.createDataFrame([(i, 3.0, 1.0) for i in range(5)], "id long, x double, y double")
    assert [r["node"] for r in node_rows(trees.grow_tree(same, ["x"], "y", "id"))] == [1]
    with pytest.raises(ValueError, match="no rows"):
        trees.grow_tree(same.limit(0), ["x"], "y", "id")


def test_unknown_categories_go_one_way(spark):
    nodes = local_rows(
        spark,
        [(1, 0, 0, "category", None, [1.0], [1.0, 2.0], True, 9, 0.0, 0.5, 0.5, 2, 3), *((n, 1, None, None, None, None, None, None, 3, float(n), 0.0, None, None, None) for n in (2, 3))],
        trees._NODES,
    )
    df = spark.createDataFrame([(1.0,), (2.0,), (7.0,)], "x double")
    assert [r["leaf"] for r in trees.route(df, nodes, ["x"], 1).orderBy("x").collect()] == [2, 3, 2]


# --- sentiment ----------------------------------------------------------------------------------


def test_polarity_is_learned_and_negated(spark):
    lessons = [("She loves it. He likes the day", True)] * 30 + [("He hates it. She despises the day", False)] * 30 + [("the it day", None)]
    table = sentiment.learn_polarity(spark.createDataFrame(lessons, "text string, good boolean"), "text", "good", prior=10.0)
    scores = {r["word"]: r["score"] for r in table.collect()}
    assert scores["loves"] > 0 > scores["hates"] and "it" not in scores and "day" not in scores
    texts = spark.createDataFrame([(1, "Bob visited the park and likes it a lot. But Jane hates it."), (2, "She never likes it, he loves it"), (3, "He doesn't hates the day")], "id long, text string")
    got = {r["id"]: (r["positive"], r["negative"], r["neutral"]) for r in sentiment.sentiment_profile(texts, "id", "text", table).collect()}
    assert got[1] == (0.5, 0.5, 0.0) and got[2] == (0.0, 0.0, 1.0) and got[3] == (1.0, 0.0, 0.0)


def test_five_classes(spark):
    scores = spark.createDataFrame([(s,) for s in (-2.0, -0.5, 0.05, 0.5, 2.0)], "score double")
    labels = [r["label"] for r in sentiment.sentence_labels(scores, strong=1.0, weak=0.1).orderBy("score").collect()]
    assert labels == ["Very negative", "Negative", "Neutral", "Positive", "Very positive"]


def test_shares_are_checked(spark):
    df = spark.createDataFrame([(["a"], 0.5, 0.25, 0.25)], "tokens array<string>, p double, n double, z double")
    good = sentiment.nlp_parts(df.select(sentiment.nlp_result("tokens", ["p", "n", "z"]).alias("nlp")), "nlp").first()
    assert good["tokens"] == ["a"] and good["sentiments"] == [0.5, 0.25, 0.25]
    with pytest.raises(Exception, match="expected 3 sentiment shares, found 2"):
        sentiment.nlp_parts(df.select(sentiment.nlp_result("tokens", ["p", "n"]).alias("nlp")), "nlp").collect()


# --- numbers, sketches, affine rows, co-occurrence ------------------------------------------------


def test_row_numbers_without_one_task(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("key"))
    out = numbering.row_numbers(df, ["key"])
    assert "SinglePartition" not in plan(out)
    rows = out.orderBy("row_number").collect()
    assert [r["row_number"] for r in rows] == list(range(5000))
    assert [r["key"] for r in rows] == sorted(r["key"] for r in rows)
    again = {r["id"]: r["row_number"] for r in numbering.row_numbers(df.repartition(5), ["key"], partitions=3).collect()}
    assert again == {r["id"]: r["row_number"] for r in rows}
    assert numbering.row_numbers(df.limit(0), ["key"]).count() == 0


def test_merged_sketches_are_those_of_all_rows(spark):
    df = spark.range(40_000).select((F.col("id") % 4).alias("g"), (F.col("id") % 2).alias("h"), F.when(F.col("id") % 50 == 0, None).otherwise(F.rand(3)).alias("x"))
    df = stage(df, "test-values")
    fine = sketches.quantile_sketches(df, ["g", "h"], "x")
    told = sketches.sketch_quantiles(sketches.merge_sketches(fine, ["h"]), ["h"], [0.1, 0.5, 0.9])
    held = sketches.exact_ranks(df, ["h"], "x", told).collect()
    assert len(held) == 6 and all(r["below"] - sketches.rank_error() <= r["prob"] <= r["upto"] + sketches.rank_error() for r in held)
    assert sketches.merge_sketches(fine, []).first()["n"] == df.where("x is not null").count()


def test_affine_rows(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3]) for i in range(11)]
    df = spark.createDataFrame(rows, "id long, p string, q string")
    labels = ["P.a", "P.b", "Q.x", "Q.y", "Q.z"]
    ones = np.array([[f"P.{p}" == c or f"Q.{q}" == c for c in labels] for _, p, q in rows], float)
    z = ones / ones.mean(0) - 1
    found = factors.affine_rows(df, "id", ["p", "q"])
    values = {(r["id"], r["label"]): r["value"] for r in factors.affine_values(found, "id", labels).collect()}
    assert all(math.isclose(values[i, c], z[i, k], abs_tol=1e-12) for i in range(11) for k, c in enumerate(labels))
    products = {r["id"]: r["product"] for r in factors.affine_products(found, "id", 4, 5).collect()}
    assert all(math.isclose(products[i], z[i] @ z[4], abs_tol=1e-9) for i in range(11))
    gram = {(r["row_label"], r["col_label"]): r["value"] for r in factors.normalised_gram(df, ["p", "q"]).collect()}
    assert len(gram) == 25 and all(math.isclose(gram[a, b], (z.T @ z)[i, j], abs_tol=1e-9) for i, a in enumerate(labels) for j, b in enumerate(labels))


def test_cooccurrences_by_hand(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],), (["a"],), ([],), (None,)], "t array<string>")
    got = {(r["word"], r["context"]): r["n"] for r in cooccurrence.cooccurrences(df, "t", 2).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("a", "a"): 2, ("b", "c"): 1, ("c", "b"): 1, ("a", "c"): 1, ("c", "a"): 1}


def test_cooccurrences_are_shuffled_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(cooccurrence, "stage", lambda df, name: plans.append(plan(df)) or stage(df, name))
    df = spark.createDataFrame([(["a", "b", "a", None],)], "t array<string>")
    out = cooccurrence.cooccurrences(df, "t")
    assert "".join([*plans, plan(out)]).count("Exchange hashpartitioning") == 1
    wanted = {("a", "b"): 2, ("b", "a"): 2, ("a", "a"): 2, ("a", None): 2, (None, "a"): 2, ("b", None): 1, (None, "b"): 1}
    assert [(r["word"], r["context"], r["n"]) for r in out.collect() if wanted.pop((r["word"], r["context"])) != r["n"]] == [] and not wanted


def test_planted_synonyms_are_near(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(600):
        topic = k % 3
        words = [f"t{topic}w{rng.integers(0, 6)}" for _ in range(8)]
        words[4] = rng.choice([["big", "large"], ["red", "crimson"], ["quick", "fast"]][topic])
        rows.append(([str(w) for w in words],))
    df = stage(spark.createDataFrame(rows, "t array<string>"), "test-lists")
    vectors, s = cooccurrence.pmi_vectors(cooccurrence.shifted_pmi(cooccurrence.cooccurrences(df, "t"), least=5), 4)
    kept = stage(vectors, "test-vectors")
    assert s == sorted(s, reverse=True)
    for a, b in (("big", "large"), ("red", "crimson"), ("quick", "fast")):
        near = embeddings.nearest(kept, "word", embeddings.vector_of(kept, "word", a), 30).collect()
        similar = {r["word"]: r["similarity"] for r in near}
        assert similar[b] > 0.9 and all(similar.get(o, -1) < 0.5 for o in ("big", "red", "quick") if o != a)


def test_pairs_in_cells_are_those_of_the_rows(spark, monkeypatch):
    """Counts, weights and vectors against brute force, with chunks within a text, several cells, null words and pairs of a word with itself."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)] + ["ä", "\U0001d54f", None]
    lists = [[words[i] for i in (rng.random(rng.integers(0, 40)) ** 2 * len(words)).astype(int)] for _ in range(60)] + [None, [], ["w1", "w1"]]
    counts = {}
    for t in lists:
        for i, x in enumerate(t or []):
            for y in (t[j] for j in range(max(i - 3, 0), min(i + 4, len(t))) if j != i):
                counts[x, y] = counts.get((x, y), 0) + 1
    df = stage(spark.createDataFrame([(t,) for t in lists], "t array<string>").repartition(3), "test-lists")
    monkeypatch.setattr(paircells, "groups_for", lambda pairs, slots: 4)
    monkeypatch.setattr(paircells, "CHUNK", 7)
    pairs = cooccurrence.cooccurrences(df, "t")
    got = pairs.collect()
    assert {(r["word"], r["context"]): r["n"] for r in got} == counts and len(got) == len(counts)
    totals = {w: sum(n for (x, _), n in counts.items() if x == w) for w in words if w is not None}
    least = sorted(totals.values())[10]
    kept = {w for w, n in totals.items() if n >= least}
    met = {p: n for p, n in counts.items() if set(p) <= kept}
    all_n = sum(met.values())
    wanted = {p: math.log(n * all_n / (totals[p[0]] * totals[p[1]])) for p, n in met.items()}
    wanted = {p: x for p, x in wanted.items() if round(x, 12) > 0}
    assert 3 < len(kept) < len(totals) and len(wanted) < len(met)
    by_cells = cooccurrence.shifted_pmi(pairs, least=least)
    by_rows = cooccurrence.shifted_pmi(pairs.select("word", "context", "n"), least=least)
    for weights in (by_cells, by_rows):
        found = {(r["word"], r["context"]): r["weight"] for r in weights.collect()}
        assert found.keys() == wanted.keys() and all(abs(found[p] - x) < 1e-9 for p, x in wanted.items())
    results = [cooccurrence.pmi_vectors(w, 3, max_held=m) for w, m in ((by_cells, 0), (by_rows, 0), (by_cells, 100))]
    tables = [{r["word"]: np.array(r["vector"]) for r in v.collect()} for v, _ in results]
    for (_, s), table in zip(results[1:], tables[1:]):
        assert np.allclose(s, results[0][1]) and table.keys() == tables[0].keys() == {w for w, _ in wanted}
        assert all(np.allclose(table[w], tables[0][w], atol=1e-6) for w in table)


def test_cells_bound_what_a_task_holds():
    assert paircells.groups_for(0, 8) == 2
    for pairs, slots in ((10**6, 8), (6 * 10**8, 12), (4 * 10**9, 12)):
        cells = (g := paircells.groups_for(pairs, slots)) * (g + 1) // 2
        assert pairs / cells <= paircells.CELL_PAIRS and sorted(paircells.place(i, j, g) for i in range(g) for j in range(i, g)) == list(range(cells))


def test_pairs_go_to_the_next_step_in_cells(spark):
    """No table of pairs, weights or vectors by word pair is shuffled once the pairs are counted: only cells and rows by word."""
    df = stage(spark.createDataFrame([(["a", "b", "c", "a"] * 5,)], "t array<string>"), "test-lists")
    weights = cooccurrence.shifted_pmi(cooccurrence.cooccurrences(df, "t"), least=1)
    assert "Exchange" not in plan(weights) and "Join" not in plan(weights)


def test_too_many_words_for_the_driver(spark):
    df = spark.createDataFrame([(["a", "b", "c"] * 5,)], "t array<string>")
    with pytest.raises(ValueError, match="3 words are more than the 2"):
        embeddings.train_word_vectors(df, "t", size=4, max_words=2)


def test_word_vectors_by_blocks(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(3000):
        topic = k % 3
        words = [f"t{topic}w{rng.integers(0, 6)}" for _ in range(12)]
        words[6] = rng.choice([["big", "large"], ["red", "crimson"], ["quick", "fast"]][topic])
        rows.append(([str(w) for w in words],))
    rows += [(["rare", "rare", "t0w1"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "t array<string>")
    one, three = (skipgram.train_by_blocks(df, "t", size=16, blocks=n) for n in (1, 3))
    kept = {"big", "large", "red", "crimson", "quick", "fast", *(f"t{a}w{b}" for a in range(3) for b in range(6))}
    for table in (one, three):
        got = {r["word"]: np.array(r["vector"]) for r in table.collect()}
        assert got.keys() == kept and all(len(v) == 16 and np.isfinite(v).all() for v in got.values())
        unit = {w: v / np.linalg.norm(v) for w, v in got.items()}
        for a, b in (("big", "large"), ("red", "crimson"), ("quick", "fast")):
            assert unit[a] @ unit[b] > 0.8
            assert all(unit[a] @ unit[b] > unit[a] @ unit[o] + 0.3 for o in ("big", "red", "quick") if o != a)
    again = skipgram.train_by_blocks(df, "t", size=16, blocks=3)
    assert sorted(again.collect()) == sorted(three.collect())


def test_word_vectors_of_no_words(spark):
    assert skipgram.train_by_blocks(spark.createDataFrame([(["a", "b"],)], "t array<string>"), "t", size=4).collect() == []


def test_word_vectors_are_trained_in_waves(spark):
    """Waves hold the vectors of their blocks only: nothing that was shuffled and no table but the result is left."""
    rng = np.random.default_rng(6)
    rows = [(i, [f"w{x}" for x in rng.integers(0, 60, rng.integers(0, 30))]) for i in range(400)]
    df = stage(spark.createDataFrame([*rows, (400, None), (401, ["once"])], "i int, t array<string>").repartition(4), "test-texts")
    folder = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(folder))
    got = skipgram.train_by_blocks(df, "t", size=8, blocks=6, waves=3)
    assert len(set(os.listdir(folder)) - before) == 1
    vectors = {r["word"]: r["vector"] for r in got.collect()}
    assert vectors.keys() == {f"w{i}" for i in range(60)} and all(len(v) == 8 and np.isfinite(v).all() for v in vectors.values())
    assert sorted(got.collect()) == sorted(skipgram.train_by_blocks(df, "t", size=8, blocks=6, waves=3).collect())
    assert skipgram._ends([(0, 10, 100), (3, 10, 300)], 2) == [0, (3 << 33) + 3, 1 << 62]


def test_merged_means_are_those_of_all_blocks():
    def batch(block, ids, n, seed):
        vectors = np.random.default_rng(seed).random((len(ids), 3), np.float32)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block, np.int32)), pa.array(ids), pa.array(n), skipgram._vectors(vectors)], ["block", "id", "n", "vector"])

    a, b, c = batch(0, [1, 2], [4, 1], 1), batch(1, [2, 3], [2, 7], 2), batch(2, [1, 2], [1, 5], 3)
    once = pa.Table.from_batches(skipgram._means([a, b, c], 3)).to_pydict()
    twice = pa.Table.from_batches(skipgram._means([c, *skipgram._means([a, b], 3)], 3)).to_pydict()
    assert once["id"] == twice["id"] == [1, 2, 3] and once["n"] == twice["n"] == [5, 8, 7]
    assert np.allclose(once["vector"], twice["vector"], atol=1e-6)


def test_staged_tables_leave_no_shuffle(spark):
    def kept():
        store = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
        blocks = store.getAllBlocks()
        return sum(str(blocks.apply(i)).startswith("shuffle_") for i in range(blocks.size()))

    before = kept()
    out = stage(spark.range(1000).repartition(5, "id"), "test-rows")
    assert kept() <= before and out.count() == 1000
    discard(out)
    assert out.sparkSession.conf.get(FREE_SHUFFLES, None) is None


def test_word_vectors_stay_off_the_driver(spark, small, monkeypatch):
    from catalog import models

    def whole(*_, **__):
        raise AssertionError("a model of all words on the driver")

    monkeypatch.setattr(embeddings, "train_word_vectors", whole)
    out = models.word_vectors_trained(spark, small).collect()
    assert len(out) == models.word_model_saved(spark, small).first()["n_words"] > 0
    assert {(r["dims"], r["finite"]) for r in out} == {(embeddings.VECTOR_SIZE, True)}


def test_sparse_vectors_are_those_of_the_vectoriser(spark):
    rows = [(0, ["a", "b", "a"]), (1, ["b"]), (2, []), (3, ["b", "c", None, "a"]), (4, None), (5, [None]), (6, ["d", "b", "d"])]
    df = stage(spark.createDataFrame(rows, "id long, tokens array<string>"), "test-lists")
    got = {r["id"]: r for r in sparse.sparse_tfidf(df, ["id"]).collect()}
    assert got.keys() == {r[0] for r in rows}
    full = df.select("id", F.coalesce(F.filter("tokens", lambda t: t.isNotNull()), F.array().cast("array<string>")).alias("tokens"))
    model = terms.fit_tfidf(full, 10)
    order = {"b": 0, "a": 1, "c": 2, "d": 3}  # by documents, then by term
    places = [order[w] for w in model.stages[0].vocabulary]
    for r in model.transform(full).collect():
        mine = got[r["id"]]
        for name, vector in (("counts", r["token_count"]), ("tfidf", r["tfidf"])):
            want = {places[i]: v for i, v in zip(vector.indices, vector.values)}
            assert mine["indices"] == sorted(want)
            assert mine[name] == pytest.approx([want[i] for i in mine["indices"]])


def test_count_vectors_need_no_vocabulary_on_the_driver(spark, small, monkeypatch):
    from catalog import models

    def whole(*_, **__):
        raise AssertionError("a vocabulary on the driver")

    monkeypatch.setattr(terms, "fit_tfidf", whole)
    assert models.count_vector_tfidf(spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()
