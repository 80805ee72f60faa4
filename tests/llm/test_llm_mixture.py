import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from textpulse.llm import mixing, near
from textpulse.llm.components import components
from textpulse.llm.probmin import WordCodes, jaccard, shingles, sketch, weights, words_of


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=12), st.integers(20, 200))
def test_each_source_is_within_one_block_of_its_weight(amounts, period):
    parts = mixing.whole_parts(dict(zip("abcdefghijkl", amounts)), period)
    assert sum(parts.values()) == period and min(parts.values()) >= 1
    given_ = dict.fromkeys(parts, 0)
    for source, nth, slot, release, deadline in mixing.period_table(parts, period):
        assert release <= slot < deadline and nth == given_[source]
        given_[source] += 1
        for s, a in parts.items():
            assert abs(given_[s] - a / period * (slot + 1)) < 1
    assert given_ == parts


def test_every_row_gets_its_slot(spark):
    draw = random.Random(3)
    rows = [(k, draw.choice(["a", "a", "a", "b", None, "c"]), "t" * draw.randrange(0, 90), "slot") for k in range(900)]
    rows += [(None, "a", None, "x"), (5, "b", "again", "y"), (5, "b", "again", "y"), (901, "c", "long " * 9000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, __block string")
    got = mixing.mix(docs, size=mixing.F.length(mixing.whole("text")), block=500, period=20).toPandas()
    assert len(got) == len(rows)
    slots = got.groupby("__tp_slot")["source"].agg(lambda s: len({x if isinstance(x, str) else None for x in s}))
    assert slots.max() == 1
    assert ((got["__tp_slot"] >= got["__tp_release"]) & (got["__tp_slot"] < got["__tp_deadline"])).all()
    for _, own in got.assign(source=got["source"].fillna("-")).groupby("source"):
        own = own.sort_values("__tp_at")
        size = own["text"].fillna("").str.len().clip(lower=1)
        assert (own["__tp_at"] == size.cumsum() - size).all() and (own["__tp_block"] == own["__tp_at"] // 500).all()
        # A block has one slot, and later blocks later slots.
        assert own["__tp_slot"].is_monotonic_increasing and own.groupby("__tp_block")["__tp_slot"].nunique().max() == 1
    ordered = mixing.mixed_rows(docs)
    assert ordered.columns == docs.columns and ordered.exceptAll(docs).count() == 0 and ordered.count() == len(rows)
    assert mixing.mixed_rows(docs.limit(0)).count() == 0


# --- near duplicates ----------------------------------------------------------------------------


def plain_jaccard(a, b):
    def sets(t):
        w = words_of(t)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    x, y = sets(a or ""), sets(b or "")
    return len(x & y) / len(x | y) if x and y else 0.0


def test_sketches_estimate_the_jaccard():
    draw = np.random.default_rng(6)
    for target in (0.5, 0.8):
        agree = []
        for _ in range(60):
            a = draw.integers(0, 2**63, 200).astype(np.uint64)
            k = int(200 * 2 * target / (1 + target))
            b = np.concatenate([a[:k], draw.integers(0, 2**63, 200 - k).astype(np.uint64)])
            agree.append((sketch(a, np.ones(200), 120) == sketch(b, np.ones(200), 120)).mean())
        assert abs(np.mean(agree) - target) < 0.03


def test_sketches_estimate_the_weighted_jaccard():
    draw = np.random.default_rng(7)
    ids = draw.integers(0, 2**63, 60).astype(np.uint64)
    x, y = draw.uniform(0.2, 5, 50), draw.uniform(0.2, 5, 50)  # over ids 0..49 and 10..59
    xs, ys = np.zeros(60), np.zeros(60)
    xs[:50], ys[10:] = x, y
    both = (xs > 0) & (ys > 0)
    want = sum(1 / np.maximum(xs / xs[i], ys / ys[i]).sum() for i in np.flatnonzero(both))
    got = (sketch(ids[:50], x, 6000) == sketch(ids[10:], y, 6000)).mean()
    assert abs(got - want) < 0.03


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=20), st.lists(st.sampled_from("abc"), max_size=20))
def test_jaccard_is_exact(a, b):
    codes = WordCodes()
    left, right = (shingles(x, codes)[0] if x else np.zeros(0, np.uint64) for x in (a, b))
    assert jaccard(left, right) == pytest.approx(plain_jaccard(" ".join(a), " ".join(b)))


def test_repeated_shingles_weigh_more():
    assert weights(np.array([1, 3])).tolist() == [1, 1 + np.log(3)]


def corpus():
    draw = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for family in range(6):
        base = [draw.choice(words) for _ in range(120)]
        docs.append(" ".join(base))
        for copy in range(12 if family else 60):
            edited = list(base)
            for _ in range(draw.randrange(0, 8)):
                edited[draw.randrange(len(edited))] = draw.choice(words)
            docs.append(" ".join(edited))
    docs += [" ".join(draw.choice(words) for _ in range(80)) for _ in range(60)]
    docs += ["", None, "...", "Two words", "two, WORDS!", "one two three four five", "w1 " * 30_000]
    return docs


def brute_classes(texts):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if plain_jaccard(texts[a], texts[b]) >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_classes_equal_brute_force(spark, texts):
    want = brute_classes(texts)
    docs = spark.createDataFrame([(k, t, 1, b"n") for k, t in enumerate(texts)], "doc_id long, text string, class_id int, node binary")
    got = near.near_classes(docs).toPandas().sort_values("doc_id")
    assert got["class_id"].tolist() == want
    sizes = [want.count(c) for c in want]
    assert got["class_size"].tolist() == sizes and (got["kept"] == (got["class_id"] == got["doc_id"])).all()
    kept = near.distinct_classes(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_nodes_that_no_star_links_are_compared_by_sketches(spark, texts, monkeypatch):
    monkeypatch.setattr(near, "ASK_BLOCK", 3)
    monkeypatch.setattr(near, "HELD_BLOCK", 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near.near_classes(docs).toPandas().sort_values("doc_id")
    assert got["class_id"].tolist() == brute_classes(texts)


def edited(draw, words, base, edits):
    out = list(base)
    for k in draw.sample(range(len(base) // 5), edits):
        out[5 * k + 2] = draw.choice(words)
    return out


def bridged(draw, words, copies=20):
    """Light copies of A and of C, which only the path A - X - Y - C joins."""
    a = [draw.choice(words) for _ in range(200)]
    x = edited(draw, words, a, 4)
    y = edited(draw, words, x, 4)
    c = edited(draw, words, y, 4)
    return [a, x, y, c, *(edited(draw, words, base, 1) for base in (a, c) for _ in range(copies))]


def edit_tree(draw, words, n=250):
    """Each text is an edit of any earlier one."""
    out = [[draw.choice(words) for _ in range(200)]]
    while len(out) < n:
        out.append(edited(draw, words, draw.choice(out), 4))
    return out


def set_classes(texts):
    """As brute_classes, over sets made once."""
    sets, root = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(texts))]


def test_linked_nodes_of_other_components_are_compared(spark):
    draw, words = random.Random(23), [f"w{k}" for k in range(5000)]
    families = [bridged(draw, words) for _ in range(25)] + [edit_tree(draw, words) for _ in range(2)]
    texts = list(itertools.chain(*families))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = near.near_classes(docs).toPandas().sort_values("doc_id")
    assert got["class_id"].tolist() == set_classes(texts)


def test_repeats_of_what_differs_do_not_part_a_pair(spark):
    draw, words = random.Random(29), [f"w{k}" for k in range(5000)]
    texts = []
    for own in range(12):
        shared = [draw.choice(words) for _ in range(320)]
        # A repeated line: as many shingles as words, and four at its beginning.
        texts += [shared + [f"{side}{own}x{k}" for k in range(28)] * 60 for side in "ab"]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = near.near_classes(docs).toPandas().sort_values("doc_id")
    assert got["class_id"].tolist() == set_classes(texts) == [k - k % 2 for k in range(24)]


def test_odd_rows(spark):
    rows = [(None, "a b c d e f g"), (4, "a b c d e f g!"), (4, "A b c d e f g"), (4, "A b c d e f g"), (None, None), (None, "alone here")]
    got = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.class_id, r.class_size) for r in got if r.class_size > 1) == [("4", 4, 4)] * 3 + [("None", 4, 4)]
    assert near.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_follow_long_paths(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


# --- pipeline -----------------------------------------------------------------------------------


def test_stages_keep_the_columns_and_do_their_work(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("digest", near.F.lit(1)).withColumn("score", near.F.lit("s"))
    seen = {"documents": docs.toPandas()}
    for name, step in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(step(spark, docs, small), name)
        if name != "packing":
            assert out.columns == docs.columns
        docs, seen[name] = out, out.toPandas()
    before, after = seen["toxicity"], seen["exact_dedup"]
    normal = before["text"].str.replace(r"[\x20\x09-\x0D]+", " ", regex=True)
    assert sorted(after["doc_id"]) == sorted(before.groupby(normal)["doc_id"].min())
    want = brute_classes(after.sort_values("doc_id")["text"].tolist())
    ids = sorted(after["doc_id"])
    assert sorted(seen["near_dedup"]["doc_id"]) == sorted(ids[k] for k in set(want))
    assert sorted(seen["mixing"]["doc_id"]) == sorted(seen["near_dedup"]["doc_id"])
    assert set(seen["packing"]["doc_id"]) == set(seen["mixing"]["doc_id"])


def test_mixing_orders_the_sequences(spark):
    draw = random.Random(31)
    rows = [(k, draw.choice("aaab"), " ".join(draw.choice(["one", "two", "three"]) for _ in range(draw.randrange(2000, 4000)))) for k in range(120)]
    docs = corpus_pipeline.stage(spark.createDataFrame(rows, "doc_id long, source string, text string"), "unmixed")
    mixed = corpus_pipeline.stage(corpus_pipeline.mixing(spark, docs, ""), "mixed-rows")
    got = {n: corpus_pipeline.packing(spark, d, "").toPandas() for n, d in (("without", docs), ("with", mixed))}
    order = [r.doc_id for r in mixing.mix(docs, size=mixing.F.length("text")).orderBy("__tp_slot", "__tp_at").collect()]
    firsts = got["with"].query("offset == 0").sort_values("sequence_id")
    assert firsts["sequence_id"].tolist() == list(range(len(firsts))) and sorted(got["with"]["doc_id"]) == sorted(got["without"]["doc_id"])
    assert (places := [order.index(d) for d in firsts["doc_id"]]) == sorted(places)
    assert not got["with"].sort_values("doc_id")["sequence_id"].tolist() == got["without"].sort_values("doc_id")["sequence_id"].tolist()


def test_stages_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, small), name)
        assert docs.count() == 0
