import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from textpulse.llm import machine, quality, rules, toxicity
from textpulse.llm.segments import fit_extremes, maximal_segments

MEDIUM = "/root/testdata/sf0.1"


def best_in(scores, low, high):
    """Ruzzo and Tompa's definition, by recursion: the best segment, the shortest and first of equals, then both sides."""
    found = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=None)
    if found is None or found[0] <= 0:
        return []
    _, _, _, a, b = found
    return best_in(scores, low, a) + [(a, b, found[0])] + best_in(scores, b, high)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-40, 40), max_size=12).map(lambda x: [v + 0.01 * k for k, v in enumerate(x)]))
def test_segments_are_those_of_the_definition(scores):
    got = maximal_segments(np.array(scores, float))
    want = best_in(scores, 0, len(scores))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_extreme_values_are_fitted():
    draw = np.random.default_rng(2)
    n = draw.integers(50, 500, 20_000)
    x = (np.log(n * 0.05) - np.log(-np.log(draw.random(20_000)))) / 1.7
    scale, log_k = fit_extremes(x[x > 0], n[x > 0])
    assert abs(scale - 1.7) < 0.1 and abs(log_k - np.log(0.05)) < 0.3


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas()


def held(labels):
    return labels[[zlib.crc32(str(i).encode()) % 4 == 2 for i in labels["doc_id"]]]


def test_toxic_documents_that_were_held_out_are_found(spark, labels):
    got = toxicity.op9_toxicity(spark, MEDIUM).toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    both = held(labels).merge(got, on="doc_id")
    assert both["held_out"].all() and got["held_out"].sum() > len(both)
    assert both[both["toxic"] == 1]["predicted"].mean() > 0.9 and both[both["toxic"] == 0]["predicted"].mean() < 0.03


def test_quality_of_documents_that_were_held_out(spark, labels):
    got = quality.op7_quality(spark, MEDIUM).toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    both = held(labels).merge(got, on="doc_id")
    good, bad = both[both["quality"] == 1], both[both["quality"] == 0]
    assert good["predicted"].mean() > 0.98 and bad["predicted"].mean() < 0.1
    assert (good["score"].to_numpy()[:, None] > bad["score"].to_numpy()[None, :]).mean() > 0.98


ODD = [
    (1, "you are such trash and scum " * 4, "en", 7), (2, None, None, None), (3, "", "x", 0), (1, "you are such trash and scum " * 4, "en", 7),
    (None, "plain words about plain things", None, 3), (5, "word " * 60_000, "en", 1),
]
ODD_SCHEMA = "doc_id long, text string, score string, n_chars long"


def labelled(spark, n=400):
    rows = [(k, ("you idiot scum trash " if k % 5 == 0 else "calm words of ") + f"day number {k} " * 20, "", 5) for k in range(n)]
    marks = [(k, int(k % 3 > 0), int(k % 5 == 0)) for k in range(n)]
    return spark.createDataFrame(rows, ODD_SCHEMA), spark.createDataFrame([*marks, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_passages_of_odd_rows(spark):
    docs, marks = labelled(spark)
    model = toxicity.fit(docs, marks)
    odd = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = toxicity.score_texts(odd.drop("score"), model).collect()
    assert len(got) == len(ODD)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1] >= 0.3 > max(scores[k] for k in (2, 3, None, 5)) and scores[2] == scores[3]
    first = next(r for r in got if r.doc_id == 1)
    assert "trash" in first.text[first.passages[0].start : first.passages[0].end]
    kept = toxicity.drop_toxic(odd, marks.limit(0))
    assert kept.count() == len(ODD)
    kept = toxicity.drop_toxic(odd.unionByName(docs), marks)
    assert kept.columns == odd.columns and kept.filter("text LIKE '%trash%'").count() == 0 and kept.filter("doc_id = 5").count() >= 1
    assert toxicity.score_texts(odd.limit(0).drop("score"), model).count() == 0


def test_quality_of_odd_rows(spark):
    docs, marks = labelled(spark)
    model = quality.fit(docs, marks)
    odd = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = quality.score_texts(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.fit(docs, marks.limit(0)) == 0.5 and quality.score_texts(odd, 0.5).count() == len(ODD)
    assert quality.score_texts(odd.limit(0), model).count() == 0


def test_the_machine_sums_all_pairs():
    draw = np.random.default_rng(1)
    m = machine.Machine(0.3, draw.normal(size=9), draw.normal(size=(9, 4)))
    rows = machine.pack([(np.array([1, 4, 7]), np.array([0.5, 2, -1])), (np.array([8]), np.array([3.0]))])
    for k, got in enumerate(m.raw(rows)):
        i, x = rows.index[rows.start[k] : rows.start[k + 1]], rows.value[rows.start[k] : rows.start[k + 1]]
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(got, 0.3 + m.linear[i] @ x + pairs)


def test_the_machine_learns_an_interaction():
    draw = np.random.default_rng(4)
    bits = draw.integers(0, 2, (3000, 2)) * 2 - 1
    rows = machine.pack([(np.array([0, 1]), b.astype(float)) for b in bits])
    label = (bits[:, 0] == bits[:, 1]).astype(float)
    raw = machine.train(rows, label, 2, rank=2, epochs=20).raw(rows)
    assert ((raw > 0) == (label > 0)).mean() > 0.99


# --- rules --------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in (k, k + 1, k + 2)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again)


TEXTS = [
    None, "", " \t\n", "one", "a b c", "a b c a b c", "a b c\na b c\n\nx\nx \nx", "é ü\x0bß\x1cz # <b>", "x " * 70, "no-break\xa0space here",
    " ".join(f"w{k}" for k in range(60)), "LOUD " + " ".join(f"WORD{k}!!" for k in range(60)), "a b a b a b a",
    " ".join(f"w{k % 50}" for k in range(300)),
]


def test_base_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "one", "x", 1)], "doc_id long, text string, body string, n_words int")
    got = rules.verdicts(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = base("one" if r.doc_id is None else TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    verdict = {r.doc_id: r.kept for r in got}
    assert verdict[10] and not verdict[11]


def test_order_of_rules_moves_no_verdict(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = rules.verdicts(docs, rules.rules()).select("doc_id", "kept")
    b = rules.verdicts(docs, rules.rules()[::-1]).select("doc_id", "kept")
    assert a.exceptAll(b).count() == 0
    assert rules.verdicts(docs.limit(0)).count() == 0


def test_rules_run_no_python(spark, small):
    plan = entry.queries()["op10_quality_rules"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
