import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textpulse.llm import periods


def brute(words):
    """All runs (start, length, period) by comparing words at every distance."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(12, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, length, p) for (s, length), p in found.items())


def solved(words):
    words = [w.encode() for w in words]
    rows = [periods.solve([(w, b)], octave) + [0, 0, at, at] for _, octave, at, w, b in periods._tiled([words])]
    rows = periods.stitched(np.concatenate(rows)) if rows else np.zeros((0, 4))
    return sorted((int(s), int(e - s), int(p)) for _, p, s, e in rows)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 3), st.integers(0, 2**32 - 1), st.integers(0, 400), st.integers(0, 6))
def test_runs_of_random_words(letters, seed, n, plants):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, letters * 5 ** (seed % 4), n)
    for _ in range(plants):
        if n:
            a, p, size = rng.integers(0, n), rng.integers(1, n // 2 + 2), rng.integers(1, n + 1)
            for i in range(a + p, min(n, a + size)):
                words[i] = words[i - p]
    words = [str(w) for w in words]
    assert solved(words) == brute(words)


@pytest.mark.parametrize("n", [4095, 9000, 20001])
def test_runs_over_several_tiles(n, monkeypatch):
    monkeypatch.setattr(periods, "TILE_WORDS", 64)
    for p in (1, 3, 7, 30, 65, 500, n // 3):
        words = [f"{i % p}" if i > 50 else f"x{i}" for i in range(n)]
        words[n - 20] = "odd"
        want = [(51, n - 20 - 51, p)] + ([(n - 19, 19, p)] if p <= 9 else [])
        assert solved(words) == want


def test_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    assert solved(list(b)) == brute(list(b)) and len(brute(list(b))) > 100


def test_z_function_is_the_common_beginning():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(0, 2, rng.integers(1, 60))
        last = len(s)
        want = [next((k for k in range(last - i) if s[k] != s[i + k]), last - i) for i in range(1, last)]
        assert periods.z_function(s, 1, last).tolist() == want


TEXTS = [
    None, "", " \n ", "one two", "a " * 40, "la di da " * 9 + "end", "\x1c x\x85 " * 20, "so it is\nand so on\n" * 4000,
    " ".join(str(k) for k in range(300)), "a b c d e f g h i j k l " * 2, "é é é é é é é é é é é é",
]


def collapse(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_rows_with_runs(spark):
    rows = [(k % 7 if k else None, t, "x") for k, t in enumerate([*TEXTS, *TEXTS])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.find_runs(docs).collect()), key=str)
    want = []
    for k, t, _ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute(words) if len(words) < 1000 else [(0, len(words), 6)]
        want.append((k, len(words), runs, collapse(words, runs)))
    assert got == sorted(want, key=str)
    assert periods.find_runs(docs.limit(0)).count() == 0
    hashed = periods.find_runs(docs, digest=True).select("collapsed").collect()
    assert sorted(r[0] for r in hashed) == sorted(hashlib.sha256(x[3].encode()).hexdigest() for x in want)


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    docs = []
    for k in range(400):
        n = int(rng.integers(0, 120))
        text = " ".join(str(x) for x in rng.integers(0, 40, n)) if k % 9 else None
        docs.append((k if k != 5 else None, text))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = periods.op11_periodic_runs(spark, str(tmp_path))
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc, text in docs:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in sorted(runs, key=lambda r: (r[0], r[2])))
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(words, runs).encode()).hexdigest())
        assert got[doc] == want
    assert planted > 20
