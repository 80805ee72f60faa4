import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textpulse.llm import align

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
MEMORY = align.Aligner(*PATHS)
SMALL = align.Aligner(*PATHS, kept=15)


def byte_of(c):
    """The byte of a byte-level letter: those that print stand for themselves, the others are counted from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD) and not 0x7F <= b <= 0xA0]
    other = [b for b in range(256) if b not in own]
    return ord(c) if ord(c) < 256 else other[ord(c) - 256]


def brute(text):
    """(A ids, B ids, groups, links) byte by byte, from the whole text."""
    if not text:
        return [], [], "", []
    body = b" " + text.encode()
    a = [(i, bytes(map(byte_of, A.id_to_token(i)))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    if any(b"".join(x for _, x in side) != body for side in (a, b)):
        return [], [], "", []
    spans = []
    for side in (a, b):
        at, out = 0, []
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        spans.append(out)
    links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
    cuts = [0, *sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})]
    groups = []
    for low, high in zip(cuts, cuts[1:]):
        groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s < high) for side in spans))
    return [i for i, _ in a], [i for i, _ in b], ";".join(groups), links


def agrees(found, text):
    a, b, groups, links = brute(text)
    got = Counter(divmod(int(c), MEMORY.width) for c in found[4])
    assert found[:4] == (len(a), len(b), groups.count(";") + 1 if groups else 0, groups) and got == Counter(links)


TRICKY = [
    "", " ", "  a", "a ", "a  b", "a \n b", "\n a", "a\n b\tc d", "a  b", "x  y", "\x1c a\x85 b", "▁", "a ▁b", "<|endoftext|> <s></s> <0x0A>", "don't I'LL it's't",
    "é ﬁ ½ 日本 語 👍🏽 x", "a\x00b", "1234567 12 3.5", "      indented\n\n\n   code  ", "İ ǅ ß", "<0x41> <unk>", "é o", "https://a.b/c?d=e&f " * 3, "\r\n \r\n", "Ġa ĠĠ",
]


@pytest.mark.parametrize("text", TRICKY)
def test_tricky_texts(text):
    agrees(MEMORY.align([text])[0], text)
    agrees(SMALL.align([text])[0], text)


@settings(max_examples=250, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(" \n\tab▁é's<", max_size=40)), max_size=5))
def test_any_text(texts):
    for found, text in zip(SMALL.align(texts), texts):
        agrees(found, text)
    assert sorted(SMALL.values()) == list(range(len(SMALL))) and max(SMALL.values(), default=0) < 15 and len(SMALL.groups) == len(SMALL) == len(SMALL.start) - 1 == len(SMALL.counts) // 3


def test_coalesce():
    a, b, i, j = align.coalesce(np.array([1, 3, 2, 4]), np.array([2, 2, 2, 1, 3]))
    assert a.tolist() == [0, 0, 1, 2] and b.tolist() == [0, 0, 1, 2, 2]
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 3), (3, 4)]


DOCS = [
    (1, "The cat sat; the mat is flat.", "x"), (2, None, "y"), (None, "The cat!", "z"), (2, "", "q"), (3, "has ▁ in it", "r"), (4, "The cat sat; the mat is flat.", "s"),
    (5, "word " * 30_000, "t"), (6, "unspaced" * 3000, "u"), (7, "cat cat", "v"),
]


@pytest.mark.parametrize("block_pairs", [align.BLOCK_PAIRS, 7])
def test_rows(spark, block_pairs):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, groups string").repartition(4)
    kept = align.stage(align.align_tokens(docs, *PATHS), "test-aligned")
    counts = align.pair_counts(kept, MEMORY.width)
    got = [tuple(r) for r in align.score_links(kept, counts, block_pairs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect()]
    whole = [(doc, brute(text) if doc not in (5, 6) else None, text) for doc, text, _ in DOCS]
    # Long texts are aligned by the memory here: the tests above hold it against whole texts.
    parts = []
    for doc, found, text in whole:
        if found is None:
            n_a, n_b, n, groups, codes = MEMORY.align([text])[0]
            parts.append((doc, n_a, n_b, n, groups, [divmod(int(c), MEMORY.width) for c in codes]))
        else:
            a, b, groups, links = found
            parts.append((doc, len(a), len(b), groups.count(";") + 1 if groups else 0, groups, links))
    held = Counter(pair for p in parts for pair in set(p[5]))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    want = [(doc, n_a, n_b, n, len(links), groups, sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links)) for doc, n_a, n_b, n, groups, links in parts]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {((r.a, r.b), r.n) for r in counts.collect()} == set(held.items())
    none = align.align_tokens(docs.limit(0), *PATHS)
    assert align.score_links(none, align.pair_counts(none, MEMORY.width)).count() == 0


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(DOCS[:4], "doc_id long, text string, groups string").write.parquet(f"{tmp_path}/documents.parquet")
    out = align.op13_token_alignment(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got.count((2, 0, 0, 0, 0, 0, 0, "")) == 2
    assert hashlib.sha256(brute("The cat!")[2].encode()).hexdigest() in {r[-1] for r in got}
