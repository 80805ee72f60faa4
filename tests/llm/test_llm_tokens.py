import io
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textpulse.llm import packing
from textpulse.llm.frames import Writer, read_documents, read_index
from textpulse.llm.store import new_folder
from textpulse.llm.tokens import read_tokens, word_tokenizer, write_tokens
from textpulse.llm.words import WordEncoder

LIBRARY = Tokenizer.from_file(word_tokenizer())
SMALL_MEMORY = WordEncoder(word_tokenizer(), kept=20)
TRICKY = ["", "  ", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x85z\xa0w", "É é ΑΣ ﬁ½ I'LL don’t 12x3", "İ ǅ ßẞ ÷×", "ª º µ", "​a　b", "it's't '", "é ́x"]


def plain(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TRICKY)
def test_words_give_the_ids_of_the_whole_text(text):
    assert SMALL_MEMORY.encode([text])[0].tolist() == plain(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text_is_encoded_as_the_library_does(texts):
    assert [x.tolist() for x in SMALL_MEMORY.encode(texts)] == [plain(t) for t in texts]
    assert len(SMALL_MEMORY) <= 20


def test_frames_open_alone_and_check_themselves():
    out = pa.BufferOutputStream()
    writer = Writer(out, 2, frame_bytes=100)
    docs = [(k if k != 3 else None, np.arange(k * 7, dtype=np.uint32)) for k in range(12)]
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.close()
    body = out.getvalue().to_pybytes()
    got = list(read_documents(pa.BufferReader(body)))
    assert [(d, x.tolist()) for d, x in got] == [(d, x.tolist()) for d, x in docs]
    assert [(d, len(x)) for d, x in read_documents(pa.BufferReader(body), [5, 9])] == [(5, 35), (9, 63)]
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body), read_across_frames=True).read()
    assert whole == b"".join(x.astype("<u2").tobytes() for _, x in docs)
    index = read_index(pa.BufferReader(body))
    assert len(index.sums) > 3
    broken = bytearray(body)
    broken[int(index.starts[2]) - 6] ^= 1
    with pytest.raises(Exception):
        list(read_documents(pa.BufferReader(bytes(broken))))
    assert list(read_documents(pa.BufferReader(bytes(broken)), [11]))


ROWS = [(4, "B b."), (2, None), (9, "word " * 9000), (None, "null id"), (4, "B b."), (4, "another"), (7, "")]


def test_files_hold_every_document_in_order(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, start string")
    folder = new_folder(spark, "test-tokens")
    got = read_tokens(spark, folder, write_tokens(docs, folder, word_tokenizer(), 2, partitions=3)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 4, 4, 4, 7, 9]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = Counter((i, zlib.crc32(np.array([*plain(t or ""), 2], "<u4").tobytes())) for i, t in ROWS)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want


def test_no_documents_no_files(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = new_folder(spark, "test-tokens")
    assert read_tokens(spark, folder, write_tokens(docs, folder, word_tokenizer(), 2)).count() == 0


# --- packing ------------------------------------------------------------------------------------


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_runs_pack_as_one_by_one_best_fit_does(lengths):
    runs, opened = packing.match_runs(dict(Counter(lengths)), 30)
    assert opened == best_fit_decreasing(lengths, 30)
    used = {}
    counts = Counter(lengths)
    starts = {}
    for length, rank, first, offset, per in runs.tolist():
        starts.setdefault(length, []).append((rank, first, offset, per))
    for length, n in counts.items():
        for r in range(n):
            rank, first, offset, per = max(x for x in starts[length] if x[0] <= r)
            used.setdefault(first + (r - rank) // per, []).append((offset + (r - rank) % per * length, length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 30


def test_pieces_cover_documents_without_gaps(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, length int")
    got = packing.pack_documents(docs, capacity=64).toPandas()
    total = sum(len(plain(t or "")) + 1 for _, t in ROWS)
    assert got["length"].sum() == total and got["length"].max() <= 64
    assert got["sequence_id"].nunique() == best_fit_decreasing(got["length"].tolist(), 64)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own["length"].cumsum() - own["length"] == own["offset"]).all() and own["length"].sum() <= 64
    long = got[got["doc_id"] == 9].sort_values("piece")
    assert (long["start"] == long["piece"] * 64).all() and (long["length"][:-1] == 64).all()
    ids = np.array([*plain(ROWS[2][1]), 1], "<u4")
    assert long["ids_crc32"].tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(long["start"], long["length"])]


def test_no_documents_no_sequences(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
