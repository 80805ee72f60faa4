"""Benchmark decontamination: words of documents that lie in a window of a benchmark item, by Wu-Manber search.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Windows are the
patterns, words their letters. Per pattern length m there is a shift table over blocks of up to three words: a block
that no pattern holds among its first m words lets the search jump m - block + 1 words, any other block the distance of
its last place in a pattern from the pattern's end. At distance 0 the block's bucket is looked up by the first block
of the place, and the words themselves are compared.

The items are a query set: they are cut into blocks of about BLOCK_WORDS words of patterns, which lie as files in the
shared folder; smaller files are put together. A task reads its documents in chunks and goes through the blocks for
each chunk, with one block in memory at a time, so that any number of items can be searched; nothing is broadcast and
no document is shuffled.

Null texts have no words. Items without words have no window and occur nowhere; an item whose id is null hits words but
is not listed. Items repeated with the same id count once, the windows of all their rows are searched. Very long
documents are searched whole, in one task; repeated rows each stand for themselves. Columns besides ids and texts are
not read, so none can clash. Without documents there are no rows, without items no word is hit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import importable, table, whole
from textpulse.llm.store import stored_blocks
from textpulse.session import scratch_path

#: Words of an item that make up a window.
WINDOW = 10
#: Words of patterns searched for at once: some 100 MB of tables in a task.
BLOCK_WORDS = 1 << 21
#: Bytes of documents for which a task goes through the blocks, unless one document has more.
CHUNK_BYTES = 8 << 20

# Fixed value: what is no letter of a word, among single bytes; those of longer characters all are.
_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII digits and letters, in lower case, and of all characters beyond ASCII."""
    return text.translate(_KEEP).split()


class WuManber:
    """Search for patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], int]):
        """patterns: words -> number of the pattern, all of one length."""
        self.size = m = len(next(iter(patterns)))
        self.block = b = min(3, m)
        self.jump = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], int]]]] = {}
        for pattern, number in patterns.items():
            for at in range(m - b + 1):
                key = pattern[at : at + b]
                self.shift[key] = min(self.shift.get(key, self.jump), m - b - at)
            self.buckets.setdefault(pattern[m - b :], {}).setdefault(pattern[:b], []).append((pattern, number))

    def search(self, words: tuple[bytes, ...]) -> Iterator[tuple[int, int]]:
        """(place, number) of every occurrence of a pattern."""
        m, b, n, jump, shift = self.size, self.block, len(words), self.jump, self.shift.get
        end = m
        while end <= n:
            key = words[end - b : end]
            skip = shift(key, jump)
            if skip:
                end += skip
                continue
            first = end - m
            for pattern, number in self.buckets[key].get(words[first : first + b], ()):
                if words[first:end] == pattern:
                    yield first, number
            end += 1


def windows(items: list[bytes], size: int) -> Iterator[tuple[int, tuple[bytes, ...]]]:
    """(row, window) of the items' texts."""
    for row, text in enumerate(items):
        words = tuple(words_of(text))
        if words and len(words) <= size:
            yield row, words
        for at in range(len(words) - size + 1 if len(words) > size else 0):
            yield row, words[at : at + size]


class Block:
    """The patterns of some items, one search per pattern length."""

    def __init__(self, ids: list[str | None], texts: list[bytes], size: int):
        self.items: list[list[str]] = []
        by_size: dict[int, dict[tuple[bytes, ...], int]] = {}
        for row, window in windows(texts, size):
            numbers = by_size.setdefault(len(window), {})
            number = numbers.setdefault(window, len(self.items))
            if number == len(self.items):
                self.items.append([])
            if ids[row] is not None and (not self.items[number] or self.items[number][-1] != ids[row]):
                self.items[number].append(ids[row])
        self.searches = [WuManber(patterns) for patterns in by_size.values()]

    def mark(self, words: tuple[bytes, ...], hit: bytearray, found: set[str]) -> None:
        for search in self.searches:
            for at, number in search.search(words):
                hit[at : at + search.size] = b"\1" * search.size
                found.update(self.items[number])


def _blocks(folder: str, size: int, block_words: int) -> Iterator[Block]:
    def weight(rows: pa.Table) -> int:
        return pc.sum(pc.binary_length(rows.column("body"))).as_py() * size // 2 if rows.num_rows else 0

    def build(rows: pa.Table) -> Block:
        return Block(rows.column("item").to_pylist(), rows.column("body").to_pylist(), size)

    return stored_blocks(folder, ["item", "body"], weight, block_words, build)


def store_items(items: DataFrame, size: int = WINDOW, id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> str:
    """Folder with the items as text (item, body), in files of up to about block_words words of patterns."""
    rows = items.select(F.col(id).cast("string").alias("item"), whole(text).cast("binary").alias("body"))
    # A word has a byte and a separator at least, and a text of n words fewer than n windows.
    words = rows.agg(F.sum(F.octet_length("body")).cast("double") * size / 2).first()[0] or 0
    path = scratch_path(items.sparkSession, "items")
    rows.repartition(max(1, -(-int(words) // block_words)), F.xxhash64("item", "body")).write.parquet(path)
    return path


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[object, bytes]]]:
    held, size = [], 0
    for batch in batches:
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.append((key, body.as_py()))
            size += len(held[-1][1])
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def find_leaks(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", size: int = WINDOW,
    item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per row of docs: id, n_words, hits (the words hit, as [start, end) spans of word numbers) and items, the ids of items
    with a window in it, as sorted strings."""
    importable(docs.sparkSession)
    folder = store_items(items, size, item_id, item_text, block_words)
    rows = docs.select(F.col(id).alias("id"), whole(text).cast("binary").alias("body"))
    kind = dict(rows.dtypes)["id"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type = None

        def typed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for batch in stream:
                key_type = batch.schema.field(0).type
                yield batch

        for chunk in _chunks(typed(batches)):
            texts = [tuple(words_of(body)) for _, body in chunk]
            hits = [bytearray(len(words)) for words in texts]
            found: list[set[str]] = [set() for _ in chunk]
            for block in _blocks(folder, size, block_words):
                for words, hit, names in zip(texts, hits, found):
                    block.mark(words, hit, names)
            spans = []
            for hit in hits:
                edges = np.flatnonzero(np.diff(np.frombuffer(bytes([0]) + bytes(hit) + bytes([0]), np.int8))) if 1 in hit else []
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
            columns = [
                pa.array([key for key, _ in chunk], key_type), pa.array([len(w) for w in texts], pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([sorted(names) for names in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "hits", "items"])

    out = rows.mapInArrow(search, f"id {kind}, n_words long, hits array<struct<start: long, end: long>>, items array<string>")
    return out.withColumnRenamed("id", id)


def op12_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP12_SQL = f"""
WITH item AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS body
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, least(len(w), 1)) + 1)) AS i FROM item)),
doc AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
met AS (
  SELECT doc_id, item_id, i, k FROM (
    SELECT doc_id, i, s.k, array_to_string(w[i:i + s.k - 1], ' ') AS body FROM place, (SELECT DISTINCT k FROM pattern) s WHERE i + s.k - 1 <= len(w)
  ) JOIN pattern USING (k, body)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM met) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
