"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Pieces are range-sorted by (length, id), which gives each its rank among the pieces of its length. Rounds go
through the lengths, longest first. In a round all pieces of the length are matched at once: a sweep over the
open gaps, sorted by size, gives them the successor of their length, the k-th piece goes to the k-th gap of that
size by rank, and who finds none left of it goes on to the next larger gaps; who finds no gap opens sequences.
Then the gaps are updated and the next round begins. As pieces of one length differ by rank only, pieces and gaps
enter a sweep as runs (a length or size, a first rank, a count): never more lengths or sizes than the capacity,
however many documents there are. Every piece finds its run by its length and rank in the task that holds it.

Columns besides id and text are not read. Null texts count as empty; a document has at least its end id. Null ids of documents come first. Rows repeated
with the same id are packed as often as they occur.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import MARK, ranked, stage, table, whole
from textpulse.llm.tokens import crc32, encoded, word_tokenizer

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Ranks fit below, lengths above.
_SHIFT = 44


def token_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document's ids with the end id: only documents over the capacity are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc, ids in encoded(batches, tokenizer, end):
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                rows.append((doc, piece, start, len(part), crc32(part)))
            if len(rows) >= 5000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return docs.select(F.col(id).alias("doc_id"), whole(text).alias("text")).mapInArrow(cut, _PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def match_runs(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first sequence, offset, pieces per sequence), and the number of sequences.

    counts: pieces of each length. A round per length, longest first, each a sweep over the gaps from the
    successor of the length upwards.
    """
    sizes: list[int] = []  # of gaps, ascending
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # runs of sequences (first, count) by gap
    runs, opened = [], 0

    def leave(size: int, first: int, count: int) -> None:
        if size and count:
            if not gaps[size]:
                insort(sizes, size)
            gaps[size].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (k := bisect_left(sizes, length)) < len(sizes):
            size = sizes[k]
            per = size // length
            first, count = gaps[size].pop()
            used = min(count, -(-left // per))
            if used < count:
                gaps[size].append((first + used, count - used))
            if not gaps[size]:
                sizes.pop(k)
            taken = min(left, used * per)
            runs.append((length, rank, first, capacity - size, per))
            full = taken // per
            leave(size - per * length, first, full)
            leave(size - (taken - full * per) * length, first + full, used - full)
            rank, left = rank + taken, left - taken
        if left:
            per = capacity // length
            full, rest = divmod(left, per)
            runs.append((length, rank, opened, 0, per))
            leave(capacity - per * length, opened, full)
            leave(capacity - rest * length, opened + full, 1 if rest else 0)
            opened += full + (1 if rest else 0)
    table_ = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return table_, opened


def best_fit(pieces: DataFrame, capacity: int, order: Sequence[str] = ("doc_id", "piece")) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset in it. order: of the pieces
    of one length."""
    placed = ranked(stage(pieces, "pieces"), ["length"], list(order), "ranked")
    # At most one row per length, so no more than the capacity.
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"pieces must have 1 to {capacity} ids")
    runs, _ = match_runs(counts, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        keys = (table_[:, 0] << _SHIFT) + table_[:, 1]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            run = table_[np.searchsorted(keys, (length << _SHIFT) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 2] + nth // run[:, 4], run[:, 3] + nth % run[:, 4] * length
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return placed.select(*names).mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")


def written_places(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """(doc_id, position) of documents read from Parquet: where the first row of an id stands in the order in which
    the table was written, by file and row. Staged."""
    at = docs.metadataColumn("_metadata")
    # The number in a file's name has five digits or more; as text, the sixth would change the order.
    number = F.regexp_extract(at["file_name"], r"part-(\d+)", 1)
    position = F.struct(F.try_to_number(number, F.lit("999999999999")).cast("long").alias("number"), at["file_name"].alias("file"), at["row_index"].alias("row"))
    return stage(docs.select(F.col(id).alias("doc_id"), position.alias("position")).groupBy("doc_id").agg(F.min("position").alias("position")), "places")


def best_fit_in_order(pieces: DataFrame, places: DataFrame, capacity: int) -> DataFrame:
    """As best_fit, by position: pieces of one length are ranked by it, and sequences are numbered by that of their
    first piece."""
    named = places.withColumnRenamed("doc_id", f"{MARK}id").hint("merge")
    placed = pieces.join(named, F.col("doc_id").eqNullSafe(F.col(f"{MARK}id"))).drop(f"{MARK}id")
    packed = stage(best_fit(placed, capacity, ["position", "doc_id", "piece"]), "packed")
    named = places.withColumnRenamed("doc_id", f"{MARK}id").hint("merge")
    # Every sequence has one piece at its beginning.
    first = packed.filter("offset = 0").join(named, F.col("doc_id").eqNullSafe(F.col(f"{MARK}id")))
    first = first.select("sequence_id", "position", "piece", F.lit(0).alias("all"))
    numbers = ranked(first, ["all"], ["position", "piece", "sequence_id"], "numbered").select("sequence_id", "rank")
    return packed.join(numbers, "sequence_id").select(*packed.columns[:5], F.col("rank").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = 4096, end: int = 1, tokenizer: str | None = None, id: str = "doc_id", text: str = "text", in_order: bool = False) -> DataFrame:
    """One row per piece of every document: where its ids lie in which sequence. in_order: docs are read from
    Parquet, and the order in which they were written is that of the sequences (see best_fit_in_order)."""
    pieces = token_pieces(docs, tokenizer or word_tokenizer(), end, capacity, id, text)
    return best_fit_in_order(pieces, written_places(docs, id), capacity) if in_order else best_fit(pieces, capacity)


def op8_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))
