"""Counts of pairs of words in cells: packed columns, NumPy over Arrow batches.

Words are dealt in groups by a hash, and the pairs of two groups, whichever way round, lie in one cell: a row with its
words and, in the order of the words, their pairs. So a cell needs what is known of the words of two groups only, and a word
goes to as many cells as there are groups. A pair takes a few bytes: lengths of runs, steps and counts, their bytes
by place, compressed. A task holds one cell, of some ``CELL_PAIRS`` pairs, or the pairs of ``CHUNK`` places of the texts.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of a cell on average, before equal ones are summed; fewer than ``LEAST_PAIRS`` are not dealt to further cells.
CELL_PAIRS, LEAST_PAIRS = 8_000_000, 500_000
#: Places of the texts whose pairs are summed at a time.
CHUNK = 4_000_000
#: Pairs of a batch that goes to Spark as rows.
OUT_PAIRS = 50_000
PACKED = "cell int, words binary, lengths binary, others binary, counts binary, totals binary, met long"
_NAMES = ["cell", "words", "lengths", "others", "counts", "totals", "met"]


@dataclass
class Cells:
    #: ``PACKED`` rows, stored: ``totals`` are a number per word, ``met`` the sum of the counts both ways round.
    rows: DataFrame
    groups: int
    #: Number of each cell, in the order of ``place``; by these each lies in a part of its own.
    numbers: list[int]

    def dealt(self, more: DataFrame, keep: str) -> DataFrame:
        """The cells with rows ``(word, *keep)`` of all words of their groups, dealt by cell."""
        lists = [[self.numbers[place(min(g, h), max(g, h), self.groups)] for h in range(self.groups)] for g in range(self.groups)]
        to = F.get(F.array(*[F.array(*map(F.lit, x)) for x in lists]), group_of(F.col("word"), self.groups))
        sent = more.select(F.explode(to).alias("cell"), "word", keep)
        met = self.rows.unionByName(sent, allowMissingColumns=True)
        return met.repartition(len(self.numbers), "cell")


def groups_for(pairs: int, slots: int) -> int:
    """Two groups at least, whose cells have ``CELL_PAIRS`` pairs at most on average, and two cells per slot if they are not tiny."""
    wanted = max(2, min(2 * slots, pairs // LEAST_PAIRS), -(-pairs // CELL_PAIRS))
    return int(np.ceil((np.sqrt(8 * wanted + 1) - 1) / 2))


def place(i, j, groups: int):
    """Place of the cell of two groups, the lesser first."""
    return i * groups - i * (i - 1) // 2 + j - i


def group_of(word: Column, groups: int) -> Column:
    return F.pmod(F.crc32(word.cast("binary")), F.lit(groups)).cast("int")


def _groups(words: pa.Array, groups: int) -> np.ndarray:
    # The same as ``group_of``; null has a group too.
    return np.fromiter((zlib.crc32((w or "").encode()) % groups for w in words.to_pylist()), np.int64, len(words))


# --- packing --------------------------------------------------------------------------------------


def _pack(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _pack_words(words: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([words], ["word"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack_words(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_next_batch().column(0)


def _packed(cell: int, words: pa.Array, a: np.ndarray, b: np.ndarray, n: np.ndarray, totals: np.ndarray | None = None, met: int = 0) -> pa.RecordBatch:
    """One row from pairs ``a <= b`` of places of words, in order."""
    lengths = np.bincount(a, minlength=len(words)).astype(np.int32)
    steps = np.diff(b, prepend=0).astype(np.int64)
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    steps[first] = b[first]
    values = [cell, _pack_words(words), _pack(lengths), _pack(steps.astype(np.int32)), _pack(n.astype(np.int64)), None if totals is None else _pack(totals.astype(np.int64)), met]
    kinds = [pa.int32(), *[pa.binary()] * 5, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], _NAMES)


def _unpacked(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``words, a, b, n`` of a row."""
    lengths, steps = _unpack(row["lengths"], np.int32), _unpack(row["others"], np.int32).astype(np.int64)
    a = np.repeat(np.arange(len(lengths)), lengths)
    b = np.cumsum(steps)
    if len(b):
        some = lengths > 0
        first = np.r_[0, np.cumsum(lengths[some])[:-1]]
        b -= np.repeat(b[first] - steps[first], lengths[some])
    return _unpack_words(row["words"]), a, b, _unpack(row["counts"], np.int64)


def _in_order(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in order, null first, and each word's place."""
    if not len(words):
        return words, np.zeros(0, np.int64)
    found = words.dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(found.dictionary, null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)), rank[found.indices.to_numpy()]


def _of_used(words: pa.Array, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words that have a pair, and the pairs by those."""
    mark = np.zeros(len(words), bool)
    mark[a] = mark[b] = True
    used, to = np.flatnonzero(mark), np.cumsum(mark) - 1
    return used, to[a], to[b]


# --- steps ----------------------------------------------------------------------------------------


def counted(batches: Iterator[pa.RecordBatch], window: int, groups: int, numbers: list[int], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cells of the texts of a task, several of each if it has many."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0))
        n += len(held[-1].flatten())
        if n >= chunk:
            yield from _counted(held, window, groups, numbers, chunk)
            held, n = [], 0
    if n:
        yield from _counted(held, window, groups, numbers, chunk)


def _counted(lists: list[pa.ListArray], window: int, groups: int, numbers: list[int], chunk: int) -> Iterator[pa.RecordBatch]:
    words, codes = _in_order(pa.concat_arrays([x.flatten().cast(pa.string()) for x in lists]))
    sizes = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists])
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    group = _groups(words, groups)
    for start in range(0, len(codes), chunk):
        keys = []
        for d in range(1, window + 1):
            to = codes[start + d : start + chunk + d]
            of, same = codes[start : start + len(to)], text[start : start + len(to)] == text[start + d : start + d + len(to)]
            of, to = of[same], to[same]
            keys.append(np.minimum(of, to) * len(words) + np.maximum(of, to))
        keys, n = np.unique(np.concatenate(keys), return_counts=True)
        a, b = np.divmod(keys, len(words))
        cell = place(np.minimum(group[a], group[b]), np.maximum(group[a], group[b]), groups)
        order = np.argsort(cell.astype(np.uint16 if len(numbers) < 1 << 16 else np.int64), kind="stable")
        a, b, n, ends = a[order], b[order], n[order], np.r_[0, np.cumsum(np.bincount(cell, minlength=len(numbers)))]
        for i in np.flatnonzero(np.diff(ends)):
            s = slice(ends[i], ends[i + 1])
            used, x, y = _of_used(words, a[s], b[s])
            yield _packed(numbers[i], words.take(pa.array(used)), x, y, n[s])


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], pa.Table]]:
    """Each cell of a task with its packed rows and those of its words."""
    packed, rest = defaultdict(list), []
    for batch in batches:
        is_cell = pc.is_valid(batch["words"])
        for row in batch.filter(is_cell).select(_NAMES).to_pylist():
            packed[row["cell"]].append(row)
        rest.append(batch.filter(pc.invert(is_cell)))
    others = pa.Table.from_batches(rest) if rest else None
    for cell in sorted(packed):
        yield cell, packed.pop(cell), others.filter(pc.equal(others["cell"], cell))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per cell, with each word's count of neighbours in this cell."""
    for cell, rows, _ in _by_cell(batches):
        parts = [_unpacked(rows.pop()) for _ in range(len(rows))]
        words, at = _in_order(pa.concat_arrays([p[0] for p in parts]))
        ends = np.r_[0, np.cumsum([len(p[0]) for p in parts])]
        keys = np.concatenate([_keys(at[e:], p, len(words)) for e, p in zip(ends, parts)])
        n = np.concatenate([p[3] for p in parts])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = np.add.reduceat(n[order], first)
        a, b = np.divmod(keys[first], len(words))
        yield _packed(cell, words, a, b, n, _sums(a, n, len(words)) + _sums(b, n, len(words)), 2 * int(n.sum()))


def _keys(at: np.ndarray, part: tuple, n: int) -> np.ndarray:
    a, b = at[part[1]], at[part[2]]
    return np.minimum(a, b) * n + np.maximum(a, b)


def _sums(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, n, size).astype(np.int64)  # exact below 2 to the power of 53


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, context, n)``, both ways round."""
    for batch in batches:
        for row in batch.to_pylist():
            words, a, b, n = _unpacked(row)
            yield from _rows(words, a, b, np.where(a == b, 2 * n, n), "n")


def _rows(words: pa.Array, a: np.ndarray, b: np.ndarray, value: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), OUT_PAIRS):
        x, y, v = (c[i : i + OUT_PAIRS] for c in (a, b, value))
        two = x != y
        word, context = np.r_[x, y[two]], np.r_[y, x[two]]
        yield pa.RecordBatch.from_arrays([words.take(pa.array(word)), words.take(pa.array(context)), pa.array(np.r_[v, v[two]])], ["word", "context", name])


def word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, total)`` of each cell."""
    for batch in batches:
        for row in batch.to_pylist():
            words, totals = _unpack_words(row["words"]), _unpack(row["totals"], np.int64)
            for i in range(0, len(words), OUT_PAIRS):
                yield pa.RecordBatch.from_arrays([words[i : i + OUT_PAIRS], pa.array(totals[i : i + OUT_PAIRS])], ["word", "total"])


def of_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells' pairs of words that came with a total, with these as ``totals``."""
    for cell, rows, kept in _by_cell(batches):
        words, a, b, n = _unpacked(rows[0])
        at = pc.fill_null(pc.index_in(words, kept["word"].combine_chunks()), -1).to_numpy()
        both = (at[a] >= 0) & (at[b] >= 0)
        n = n[both]
        used, a, b = _of_used(words, a[both], b[both])
        if len(used):
            yield _packed(cell, words.take(pa.array(used)), a, b, n, kept["total"].to_numpy()[at[used]], 2 * int(n.sum()))


@dataclass
class Weights:
    """Positive part of the shifted mutual information of ``total`` pairs."""

    total: int
    shift: float

    def of(self, row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        words, a, b, n = _unpacked(row)
        totals = _unpack(row["totals"], np.int64).astype(float)
        weight = np.log(np.where(a == b, 2 * n, n) * float(self.total) / (totals[a] * totals[b])) - np.log(self.shift)
        positive = np.round(weight, 12) > 0
        return words, a[positive], b[positive], weight[positive]

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(word, context, weight)``, both ways round."""
        for batch in batches:
            for row in batch.to_pylist():
                yield from _rows(*self.of(row), "weight")

    def words(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``word`` of each cell that has a weight in it."""
        for batch in batches:
            for row in batch.to_pylist():
                words, a, b, _ = self.of(row)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(_of_used(words, a, b)[0]))], ["word"])

    def product(self, batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
        """``(word, vector)``: the weights of each cell, both ways round, times the vectors that came with it."""
        for _, rows, factor in _by_cell(batches):
            words, a, b, weight = self.of(rows[0])
            at = pc.fill_null(pc.index_in(words, factor["word"].combine_chunks()), -1).to_numpy()
            used, a, b = _of_used(words, a, b)  # all of them have a vector
            block = pc.list_flatten(factor["vector"]).to_numpy().reshape(-1, width)[at[used]]
            two = a != b
            x, y, w = a[two], b[two], weight[two]
            out = np.empty_like(block)
            for c in range(width):  # so that only one number per pair is held
                out[:, c] = np.bincount(a, weight * block[b, c], len(used)) + np.bincount(y, w * block[x, c], len(used))
            words = words.take(pa.array(used))
            for i in range(0, len(used), OUT_PAIRS):
                some = out[i : i + OUT_PAIRS]
                ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([words[i : i + OUT_PAIRS], pa.ListArray.from_arrays(ends, pa.array(some.ravel()))], ["word", "vector"])
