"""Word vectors by skip-gram with negative sampling, over blocks of texts.

The texts are dealt in blocks. A task trains the vectors of the words of its block, from the same start in every block,
and the vectors of a word are averaged over its blocks by its occurrences there. That is the way of Spark's ``Word2Vec``
with as many parts and its one pass, but vectors are rows: neither the driver nor a task holds those of all words.
Instead of a Huffman tree of all words, a pair is told from words drawn by their frequency to the power of 3/4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.operators.unnest import unnest
from textpulse.session import discard, importable, stage

WINDOW = 5
NEGATIVES = 5
#: Tokens of a block at most, on average; some 250,000 words of natural text.
BLOCK_TOKENS = 8_000_000
#: Fewer tokens than that are not dealt to further tasks.
LEAST_TOKENS = 200_000
#: Places that share drawn words, and how many are drawn for them. A step takes up to ``GROUPS`` times that many places,
#: fewer where a block would have less than ``STEPS`` steps.
PLACES, DRAWN, GROUPS, STEPS = 32, 16, 32, 2000
RATE = 0.05
OUT_ROWS = 8192
#: Bits of a row number that number the rows of one part of a scan.
PART_BITS = 33
_VECTORS = "block int, id long, n long, vector array<float>"


def block_number(spark, tokens: int) -> int:
    """One block per task slot, whole rounds of slots when blocks would have over ``BLOCK_TOKENS``, fewer when they would be tiny."""
    slots = spark.sparkContext.defaultParallelism
    most = -(-tokens // BLOCK_TOKENS)
    return max(1, min(slots, tokens // LEAST_TOKENS)) if most <= slots else -(-most // slots) * slots


def train_by_blocks(
    corpus: DataFrame, tokens: str = "tokens", size: int = 200, min_count: int = 5, seed: int = 1, blocks: int | None = None,
    waves: int | None = None,
) -> DataFrame:
    """``(word, vector array<float>)`` of every word with at least ``min_count`` occurrences, stored.

    Each text is trained on whole, without its rarer words. What is shuffled are the tokens' hashes, once, and a vector
    per block and word of it. Blocks are trained in ``waves`` of one per task slot: the means of a wave and of those before are
    stored and its vectors deleted, so that disk holds those of one wave and not those of all blocks. ``corpus`` is read once.
    """
    spark = corpus.sparkSession
    importable(spark)
    # The number of a row is settled by storing it; copies of a text go to several blocks.
    texts = stage(corpus.select(F.monotonically_increasing_id().alias("at"), F.col(tokens).alias("tokens")), "texts")
    of_part = texts.groupBy(F.shiftright("at", PART_BITS).alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.greatest(F.size("tokens"), F.lit(0))).alias("n"))
    read = [tuple(r) for r in of_part.orderBy("part").collect()]  # a row per part of the scan
    blocks = blocks or block_number(spark, sum(n for _, _, n in read))
    waves = waves or -(-blocks // spark.sparkContext.defaultParallelism)
    per = -(-blocks // waves)
    ends = _ends(read, waves)
    wave = sum((F.col("at") >= e).cast("int") for e in ends[1:-1]) if waves > 1 else F.lit(0)
    block = (wave * per + F.pmod("at", F.lit(per))).cast("int").alias("block")
    cells = stage(unnest(texts, [block], F.col("tokens"), "word").groupBy("block", "word").agg(F.count(F.lit(1)).alias("n")), "cells")
    kept = stage(cells.groupBy("word").agg(F.sum("n").alias("total")).where(F.col("total") >= min_count), "words")
    none, no_word = F.lit(None).cast("long"), F.lit(None).cast("string").alias("word")
    names = kept.select(F.lit(-1).alias("block"), F.xxhash64("word").alias("id"), F.lit(0).cast("long").alias("n"), F.array().cast("array<float>").alias("vector"), "word")
    part = F.pmod("id", F.lit(4 * per)).cast("int")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            yield from _trained(rows, size, seed)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _means(batches, size)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _means(batches, size, named=True)

    means = None
    for w, (start, end) in enumerate(zip(ends, ends[1:])):
        # A range of row numbers, which parts that hold none of them are skipped by.
        mine = texts.where((F.col("at") >= start) & (F.col("at") < end))
        needed = cells.where(F.col("block").between(w * per, w * per + per - 1)).join(kept, "word")
        hashed = mine.select(block, "at", F.transform("tokens", lambda t: F.xxhash64(t)).alias("ids"), none.alias("total"))
        dealt = hashed.unionByName(needed.select("block", none.alias("at"), F.array(F.xxhash64("word")).alias("ids"), "total"))
        met = dealt.repartitionById(per, F.col("block") - w * per).mapInArrow(train, _VECTORS)
        met = met if means is None else met.unionByName(means)
        if w < waves - 1:
            before, means = means, stage(met.repartitionById(4 * per, part).mapInArrow(merge, _VECTORS), "means")
            if before is not None:
                discard(before)
    met = met.withColumn("word", no_word).unionByName(names).repartitionById(4 * per, part)
    out = stage(met.mapInArrow(name, "word string, vector array<float>"), "vectors")
    for done in [texts, cells, kept, *[means] * (means is not None)]:
        discard(done)
    return out


def _ends(parts: list[tuple[int, int, int]], waves: int) -> list[int]:
    """Row numbers that deal the tokens of parts ``(part, rows, tokens)`` in ``waves`` about equal ranges, from 0 to above all."""
    total, so_far, inner = sum(n for _, _, n in parts), 0, []
    for part, rows, n in parts:
        while len(inner) < waves - 1 and n and so_far + n >= (goal := total * (len(inner) + 1) / waves):
            inner.append((part << PART_BITS) + int(rows * (goal - so_far) / n))
        so_far += n
    return [0, *inner, *[1 << 62] * (waves - len(inner))]


# --- within a task --------------------------------------------------------------------------------


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    rows = list(batches)
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    for b in sorted(pc.unique(table["block"]).to_pylist()):
        yield table.filter(pc.equal(table["block"], b))


def _vectors(vectors: np.ndarray) -> pa.Array:
    n, size = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(vectors.ravel()))


def _trained(rows: pa.Table, size: int, seed: int) -> Iterator[pa.RecordBatch]:
    """``(block, id, n, vector)`` of the words of one block, from its texts and the words to train."""
    block = rows["block"][0].as_py()
    is_word = pc.is_valid(rows["total"])
    words, texts = rows.filter(is_word), rows.filter(pc.invert(is_word)).sort_by("at")
    if not words.num_rows:
        return
    known, first = np.unique(pc.list_flatten(words["ids"]).to_numpy(), return_index=True)
    total = words["total"].to_numpy()[first]
    found = pc.list_flatten(texts["ids"]).to_numpy()
    text = np.repeat(np.arange(texts.num_rows, dtype=np.int32), pc.fill_null(pc.list_value_length(texts["ids"]), 0).to_numpy())
    ids = np.minimum(np.searchsorted(known, found), len(known) - 1).astype(np.int32)
    held = known[ids] == found
    ids, text = ids[held], text[held]
    vectors = start_vectors(known, size, seed)
    skip_gram(ids, text, total, vectors, np.random.default_rng([seed, block]))
    n = np.bincount(ids, minlength=len(known))
    for i in range(0, len(known), OUT_ROWS):
        s = slice(i, i + OUT_ROWS)
        columns = [pa.array(np.full(len(known[s]), block, np.int32)), pa.array(known[s]), pa.array(n[s]), _vectors(vectors[s])]
        yield pa.RecordBatch.from_arrays(columns, ["block", "id", "n", "vector"])


def start_vectors(ids: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Small random numbers that a word has in every block: its hash, mixed with the place (splitmix64)."""
    out = np.empty((len(ids), size), np.float32)
    with np.errstate(over="ignore"):
        place = (np.arange(1, size + 1, dtype=np.uint64) + np.uint64(seed * size)) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(0, len(ids), OUT_ROWS):
            z = ids[i : i + OUT_ROWS].view(np.uint64)[:, None] + place
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
            out[i : i + OUT_ROWS] = ((z >> np.uint64(11)) / 2.0**53 - 0.5) / size
    return out


def skip_gram(ids: np.ndarray, text: np.ndarray, total: np.ndarray, vectors: np.ndarray, rng: np.random.Generator) -> None:
    """One pass over all places, which moves ``vectors``. Each place has its own window of up to ``WINDOW`` words on both
    sides, as in word2vec. Neighbouring places share drawn words, weighed so that a pair meets ``NEGATIVES`` of them."""
    size, width = vectors.shape[1], PLACES + 2 * WINDOW
    contexts = np.zeros_like(vectors)
    moved, moved_contexts = np.zeros(len(vectors), np.float32), np.zeros(len(vectors), np.float32)
    noise = np.cumsum(total.astype(float) ** 0.75)
    noise /= noise[-1]
    groups = min(max(len(ids) // (PLACES * STEPS), 1), GROUPS)
    step = PLACES * groups
    after = WINDOW + -len(ids) % step
    ids, text = np.pad(ids, (WINDOW, after)), np.pad(text, (WINDOW, after), constant_values=-1)
    around = np.arange(groups)[:, None] * PLACES + np.arange(width)
    gap = np.abs(np.arange(width) - WINDOW - np.arange(PLACES)[:, None])
    for at in range(0, len(ids) - 2 * WINDOW, step):
        near, near_text = ids[at + around], text[at + around]
        inner = slice(WINDOW, WINDOW + PLACES)
        reach = rng.integers(1, WINDOW + 1, (groups, PLACES, 1))
        center_text = near_text[:, inner, None]
        pair = (gap > 0) & (gap <= reach) & (center_text == near_text[:, None]) & (center_text >= 0)
        drawn = np.searchsorted(noise, rng.random((groups, DRAWN))).clip(max=len(noise) - 1)
        others = np.concatenate([near, drawn], axis=1)
        a, b = vectors[near[:, inner]], contexts[others]
        likely = 1 / (1 + np.exp(-(a @ b.transpose(0, 2, 1)).clip(-30, 30)))
        likely[:, :, :width] = (1 - likely[:, :, :width]) * pair
        likely[:, :, width:] *= -NEGATIVES / DRAWN * pair.sum(axis=2, keepdims=True, dtype=np.float32)
        _move(vectors, moved, near[:, inner].ravel(), (likely @ b).reshape(-1, size))
        _move(contexts, moved_contexts, others.ravel(), (likely.transpose(0, 2, 1) @ a).reshape(-1, size))


def _move(vectors: np.ndarray, moved: np.ndarray, ids: np.ndarray, by: np.ndarray) -> None:
    """Adds up what moves each word and takes a step that shrinks with the way it has gone (Adagrad by rows)."""
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    times, which = np.diff(np.r_[first, len(ids)]), ordered[first]
    # Second rows of all words, then third ones: rows are added whole, which reduceat does not. The few words that are left go one by one.
    sums, k, more = by[order[first]], 1, np.flatnonzero(times > 1)
    while len(more) > 8:
        sums[more] += by[order[first[more] + k]]
        k += 1
        more = more[times[more] > k]
    for w in more:
        sums[w] += by[order[first[w] + k : first[w] + times[w]]].sum(axis=0)
    moved[which] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
    vectors[which] += sums * (RATE / np.sqrt(moved[which] + 1e-12))[:, None]


def _means(batches: Iterator[pa.RecordBatch], size: int, named: bool = False) -> Iterator[pa.RecordBatch]:
    """``(block, id, n, vector)``: the mean of a word's vectors over its blocks, by its occurrences, and their sum; the
    block is -1, as means are merged with those of later blocks. Or ``(word, vector)`` of the words that have a name here."""
    rows = list(batches)
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    if named:
        is_name = pc.is_valid(table["word"])
        names, table = table.filter(is_name).sort_by("word"), table.filter(pc.invert(is_name))
        if not names.num_rows:
            return
    elif not table.num_rows:
        return
    vectors = pc.list_flatten(table["vector"]).to_numpy().reshape(-1, size)
    ids, n = table["id"].to_numpy(), table["n"].to_numpy()
    order = np.lexsort((table["block"].to_numpy(), ids))
    known, first = np.unique(ids[order], return_index=True)
    sums = np.add.reduceat(n[order], first)
    share = (n / sums[np.searchsorted(known, ids)]).astype(np.float32)
    means = np.add.reduceat(vectors[order] * share[order][:, None], first, axis=0)
    if not named:
        for i in range(0, len(known), OUT_ROWS):
            s = slice(i, i + OUT_ROWS)
            columns = [pa.array(np.full(len(known[s]), -1, np.int32)), pa.array(known[s]), pa.array(sums[s]), _vectors(means[s])]
            yield pa.RecordBatch.from_arrays(columns, ["block", "id", "n", "vector"])
        return
    at = np.searchsorted(known, names["id"].to_numpy())
    words = names["word"].combine_chunks()
    for i in range(0, len(at), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([words[i : i + OUT_ROWS], _vectors(means[at[i : i + OUT_ROWS]])], ["word", "vector"])
