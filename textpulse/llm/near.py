"""Near-duplicates: ProbMinHash sketches, banding, verification, connected classes.

1. Texts of the same words are one node. Each node gets a sketch over the set of its five-word shingles (see probmin;
   with equal weights, so that bands, screen and threshold mean one Jaccard) and 24 band keys of five registers: two
   texts of Jaccard 0.8 share none with a chance below 1 in 10,000.
2. In a bucket (band and key) the node that meets most others over all its bands leads, and every other node is
   paired with it: a star, never all pairs. Pairs are verified on whole texts by the Jaccard of their shingle sets.
3. Links of stars join nodes to components. In each bucket, every node outside the bucket's largest component is
   compared with all nodes of other components by sketches, in blocks of bounded size. Pairs whose sketches agree as
   pairs of the threshold do, less three deviations, are verified as well. So each pair of a bucket that lies in two
   components is asked for; later links only join components, which leaves no further pair to ask for.
4. Linked nodes form connected classes; the smallest doc_id of a class stays.

Words are runs of letters, digits and underscores, lower-cased. Null texts count as empty; texts without words are
classes of their own. A null doc_id stays only in a class without any other. Rows repeated with one id and text are
in one class and share its verdict.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import MARK, hot_keys, lookup, stage, table, whole
from textpulse.llm.components import components
from textpulse.llm.probmin import WordCodes, band_keys, jaccard, shingles, sketch, words_of

BANDS, ROWS = 24, 5
#: Registers of a sketch: the bands take the first 120, the screen before verification all.
REGISTERS = 240
THRESHOLD = 0.8
#: Nodes of a bucket that are compared at once: asking ones, and those they are compared with.
ASK_BLOCK, HELD_BLOCK = 512, 4096

_SKETCHED = "doc_id long, x long, node binary, bands array<long>, sketch binary"
_CODES = WordCodes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            nodes, winners = [], []
            for text in part.column(2).to_pylist():
                words = words_of(text)
                if not words:
                    nodes.append(None)
                    continue
                elements, _ = shingles(words, _CODES)
                winners.append(sketch(elements, np.ones(len(elements)), REGISTERS))
                nodes.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest())
            found = np.array(winners, np.uint64).reshape(-1, REGISTERS)
            bands, short = iter(band_keys(found[:, : BANDS * ROWS], ROWS)), iter(found.astype(np.uint16))
            columns = [
                part.column(0),
                part.column(1),
                pa.array(nodes, pa.binary()),
                pa.array([None if n is None else next(bands) for n in nodes], pa.list_(pa.int64())),
                pa.array([None if n is None else next(short).tobytes() for n in nodes], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "x", "node", "bands", "sketch"])


def sketched(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x, node, bands, sketch) of every row, staged. x is a hash of the text, node one of its words."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(whole(text)).alias("x"), whole(text).alias("text"))
    return stage(rows.mapInArrow(_sketches, _SKETCHED), "sketched")


def node_table(rows: DataFrame) -> DataFrame:
    """One row per node, staged: node, a row that has its text, rows of it, bands, sketch."""
    firsts = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "x")).alias("source")
    held = rows.filter("node IS NOT NULL").groupBy("node").agg(firsts, F.count("*").alias("n"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch"))
    return stage(held, "nodes")


def bucket_members(nodes: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """(bucket, band, node, size) of buckets with several nodes, their leaders (bucket, leader, size), and hot buckets."""
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key")).select("node", "band", F.xxhash64("band", "key").alias("bucket"))
    sizes = stage(keyed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    hot = hot_keys(sizes, "bucket", "size")
    members = stage(lookup(keyed, "bucket", sizes, hot, "node", "inner"), "members")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    # The node with most meetings leads; of equal ones the smaller.
    rank = F.struct((-F.col("degree")).alias("degree"), F.col("node"))
    leaders = members.join(degree, "node").groupBy("bucket").agg(F.min(rank).alias("rank"), F.count("*").alias("size"))
    return members, stage(leaders.select("bucket", F.col("rank.node").alias("leader"), "size"), "leaders"), hot


def candidate_texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, text) of the wanted nodes, staged."""
    asked = nodes.join(wanted, "node", "left_semi").select("node", F.col("source.doc_id").alias(f"{MARK}id"), F.col("source.x").alias(f"{MARK}x"))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), whole(text).alias("text"), F.xxhash64(whole(text)).alias("x"))
    met = rows.join(asked.hint("merge"), (F.col("x") == F.col(f"{MARK}x")) & F.col("doc_id").eqNullSafe(F.col(f"{MARK}id")))
    return stage(met.groupBy("node").agg(F.min("text").alias("text")), "texts")


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    last: tuple[str | None, np.ndarray] = (None, np.zeros(0))
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            kept = []
            for left, right in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                if left != last[0]:
                    last = left, shingles(words_of(left), _CODES)[0]
                kept.append(jaccard(last[1], shingles(words_of(right), _CODES)[0]) >= threshold)
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(k).filter(mask) for k in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) whose whole texts have a Jaccard of at least the threshold, staged. a may be hot."""
    counts = stage(pairs.groupBy("a").count(), "pair-counts")
    hot = hot_keys(counts, "a", "count")
    b_texts = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")).hint("merge")
    a_texts = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")).hint("merge")
    both = lookup(pairs.join(b_texts, "b"), "a", a_texts, hot, "b", "inner")
    return stage(both.select("a", "b", "a_text", "b_text").mapInArrow(partial(_verify, threshold=threshold), "a binary, b binary"), "links")


def least_agreement(threshold: float = THRESHOLD) -> int:
    """Registers in which sketches of texts at the threshold agree, less three deviations."""
    m = REGISTERS
    return math.floor(m * threshold - 3 * math.sqrt(m * threshold * (1 - threshold)))


def _compare(nodes: list, roots: np.ndarray, held: np.ndarray, asks: np.ndarray, band: int, least: int) -> list[tuple]:
    """Pairs of an asking node and one of another root in one block whose sketches agree in enough registers, if the
    block's band is the first that the two share: in the other buckets where they meet, they are not given again."""
    out = []
    for k in np.flatnonzero(asks):
        same = held == held[k]
        near = np.flatnonzero((np.count_nonzero(same, axis=1) >= least) & (roots != roots[k]).any(axis=1))
        if len(near):
            shared = same[near, : BANDS * ROWS].reshape(len(near), BANDS, ROWS).all(axis=2).argmax(axis=1)
            out += [(nodes[j], nodes[k]) for j in near[shared == band]]
    return out


def _screen(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Compare the nodes of each block (bucket, ask, held) of rows sorted by block. A block may go on in the next
    batch; only one block is held, and its size is bounded."""
    keys = ["bucket", "ask", "held"]
    rest: pa.Table | None = None

    def compared(rows: pa.Table) -> pa.RecordBatch:
        key = np.stack([rows[n].to_numpy() for n in keys])
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]) if len(rows) else []
        sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(len(rows), REGISTERS)
        asks, bands, nodes = rows["asks"].to_numpy(), rows["band"].to_numpy(), rows["node"].to_pylist()
        roots = np.frombuffer(b"".join(rows["root"].to_pylist()), np.uint64).reshape(len(rows), 2)
        pairs: list[tuple] = []
        for s, e in zip(starts, [*starts[1:], len(rows)]):
            pairs += _compare(nodes[s:e], roots[s:e], sketches[s:e], asks[s:e], int(bands[s]), least)
        columns = zip(*pairs) if pairs else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in columns], names=["a", "b"])

    for batch in (b for b in batches if b.num_rows):
        new = pa.Table.from_batches([batch])
        rows = new if rest is None else pa.concat_tables([rest, new])
        last = np.ones(len(rows), bool)
        for n in keys:
            own = rows[n].to_numpy()
            last &= own == own[-1]
        cut = len(rows) - int(last[::-1].argmin() if not last.all() else len(rows))
        if cut:
            yield compared(rows.slice(0, cut))
        rest = rows.slice(cut)
    if rest is not None:
        yield compared(rest)


def sketch_pairs(members: DataFrame, nodes: DataFrame, roots: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of nodes of one bucket in different components, screened by sketches in blocks. roots: (node, root) of
    linked nodes; any other is a component of its own. Nodes of a bucket's largest component are asked by the others
    and need not ask. Buckets of two need no screen: their star is their only pair."""
    owned = members.filter("size > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    owned = stage(owned.select("bucket", "band", "node", "root"), "owned")
    shares = owned.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    largest = shares.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("in_bucket")).filter("in_bucket > top.n")
    counts = stage(largest.select("bucket", F.col("top.root").alias("largest"), "in_bucket", (F.col("in_bucket") - F.col("top.n")).alias("asking")), "open")
    hot = hot_keys(counts, "bucket", "in_bucket")
    blocks = lookup(owned, "bucket", counts, hot, "node", "inner").join(nodes.select("node", "sketch"), "node")
    blocks = blocks.withColumn("asks", F.col("root") != F.col("largest"))
    n_ask, n_held = F.ceil(F.col("asking") / ASK_BLOCK).cast("int"), F.ceil(F.col("in_bucket") / HELD_BLOCK).cast("int")
    mixed = F.xxhash64("node")
    own_ask, own_held = F.pmod(mixed, n_ask).cast("int"), F.pmod(F.shiftright(mixed, 20), n_held).cast("int")

    def place(ask: Column, held: Column) -> Column:
        """A node asks in its own block of those asking, and is there to be asked once for each block."""
        return F.struct(ask.alias("ask"), held.alias("held"), (F.col("asks") & (ask == own_ask)).alias("asks"))

    every_ask = F.transform(F.sequence(F.lit(0), n_ask - 1), lambda a: place(a, own_held))
    every_held = F.transform(F.sequence(F.lit(0), n_held - 1), lambda h: place(own_ask, h))
    places = F.when(F.col("asks"), F.array_distinct(F.concat(every_ask, every_held))).otherwise(every_ask)
    dealt = blocks.select("bucket", "band", "node", "root", "sketch", F.explode(places).alias("p"))
    dealt = dealt.select("bucket", "p.ask", "p.held", "band", "node", "root", "sketch", "p.asks")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parts, "bucket", "ask", "held").sortWithinPartitions("bucket", "ask", "held")
    found = sorted_.mapInArrow(partial(_screen, least=least_agreement(threshold)), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, x (hash of the text), class_id, class_size (rows), kept."""
    rows = sketched(docs, id, text)
    nodes = node_table(rows)
    members, leaders, hot = bucket_members(nodes)
    stars = lookup(members.select("bucket", "node"), "bucket", leaders, hot, "node", "inner").filter("node != leader")
    pairs = stage(stars.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    texts = candidate_texts(docs, nodes, members.select("node").distinct(), id, text)
    first = verified(pairs, texts, threshold)
    starred = stage(components(first), "starred")
    more = stage(sketch_pairs(members, nodes, starred, threshold), "more").join(pairs, ["a", "b"], "left_anti")
    second = verified(stage(more.join(pairs.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "rest"), texts, threshold)
    roots = components(starred.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second))
    # Classes of several rows; a node that no link has is a class of its rows.
    rooted = nodes.select("node", "source.doc_id", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size")).filter("class_size > 1")
    several = stage(rooted.join(classes, "root").select("node", "n", "class_id", "class_size"), "classes")
    found = lookup(rows.select("doc_id", "x", "node"), "node", several.drop("n"), hot_keys(several, "node", "n"), "x")
    size = F.coalesce("class_size", F.lit(1)).cast("long")
    own = F.when(size > 1, F.col("class_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "x", own.alias("class_id"), size.alias("class_size"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_classes(table(spark, folder, "documents")).drop("x")


def distinct_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class the one with the smallest id."""
    out = near_classes(docs, id, text, threshold).filter(~F.col("kept"))
    gone = stage(out.select(F.col("doc_id").alias(f"{MARK}id"), F.col("x").alias(f"{MARK}x")).distinct(), "gone")
    same = F.xxhash64(whole(docs[text])).eqNullSafe(F.col(f"{MARK}x")) & docs[id].cast("long").eqNullSafe(F.col(f"{MARK}id"))
    return docs.join(gone.hint("merge"), same, "left_anti")
