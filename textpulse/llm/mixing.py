"""Mixing sources to target weights by Pfair scheduling.

The documents of each source, in the order of a hash of their ids, are cut into blocks of about equal size. With a
target weight w, block j of a source may start at slot j / w at the earliest and must be placed before slot
(j + 1) / w. Of the blocks that may start, each slot takes the one with the earliest deadline. Weights are whole
parts of a period, so the schedule repeats: one period is worked out, of as many slots as it has parts, and block j
finds its slot by j alone. At every slot, each source has been given its weight of the slots so far to within less
than one block, until the first source ends; from then on its slots stay empty and the others go on in their order.

Every row gets one slot: nothing is dropped or repeated. A null source is a source of its own; null ids come first
in theirs; rows repeated with one id keep apart. A null or empty text has size 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.llm.common import MARK, stage, table, whole

#: Size of a block in characters, slots of a period, and how far weights lean to even ones (1: by size).
BLOCK, PERIOD, ALPHA = 1 << 16, 1000, 0.7


def whole_parts(weights: Mapping, period: int) -> dict:
    """Parts of the period, at least one each, by largest remainders."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of as many slots")
    total = float(sum(weights.values()))
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    ideal = {s: weights[s] / total * period for s in names}
    parts = {s: max(1, int(ideal[s])) for s in names}
    while (gap := period - sum(parts.values())) != 0:
        step = 1 if gap > 0 else -1
        able = [s for s in names if step > 0 or parts[s] > 1]
        best = max(able, key=lambda s: step * (ideal[s] - parts[s]))
        parts[best] += step
    return parts


def period_table(parts: Mapping, period: int) -> list[tuple]:
    """(source, nth block in the period, slot, release, deadline), by earliest deadline first among those released."""
    names = list(parts)
    waiting = [(0, k, 0) for k in range(len(names))]  # release, source, nth
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []  # deadline, source, nth, release
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, k, nth = heapq.heappop(waiting)
            a = parts[names[k]]
            heapq.heappush(ready, (-(-(nth + 1) * period // a), k, nth, release))
        deadline, k, nth, release = heapq.heappop(ready)
        out.append((names[k], nth, slot, release, deadline))
        if nth + 1 < parts[names[k]]:
            heapq.heappush(waiting, ((nth + 1) * period // parts[names[k]], k, nth + 1))
    return out


def _running(batches: Iterator[pa.RecordBatch], source: str, size: str) -> Iterator[pa.RecordBatch]:
    """Adds the partition and, per source, the size of the rows before in the partition."""
    part = TaskContext.get().partitionId()
    before: dict = {}
    for batch in batches:
        names, sizes = batch.column(source).to_pylist(), batch.column(size).to_numpy()
        at = np.zeros(len(names), np.int64)
        for k, (name, own) in enumerate(zip(names, sizes)):
            at[k] = before.get(name, 0)
            before[name] = at[k] + own
        columns = [*batch.columns, pa.array(np.full(len(names), part, np.int64)), pa.array(at)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, f"{MARK}part", f"{MARK}at"])


def tempered(totals: Mapping, alpha: float = ALPHA) -> dict:
    """Weights by size to a power below one: large sources give way to small ones."""
    return {s: max(n, 1) ** alpha for s, n in totals.items()}


def mix(
    docs: DataFrame, id: str = "doc_id", source: str = "source", size: Column | None = None, weights: Mapping | None = None,
    block: int = BLOCK, period: int = PERIOD,
) -> DataFrame:
    """The rows of docs with __tp_slot, __tp_release, __tp_deadline, __tp_block and __tp_at (its place in the
    source). weights: by source, else by size, tempered. The driver holds one row per source and per slot."""
    spark = docs.sparkSession
    own, mixed, name = f"{MARK}size", f"{MARK}mixed", f"{MARK}source"
    sized = docs.withColumns({
        own: F.greatest(F.coalesce(F.lit(1) if size is None else size, F.lit(1)).cast("long"), F.lit(1).cast("long")),
        mixed: F.xxhash64(id),
        name: F.col(source).cast("string"),
    })
    totals = {r[0]: r[1] for r in sized.groupBy(name).agg(F.sum(own)).collect()}
    if weights is None:
        weights = tempered(totals)
    period = max(period, 4 * len(totals))
    parts = whole_parts({s: weights[s] for s in totals}, period) if totals else {}
    slots = period_table(parts, period) if totals else []

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [name, mixed, id]
    dealt = sized.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*dealt.schema.fields, T.StructField(f"{MARK}part", T.LongType()), T.StructField(f"{MARK}at", T.LongType())])
    ran = stage(dealt.mapInArrow(partial(_running, source=name, size=own), schema), "mixed")

    # A partition is a range of sources: partitions + sources rows at most.
    sums = ran.groupBy(name, f"{MARK}part").agg(F.sum(own).alias(f"{MARK}sum"))
    earlier = Window.partitionBy(name).orderBy(f"{MARK}part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.struct(name).alias(f"{MARK}key"), f"{MARK}part", F.coalesce(F.sum(f"{MARK}sum").over(earlier), F.lit(0)).alias(f"{MARK}before"))
    placed = ran.withColumn(f"{MARK}key", F.struct(name)).join(F.broadcast(before), [f"{MARK}key", f"{MARK}part"])
    at = F.col(f"{MARK}at") + F.col(f"{MARK}before")
    placed = placed.withColumn(f"{MARK}at", at).withColumn(f"{MARK}block", F.floor(F.col(f"{MARK}at") / block).cast("long"))

    # As many rows as the period has slots.
    fields = f"{MARK}name string, {MARK}nth long, {MARK}s long, {MARK}r long, {MARK}d long, {MARK}parts long"
    times = spark.createDataFrame([(*row, parts[row[0]]) for row in slots], fields)
    sizes = spark.createDataFrame(list(parts.items()), f"{MARK}name string, {MARK}own long").select(F.struct(F.col(f"{MARK}name").alias(name)).alias(f"{MARK}key"), f"{MARK}own")
    times = times.select(F.struct(F.col(f"{MARK}name").alias(name)).alias(f"{MARK}key"), f"{MARK}nth", f"{MARK}s", f"{MARK}r", f"{MARK}d")
    known = placed.join(F.broadcast(sizes), f"{MARK}key")
    known = known.withColumn(f"{MARK}nth", F.col(f"{MARK}block") % F.col(f"{MARK}own")).withColumn(
        f"{MARK}start", F.floor(F.col(f"{MARK}block") / F.col(f"{MARK}own")).cast("long") * period
    )
    timed = known.join(F.broadcast(times), [f"{MARK}key", f"{MARK}nth"])
    later = {f"{MARK}{long}": F.col(f"{MARK}{short}") + F.col(f"{MARK}start") for long, short in (("slot", "s"), ("release", "r"), ("deadline", "d"))}
    return timed.withColumns(later).select(*docs.columns, *later, f"{MARK}block", f"{MARK}at")


def mixed_rows(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: Mapping | None = None) -> DataFrame:
    """The rows of docs in the order of their slots: by range over tasks, sorted within each."""
    order = [f"{MARK}slot", f"{MARK}at"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = mix(docs, id, source, F.length(whole(text)), weights)
    return mixed.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*docs.columns)


def op6_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", F.length(whole("text")).alias("size"))
    names = {f"{MARK}{n}": n for n in ("slot", "release", "deadline", "block")}
    return mix(docs, size=F.col("size")).select("doc_id", "source", "size", *[F.col(a).alias(b) for a, b in names.items()])
