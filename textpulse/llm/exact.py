"""Exact dedup: a binary-fuse filter per immutable snapshot screens the digests of an incoming batch.

Only digests move between tasks until the byte check. A snapshot is a table of one row per digest, dealt to
buckets, with one filter per bucket. An incoming batch is first grouped by itself, so that its digests are
distinct and its buckets even; what the filters let through joins the snapshot's buckets. Rows whose digest
occurs more than once, and only those, have their whole texts compared.

Null texts count as empty. Very long texts are digested whole; only the smallest and largest text of a group with copies is
compared. Columns besides id and text are kept by distinct_texts and read by nothing; helper columns have a prefix of
their own. Null ids come after all others. Rows repeated with the same id are copies of one
another: all of them carry the same keep_id; `distinct_texts` still returns one row of a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm import fuse
from textpulse.llm.common import MARK, hot_keys, lookup, stage, table, union_all, whole

#: Digests for which one filter is built in one task: about 600 KB of slots.
BUCKET_KEYS = 500_000
_FILTER = "bucket int, seed long, segment int, segments int, slots binary"


def normalised(text: str | Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(whole(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Snapshot:
    """An immutable set of texts: groups (digest, first_id, n, bucket) and a filter per bucket."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def _keys(digests: pd.Series) -> np.ndarray:
    """The first eight bytes of each digest as an unsigned number."""
    return np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests), dtype="<u8").astype(np.uint64)


def _build(part: pd.DataFrame) -> pd.DataFrame:
    f = fuse.build(_keys(part["digest"]))
    rows = [(int(part["bucket"].iloc[0]), f.seed, f.segment, f.segments, f.slots)]
    return pd.DataFrame(rows, columns=["bucket", "seed", "segment", "segments", "slots"])


def group_batch(rows: DataFrame) -> DataFrame:
    """One row per digest of a batch: first_id and n. Partial sums before the shuffle keep copies even."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def take_snapshot(groups: DataFrame, bucket_keys: int = BUCKET_KEYS) -> Snapshot:
    """Deal groups of distinct digests to even buckets and build each bucket's filter."""
    held = groups.agg(F.count("*")).first()[0]
    buckets = max(1, -(-held // bucket_keys))
    dealt = groups.withColumn("bucket", _bucket(buckets))
    filters = dealt.select("bucket", "digest").groupBy("bucket").applyInPandas(_build, _FILTER)
    return Snapshot(stage(dealt, "snapshot"), stage(filters, "filters"), buckets)


def _screen(asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if len(asked) == 0:
        return pd.DataFrame({"digest": pd.Series([], dtype=object)})
    maybe = np.zeros(len(asked), bool)
    keys = _keys(asked["digest"])
    for f in filters.itertuples():
        maybe |= fuse.ask(fuse.Fuse(int(f.seed), int(f.segment), int(f.segments), f.slots), keys)
    return asked.loc[maybe, ["digest"]]


def screen(groups: DataFrame, snapshot: Snapshot, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Digests of an incoming batch that the snapshot's filters let through. A batch that is larger than the snapshot
    has its buckets cut into parts by a second hash, and each part gets the bucket's filter, so that a task holds
    about bucket_keys digests whatever the two sizes are."""
    parts = max(1, -(-groups.count() // (snapshot.buckets * bucket_keys)))
    part = F.pmod(F.xxhash64("digest", F.lit("part")), F.lit(parts)).cast("int").alias("part")
    asked = groups.select(_bucket(snapshot.buckets).alias("bucket"), part, "digest")
    filters = snapshot.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = asked.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part"))
    return pairs.applyInPandas(_screen, "digest binary")


def find_in(incoming: DataFrame, snapshots: list[Snapshot]) -> DataFrame:
    """(digest, earlier_id, earlier_n) of the incoming digests that exact buckets of the snapshots hold.

    Only what a filter let through joins its snapshot's bucket; the filter's false positives find no row there.
    """
    found = [
        s.groups.select("digest", F.col("first_id").alias("earlier_id"), F.col("n").alias("earlier_n")).join(
            screen(incoming, s), "digest", "left_semi"
        )
        for s in snapshots
    ]
    return union_all(found).groupBy("digest").agg(F.min("earlier_id").alias("earlier_id"), F.sum("earlier_n").alias("earlier_n"))


def copy_groups(digested: DataFrame, early: Column) -> DataFrame:
    """(digest, keep_id, group_size) of digests on more than one row.

    digested: (doc_id, digest), staged. Rows where early holds are the snapshot, the others the incoming batch.
    A group is one of: copies inside the incoming batch that the snapshot lacks; copies inside the snapshot that
    no incoming row hits; incoming rows, copies or not, that hit the snapshot.
    """
    before = stage(group_batch(digested.filter(early)), "before")
    incoming = stage(group_batch(digested.filter(~early)), "incoming")
    snapshot = take_snapshot(before)
    hits = stage(find_in(incoming, [snapshot]), "hits")
    new, old = incoming.join(hits, "digest", "left_anti"), snapshot.groups.join(hits, "digest", "left_anti")
    alone = [
        g.filter("n > 1").select("digest", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size")) for g in (new, old)
    ]
    met = incoming.join(hits, "digest").select(
        "digest", F.least("first_id", "earlier_id").alias("keep_id"), (F.col("n") + F.col("earlier_n")).alias("group_size")
    )
    return union_all([*alone, met])


def byte_check(docs: DataFrame, groups: DataFrame, hot: list, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of groups whose rows do not all hold the same bytes; none, unless the hash function collides.

    The smallest and the largest text of a group are equal when all are. Both are partial aggregates, so the
    rows of a hot group need not meet.
    """
    texts = docs.select(F.col(id).alias("doc_id"), normalised(text).alias("body")).withColumn("digest", sha256(F.col("body")))
    # Always dealt by digest, however few the groups are, so that the plan is the same at every size.
    asked = lookup(texts, "digest", groups.select("digest").hint("merge"), hot, "doc_id", "inner")
    ends = asked.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    return ends.filter(F.col("low") != F.col("high")).select("digest")


def _early(docs: DataFrame, id: str) -> Column:
    """The lower half of the ids: what came first is the snapshot, the rest, and null ids, the incoming batch."""
    middle = docs.agg(F.percentile_approx(id, 0.5)).first()[0]
    return F.coalesce(F.col(id) <= F.lit(middle), F.lit(False))


def find_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, list]:
    """(doc_id, digest) of every row; (digest, keep_id, group_size) of texts on several rows; hot digests."""
    digested = stage(docs.select(F.col(id).alias("doc_id"), sha256(normalised(text)).alias("digest")), "digests")
    groups = stage(copy_groups(digested, _early(digested, "doc_id")), "groups")
    hot = hot_keys(groups, "digest", "group_size")
    mixed = byte_check(docs, groups, hot, id, text).limit(1).collect()
    if mixed:
        raise ValueError(f"different texts share the SHA-256 digest {bytes(mixed[0][0]).hex()}")
    return digested, groups, hot


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    digested, groups, hot = find_copies(docs, id, text)
    copy = F.col("group_size").isNotNull()
    keep = F.when(copy, F.col("keep_id")).otherwise(F.col("doc_id"))
    return lookup(digested, "digest", groups, hot, "doc_id").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the smallest id."""
    digested, groups, hot = find_copies(docs, id, text)
    digest, keep = f"{MARK}digest", f"{MARK}keep"
    found = groups.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.lit(True).alias(f"{MARK}copy"))
    rows = docs.withColumn(digest, sha256(normalised(text)))
    joined = lookup(rows, digest, found, hot, id)
    is_copy = F.col(f"{MARK}copy").isNotNull()
    stay = joined.filter(~is_copy | F.col(keep).eqNullSafe(F.col(id)))
    # Rows repeated with the id that stays: only then is a second look for one of them needed.
    repeated = lookup(digested, "digest", groups, hot, "doc_id", "inner").filter(F.col("keep_id").eqNullSafe(F.col("doc_id")))
    tied = repeated.groupBy("digest").count().filter("count > 1").limit(1).collect()
    if tied:
        stay = union_all([stay.filter(~is_copy), stay.filter(is_copy).dropDuplicates([digest])])
    return stay.select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
