"""Periodic runs of words, and texts with the repeats of runs collapsed.

A run is a stretch of consecutive words in which words q apart are identical, q being its smallest period, that is at
least max(12, 2 q) words long and that no neighbouring word extends. Texts are cut into overlapping tiles, one set
per octave of periods [P, 2P); a tile gives, around each of its boundaries, the stretches of every such period by the
Z-functions of the words after and before the boundary; fragments are shuffled by (document, period) and stitched where
they overlap by a period, which two runs of one period never do.

Sizes: a stretch [s, e) of period p has e - p - s >= 2 b words that recur p words later, b from the octave alone. So it
holds a boundary, as these lie 2 b apart, and beside it a whole aligned block of b words that recurs p words on. Only
boundaries beside such a block are solved; blocks are compared by hashes, which may let more boundaries through but
never fewer. A window of 2P words before and 4P after each boundary shows at least 2 p words of any run, and the windows
of neighbouring boundaries share at least p words of it. Work is n log n in the words of a text.

Null texts count as empty: no words, no runs. Very long texts are read by one task, word by word, but solved in tiles
by many. Each row stands for itself, also with a repeated or null id; no row meets another. Columns besides id and
text are not read, so none can clash. Empty tables give empty tables.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpulse.llm.common import stage, table, whole

#: Least words of a run.
LEAST = 12
#: Words of a tile between its first and last boundary, at least; four octave lengths for long periods.
TILE_WORDS = 4096
#: Words whose blocks are compared at once in a task, unless one text has more.
BATCH_WORDS = 1 << 18
#: Octaves up to this one are solved for many boundaries at once, that many words at a time; wider ones each by a scan.
NARROW = 128
WINDOW_WORDS = 1 << 17
_SLOTS = 1 << 20
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

RUNS = "array<struct<start: long, length: long, period: long>>"
_TILES = "key long, id {id}, n_words long, tiled boolean, text binary, octave int, at long, words array<int>, bounds array<int>"


def octaves(n: int) -> list[int]:
    """Octaves whose periods can fill a run in n words."""
    out, p = [], 1
    while n >= max(LEAST, 2 * p):
        out.append(p)
        p *= 2
    return out


def block_of(octave: int) -> int:
    """Words of a block: at most half of the least max(12, 2 p) - p of the octave."""
    return {1: 4, 2: 4, 4: 3}.get(octave, octave // 2)


def reach(octave: int) -> tuple[int, int]:
    """Words before and after a boundary that its window shows."""
    return 2 * max(octave, 16), 4 * max(octave, 16)


# --- where a tile is worth solving ----------------------------------------------------------------


def _hashes(ids: np.ndarray) -> dict[int, np.ndarray]:
    h = (ids.astype(np.uint64) + np.uint64(1)) * _K1
    return {1: h ^ (h >> np.uint64(31))}


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left[: len(right)] * _K1 + (right ^ (right >> np.uint64(29))) * _K2


def boundaries(ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, places) of boundaries beside a block that recurs within the octave. Texts lie one after another,
    longest first; sizes are their numbers of words."""
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes
    place = (np.arange(len(ids)) - np.repeat(starts, sizes)).astype(np.int32)
    levels = _hashes(ids)

    def level(b: int) -> np.ndarray:
        if b not in levels:
            half = 2 if b == 3 else b // 2
            low = level(half)
            levels[b] = _joined(low, level(b - half)[half:])
            for old in [x for x in levels if x < half and x > 2]:
                del levels[old]
        return levels[b]

    for octave in octaves(int(sizes[0]) if len(sizes) else 0):
        b = block_of(octave)
        texts = int(np.searchsorted(-sizes, -max(LEAST, 2 * octave), "right"))
        h = level(b)[: max(0, int(ends[texts - 1]) - b + 1)]
        slot = (h >> np.uint64(44)).astype(np.int32)
        aligned = np.flatnonzero(place[: len(h)] % 3 == 0 if b == 3 else place[: len(h)] & (b - 1) == 0)
        # Whose block shares a slot with an aligned block that is not itself.
        mine = slot[aligned]
        last = np.empty(_SLOTS, np.int32)
        last[mine] = aligned
        held = np.zeros(_SLOTS, np.uint8)
        held[mine] = 1
        held[mine[last[mine] != aligned]] = 2
        other = held[slot]
        other[aligned] -= 1
        later = np.flatnonzero(other)
        if not len(later):
            continue
        met = np.zeros(_SLOTS, bool)
        met[slot[later]] = True
        asked = aligned[met[mine]]
        order = np.argsort(h[later], kind="stable")
        keys, places = h[later][order], later[order]
        group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
        listed = (group << 40) + places
        at = np.minimum(np.searchsorted(keys, h[asked]), len(keys) - 1)
        found = np.searchsorted(listed, (group[at] << 40) + asked + octave)
        inside = np.minimum(found, len(keys) - 1)
        end = ends[np.searchsorted(starts[:texts], asked, "right") - 1]
        live = (found < len(keys)) & (keys[inside] == h[asked]) & (places[inside] < asked + 2 * octave) & (places[inside] + b <= end)
        asked = asked[live]
        if len(asked):
            # Even blocks begin at a boundary, odd ones end at one.
            yield octave, np.unique(np.where(place[asked] // b % 2 == 0, asked, asked + b))


# --- solving --------------------------------------------------------------------------------------


def _common(s: np.ndarray, a: int, b: int) -> int:
    """Length of the common beginning of s[a:] and s[b:], a < b."""
    rest, done, step = len(s) - b, 0, 32
    while done < rest:
        m = min(step, rest - done)
        odd = s[a + done : a + done + m] != s[b + done : b + done + m]
        first = int(odd.argmax())
        if odd[first]:
            return done + first
        done += m
        step *= 4
    return rest


def z_function(s: np.ndarray, first: int, last: int) -> np.ndarray:
    """z[i], the length of the common beginning of s and s[i:], for first <= i < last; places before first are worked
    out too, as the scan needs them."""
    z = np.zeros(max(last, 1), np.int64)
    z[1:last] = s[1:last] == s[:1]
    left = right = 0
    # Places where the second word differs too need no scan.
    more = z[1:last].astype(bool) & (np.append(s[2 : last + 1], -3)[: last - 1] == s[1:2])
    for i in (np.flatnonzero(more) + 1).tolist():
        k = min(right - i, int(z[i - left])) if i < right else 0
        if i + k >= right:
            k += _common(s, k, i + k)
            left, right = i, i + k
        z[i] = k
    return z[first:last]


def _wide(words: np.ndarray, bound: int, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """For each period below 2P: equal words after the boundary, and before it, that are a period apart."""
    before, after = reach(octave)
    low = max(0, bound - before)
    right, left = words[bound : bound + after], words[low:bound][::-1]
    last = min(2 * octave, len(right) + 1)
    forward, backward = np.zeros((2, 2 * octave), np.int64)
    forward[1:last] = np.append(z_function(right, 1, min(last, len(right))), 0)[: last - 1]
    if len(left):
        back = words[low : bound + last - 1][::-1]
        z = z_function(np.concatenate([left, [-1], back]), len(left) + 1, len(left) + 1 + last - 1)
        backward[1:last] = z[::-1][: last - 1]
    return forward, backward


def _narrow(words: np.ndarray, bounds: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many boundaries at once: z-values by comparing all windows with themselves, a period apart."""
    before, after = reach(octave)
    window = words[bounds[:, None] + np.arange(-before, after)]
    forward, backward = np.zeros((2, len(bounds), 2 * octave), np.int64)
    odd = np.ones((len(bounds), after + 1), bool)
    for p in range(1, 2 * octave):
        np.not_equal(window[:, before : before + after - p], window[:, before + p :], out=odd[:, : after - p])
        odd[:, after - p] = True
        forward[:, p] = odd[:, : after - p + 1].argmax(1)
        np.not_equal(window[:, before - 1 :: -1], window[:, before + p - 1 : p - 1 : -1], out=odd[:, :before])
        odd[:, before] = True
        backward[:, p] = odd[:, : before + 1].argmax(1)
    return forward, backward


def _primes(p: int) -> list[int]:
    out, d = [], 2
    while d * d <= p:
        if p % d == 0:
            out.append(d)
            while p % d == 0:
                p //= d
        d += 1
    return out + [p] if p > 1 else out


def solve(tiles: list[tuple[np.ndarray, np.ndarray]], octave: int) -> np.ndarray:
    """Rows (tile, period, start, end) of stretches of a period in the octave, the smallest of the stretch, that the
    windows of the boundaries of tiles (words, boundaries) show; joined where they overlap by a period."""
    found = []
    before, after = reach(octave)
    if octave <= NARROW:
        # Tiles one after another, so far apart that no window shows two.
        size = np.array([len(w) + before + after for w, _ in tiles])
        shift = np.cumsum(size) - size + before
        words = np.full(int(size.sum()), -1, np.int32)
        for (w, _), at in zip(tiles, shift.tolist()):
            words[at : at + len(w)] = w
            words[at + len(w) : at + len(w) + after] = -2
        tile = np.repeat(np.arange(len(tiles)), [len(b) for _, b in tiles])
        bounds = np.concatenate([b for _, b in tiles])
        step = max(1, WINDOW_WORDS // (before + after))
        parts = [slice(k, k + step) for k in range(0, len(bounds), step)]
        pairs = ((tile[k], bounds[k], *_narrow(words, bounds[k] + shift[tile[k]], octave)) for k in parts)
    else:
        each = ((t, w, c) for t, (w, b) in enumerate(tiles) for c in b.tolist())
        pairs = ((np.array([t]), np.array([c]), *(x[None] for x in _wide(w, c, octave))) for t, w, c in each)
    periods = np.arange(2 * octave)
    least = np.maximum(LEAST, 2 * periods)
    for owner, places, forward, backward in pairs:
        long = forward + backward + periods >= least
        long[:, :octave] = False
        rows, ps = np.nonzero(long)
        f, k = forward[rows, ps], backward[rows, ps]
        smallest = np.ones(len(ps), bool)
        for p in np.unique(ps).tolist():
            here = np.flatnonzero(ps == p)
            r = rows[here]
            for prime in _primes(p):
                q = p // prime
                smallest[here] &= (forward[r, q] + q < p + f[here]) | (backward[r, q] < k[here])
        c = places[rows]
        found.append(np.stack([owner[rows], ps, c - k, c + ps + f], 1)[smallest])
    return stitched(np.concatenate(found)) if found else np.zeros((0, 4), np.int64)


def stitched(rows: np.ndarray) -> np.ndarray:
    """Rows (tile, period, start, end), those of a tile and period that overlap by the period joined."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    tile, period, start, end = rows.T
    new = np.concatenate([[True], (period[1:] != period[:-1]) | (tile[1:] != tile[:-1])])
    group = np.cumsum(new) << 40
    most = np.maximum.accumulate(group + end) - group
    new[1:] |= start[1:] + period[1:] > most[:-1]
    first = np.flatnonzero(new)
    return np.stack([tile[first], period[first], start[first], np.maximum.reduceat(end, first)], 1)


# --- jobs -----------------------------------------------------------------------------------------


def _lists(parts: tuple[np.ndarray, ...]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, []]).astype(np.int32)))


def _tiled(words: list[list[bytes]]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(text, octave, first word, words, boundaries) of the tiles to be solved."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    known: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words[k] for k in order.tolist())), np.int32, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    for octave, places in boundaries(ids, sizes):
        before, after = reach(octave)
        text = np.searchsorted(starts, places, "right") - 1
        place = places - starts[text]
        tile = place // max(TILE_WORDS, 4 * octave)
        cut = np.flatnonzero((np.diff(text) != 0) | (np.diff(tile) != 0)) + 1
        for part in np.split(np.arange(len(places)), cut):
            t = int(text[part[0]])
            low = max(0, int(place[part[0]]) - before)
            high = min(int(sizes[t]), int(place[part[-1]]) + after)
            yield int(order[t]), octave, low, ids[starts[t] + low : starts[t] + high], place[part] - low


def tiles(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs one row of its text (key, id, n_words, tiled, text: its words joined by one space) without an octave,
    and one row per tile to be solved (key, octave, at, words as numbers, bounds). Keys number the rows; a task that runs
    again writes all of its rows anew, so they hold together once the table is stored."""
    kind = dict(docs.select(F.col(id).alias("id")).dtypes)["id"]
    rows = docs.select(F.col(id).alias("id"), whole(text).cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33

        def rows_of(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        def flush(ids: pa.Array, words: list[list[bytes]], key: int) -> Iterator[pa.RecordBatch]:
            found = list(_tiled(words))
            tiled = np.zeros(len(words), bool)
            tiled[[x[0] for x in found]] = True
            keys = pa.array(range(key, key + len(words)), pa.int64())
            sizes = pa.array([len(w) for w in words], pa.int64())
            yield rows_of(key=keys, id=ids, n_words=sizes, tiled=pa.array(tiled), text=pa.array([b" ".join(w) for w in words], pa.binary()))
            for first in range(0, len(found), 512):
                text, octave, at, ws, bs = zip(*found[first : first + 512])
                keys = pa.array([key + t for t in text], pa.int64())
                yield rows_of(key=keys, octave=pa.array(octave, pa.int32()), at=pa.array(at, pa.int64()), words=_lists(ws), bounds=_lists(bs))

        schema = None
        for batch in batches:
            ints = pa.list_(pa.int32())
            schema = pa.schema(
                [("key", pa.int64()), ("id", batch.column(0).type), ("n_words", pa.int64()), ("tiled", pa.bool_()), ("text", pa.binary()),
                 ("octave", pa.int32()), ("at", pa.int64()), ("words", ints), ("bounds", ints)]
            )
            first, held, words = 0, 0, []
            for k, body in enumerate(batch.column(1)):
                # Bytes are split at space and \t to \r, no other characters.
                words.append(body.as_py().split())
                held += len(words[-1])
                if held >= BATCH_WORDS or k == batch.num_rows - 1:
                    yield from flush(batch.column(0).slice(first, len(words)), words, key)
                    key += len(words)
                    first, held, words = k + 1, 0, []

    return rows.mapInArrow(cut, _TILES.format(id=kind))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, octaves, at = (batch.column(c).to_numpy() for c in ("key", "octave", "at"))
        words, bounds = ([x.values.to_numpy() for x in batch.column(c)] for c in ("words", "bounds"))
        for octave in np.unique(octaves).tolist():
            here = np.flatnonzero(octaves == octave)
            tile, period, start, end = solve([(words[k], bounds[k]) for k in here.tolist()], octave).T
            columns = (keys[here[tile]], period, start + at[here[tile]], end + at[here[tile]])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "period", "start", "end"])


def stitch(fragments: DataFrame) -> DataFrame:
    """(key, period, start, end) of whole runs. A text has one fragment per tile and period at most that run into each
    other, so a window holds no more rows than a text has tiles."""
    by = Window.partitionBy("key", "period").orderBy("start", "end")
    most = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") + F.col("period") > most, F.lit(True))
    numbered = fragments.withColumn("new", new).withColumn("run", F.count_if("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for body, runs in zip(batch.column("text"), batch.column("runs").to_pylist()):
            words = body.as_py().split()
            if runs:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [r["start"] + r["period"] for r in runs], 1)
                np.add.at(edge, [r["start"] + r["length"] for r in runs], -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
            texts.append(b" ".join(words))
        out = {"id": batch.column("id"), "n_words": batch.column("n_words"), "runs": batch.column("runs"), "collapsed": pa.array(texts, pa.binary())}
        yield pa.RecordBatch.from_pydict(out)


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, runs in the order of (start, period), and collapsed, the words that are in no run
    after its first period, joined by one space. With digest, collapsed is the SHA-256 of that text in hex instead,
    so that texts without a tile to solve are stored as their digest only."""
    kind = dict(docs.select(F.col(id).alias("id")).dtypes)["id"]

    def told(body: Column) -> Column:
        return F.sha2(body, 256) if digest else body.cast("string")

    cut = tiles(docs, id, text).withColumn("collapsed", F.when(~F.col("tiled"), told(F.col("text"))))
    kept = stage(cut.withColumn("text", F.when(F.col("tiled"), F.col("text"))), "tiles")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept.filter("octave is not null").select("key", "octave", "at", "words", "bounds").repartition(n, "key", "octave", "at")
    runs = stitch(dealt.mapInArrow(_fragments, "key long, period long, start long, end long"))
    row = F.struct("start", (F.col("end") - F.col("start")).alias("length"), F.col("period"))
    listed = runs.groupBy("key").agg(F.sort_array(F.collect_list(row)).alias("runs"))
    none = F.array().cast(RUNS)
    texts = kept.filter("octave is null")
    solved = texts.filter("tiled").select("key", "id", "n_words", "text").join(listed, "key", "left")
    solved = solved.select("id", "n_words", "text", F.coalesce("runs", none).alias("runs"))
    collapsed = solved.mapInArrow(_collapse, f"id {kind}, n_words long, runs {RUNS}, collapsed binary")
    rest = texts.filter("not tiled").select("id", "n_words", none.alias("runs"), "collapsed")
    both = collapsed.withColumn("collapsed", told(F.col("collapsed"))).unionByName(rest)
    return both.select(F.col("id").alias(id), "n_words", "runs", "collapsed")


def with_planted_runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text): in a tenth of the rows, told by the CRC-32 h of the id, the words from a place on repeat those of one
    period, as often as h says."""
    h = F.crc32(F.col(id).cast("string").cast("binary"))
    words = F.regexp_extract_all(whole(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(x: Column) -> Column:
        w, g = x["w"], x["g"]
        n = F.size(w)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")

    # The one-element array holds the words, so that they are worked out once.
    held = F.array(F.struct(words.alias("w"), F.floor(h / 10).cast("long").alias("g")))
    planted = F.get(F.transform(held, repeated), F.lit(0))
    return docs.select(id, F.when(h % 10 == 0, planted).otherwise(whole(text)).alias(text))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, folder, "documents")), digest=True)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    order = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))
    best = F.array_max(F.transform("runs", order))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
    length, start, period = F.col("best.length"), -F.col("best.before"), -F.col("best.shorter")
    return told.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
