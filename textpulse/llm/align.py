"""Alignment of two tokenizers' tokens by their bytes, and how often tokens of the two meet in a corpus.

A is a byte-level BPE, B a piece model that puts a space before a text; A gets the space with the text. Tokens are byte
intervals. All A and B tokens are sorted by start (lexsort), the running maximum of their ends is accumulated, and a group
ends where a start reaches it: there tokens of both end. Within groups every A token is expanded to the B tokens that
its bytes overlap; each such pair of tokens is a link.

Both tokenizers part a text at every space behind a character that is no white space, whatever stands around: A's
pattern lets no token reach over it, and no piece of B holds a space behind another character (checked when B is
loaded). So a text is aligned unit by unit, and a unit met before is taken from a bounded memory. Tests hold the result
against whole texts.

Counts of linked id pairs are a table of at most |A| x |B| rows, range-partitioned by pair. It is stored in the shared
folder; tasks look pairs up in one file of it at a time, so neither is it broadcast nor are the documents' links shuffled.

Null and empty texts, and texts whose tokens do not give back their bytes, have no tokens: counts of 0, empty lists.
Special tokens' strings inside texts are plain text. Very long texts are aligned whole, in one task; units without a space
may be as long as the text. Each row is a document of its own, also with a repeated or null id. Columns besides id and
text are not read, so none can clash. Empty tables give empty tables.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import importable, stage, table, whole
from textpulse.llm.store import stored_blocks
from textpulse.llm.words import _byte_letters
from textpulse.session import scratch_path

#: Units kept per process; beyond that, units are aligned anew in each chunk. Longer ones than UNIT_CHARS are never kept.
KEPT_UNITS, UNIT_CHARS = 300_000, 64
#: Units that are encoded as one text.
JOINED_UNITS = 1 << 14
#: Characters of texts that a task aligns at once, unless one text has more.
CHUNK_CHARS = 2 << 20
#: Rows of the table of pairs that a task holds at once.
BLOCK_PAIRS = 1 << 23

_JOINT = re.compile(r"\s ")


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens by their sizes in bytes, both lists over the same bytes: the group of each A and each B token, and the
    links as places of A and of B."""
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    a_start, b_start = a_end - a_sizes, b_end - b_sizes
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    first = np.searchsorted(b_end, a_start, "right")
    n = np.searchsorted(b_start, a_end, "left") - first
    a = np.repeat(np.arange(len(a_end)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return group[: len(a_end)], group[len(a_end) :], a, b


def _open(unit: str) -> bool:
    """True if a space behind the unit would not part it from the next one."""
    return not unit or unit[-1].isspace()


def _passing(unit: str) -> bool:
    return len(unit) > UNIT_CHARS or _open(unit)


class Aligner(dict):
    """Unit -> row of its alignment."""

    def __init__(self, byte_path: str, piece_path: str, kept: int = KEPT_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        self.kept = kept
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte_of = {letter: b for b, letter in _byte_letters().items()}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        #: Codes of pairs are a * width + b.
        self.width = len(pieces)
        self.code = "int" if len(self.a_bytes) * self.width < 1 << 31 else "long"
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)
        #: Per row: A tokens, B tokens, groups; the groups as text; where its links' codes end.
        self.counts = array("q")
        self.groups: list[str | None] = []
        self.odd: set[int] = set()
        self.codes, self.start = array("q"), array("q", [0])

    def units(self, text: str) -> list[str]:
        """Parts of a text that begin at a space behind no white space; that space is left out, as the first one is."""
        parts = text.split(" ")
        if not self.parts:
            return [text]
        if parts[0] and not _JOINT.search(text):
            return parts
        out = [parts[0]]
        for part in parts[1:]:
            if not out[-1] or out[-1][-1].isspace():
                out[-1] += " " + part
            else:
                out.append(part)
        return out

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B of units one after another, as the tokenizers give them for the text of them all."""
        text = " ".join(units)
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        return np.array(a, np.int64), np.array(self.b.encode(text), np.int64)

    def _whole(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and B and sizes of units in bytes; none if any token reaches over the end of a unit or if the tokens
        do not give back the bytes."""
        bodies = [b" " + u.encode() for u in units]
        sizes = np.array([len(x) for x in bodies], np.int64)
        a, b = self._encode(units)
        body = b"".join(bodies)
        if any(b"".join(map(held.__getitem__, ids.tolist())) != body for ids, held in ((a, self.a_bytes), (b, self.b_bytes))):
            return None
        ends = np.cumsum(sizes)
        for ids, held in ((a, self.a_sizes), (b, self.b_sizes)):
            token_ends = np.cumsum(held[ids])
            if not np.array_equal(token_ends[np.searchsorted(token_ends, ends)], ends):
                return None
        return a, b, sizes

    def _learn(self, units: list[str]) -> None:
        """Align units that are not known. A unit whose tokens do not give back its bytes has no groups."""
        # Those that end in white space, or are empty, stand alone: the next one's space would not part them.
        plain = [u for u in units if not _open(u)]
        for at in range(0, len(plain), JOINED_UNITS):
            part = plain[at : at + JOINED_UNITS]
            if self.parts and (found := self._whole(part)):
                self._add(part, *found)
            else:
                self._learn_each(part)
        self._learn_each([u for u in units if _open(u)])

    def _learn_each(self, units: list[str]) -> None:
        for unit in units:
            if found := self._whole([unit]):
                self._add([unit], *found)
            else:
                self.odd.add(len(self.groups))
                self[unit] = len(self.groups)
                self.groups.append(None)
                self.counts.extend((0, 0, 0))
                self.start.append(len(self.codes))

    def _add(self, units: list[str], a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> None:
        a_group, b_group, a_link, b_link = coalesce(self.a_sizes[a], self.b_sizes[b])
        ends = np.cumsum(sizes)
        a_end = np.searchsorted(np.cumsum(self.a_sizes[a]), ends) + 1
        b_end = np.searchsorted(np.cumsum(self.b_sizes[b]), ends) + 1
        link_end = np.searchsorted(a_link, a_end, "left")
        n_a, n_b = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
        n_groups = np.diff(a_group[a_end - 1] + 1, prepend=0)
        # All ids in the order of groups, A before B, each with what comes between it and the next.
        group = np.concatenate([a_group, b_group])
        side = np.repeat([0, 1], [len(a), len(b)])
        unit = np.concatenate([np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)])
        order = np.lexsort((side, group))
        group, side, unit = group[order], side[order], unit[order]
        between = np.where(group[1:] == group[:-1], side[1:] - side[:-1], np.where(unit[1:] == unit[:-1], 2, 3))
        ids = np.concatenate([a, b])[order]
        pieces = [""] * (2 * len(ids))
        pieces[::2] = map(str, ids.tolist())
        pieces[1::2] = [*map(",|;\n".__getitem__, between.tolist()), ""]
        first = len(self.groups)
        self.groups.extend("".join(pieces).split("\n"))
        self.update(zip(units, range(first, first + len(units))))
        self.counts.frombytes(np.stack([n_a, n_b, n_groups], 1).astype(np.int64).tobytes())
        base = len(self.codes)
        self.codes.frombytes((a[a_link] * self.width + b[b_link]).tobytes())
        self.start.frombytes((link_end + base).astype(np.int64).tobytes())

    def _forget(self, rows: int, units: list[str]) -> None:
        for unit in units:
            del self[unit]
        del self.groups[rows:], self.counts[3 * rows :], self.start[rows + 1 :]
        self.odd = {row for row in self.odd if row < rows}
        del self.codes[self.start[-1] :]

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """Of each text: numbers of A tokens, B tokens and groups, the groups as text, the codes of its links."""
        cut = [self.units(t) if t else [] for t in texts]
        known = len(self.groups)
        new = list(dict.fromkeys(u for units in cut for u in units if u not in self))
        # Those that are not kept come last, so that the memory can end before them.
        new.sort(key=_passing)
        if new:
            self._learn(new)
        rows = [list(map(self.__getitem__, units)) for units in cut]
        odd = [k for k, r in enumerate(rows) if not self.odd.isdisjoint(r)] if self.odd else []
        again = []
        for k in odd:
            # The text as one unit, as both tokenizers see it.
            if texts[k] not in self:
                self._learn([texts[k]])
                again.append(texts[k])
            row = self[texts[k]]
            rows[k] = [row] if self.groups[row] is not None else []
        flat = np.fromiter(chain.from_iterable(rows), np.int64)
        counts, start, codes = np.array(self.counts).reshape(-1, 3), np.array(self.start), np.array(self.codes)
        first, n = start[flat], start[flat + 1] - start[flat]
        links = codes[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        out, unit_at, link_at = [], 0, 0
        ends = np.cumsum(n)
        for r in rows:
            unit_end = unit_at + len(r)
            link_end = int(ends[unit_end - 1]) if unit_end else 0
            sums = counts[flat[unit_at:unit_end]].sum(0).tolist()
            out.append((*sums, ";".join([self.groups[x] for x in r]), links[link_at:link_end]))
            unit_at, link_at = unit_end, link_end
        keep = len(new) - sum(map(_passing, new))
        keep = keep if known + keep <= self.kept else 0
        self._forget(known + keep, new[keep:] + again)
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One per process and pair of files."""
    key = byte_path, piece_path
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def align_tokens(docs: DataFrame, byte_path: str, piece_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, n_a, n_b, n_groups, n_links, groups as text (`a1,a2|b1;a3|b2,b3`), and the distinct linked pairs as
    codes (a id * |B| + b id, ascending) with how often each is linked, times."""
    importable(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), whole(text).alias("text"))
    kind, code = dict(rows.dtypes)["id"], Aligner(byte_path, piece_path).code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = aligner(byte_path, piece_path)
        pair = pa.int32() if code == "int" else pa.int64()
        for batch in batches:
            ids, bodies = batch.column(0), batch.column(1)
            first, held, texts = 0, 0, []
            for k in range(batch.num_rows):
                texts.append(bodies[k].as_py())
                held += len(texts[-1])
                if held < CHUNK_CHARS and k < batch.num_rows - 1:
                    continue
                found = coder.align(texts)
                sizes = [len(x[4]) for x in found]
                doc = np.repeat(np.arange(len(found)), sizes)
                links = np.concatenate([x[4] for x in found])
                order = np.lexsort((links, doc))
                doc, links = doc[order], links[order]
                new = np.ones(len(links), bool)
                new[1:] = (links[1:] != links[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                offsets = np.searchsorted(doc[at], np.arange(len(found) + 1)).astype(np.int32)
                times = np.diff(np.append(at, len(links)))
                columns = [
                    ids.slice(first, len(texts)), *(pa.array([x[c] for x in found], pa.int64()) for c in range(3)), pa.array(sizes, pa.int64()),
                    pa.array([x[3] for x in found], pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(links[at], pair)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(times, pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
                first, held, texts = k + 1, 0, []

    counts = "n_a long, n_b long, n_groups long, n_links long"
    return rows.mapInArrow(run, f"id {kind}, {counts}, groups string, pairs array<{code}>, times array<int>").withColumnRenamed("id", id)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(code, a, b, n, best): in how many rows each pair is linked, and whether no pair of its A id is in more."""
    counts = stage(aligned.select(F.explode("pairs").alias("code")).groupBy("code").agg(F.count("*").alias("n")), "pairs")
    a, b = F.floor(F.col("code") / width).cast("int"), (F.col("code") % width).cast("int")
    named = counts.select("code", a.alias("a"), b.alias("b"), "n")
    most = named.groupBy("a").agg(F.max("n").alias("most"))
    return named.join(most, "a").select("code", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _sorted(rows: pa.Table) -> tuple[np.ndarray, ...]:
    rows = rows.sort_by("code")
    return tuple(rows.column(c).to_numpy() for c in ("code", "n", "best"))


def score_links(aligned: DataFrame, counts: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The rows of aligned with n_best, links of a pair that no other of its A id exceeds, and count_sum, the sum of the
    pairs' counts over all links."""
    held = stage(counts.select("code", "n", "best"), "pair-counts")
    path = scratch_path(aligned.sparkSession, "pair-blocks")
    held.repartitionByRange(max(1, -(-held.count() // block_pairs)), "code").write.parquet(path)
    rest = [c for c in aligned.columns if c not in ("pairs", "times")]
    kinds = dict(aligned.dtypes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            codes, weight = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            total, best = np.zeros((2, len(codes)), np.int64)
            for keys, n, top in stored_blocks(path, ["code", "n", "best"], len, block_pairs, _sorted):
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
                    met = keys[at] == codes
                    total += np.where(met, n[at], 0)
                    best += met & top[at]
            offsets = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(x * weight)])[offsets] for x in (best, total)]
            columns = [*(batch.column(c) for c in rest), *(pa.array(np.diff(s), pa.int64()) for s in sums)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "n_best", "count_sum"])

    return aligned.mapInArrow(look, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", n_best long, count_sum long")


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = align_tokens(table(spark, folder, "documents"), *paths)
    told = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    kept = stage(aligned.withColumn("groups_sha256", told).drop("groups"), "aligned")
    scored = score_links(kept, pair_counts(kept, aligner(*paths).width))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
