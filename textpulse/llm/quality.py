"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

Words enter as log counts of unit length in a hashed space, statistics and metadata as standardised numbers. The
machine gives every pair of them an interaction of low rank and scores a text in time linear in its words.

Null texts count as empty; an empty text has the statistics of one, and a score. A null length (metadata) is
replaced by the text's own. Without labels of both classes every score is the share of label 1, or 0.5 if none.
Labels, lang, source and doc_id are no inputs. Rows repeated with one id are scored alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import table, whole
from textpulse.llm.labelled import held_out, training_labels
from textpulse.llm.machine import Machine, pack, probability, train

#: Size of the hashed word space, rank of the interactions.
WORDS, RANK = 1 << 15, 8
#: Labelled rows to learn from at most: their features are held by the driver.
MAX_LABELLED = 12_000
THRESHOLD = 0.7
REMEMBERED = 400_000

_WORD = re.compile(r"\w+")
_KINDS = ("lower", "upper", "digit", "space", "mark", "symbol", "exclamation", "other")


def _kind_table() -> np.ndarray:
    """Kind of each character below 65,536; the last entry is for those above."""
    kinds = np.full((1 << 16) + 1, 7, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        if c.islower():
            kinds[k] = 0
        elif c.isupper():
            kinds[k] = 1
        elif c.isdigit():
            kinds[k] = 2
        elif c.isspace():
            kinds[k] = 3
        elif c in "#*$%&|<>=~^{}[]\\+@_":
            kinds[k] = 5
        elif c == "!":
            kinds[k] = 6
        elif k < 128 or 0x2000 <= k < 0x2070:
            kinds[k] = 4
    return kinds


_KIND_OF: list[np.ndarray] = []
STATISTICS = (
    *_KINDS, "words", "word length", "longest word", "distinct words", "commonest word", "lines", "repeated lines",
    "words in repeated triples", "words a line", "marked word ends",
)


class Places(dict):
    """Word -> place in the hashed space and a 64-bit mix of it."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = zlib.crc32(word.encode())
        return value


def _triples(codes: np.ndarray) -> float:
    """Share of words that lie in a three-word window found twice or more."""
    n = len(codes)
    if n < 4:
        return 0.0
    c = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) + (c[2:] * np.uint64(0x165667B19E3779F9))
    _, place, count = np.unique(mixed, return_inverse=True, return_counts=True)
    again = count[place] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return float(covered.mean())


def statistics(text: str, codes: np.ndarray, words: list[str]) -> np.ndarray:
    """Numbers on the make-up of a text, about 0 to 10 each."""
    if not _KIND_OF:
        _KIND_OF.append(_kind_table())
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 1 << 16)
    kinds = np.bincount(_KIND_OF[0][points], minlength=8) / max(len(points), 1)
    lines = [line for line in text.split("\n") if line.strip()]
    n = max(len(words), 1)
    _, count = np.unique(codes, return_counts=True)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    marks = sum(text.count(m) for m in ("!! ", "*** ", "### ", "$$$ ", "%%% ", "&&& ", " | ")) if kinds[5] + kinds[6] > 0 else 0
    own = [
        np.log1p(len(words)), lengths.mean() if len(words) else 0.0, np.log1p(lengths.max(initial=0)), len(count) / n,
        count.max(initial=0) / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), _triples(codes),
        np.log1p(n / max(len(lines), 1)), marks / n,
    ]
    return np.concatenate([kinds, own])


def features(text: str, length: float, places: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of hashed words, and the statistics with the metadata."""
    words = _WORD.findall(text.lower())
    codes = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
    place, count = np.unique(codes % WORDS, return_counts=True)
    value = np.log1p(count)
    norm = np.sqrt((value * value).sum()) or 1.0
    return place, value / norm, np.append(statistics(text, codes, words), np.log1p(max(length, 0)))


@dataclass(frozen=True)
class Model:
    machine: Machine
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """Standardised statistics follow the hashed words; beyond four deviations they are held."""
        joined = []
        for place, value, stats in parts:
            own = np.clip((stats - self.mean) / self.spread, -4, 4) / 2
            joined.append((np.concatenate([place, WORDS + np.arange(len(own))]), np.concatenate([value, own])))
        return pack(joined)


def _inputs(docs: DataFrame, text: str, length: str | None) -> list[Column]:
    own = F.length(whole(text)).cast("double")
    return [whole(text).alias("text"), (F.coalesce(F.col(length).cast("double"), own) if length else own).alias("length")]


def _features_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    places = Places()
    for batch in batches:
        rows = [(*features(t, n, places), int(y > 0)) for t, n, y in zip(batch["text"], batch["length"], batch["label"])]
        yield pd.DataFrame(rows, columns=["place", "value", "stats", "label"])


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", length: str | None = "n_chars", label: str = "quality", most: int = MAX_LABELLED
) -> Model | float:
    """Learn from at most `most` labelled documents, whole texts; a constant without both classes."""
    known = training_labels(labels, id, label, most)
    inputs = docs.select(F.col(id).alias("doc_id"), *_inputs(docs, text, length))
    # Bounded by `most` rows of three numbers.
    cases = inputs.join(F.broadcast(known), "doc_id").select("text", "length", "label")
    seen = cases.mapInPandas(_features_of, "place array<int>, value array<float>, stats array<double>, label int").toArrow()
    answer = seen["label"].to_numpy()
    if len(answer) == 0 or answer.min() == answer.max():
        return float(answer.mean()) if len(answer) else 0.5
    stats = np.stack(seen["stats"].to_numpy())
    # The order of rows depends on tasks; training must not.
    order = np.lexsort([stats.sum(axis=1), answer])
    stats = stats[order]
    spread = stats.std(axis=0)
    blank = Model(None, stats.mean(axis=0), np.where(spread > 1e-9, spread, 1.0))
    place, value = (seen[c].to_numpy()[order] for c in ("place", "value"))
    rows = blank.rows(list(zip(place, value, stats)))
    machine = train(rows, answer[order].astype(float), WORDS + stats.shape[1], RANK)
    return Model(machine, blank.mean, blank.spread)


def score_texts(docs: DataFrame, model: Model | float, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows of docs with score: the probability of label 1, from the whole text."""
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memory: list[Places] = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series, lengths: pd.Series) -> pd.Series:
        if not memory:
            memory.append(Places())
        out = []
        for at in range(0, len(texts), 256):
            parts = [features(t, n, memory[0]) for t, n in zip(texts.iloc[at : at + 256], lengths.iloc[at : at + 256])]
            out.append(probability(shared.value.machine.raw(shared.value.rows(parts))))
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return docs.withColumn("score", scored(*_inputs(docs, text, length)))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    model = fit(docs, table(spark, folder, "labels"))
    return score_texts(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
