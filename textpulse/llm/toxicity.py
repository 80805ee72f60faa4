"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by the law of extreme values.

1. Words and word beginnings of labelled documents are counted by class, in hashed tables of fixed size.
2. A word's score is its log-odds toxic : clean under a Dirichlet prior that leans to the odds of its beginning,
   which leans to neutral; a constant is taken off, so that clean text drifts down.
3. A linear scan finds all maximal scoring segments of a text. Best segments of clean documents, scored by tables
   that have not seen them, give lambda and K of the extreme-value law, hence each segment's expected number of
   equals in a clean text of that length. Segments below one are significant passages.
4. A document's evidence, of its best passage and of all together, becomes a probability by logistic regression.

Null and empty texts have no segment and get the lowest score. Without labels of both classes every score is 0.
Rows repeated with one id are scored alike. Only id, text and the labels are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import MARK, table, whole
from textpulse.llm.labelled import MAX_LABELLED, held_out, training_labels
from textpulse.llm.segments import fit_extremes, fit_logistic, maximal_segments

#: Sizes of the hashed tables of words and of beginnings, and the letters of a beginning.
WORDS, STEMS, STEM_LETTERS = 1 << 19, 1 << 17, 5
#: Weight of the priors in occurrences, and what is taken off each token's log-odds.
WORD_PRIOR, STEM_PRIOR, DRIFT = 4.0, 4.0, 1.5
#: Scores of words that a worker remembers.
REMEMBERED = 400_000
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def _word_place(word: str) -> int:
    return zlib.crc32(word.encode()) % WORDS


def _stem_place(word: str) -> int:
    return WORDS + zlib.crc32(word[:STEM_LETTERS].encode()) % STEMS


@dataclass(frozen=True)
class Odds:
    """Occurrences of each place of the tables in clean and toxic documents."""

    clean: np.ndarray
    toxic: np.ndarray

    def __add__(self, other: Odds) -> Odds:
        return Odds(self.clean + other.clean, self.toxic + other.toxic)

    def score(self, word: str) -> float:
        """Log-odds of the word, less the drift."""
        clean, toxic = max(self.clean[:WORDS].sum(), 1.0), max(self.toxic[:WORDS].sum(), 1.0)
        return _score(self, toxic / (clean + toxic), word)


def _score(odds: Odds, share: float, word: str) -> float:
    w, s = _word_place(word), _stem_place(word)
    lean = (odds.toxic[s] + STEM_PRIOR * share) / (odds.toxic[s] + odds.clean[s] + STEM_PRIOR)
    ratio = (odds.toxic[w] + WORD_PRIOR * lean) / (odds.clean[w] + WORD_PRIOR * (1 - lean))
    return float(np.log(ratio) - np.log(share / (1 - share)) - DRIFT)


class Scores(dict):
    """Word -> score, worked out once."""

    def __init__(self, odds: Odds):
        super().__init__()
        clean, toxic = max(odds.clean[:WORDS].sum(), 1.0), max(odds.toxic[:WORDS].sum(), 1.0)
        self.odds, self.share = odds, toxic / (clean + toxic)

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = _score(self.odds, self.share, word)
        return value

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, _WORD.findall(text.lower())), float)


@dataclass(frozen=True)
class Model:
    odds: Odds
    scale: float  # lambda
    log_k: float
    weights: tuple[float, ...]

    def surplus(self, score: float, words: int) -> float:
        """Minus the logarithm of how many such segments a clean text of so many words has."""
        return self.scale * score - self.log_k - float(np.log(max(words, 1)))


def evidence(model: Model, segments: list[tuple[int, int, float]], words: int) -> tuple[float, float]:
    """Of the best segment, and of all significant ones together."""
    each = [model.surplus(s, words) for _, _, s in segments]
    return max([-10.0, *each]), float(np.log1p(sum(e for e in each if e > 0)))


def probability(model: Model, features: np.ndarray) -> np.ndarray:
    z = features @ np.array(model.weights[:-1]) + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences per fold, class and place of the tables."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for text, label, fold in zip(batch["text"], batch["label"], batch["fold"]):
            words = _WORD.findall(text.lower())
            places = np.array([*map(_word_place, words), *map(_stem_place, words)], np.int64)
            own = sums.setdefault((int(fold), int(label > 0)), np.zeros(WORDS + STEMS, np.int64))
            place, n = np.unique(places, return_counts=True)
            own[place] += n
    for (fold, label), own in sums.items():
        place = np.flatnonzero(own)
        yield pd.DataFrame({"fold": fold, "label": label, "place": place, "n": own[place]})


def count_odds(texts: DataFrame) -> list[Odds]:
    """Tables of the two folds from (text, label, fold). The driver gets one row per place at most."""
    parts = texts.select("text", "label", "fold").mapInPandas(_count, "fold int, label int, place int, n long")
    sums = [
        F.sum(F.when((F.col("fold") == fold) & (F.col("label") == label), F.col("n")).otherwise(0)).alias(f"n{fold}{label}")
        for fold in (0, 1)
        for label in (0, 1)
    ]
    rows = parts.groupBy("place").agg(*sums).toArrow()
    place = rows["place"].to_numpy()

    def spread(name: str) -> np.ndarray:
        out = np.zeros(WORDS + STEMS)
        out[place] = rows[name].to_numpy()
        return out

    return [Odds(spread(f"n{fold}0"), spread(f"n{fold}1")) for fold in (0, 1)]


def _segments_of(shared, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of labelled texts under the table of the other fold: label, words, scores."""
    scores = [Scores(o) for o in shared.value]
    for batch in batches:
        rows = []
        for text, label, fold in zip(batch["text"], batch["label"], batch["fold"]):
            values = scores[1 - int(fold)].of(text)
            best = sorted((s for _, _, s in maximal_segments(values)), reverse=True)
            rows.append((int(label > 0), len(values), best))
        yield pd.DataFrame(rows, columns=["label", "words", "scores"])


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED) -> Model | None:
    """Learn from at most `most` labelled documents, whole texts; None without both classes."""
    spark = docs.sparkSession
    known = training_labels(labels, id, label, most)
    # Bounded by `most` rows of three numbers.
    texts = docs.select(F.col(id).alias("doc_id"), whole(text).alias("text")).join(F.broadcast(known), "doc_id")
    folds = count_odds(texts)
    odds = folds[0] + folds[1]
    if not odds.clean.any() or not odds.toxic.any():
        return None
    shared = spark.sparkContext.broadcast(folds)
    cases = texts.select("text", "label", "fold").mapInPandas(partial(_segments_of, shared), "label int, words int, scores array<double>")
    seen = cases.toArrow()
    each = seen["scores"].to_pylist()
    best = np.array([s[0] if s else 0.0 for s in each])
    words, label_ = seen["words"].to_numpy(), seen["label"].to_numpy()
    scale, log_k = fit_extremes(best[label_ == 0], words[label_ == 0])
    model = Model(odds, scale, log_k, (0.0, 0.0, 0.0))
    features = [evidence(model, [(0, 0, s) for s in scores], n) for scores, n in zip(each, words)]
    return Model(odds, scale, log_k, tuple(fit_logistic(np.array(features), label_)))


_RESULT = "score double, passages array<struct<start:int,end:int,surplus:double>>"


def _passages(model: Model, text: str, segments: list, words: int) -> list[dict]:
    """Significant segments as places of characters."""
    strong = [(s, e, model.surplus(v, words)) for s, e, v in segments]
    strong = [x for x in strong if x[2] > 0]
    if not strong:
        return []
    # Lower-casing can change a text's length, so places are those of words in the text itself.
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) != words:
        spans = [m.span() for m in _WORD.finditer(text.lower())]
    return [{"start": spans[s][0], "end": spans[e - 1][1], "surplus": v} for s, e, v in strong]


def score_texts(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs with score (probability of label 1) and passages (start, end, surplus) of whole texts."""
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "passages": F.lit(None).cast(_RESULT.split(" ", 3)[3])})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memory: list[Scores] = []

    @F.pandas_udf(_RESULT)
    def scored(texts: pd.Series) -> pd.DataFrame:
        if not memory:
            memory.append(Scores(shared.value.odds))
        m, features, passages = shared.value, [], []
        for t in texts:
            values = memory[0].of(t)
            segments = maximal_segments(values)
            features.append(evidence(m, segments, len(values)))
            passages.append(_passages(m, t, segments, len(values)))
        scores = probability(m, np.array(features).reshape(-1, 2))
        return pd.DataFrame({"score": scores, "passages": passages})

    found = f"{MARK}scored"
    return docs.withColumn(found, scored(whole(text))).select(*docs.columns, F.col(f"{found}.score"), F.col(f"{found}.passages"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, folder, "labels"))
    return score_texts(docs, model).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    model = fit(docs, labels, id, text)
    if model is None:
        return docs
    renamed = docs.select(*[F.col(c).alias(f"{MARK}{k}") for k, c in enumerate(docs.columns)])
    kept = score_texts(renamed, model, f"{MARK}{docs.columns.index(text)}").filter(F.col("score") < threshold)
    return kept.select(*[F.col(f"{MARK}{k}").alias(c) for k, c in enumerate(docs.columns)])
