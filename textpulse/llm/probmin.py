"""ProbMinHash sketches of weighted word shingles, in NumPy.

Each shingle is a Poisson process whose rate is its weight; arrivals fall on random registers, and a register keeps
the shingle that arrives there first. A process ends as soon as its next arrival comes after the latest first
arrival of all registers. Two sketches agree in a register with the probability Jaccard of the weighted sets, which
for equal weights is the plain Jaccard.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash

SHINGLE = 5
_WORD = re.compile(r"\w+")
_U = np.uint64
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)
#: Word codes that a worker remembers.
REMEMBERED = 100_000


class WordCodes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str], codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles and how often each occurs; texts shorter than a shingle are one."""
    c = np.fromiter(map(codes.__getitem__, words), _U, len(words))
    n = len(c) - SHINGLE + 1
    if n < 1:
        rolled = (c * _STEPS[: len(c)]).sum(keepdims=True) if len(c) else c
    else:
        rolled = c[:n] * _STEPS[0]
        for k in range(1, SHINGLE):
            rolled += c[k : k + n] * _STEPS[k]
    return np.unique(mix(rolled), return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    """A repeated shingle weighs more, but not in proportion."""
    return 1 + np.log(counts)


def sketch(elements: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """The winning shingle of each register. Elements must not be empty."""
    first = np.full(registers, np.inf)
    winner = np.zeros(registers, _U)
    # Arrivals are drawn in blocks: at first as many as hit all registers, then a few for those still early.
    block = 1 + math.ceil(registers * (math.log(registers) + 1) / float(weight.sum()))
    alive, clock, arrival = np.arange(len(elements)), 0.0, 0
    while len(alive):
        e = elements[alive]
        number = (np.arange(arrival, arrival + block, dtype=_U) + _U(1)) * _STEPS[0]
        drawn = mix(e[:, None] + number)
        gap = np.log(((drawn >> _U(11)).astype(float) + 0.5) * 2.0**-53) / -weight[alive][:, None]
        times = np.cumsum(gap, axis=1) + clock
        early = np.flatnonzero(times.ravel() < first.max())
        flat = times.ravel()[early]
        order = np.argsort(flat)
        at = early[order]
        register = (mix(drawn.ravel()[at] ^ _STEPS[1]) % _U(registers)).astype(np.int64)
        hit, won = np.unique(register, return_index=True)
        when = flat[order[won]]
        better = when < first[hit]
        hit = hit[better]
        first[hit] = when[better]
        winner[hit] = e[at[won[better]] // block]
        last = times[:, -1]
        going = last < first.max()
        alive, clock, arrival = alive[going], last[going][:, None], arrival + block
        block = 4
    return winner


def band_keys(winners: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of so many registers, for each sketch (one per row)."""
    bands = winners.reshape(len(winners), winners.shape[1] // rows, rows)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=_U) * _STEPS[1], bands.shape[:2])
    for k in range(rows):
        keys = mix(keys + bands[:, :, k] * _STEPS[k % len(_STEPS)])
    return keys.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets of distinct shingles."""
    if not len(a) or not len(b):
        return 0.0
    place = np.searchsorted(a, b)
    both = int((a[np.minimum(place, len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)
