"""Three-wise binary fuse filters over 64-bit keys, built and asked with NumPy.

A filter holds one byte for each of about 1.13 slots a key and answers "maybe" for every key it was built
from, and for about one other key in 256.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_U = np.uint64


@dataclass(frozen=True)
class Fuse:
    seed: int
    segment: int
    segments: int
    slots: bytes


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over key + seed."""
    with np.errstate(over="ignore"):
        h = keys + _U(seed)
        h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots a key, in three neighbouring segments: 3 x n."""
    with np.errstate(over="ignore"):
        start = ((h >> _U(32)) * _U(segments)) >> _U(32)
        low = _U(segment - 1)
        base = start.astype(np.int64) * segment
        inside = [h & low, (h >> _U(18)) & low, ((h ^ (h >> _U(7))) * _U(0x9E3779B97F4A7C15) >> _U(40)) & low]
    return np.stack([base + k * segment + x.astype(np.int64) for k, x in enumerate(inside)])


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> _U(32))) & _U(0xFF)).astype(np.uint8)


def _shape(n: int) -> tuple[int, int]:
    segment = 1 << min(18, max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2 + 1)
    return segment, segments


def build(keys: np.ndarray, seed: int = 1) -> Fuse:
    """A filter of all distinct keys. Peels slots that one key alone uses, in rounds; another seed if stuck."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n = len(keys)
    segment, segments = _shape(n)
    for attempt in range(200):
        if attempt and attempt % 10 == 0:
            segments += max(1, segments // 10)
        h = _mix(keys, seed + attempt * 0x9E3779B9)
        at = _places(h, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=size).astype(np.int64)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left, single = [], n, np.flatnonzero(count == 1)
        while len(single):
            own, first = np.unique(owner[single], return_index=True)
            rounds.append((own, single[first]))
            left -= len(own)
            used = at[:, own]
            for row in used:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, own)
            touched = np.unique(used)
            single = touched[count[touched] == 1]
        if not left:
            slots, want = np.zeros(size, np.uint8), _print(h)
            for own, slot in reversed(rounds):
                p = at[:, own]
                # Its own slot is still 0, so the three give what the other two hold.
                slots[slot] = want[own] ^ slots[p[0]] ^ slots[p[1]] ^ slots[p[2]]
            return Fuse(seed + attempt * 0x9E3779B9, segment, segments, slots.tobytes())
    raise RuntimeError("no fuse filter after 200 seeds")


def ask(f: Fuse, keys: np.ndarray) -> np.ndarray:
    """True for each key that may be in the filter."""
    h = _mix(np.asarray(keys, dtype=np.uint64), f.seed)
    at = _places(h, f.segment, f.segments)
    slots = np.frombuffer(f.slots, np.uint8)
    return (slots[at[0]] ^ slots[at[1]] ^ slots[at[2]]) == _print(h)
