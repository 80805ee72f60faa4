"""A factorisation machine for two classes over sparse rows, in NumPy.

score = b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): every pair of features interacts
through its vectors of length rank, in time linear in the features of a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: feature numbers and values, and where each row begins (one more entry than rows)."""

    index: np.ndarray
    value: np.ndarray
    start: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = self.start[rows + 1] - self.start[rows]
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[rows] - start[:-1], size) + np.arange(start[-1])
        return Rows(self.index[at], self.value[at], start)


def pack(parts: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
    start = np.concatenate([[0], np.cumsum([len(i) for i, _ in parts])]).astype(np.int64)
    index = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in parts]) if parts else np.zeros(0)
    return Rows(index.astype(np.int64), value.astype(np.float64), start)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, rows: Rows) -> np.ndarray:
        return self._forward(rows)[0]

    def _forward(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Scores and the sums over features of v x, per row and factor. Every row has a feature."""
        if not len(rows):
            return np.zeros(0), np.zeros((0, self.factors.shape[1]))
        vx = self.factors[rows.index] * rows.value[:, None]
        at = rows.start[:-1]
        sums = np.add.reduceat(vx, at)
        squares = np.add.reduceat(vx * vx, at)
        flat = np.add.reduceat(self.linear[rows.index] * rows.value, at)
        return self.bias + flat + 0.5 * (sums * sums - squares).sum(axis=1), sums


def probability(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def train(
    rows: Rows, label: np.ndarray, features: int, rank: int = 8, epochs: int = 12, batch: int = 256, rate: float = 0.05, decay: float = 1e-4, seed: int = 3
) -> Machine:
    """Logistic loss by AdaGrad over mini-batches; only the features of a batch move in its step."""
    draw = np.random.default_rng(seed)
    share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(features), draw.normal(0, 0.01, (features, rank)))
    seen_b, seen_w, seen_v = 1e-6, np.full(features, 1e-6), np.full((features, rank), 1e-6)
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            part = rows.take(chosen)
            raw, sums = m._forward(part)
            miss = (probability(raw) - label[chosen]) / len(chosen)
            row = np.repeat(np.arange(len(part)), np.diff(part.start))
            x = part.value * miss[row]
            own, place = np.unique(part.index, return_inverse=True)
            grad_w = np.bincount(place, x, len(own)) + decay * m.linear[own]
            each = x[:, None] * (sums[row] - m.factors[part.index] * part.value[:, None])
            grad_v = np.stack([np.bincount(place, each[:, f], len(own)) for f in range(rank)], axis=1) + decay * m.factors[own]
            grad_b = float(miss.sum())
            seen_b += grad_b**2
            seen_w[own] += grad_w**2
            seen_v[own] += grad_v**2
            m.bias -= rate * grad_b / np.sqrt(seen_b)
            m.linear[own] -= rate * grad_w / np.sqrt(seen_w[own])
            m.factors[own] -= rate * grad_v / np.sqrt(seen_v[own])
    return m
