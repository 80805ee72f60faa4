"""Maximum-scoring segments of a token sequence and the extreme-value law of their scores. NumPy helpers."""

from __future__ import annotations

import math

import numpy as np


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in order; linear in the tokens.

    They are disjoint; each is the best segment of what is left around it, and none can be widened or shortened
    for a higher score. Only tokens of positive score can begin or end one, so the scan visits those alone and
    takes the rest from running sums.
    """
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before start, sum at end
    links: list[int] = []  # the nearest earlier candidate with a smaller sum before it
    before, after = total[places].tolist(), total[places + 1].tolist()
    for place, low, high in zip(places.tolist(), before, after):
        start, end = place, place + 1
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = links[j]
            if j < 0 or kept[j][3] >= high:
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:], links[j:]
        kept.append((start, end, low, high))
        links.append(j)
    return [(s, e, h - b) for s, e, b, h in kept]


def fit_extremes(best: np.ndarray, length: np.ndarray) -> tuple[float, float]:
    """(lambda, ln K) of P(best <= x) = exp(-K n exp(-lambda x)) by maximum likelihood over clean texts."""
    use = (length > 0) & (best > 0)
    x, n = best[use].astype(float), length[use].astype(float)
    if len(x) < 5 or x.std() < 1e-9:
        return 1.0, 0.0

    def slope(lam: float) -> float:
        w = n * np.exp(-lam * (x - x.min()))
        return 1 / lam - x.mean() + float((w * x).sum() / w.sum())

    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    lam = math.sqrt(low * high)
    weights = n * np.exp(-lam * (x - x.min()))
    return lam, math.log(len(x) / weights.sum()) - lam * float(x.min())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with an intercept last, by Newton's method."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) / len(y) + ridge * w
        hess = (design * (p * (1 - p))[:, None]).T @ design / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
