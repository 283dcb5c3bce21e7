"""Logistic regression on sparse 0/1 features and a few dense ones, by limited-memory BFGS in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: the features of row r are idx[start[r]:start[r + 1]], each of value 1."""

    start: np.ndarray
    idx: np.ndarray
    width: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(w[self.idx])))
        return total[self.start[1:]] - total[self.start[:-1]]

    def spread(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.idx, np.repeat(r, np.diff(self.start)), self.width)

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.start)[rows]
        start = np.concatenate(([0], np.cumsum(size)))
        return Rows(start, self.idx[np.repeat(self.start[rows] - start[:-1], size) + np.arange(start[-1])], self.width)

    def only(self, features: list[int]) -> Rows:
        """These features alone, numbered in the order given."""
        slot = np.full(self.width, -1, np.int64)
        slot[features] = np.arange(len(features))
        now = slot[self.idx]
        kept = np.concatenate(([0], np.cumsum(now >= 0)))
        return Rows(kept[self.start], now[now >= 0], len(features))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def fit(x: Rows, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, rounds: int = 150) -> np.ndarray:
    """Coefficients: sparse features, dense ones, intercept. With one class only, the smoothed share of it and no feature."""
    k = x.width + dense.shape[1]
    total, hits = weight.sum(), (weight * y).sum()
    if hits <= 0 or hits >= total:
        out = np.zeros(k + 1)
        p = (hits + 0.5) / (total + 1)
        out[-1] = np.log(p / (1 - p))
        return out

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(w[: x.width]) + dense @ w[x.width : k] + w[k]
        r = weight * (sigmoid(z) - y)
        f = (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * l2 * (w[:k] ** 2).sum()
        return f, np.concatenate((x.spread(r) + l2 * w[: x.width], r @ dense + l2 * w[x.width : k], [r.sum()]))

    w = np.zeros(k + 1)
    f, g = value(w)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, back = g.copy(), []
        for s, t in reversed(memory):
            a = (s @ d) / (s @ t)
            d -= a * t
            back.append(a)
        if memory:
            s, t = memory[-1]
            d *= (s @ t) / (t @ t)
        for (s, t), a in zip(memory, reversed(back), strict=True):
            d += (a - (t @ d) / (s @ t)) * s
        step = 1.0 if memory else 1.0 / max(1.0, np.abs(g).max())
        while step > 1e-12:
            new = w - step * d
            f2, g2 = value(new)
            if f2 <= f - 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        if (s := new - w) @ (t := g2 - g) > 1e-12:
            memory = [*memory[-9:], (s, t)]
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        w, f, g = new, f2, g2
        if done:
            break
    return w
