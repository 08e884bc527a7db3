"""Small gradient-boosted trees for binary labels: trees of depth two on the logistic loss."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """``fit`` on at most some ten thousand rows; ``predict`` gives probabilities."""

    rounds: int = 60
    rate: float = 0.3
    shrink: float = 1.0
    bias: float = 0.0
    trees: list[tuple] = field(default_factory=list)

    def _leaf(self, g: np.ndarray, h: np.ndarray) -> float:
        return float(self.rate * g.sum() / (h.sum() + self.shrink))

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float] | None:
        best, found = 1e-6, None
        total = g.sum() ** 2 / (h.sum() + self.shrink)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v = x[order, f]
            at = np.flatnonzero(v[1:] > v[:-1])
            if not len(at):
                continue
            gl, hl = np.cumsum(g[order])[at], np.cumsum(h[order])[at]
            gain = gl**2 / (hl + self.shrink) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.shrink) - total
            i = int(gain.argmax())
            if gain[i] > best:
                best, found = gain[i], (f, float(v[at[i]] + v[at[i] + 1]) / 2)
        return found

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.bias = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.bias)
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            top = self._split(x, g, h)
            if top is None:
                break
            right = x[:, top[0]] > top[1]
            sides = []
            for side in (~right, right):
                low = self._split(x[side], g[side], h[side])
                if low is None:
                    sides.append((0, np.inf, self._leaf(g[side], h[side]), 0.0))
                else:
                    up = side & (x[:, low[0]] > low[1])
                    down = side & ~up
                    sides.append((*low, self._leaf(g[down], h[down]), self._leaf(g[up], h[up])))
            self.trees.append((*top, *sides))
            score = self.bias + self._raw(x)
        return self

    def _raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for f, t, left, right in self.trees:
            go = x[:, f] > t
            for side, (sf, st, a, b) in ((~go, left), (go, right)):
                out[side] += np.where(x[side, sf] > st, b, a)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self._raw(x)))) if len(x) else np.zeros(0)


def precise_threshold(p: np.ndarray, y: np.ndarray, precision: float, floor: float = 0.5) -> float:
    """Least score from which on at least ``precision`` of the rows are positive, and ``floor`` at least; 2 if there is none."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    last = np.append(p[order][1:] < p[order][:-1], True) if len(p) else np.zeros(0, bool)
    ok = np.flatnonzero((hits >= precision) & last)
    return max(floor, float(p[order][ok[-1]])) if len(ok) else 2.0
