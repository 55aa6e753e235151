"""Gradient-boosted regression trees for two classes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays; feature -1 marks a leaf.  A row goes left when its value is <= the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[at]
            go_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f < 0, at, np.where(go_left, self.left[at], self.right[at]))
        return self.value[at]

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """Every node but the root as a conjunction of (feature, value <= threshold?, threshold)."""
        out, todo = [], [(0, ())]
        while todo:
            i, path = todo.pop()
            if path:
                out.append(path)
            if self.feature[i] >= 0:
                f, t = int(self.feature[i]), float(self.threshold[i])
                todo += [(int(self.left[i]), (*path, (f, True, t))), (int(self.right[i]), (*path, (f, False, t)))]
        return out


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, reg: float) -> Tree:
    feature, threshold, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        i = len(feature)
        gs, hs = g[rows].sum(), h[rows].sum()
        for a, v in zip((feature, threshold, left, right, value), (-1, 0.0, 0, 0, -gs / (hs + reg))):
            a.append(v)
        if level == depth or len(rows) < 2 * least:
            return i
        best = (1e-6, -1, 0)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = bins[rows, f]
            k = len(e) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + reg) + (gs - gl) ** 2 / (hs - hl + reg) - gs**2 / (hs + reg)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), f, j)
        if best[1] < 0:
            return i
        f, j = best[1], best[2]
        go = bins[rows, f] <= j
        feature[i], threshold[i] = f, float(edges[f][j])
        left[i] = node(rows[go], level + 1)
        right[i] = node(rows[~go], level + 1)
        return i

    node(np.arange(len(x)), 0)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), depth)


@dataclass
class Boosted:
    trees: list[Tree]
    bias: float
    rate: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for t in self.trees:
            out += self.rate * t.predict(x)
        return out


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 5, reg: float = 1.0, cuts: int = 32) -> Boosted:
    """Logistic loss, second order, on quantile bins."""
    x = np.asarray(x, dtype=np.float64)
    y = np.asarray(y, dtype=np.float64)
    edges = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        if len(v) > cuts:
            v = np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts + 1)))
        edges.append((v[1:] + v[:-1]) / 2)
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Boosted([], float(np.log(p / (1 - p))), rate)
    z = np.full(len(y), model.bias)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        t = _grow(x, bins, edges, q - y, q * (1 - q), depth, least, reg)
        model.trees.append(t)
        z += rate * t.predict(x)
    return model


def lasso_logistic(x: np.ndarray, y: np.ndarray, *, penalty: float = 0.003, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression with an L1 penalty, by accelerated proximal gradient."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    n, k = x.shape
    size = 1 / (0.25 * (np.linalg.norm(x, 2) ** 2 / n + 1) + 1e-9)
    w, b = np.zeros(k), 0.0
    vw, vb, t = w, b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -40, 40))) - y
        nw = vw - size * (x.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - size * penalty, 0)
        nb = vb - size * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)
