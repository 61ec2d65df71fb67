"""Gradient-boosted trees on a bounded sample, flattened into NumPy node arrays.

Histogram splits, Newton leaf values, monotone constraints by value bounds that
are handed down the tree: below a split on a constrained feature no leaf on the
low side can pass the midpoint of the two children from the wrong side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees end to end; a leaf has feature -1.  ``root`` is the first node of each tree."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                low = x[rows, np.maximum(f, 0)] <= self.cut[node]
                node = np.where(f < 0, node, np.where(low, self.left[node], self.right[node]))
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, rounds: int = 60, depth: int = 4,
        rate: float = 0.2, bins: int = 64, l2: float = 1.0, min_hessian: float = 2.0) -> Forest:
    """Logistic boosting.  ``monotone`` maps a feature to +1 (rising) or -1 (falling)."""
    monotone = monotone or {}
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(n, base)
    feature, cut, left, right, value, root = [], [], [], [], [], []

    def add() -> int:
        for column, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, 0.0)):
            column.append(v)
        return len(feature) - 1

    def grow(node: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        value[node] = rate * float(np.clip(-gs / (hs + l2), lo, hi))
        if level == depth or hs < 2 * min_hessian:
            return
        best, choice = 1e-6, None
        for j in range(d):
            if not len(cuts[j]):
                continue
            size = len(cuts[j]) + 1
            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], size))[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
            gain = -(gl * vl + (hl + l2) * vl**2 / 2) - (gr * vr + (hr + l2) * vr**2 / 2)
            ok = (hl >= min_hessian) & (hr >= min_hessian)
            if j in monotone:
                ok &= monotone[j] * (vr - vl) >= 0
            gain = np.where(ok, gain, -np.inf)
            k = int(np.argmax(gain))
            parent = np.clip(-gs / (hs + l2), lo, hi)
            win = gain[k] + gs * parent + (hs + l2) * parent**2 / 2
            if win > best:
                best, choice = win, (j, k, vl[k], vr[k])
        if choice is None:
            return
        j, k, vl, vr = choice
        low = binned[rows, j] <= k
        a, b = add(), add()
        feature[node], cut[node], left[node], right[node] = j, float(cuts[j][k]), a, b
        mid = (vl + vr) / 2
        bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}.get(monotone.get(j, 0), ((lo, hi), (lo, hi)))
        grow(a, rows[low], g, h, level + 1, *bounds[0])
        grow(b, rows[~low], g, h, level + 1, *bounds[1])

    everything = np.arange(n)
    forest = None
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        start = add()
        root.append(start)
        grow(start, everything, p - y, p * (1 - p), 0, -8.0, 8.0)
        one = Forest(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value),
                     np.array([start]), 0.0, depth)
        margin += one.margin(x)
    forest = Forest(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value),
                    np.array(root), base, depth)
    return forest
