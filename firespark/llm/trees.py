"""Histogram trees as flat arrays: grown from binned features, read by vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Per feature the cut points between at most BINS bins of about equal counts."""
    probs = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(x[:, f], probs)) for f in range(x.shape[1])]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A value is in bin b if b cut points are smaller than it."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.int64)


@dataclass
class Trees:
    """All trees' nodes end to end; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' values for every row, all trees of a row stepping at once."""
        out = np.zeros(len(x))
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.repeat(self.roots[None, :], len(part), axis=0)
            for _ in range(self.depth):
                low = part[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            out[i : i + 4096] = self.value[node].sum(axis=1)
        return out


class Grower:
    """Grows trees on one binned table and keeps them as flat arrays."""

    def __init__(self, x: np.ndarray, max_depth: int, least_weight: float, penalty: float, seed: int = 0):
        self.edges = bin_edges(x)
        self.bins = to_bins(x, self.edges)
        self.width = max(len(e) for e in self.edges) + 1
        self.max_depth, self.least, self.penalty = max_depth, least_weight, penalty
        self.rng = np.random.default_rng(seed)
        self.nodes: list[list] = []
        self.roots: list[int] = []

    def grow(self, gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, features: int, rate: float) -> np.ndarray:
        """Add a tree; its value for every row of the table. Each node looks at ``features`` features."""
        root = len(self.nodes)
        self.roots.append(root)
        self.nodes.append([0, np.inf, root, root, 0.0])
        open_nodes = [(root, rows, 0)]
        while open_nodes:
            node, held, depth = open_nodes.pop()
            g, w = gradient[held], weight[held]
            total_g, total_w = g.sum(), w.sum()
            self.nodes[node][4] = -rate * total_g / (total_w + self.penalty)
            if depth == self.max_depth or total_w < 2 * self.least:
                continue
            best = self._best(held, g, w, total_g, total_w, features)
            if best is None:
                continue
            feature, cut = best
            low = self.bins[held, feature] <= cut
            children = len(self.nodes)
            self.nodes[node][:4] = [feature, self.edges[feature][cut], children, children + 1]
            self.nodes += [[0, np.inf, children, children, 0.0], [0, np.inf, children + 1, children + 1, 0.0]]
            open_nodes += [(children, held[low], depth + 1), (children + 1, held[~low], depth + 1)]
        return self._values(root)

    def _best(self, held, g, w, total_g, total_w, features) -> tuple[int, int] | None:
        chosen = np.arange(self.bins.shape[1])
        if features < len(chosen):
            chosen = np.sort(self.rng.choice(chosen, features, replace=False))
        flat = (self.bins[held][:, chosen] + np.arange(len(chosen)) * self.width).ravel()
        size = len(chosen) * self.width
        sum_g = np.bincount(flat, np.repeat(g, len(chosen)), size).reshape(len(chosen), -1).cumsum(axis=1)
        sum_w = np.bincount(flat, np.repeat(w, len(chosen)), size).reshape(len(chosen), -1).cumsum(axis=1)
        rest_g, rest_w = total_g - sum_g, total_w - sum_w
        gain = sum_g**2 / (sum_w + self.penalty) + rest_g**2 / (rest_w + self.penalty) - total_g**2 / (total_w + self.penalty)
        gain[(sum_w < self.least) | (rest_w < self.least)] = -1.0
        for i, f in enumerate(chosen):
            gain[i, len(self.edges[f]) :] = -1.0
        at = int(np.argmax(gain))
        i, cut = divmod(at, self.width)
        return (int(chosen[i]), cut) if gain[i, cut] > 1e-12 else None

    def _values(self, root: int) -> np.ndarray:
        node = np.full(len(self.bins), root)
        feature, cut, left, right, value = self._columns()
        for _ in range(self.max_depth):
            edge = np.array([np.searchsorted(self.edges[int(f)], c) if np.isfinite(c) else self.width for f, c in zip(feature, cut)])
            low = self.bins[np.arange(len(node)), feature[node]] <= edge[node]
            node = np.where(low, left[node], right[node])
        return value[node]

    def _columns(self):
        feature, cut, left, right, value = zip(*self.nodes)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)

    def trees(self) -> Trees:
        return Trees(np.array(self.roots), *self._columns(), self.max_depth)


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, max_depth: int = 8, seed: int = 0) -> Trees:
    """Bootstrap trees whose values sum to the share of label 1; each node sees about sqrt(features)."""
    grower = Grower(x, max_depth, 1.0, 1e-9, seed)
    features = max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    for _ in range(trees):
        drawn = np.bincount(grower.rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        grower.grow(-y * drawn, drawn, np.flatnonzero(drawn), features, 1 / trees)
    return grower.trees()


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 80, max_depth: int = 4, rate: float = 0.15, seed: int = 0) -> tuple[float, Trees]:
    """Gradient boosting of the logistic loss: the starting log-odds and the trees to add to it."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    grower = Grower(x, max_depth, 1.0, 1.0, seed)
    logit, rows = np.full(len(y), start), np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        logit += grower.grow(p - y, np.maximum(p * (1 - p), 1e-6), rows, x.shape[1], rate)
    return start, grower.trees()
