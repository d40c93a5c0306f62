"""Regression trees on binned features, small enough to be grown inside one grouped task.

A feature's cuts lie between its distinct values, or between 255 quantiles where it
has more. Trees grow best-first on the reduction of squared error, one histogram
of all features per node. Equal gains go to the first feature and the lowest cut, and
bootstrap rows come from a seeded generator, so that a fit depends on the rows and
their order alone.
"""

from __future__ import annotations

import heapq

import numpy as np

MOST_BINS = 255


class Bins:
    """Cuts of each feature; ``codes`` gives the number of cuts below a value."""

    def __init__(self, x: np.ndarray):
        self.cuts = []
        for column in x.T:
            values = np.unique(column)
            if len(values) > MOST_BINS:
                values = np.unique(np.quantile(column, np.linspace(0, 1, MOST_BINS + 1), method="nearest"))
            self.cuts.append((values[:-1] + values[1:]) / 2)
        self.width = max(map(len, self.cuts)) + 1

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(self.cuts, x.T)])


class Tree:
    """Nodes in lists; a leaf has feature -1. Rows at most ``cut`` go left."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []

    def node(self, value: float) -> int:
        for column, blank in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(blank)
        return len(self.value) - 1

    def predict(self, row: np.ndarray) -> float:
        at = 0
        while self.feature[at] >= 0:
            at = self.left[at] if row[self.feature[at]] <= self.cut[at] else self.right[at]
        return self.value[at]


def _best_split(codes: np.ndarray, target: np.ndarray, width: int, min_leaf: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the split that lowers the squared error most, or None."""
    n, features = codes.shape
    flat = (codes + np.arange(features) * width).ravel()
    size = features * width
    counts = np.bincount(flat, minlength=size).reshape(features, width).cumsum(1)[:, :-1]
    sums = np.bincount(flat, np.repeat(target, features), size).reshape(features, width).cumsum(1)[:, :-1]
    total, rest = target.sum(), n - counts
    allowed = (counts >= min_leaf) & (rest >= min_leaf)
    if not allowed.any():
        return None
    gain = np.where(allowed, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(rest, 1) - total**2 / n, -1.0)
    at = int(gain.argmax())
    if gain.flat[at] <= 1e-12 * max(1.0, float(target @ target)):
        return None
    return float(gain.flat[at]), at // (width - 1), at % (width - 1)


def grow(bins: Bins, codes: np.ndarray, target: np.ndarray, min_leaf: int, depth: int | None = None, leaves: int | None = None) -> tuple[Tree, np.ndarray, np.ndarray]:
    """A tree, the value it gives to each of its own rows, and the gain of each feature."""
    tree, fitted, gains = Tree(), np.empty(len(target)), np.zeros(codes.shape[1])
    heap: list = []

    def add(rows: np.ndarray, level: int) -> int:
        at = tree.node(float(target[rows].mean()))
        fitted[rows] = tree.value[at]
        split = _best_split(codes[rows], target[rows], bins.width, min_leaf) if (depth is None or level < depth) and len(rows) >= 2 * min_leaf else None
        if split:
            heapq.heappush(heap, (-split[0], at, split, rows, level))
        return at

    add(np.arange(len(target)), 0)
    n_leaves = 1
    while heap and (leaves is None or n_leaves < leaves):
        _, at, (gain, feature, cut), rows, level = heapq.heappop(heap)
        low = codes[rows, feature] <= cut
        tree.feature[at], tree.cut[at] = feature, float(bins.cuts[feature][cut])
        gains[feature] += gain
        tree.left[at], tree.right[at] = add(rows[low], level + 1), add(rows[~low], level + 1)
        n_leaves += 1
    return tree, fitted, gains


class Ensemble:
    """``base`` plus ``rate`` times the sum of the trees; ``importance`` sums to 1 where any split was made."""

    def __init__(self, base: float, rate: float, trees: list[Tree], gains: np.ndarray):
        self.base, self.rate, self.trees = base, rate, trees
        self.importance = gains / gains.sum() if gains.sum() > 0 else gains

    def predict(self, row: np.ndarray) -> float:
        return self.base + self.rate * sum(t.predict(row) for t in self.trees)


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, min_leaf: int, seed: int = 42) -> Ensemble:
    """Trees on bootstrap samples, averaged."""
    bins = Bins(x)
    codes, gains, grown = bins.codes(x), np.zeros(x.shape[1]), []
    for k in range(trees):
        rows = np.sort(np.random.default_rng([seed, k]).integers(0, len(y), len(y)))
        tree, _, gain = grow(bins, codes[rows], y[rows], min_leaf, depth)
        grown.append(tree)
        gains += gain / max(gain.sum(), 1e-300)
    return Ensemble(0.0, 1 / trees, grown, gains)


def boosting(x: np.ndarray, y: np.ndarray, rounds: int, min_leaf: int, depth: int | None = None, leaves: int | None = None, rate: float = 0.1) -> Ensemble:
    """Trees on what the ones before left over."""
    bins = Bins(x)
    codes, gains, grown = bins.codes(x), np.zeros(x.shape[1]), []
    base = float(y.mean())
    left = y - base
    for _ in range(rounds):
        tree, fitted, gain = grow(bins, codes, left, min_leaf, depth, leaves)
        left = left - rate * fitted
        grown.append(tree)
        gains += gain
    return Ensemble(base, rate, grown, gains)
