"""A random forest on binned features, small enough to train on a bounded sample on one machine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as arrays: ``feature`` (-1 at a leaf), ``split`` (go left at <=), ``left``, ``right`` and ``share`` of positives."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives over the trees, for each row of ``x``."""
        total = np.zeros(len(x))
        for feature, split, left, right, share in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            inner = feature[node] >= 0
            while inner.any():
                at = node[inner]
                go = x[inner, feature[at]] <= split[at]
                node[inner] = np.where(go, left[at], right[at])
                inner = feature[node] >= 0
            total += share[node]
        return total / max(1, len(self.trees))


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, bins: int = 48, least: int = 4, seed: int = 7) -> Forest:
    """Bootstrap trees with random feature subsets and Gini splits at feature quantiles."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    if n == 0 or y.min() == y.max():
        p = float(y.mean()) if n else 0.0
        return Forest([(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.array([p]))])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    tried = max(2, int(np.ceil(np.sqrt(d))) + 1)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, n, n)
        nodes: list[list[float]] = []

        def grow(at: np.ndarray, level: int) -> int:
            me = len(nodes)
            share = float(y[at].mean())
            nodes.append([-1, 0.0, 0, 0, share])
            if level >= depth or len(at) < 2 * least or share in (0.0, 1.0):
                return me
            best = (0.0, -1, 0)
            for j in rng.choice(d, min(tried, d), replace=False):
                if not len(cuts[j]):
                    continue
                all_ = np.bincount(binned[at, j], minlength=len(cuts[j]) + 1).cumsum()[:-1]
                pos = np.bincount(binned[at, j], weights=y[at], minlength=len(cuts[j]) + 1).cumsum()[:-1]
                na, nb = all_, len(at) - all_
                pa, pb = pos, y[at].sum() - pos
                with np.errstate(divide="ignore", invalid="ignore"):
                    gini = np.where((na >= least) & (nb >= least), pa * (1 - pa / na) + pb * (1 - pb / nb), np.inf)
                k = int(gini.argmin())
                gain = len(at) * share * (1 - share) - gini[k]
                if gain > best[0] + 1e-12:
                    best = (gain, int(j), k)
            if best[1] < 0:
                return me
            low = binned[at, best[1]] <= best[2]
            nodes[me][0], nodes[me][1] = best[1], float(cuts[best[1]][best[2]])
            nodes[me][2] = grow(at[low], level + 1)
            nodes[me][3] = grow(at[~low], level + 1)
            return me

        grow(rows, 0)
        a = np.array(nodes)
        out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return Forest(out)
