"""A small random forest: trained in numpy on a bounded sample, applied as a column expression."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def _grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator):
    """A node: (feature, threshold, left, right), or the share of positives at a leaf."""
    mean = float(y.mean())
    if depth == 0 or len(y) < 2 * least or mean in (0.0, 1.0):
        return mean
    best = None
    for f in rng.permutation(x.shape[1])[: max(1, int(np.sqrt(x.shape[1]) + 1))]:
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        cuts = cuts[(cuts >= least) & (cuts <= len(y) - least)]
        if not len(cuts):
            continue
        positives = np.cumsum(t)
        left, right = positives[cuts - 1] / cuts, (positives[-1] - positives[cuts - 1]) / (len(y) - cuts)
        gini = cuts * left * (1 - left) + (len(y) - cuts) * right * (1 - right)
        k = int(np.argmin(gini))
        if best is None or gini[k] < best[0]:
            best = float(gini[k]), int(f), float((v[cuts[k]] + v[cuts[k] - 1]) / 2)
    if best is None:
        return mean
    _, f, threshold = best
    low = x[:, f] <= threshold
    return f, threshold, _grow(x[low], y[low], depth - 1, least, rng), _grow(x[~low], y[~low], depth - 1, least, rng)


def train(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 6, least: int = 4, seed: int = 7) -> list:
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        forest.append(_grow(x[rows], y[rows].astype(float), depth, least, rng))
    return forest


def probability(forest: list, features: list[Column]) -> Column:
    """Mean of the trees' leaves, as nested conditions."""

    def expression(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        f, threshold, low, high = node
        return F.when(features[f] <= F.lit(threshold), expression(low)).otherwise(expression(high))

    total = F.lit(0.0)
    for tree in forest:
        total = total + expression(tree)
    return total / F.lit(float(len(forest)))
