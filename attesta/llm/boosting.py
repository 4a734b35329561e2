"""Gradient-boosted trees over small integer features, fitted on a table of distinct feature rows with
counts (bounded by the product of the feature ranges) and applied as a plain column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _grow(x, rows, grad, hess, depth: int, l2: float):
    """A nested (feature, threshold, left, right), or a leaf value; splits are found on sums by feature value."""
    g_all, h_all = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    whole, best, split = g_all * g_all / (h_all + l2), 1e-9, None
    for f in range(len(x[0])) if depth else ():
        sums: dict[int, list[float]] = {}
        for i in rows:
            at = sums.setdefault(x[i][f], [0.0, 0.0])
            at[0] += grad[i]
            at[1] += hess[i]
        g = h = 0.0
        for t in sorted(sums)[:-1]:
            g, h = g + sums[t][0], h + sums[t][1]
            gain = g * g / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - whole
            if gain > best:
                best, split = gain, (f, t)
    if split is None:
        return -g_all / (h_all + l2)
    f, t = split
    sides = [i for i in rows if x[i][f] <= t], [i for i in rows if x[i][f] > t]
    return f, t, *(_grow(x, side, grad, hess, depth - 1, l2) for side in sides)


def value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def fit(x: list[tuple[int, ...]], y: list[int], weight: list[float], rounds: int = 30, depth: int = 4, rate: float = 0.3, l2: float = 1.0) -> list:
    """Trees whose summed value is the log-odds of label 1; newton steps on the logistic loss."""
    score, trees = [0.0] * len(x), []
    for _ in range(rounds if len(set(y)) == 2 else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [w * (q - t) for q, t, w in zip(p, y, weight, strict=True)]
        hess = [w * q * (1 - q) for q, w in zip(p, weight, strict=True)]
        tree = _grow(x, range(len(x)), grad, hess, depth, l2)
        trees.append(tree)
        score = [s + rate * value(tree, row) for s, row in zip(score, x, strict=True)]
    return [_scaled(t, rate) for t in trees]


def _scaled(tree, rate: float):
    return (tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate)) if isinstance(tree, tuple) else tree * rate


def total(trees, x) -> float:
    return sum(value(t, x) for t in trees)


def expression(trees, features: list[Column]) -> Column:
    def of(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(features[tree[0]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

    out = F.lit(0.0)
    for tree in trees:
        out = out + of(tree)
    return out


def calibrated(scored: list[tuple[float, int, float]], precision: float) -> float | None:
    """The lowest score from which on the rows (score, label, weight) hold ``precision``; None if there is none."""
    good = bad = 0.0
    best = None
    by_score: dict[float, list[float]] = {}
    for s, y, w in scored:
        by_score.setdefault(round(s, 9), [0.0, 0.0])[y] += w
    for s in sorted(by_score, reverse=True):
        bad, good = bad + by_score[s][0], good + by_score[s][1]
        if good >= precision * (good + bad) and good:
            best = s
    return None if best is None else best - 1e-6
