"""Contributions, Shapley values, partial dependence, reason codes: walks over bounded models, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.tree import Model, Node

METHODS = ("Weight", "Average", "BranchDifference", "MidpointDifference", "ModeDifference", "ProbabilityChange", "Shapley")


def _means(tree: list[Node]) -> dict[int, float]:
    """Cover-weighted leaf average under each node, bottom up."""
    out: dict[int, float] = {}
    for n in reversed(tree):
        if n.is_leaf:
            out[n.id] = n.weight
        else:
            out[n.id] = _weighted(tree, n, out.__getitem__)
    return out


def _weighted(tree: list[Node], n: Node, value) -> float:
    """Cover-weighted mean of value(child) over a node's children."""
    return sum(tree[k].cover * value(k) for k in n.children) / max(sum(tree[k].cover for k in n.children), 1e-300)


def _along(model: Model, x: np.ndarray, method: str) -> np.ndarray:
    """[row, feature..., bias] by what changes from a node to its child on the row's path."""
    out = np.zeros((len(x), len(model.features) + 1))
    out[:, -1] = model.base_score
    so_far = np.full(len(x), model.base_score)
    sig = lambda v: 1 / (1 + np.exp(-v))
    if method == "ProbabilityChange":
        out[:, -1] = sig(out[:, -1])
    for tree in model.trees:
        mean = _means(tree)
        value = {n.id: mean[n.id] if method in ("Average", "Shapley") else n.weight for n in tree}
        root = value[0]
        if method in ("Weight", "Average"):
            out[:, -1] += root
        elif method == "ProbabilityChange":
            out[:, -1] += sig(so_far + root) - sig(so_far)
        for n, rows in model.visits(tree, x):
            if n.is_leaf:
                if method == "ProbabilityChange":
                    so_far[rows] += n.weight
                continue
            heaviest = max(n.children, key=lambda k: tree[k].cover)
            mid = _weighted(tree, n, lambda k: tree[k].weight)
            for took, mask in model.branches(n, x[rows]):
                here, a = rows[mask], tree[took]
                if method in ("Weight", "Average"):
                    d = value[took] - value[n.id]
                elif method == "BranchDifference":
                    d = a.weight - tree[n.right if took == n.left else n.left].weight
                elif method == "MidpointDifference":
                    d = a.weight - mid
                elif method == "ModeDifference":
                    d = a.weight - tree[heaviest].weight
                else:
                    d = sig(so_far[here] + a.weight) - sig(so_far[here] + n.weight)
                out[here, n.feature] += d
    return out


def _shapley(model: Model, x: np.ndarray) -> np.ndarray:
    """Exact path-dependent Shapley values, a leaf at a time and all rows at once.

    A leaf is reached if each feature on its path holds; a feature left out holds with the share of cover that its branches
    keep. A feature's value is its marginal effect averaged over orders, summed by the size of what came before.
    """
    out = np.zeros((len(x), len(model.features) + 1))
    out[:, -1] = model.base_score
    for tree in model.trees:
        out[:, -1] += _means(tree)[0]
        todo: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = [(0, {})]
        while todo:
            i, path = todo.pop()
            n = tree[i]
            if not n.is_leaf:
                whole = max(sum(tree[k].cover for k in n.children), 1e-300)
                for k, side in model.branches(n, x):
                    hot, cold = path.get(n.feature, (np.ones(len(x), bool), 1.0))
                    todo.append((k, {**path, n.feature: (hot & side, cold * tree[k].cover / whole)}))
                continue
            fs = list(path)
            d = len(fs)
            for f in fs:
                poly = np.zeros((len(x), d))
                poly[:, 0] = 1
                for g in fs:
                    if g != f:
                        hot, cold = path[g]
                        grown = poly * cold
                        grown[:, 1:] += poly[:, :-1] * hot[:, None]
                        poly = grown
                share = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
                hot, cold = path[f]
                out[:, f] += n.weight * (hot - cold) * (poly @ share)
    return out


def contributions_of(model: Model, x: np.ndarray, method: str = "Average") -> np.ndarray:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    got = _shapley(model, x) if method == "Shapley" else _along(model, x, method)
    return got if method == "ProbabilityChange" else got + model.head_terms(x)


def contributions(model: Model, method: str = "Average") -> Column:
    """A value for each feature, in order, then the bias."""
    return model._udf(lambda x: list(contributions_of(model, x, method)), "array<double>")


def partial_dependence(model: Model, feature: str, values: list[float | None]) -> list[tuple[float | None, float]]:
    """Cover-weighted expectation of the score at each value of a feature (None: missing), categories included."""
    f, out = model.features.index(feature), []
    for v in values:
        x = np.full((1, len(model.features)), np.nan)
        x[0, f] = np.nan if v is None else v

        def at(tree: list[Node], i: int) -> float:
            n = tree[i]
            if n.is_leaf:
                return n.weight
            if n.feature == f:
                return at(tree, next(k for k, m in model.branches(n, x) if m[0]))
            return _weighted(tree, n, lambda k: at(tree, k))

        out.append((v, float(model.base_score + sum(at(t, 0) for t in model.trees) + model.head_terms(x).sum())))
    return out


def grid(df: DataFrame, feature: str, samples: int = 100, low: float = 0.2, high: float = 0.98) -> list[float]:
    """Values for a partial dependence: quantiles between two shares, sorted and distinct."""
    ps = [low + (high - low) * i / max(1, samples - 1) for i in range(samples)]
    return sorted(set(df.agg(F.percentile_approx(feature, ps, 10_000)).first()[0] or []))


def reason_codes(model: Model, threshold: float, n: int = 3, method: str = "Average", direction: str = "lower") -> Column:
    """For rows that the threshold rejects, the n features that push that way most; else null."""
    c = contributions(model, method)
    names = F.lit(model.features)
    pairs = F.transform(F.slice(c, 1, len(model.features)), lambda v, i: F.struct((v if direction == "lower" else -v).alias("v"), F.get(names, i).alias("f")))
    worst = F.transform(F.slice(F.filter(F.array_sort(pairs), lambda p: p["v"] < 0), 1, n), lambda p: p["f"])
    score = model.raw_score()
    return F.when(score < threshold if direction == "lower" else score > threshold, worst)
