"""Scalar building blocks of boosted trees, as columns. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps a weight finite where no hessian is left.
TINY = 1e-8


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def is_missing(v: Column, missing: float | None = None) -> Column:
    """Null, NaN, or the configured value."""
    gone = v.isNull() | F.isnan(v)
    return gone if missing is None else gone | (v == missing)


def between(v: Column, a: Column, b: Column) -> Column:
    return v.between(F.least(a, b), F.greatest(a, b))


def leaf_weight(g: Column, h: Column, ridge: float = 0.0) -> Column:
    """-G / (H + ridge + TINY). With a constant hessian h is the row count and TINY is left out by ``const_leaf_weight``."""
    return -g / (h + ridge + TINY)


def const_leaf_weight(g: Column, n: Column, ridge: float = 0.0) -> Column:
    return -g / F.nullif(n + F.lit(ridge), F.lit(0.0))


def node_gain(g: Column, h: Column, ridge: float = 0.0) -> Column:
    """G**2 / (H + ridge + TINY), without the half."""
    return g * g / (h + ridge + TINY)


def const_node_gain(g: Column, n: Column, ridge: float = 0.0) -> Column:
    return g * g / F.nullif(n + F.lit(ridge), F.lit(0.0))


def gain_at(g: Column, h: Column, w: Column, ridge: float = 0.0) -> Column:
    """What a given weight gains: -(2 G w + (H + ridge + TINY) w**2)."""
    return -(2 * g * w + (h + ridge + TINY) * w * w)


def const_gain_at(g: Column, n: Column, w: Column, ridge: float = 0.0) -> Column:
    return -(2 * g * w + (n + ridge) * w * w)


def constrained(w: Column, low: Column, high: Column, direction: int | None) -> Column:
    """w within its bounds, where the feature has a monotone direction."""
    return w if direction is None else F.least(F.greatest(w, low), high)


def culled(gain: Column, left: Column, right: Column, direction: int) -> Column:
    """-inf for children that go against a direction (1 up, -1 down, 0 none)."""
    against = left > right if direction > 0 else left < right if direction < 0 else F.lit(False)
    return F.when(against, float("-inf")).otherwise(gain)


def bound_to_parent(left: Column, right: Column, parent: Column) -> tuple[Column, Column]:
    """Where both children lie on one side of the parent's weight, the nearer moves onto it."""
    off = ~between(parent, left, right)
    nearer = F.abs(parent - left) <= F.abs(parent - right)
    return F.when(off & nearer, parent).otherwise(left), F.when(off & ~nearer, parent).otherwise(right)


def split_gain(left: Column, right: Column, parent: Column, missing: Column | None = None) -> Column:
    return left + right - parent if missing is None else left + right + missing - parent


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of a 2x2 table; 0 where a margin is empty."""
    n, under = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(under > 0, n * (a * d - b * c) ** 2 / F.nullif(under, F.lit(0.0))).otherwise(0.0)


def generalization(parent: Column, train: Column, valid: Column) -> Column:
    """How much of the training improvement holds on the held-out fold."""
    return (parent - train) / F.nullif(parent - valid, F.lit(0.0))


def each_fold(xs: Column, fn) -> Column:
    """fn of each of five values; without a lambda, so that xs may come from a Python function."""
    return F.array(*[fn(F.get(xs, j)) for j in range(5)])


def _over_folds(xs: Column, fn=lambda x: x) -> Column:
    return sum((fn(F.get(xs, j)) for j in range(1, 5)), fn(F.get(xs, 0))) / 5


def fold_mean(xs: Column) -> Column:
    """Sum over five, even where fewer folds counted."""
    return _over_folds(xs)


def fold_spread(xs: Column) -> Column:
    """Population standard deviation of five values."""
    m = fold_mean(xs)
    return F.sqrt(_over_folds(xs, lambda x: (x - m) * (x - m)))


def fold_stability(xs: Column) -> Column:
    """1 / (1 + sd / mean magnitude), within a half and 1; 1 where all are zero."""
    size = _over_folds(xs, F.abs)
    return F.when(size > 0, F.least(F.greatest(1 / (1 + fold_spread(xs) / (size + 1e-6)), F.lit(0.5)), F.lit(1.0))).otherwise(1.0)


def fold_energy(xs: Column) -> Column:
    """Root of the mean square."""
    return F.sqrt(_over_folds(xs, lambda x: x * x))


def split_stability(left: Column, right: Column) -> Column:
    return (fold_stability(left) + fold_stability(right)) / 2


# fixed values: the floor of a split's generalization (numeric, categorical), what instability adds, relief, least floor
FLOORS, UNSTABLE, RELIEF, LEAST_FLOOR = (1.0, 0.99), (0.0, 0.004), (0.01, 0.006), (0.98, 0.984)
RELIEF_ROWS, RELIEF_DEPTH = 2048, 3
# fixed values: a rank's share of stability, the power of generalization and its cap (numeric, categorical); weight of energy
STEADY, POWER, CAP, ENERGY = (0.08, 0.25), (0.1, 0.3), (1.05, 1.12), 0.02
# fixed values: a small child's share and rows; the least factor, plain and strict
SPARSE_SHARE, SPARSE_ROWS, SPARSE_LEAST = 0.12, 96, (0.9, 0.82)


def _within(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low) if isinstance(low, (int, float)) else low), F.lit(high))


def generalization_floor(stability: Column, depth: Column, count: Column, categorical: bool = False) -> Column:
    """What a split must reach under the root; small, deep and stable nodes are asked less."""
    i = int(categorical)
    need = FLOORS[i] + UNSTABLE[i] * (1 - stability)
    small = 1 - F.least(count, F.lit(RELIEF_ROWS)) / RELIEF_ROWS
    deep = 0.5 + 0.5 * F.least(depth, F.lit(RELIEF_DEPTH)) / RELIEF_DEPTH
    return _within(need - RELIEF[i] * small * deep * _within(stability, 0.5, 1.0), LEAST_FLOOR[i], FLOORS[0])


def split_rank(gain: Column, gen: Column, left: Column, right: Column, categorical: bool = False) -> Column:
    """Gain by stability and generalization of fold weights; large weights of categories are damped."""
    i = int(categorical)
    steady = split_stability(left, right)
    least = FLOORS[i] + UNSTABLE[i] * (1 - steady)
    out = gain * (1 - STEADY[i] + STEADY[i] * steady) * F.pow(_within(gen, least, CAP[i]), F.lit(POWER[i]))
    return out / (1 + ENERGY * (fold_energy(left) + fold_energy(right))) if categorical else out


def sparse_balance(left: Column, right: Column, strict: bool = False) -> Column:
    """Damps a split of many categories that sets apart a very small child."""
    fewer = F.least(left, right)
    share = fewer / F.greatest(left + right, F.lit(1))
    factor = F.least(F.sqrt(share / SPARSE_SHARE), F.sqrt(fewer / SPARSE_ROWS))
    least = SPARSE_LEAST[int(strict)]
    return F.when((share >= SPARSE_SHARE) | (fewer >= SPARSE_ROWS), 1.0).otherwise(least + (1 - least) * F.least(factor, F.lit(1.0)))


def softmax(xs: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(xs)
    up = F.transform(xs, lambda x: F.exp((x - top) / temperature))
    return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda a, y: a + y))
