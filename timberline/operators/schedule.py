"""What a fit takes from its data's shape, and what becomes of a tree once it is grown.

A schedule is a handful of numbers worked out on the driver before the first round. It knows three families of
objectives and three sizes of tables, where finer rules of thumb for tables under a thousand rows exist elsewhere:
such tables are not what this engine is for, and a rule that nobody can check is not kept.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.objectives import Objective
from timberline.operators.tree import Model, Node

BINARY = ("LogLoss", "BrierLoss", "HingeLoss", "CrossEntropyLoss", "CrossEntropyLambdaLoss")
ROBUST = ("SquaredLoss", "QuantileLoss", "HuberLoss", "AdaptiveHuberLoss", "AbsoluteLoss")
# fixed values: ridge of a leaf: constant, per log of rows a feature, per share of categories; its cap; rows it starts at
RIDGE = {"binary": (0.015, 0.012, 0.02), "robust": (0.008, 0.008, 0.0), "other": (0.01, 0.01, 0.0)}
RIDGE_CAP, RIDGE_ROWS, RIDGE_RELIEF = 0.12, 32, 0.35
# fixed values: rounds and idle rounds at budget 1, how they grow beyond it and by how much at most
ROUNDS, ROUNDS_GROW, ROUNDS_CAP = 1000, 0.35, 4.0
IDLE, IDLE_GROW, IDLE_CAP = 3, 0.5, 6.0
# fixed values: rows times features that one tree scans whole; the share left out beyond that; rows it must be
WORK, WORK_GROW, LEFT_OUT, LEFT_ROWS = 180_000, 0.35, 0.05, 2048
# fixed values: healthy and weak generalization; what counts as falling behind; trees remembered
HEALTHY, WEAK, BEHIND, RECENT = 1.0, 0.99, 0.002, 8
# fixed values: damping's strength for generalization, instability and concentration; its floor; scales of the first two
DAMP = {"binary": (0.12, 0.16, 0.18, 0.6), "robust": (0.06, 0.22, 0.0, 0.82), "other": (0.06, 0.22, 0.0, 0.82)}
SHORTFALL, UNSTEADY = 0.015, (0.88, 0.38)
# fixed values: how fast the step shrinks beyond budget 1, and up to which features (binary) or rows and features (robust)
BINARY_SLOPE, BINARY_FEATURES = 0.65, 96
ROBUST_SLOPE, ROBUST_ROWS, ROBUST_FEATURES = 1.1, 16_384, 32
#: Rows up to which leaves are refined four times, and from which once; trees a fit has at least, at budget 0 and at most.
SMALL_ROWS, LARGE_ROWS = 2048, 100_000
LEAST_BINARY, MOST_BINARY, LEAST_ROBUST = 2, 96, 40
#: Steps tried for a leaf's further Newton steps, largest first; the least change of the mean loss.
STEPS, LEAST_CHANGE = (1.0, 0.5, 0.25, 0.125), 1e-7


def family(objective: str | Objective) -> str:
    name = objective if isinstance(objective, str) else objective.name
    return "binary" if name in BINARY else "robust" if name in ROBUST else "other"


@dataclass(frozen=True)
class Schedule:
    """eta and target are of the training step, the rest replaces Config's fields of these names."""

    eta: float
    ridge: float
    iterations: int
    stopping_rounds: int
    subsample: float
    refine: int
    least_trees: int


def step_size(budget: float, kind: str, rows: int, features: int) -> float:
    """10 to minus the budget; beyond budget 1 small steps come slower for losses with a curvature of their own
    and, where a small table is cheap to pass over, faster for robust ones."""
    slope = 1.0
    if kind == "binary" and features <= BINARY_FEATURES:
        slope = BINARY_SLOPE
    elif kind == "robust" and rows <= ROBUST_ROWS and features <= ROBUST_FEATURES:
        slope = ROBUST_SLOPE
    return 10.0 ** -(min(budget, 1.0) + slope * max(budget - 1.0, 0.0))


# fixed values: what is left of a log loss's budget beyond 1, by the most and least rows, most and least features and least
# share of categories of the tables it holds for; the first that fits counts
BUDGETS = (
    (0.5, None, 50_000, 32, None, 0.6),
    (0.3, 1_000, None, 4, None, 0.0),
    (0.7, 1_000, None, 12, None, 0.0),
    (0.8, 1_500, None, 24, None, 0.0),
    (0.4, 10_000, None, None, 64, 0.0),
)


def scheduled_budget(budget: float, objective: str, rows: int, features: int, categorical: int = 0) -> float:
    """A log loss's budget, damped beyond 1 for tables that are small, or wide, or mostly categories."""
    if budget <= 1 or objective != "LogLoss":
        return budget
    for part, most_rows, least_rows, most, least, share in BUDGETS:
        within = (most_rows is None or rows <= most_rows) and (least_rows is None or rows >= least_rows)
        if within and (most is None or features <= most) and (least is None or features >= least) and categorical >= share * max(features, 1):
            return 1 + part * (budget - 1)
    return budget


class FeatureSample:
    """Which features a tree may split: the ``count`` of highest mean gain a tree they were tried in, plus what their mean is
    unsure by (an upper confidence bound), so that features not tried for long come up again. Ties go by a hash of the seed."""

    def __init__(self, features: int, count: int, seed: int = 0):
        self.count, self.tried, self.gain = max(1, min(count, features)), np.zeros(features), np.zeros(features)
        self.order = np.random.default_rng(seed).permutation(features)

    def draw(self) -> list[int]:
        rounds = self.tried.sum() / self.count
        tried = np.maximum(self.tried, 1)
        mean = self.gain / tried
        worth = np.where(self.tried > 0, mean / (mean.max() or 1.0) + 0.5 * np.sqrt(np.log1p(rounds) / tried), np.inf)
        got = sorted(self.order[np.argsort(-worth[self.order], kind="stable")][: self.count].tolist())
        self.tried[got] += 1
        return got

    def learn(self, tree: list[Node]) -> None:
        for n in tree:
            if not n.is_leaf:
                self.gain[n.feature] += max(n.gain, 0.0)


def leaf_ridge(budget: float, kind: str, rows: int, features: int, categorical: int = 0) -> float:
    """More where a feature has many rows, less for large budgets."""
    if rows < RIDGE_ROWS:
        return 0.0
    base, per_log, per_category = RIDGE[kind]
    wide = max(features, 1)
    raw = base + per_log * math.log1p(max(rows / wide, 1.0)) + per_category * categorical / wide
    return min(RIDGE_CAP, raw / max(budget, 0.75) ** RIDGE_RELIEF)


def target_decrement(budget: float, first: float, now: float) -> float:
    """How much mean loss a tree may take off: a share of a blend of the first loss and the present one. The share is
    what a geometric series of ratio budget/10 leaves beyond its second term, short of its first: b/5 - b/(10 - b)."""
    b = min(max(budget, 0.1), 4.9)
    keep = min(max(1 - 0.1 * budget, 0.85), 0.995) if budget > 0.2 else 1.0
    share = b / 5 - b / (10 - b)
    return share * 10.0 ** -min(b, 3.0) * max(keep * first + (1 - keep) * now, 1e-12) * (1.2 if budget > 0.2 else 1.0)


def row_rate(budget: float, rows: int, features: int) -> float:
    """A twentieth of the rows is left out of a tree where that is many and a pass over all is much work."""
    much = rows * max(features, 1) > WORK * max(budget, 0.5) ** WORK_GROW
    return 1 - LEFT_OUT if much and rows * LEFT_OUT >= LEFT_ROWS else 1.0


# fixed values: rows and features of plain regressions that leave some FRONTIER rows out of each tree; the least and most share
FRONTIER_ROWS, FRONTIER_FEATURES, FRONTIER, FRONTIER_SHARE = (640, 2048), (2, 12), 48, (0.05, 0.12)
# fixed values: rows from which a log loss's folds are redrawn for each tree; rows and features of tables that keep theirs
REDRAW_ROWS, KEEP_ROWS, KEEP_FEATURES = 2000, 4096, 32


def frontier_rate(budget: float, objective: str, rows: int, features: int, categorical: int = 0) -> float:
    """The share of rows that a tree of a small regression sees, so that the rest tell when to stop; else 1."""
    within = lambda v, ends: ends[0] <= v <= ends[1]
    if objective != "SquaredLoss" or budget < 1 or categorical or not within(rows, FRONTIER_ROWS) or not within(features, FRONTIER_FEATURES):
        return 1.0
    return 1 - min(max(FRONTIER / rows, FRONTIER_SHARE[0]), FRONTIER_SHARE[1])


def redraws_folds(objective: str, rows: int, features: int) -> bool:
    """Whether each tree of a two-class fit has folds of its own: on small tables of few features folds stay."""
    return objective == "LogLoss" and rows >= REDRAW_ROWS and (rows > KEEP_ROWS or features > KEEP_FEATURES)


def schedule(budget: float, objective: str | Objective, rows: int, features: int, categorical: int = 0, monotone: bool = False) -> Schedule:
    """All numbers of a fit. Larger budgets take more rounds; small tables have their leaves refined more often."""
    kind = family(objective)
    more = max(budget - 1.0, 0.0)
    grown = lambda start, by, cap: start * min(10.0 ** (by * more), cap)
    passes = 1 if monotone or kind == "other" or rows > LARGE_ROWS else 4 if rows <= SMALL_ROWS else 2
    least = min(MOST_BINARY, round(LEAST_BINARY * 10.0 ** (0.5 * budget))) if kind == "binary" else round(LEAST_ROBUST * 10.0 ** (0.5 * more)) if kind == "robust" else 0
    return Schedule(
        eta=step_size(budget, kind, rows, features),
        ridge=leaf_ridge(budget, kind, rows, features, categorical),
        iterations=round(grown(ROUNDS, ROUNDS_GROW, ROUNDS_CAP)),
        stopping_rounds=math.ceil(grown(IDLE, IDLE_GROW, IDLE_CAP)),
        subsample=min(row_rate(budget, rows, features), frontier_rate(budget, objective if isinstance(objective, str) else objective.name, rows, features, categorical)),
        refine=passes,
        least_trees=least,
    )


# what a tree is worth


def _steady(n: Node) -> float:
    w = np.array(n.fold_weights)
    size = np.abs(w).mean()
    return float(np.clip(1 / (1 + w.std() / (size + 1e-6)), 0.5, 1.0)) if size > 0 else 1.0


def specialization(tree: list[Node]) -> float:
    """1 where a tree's effect is spread evenly over its leaves, 0 where one leaf has it all: how many leaves of equal effect
    would concentrate it as much (the inverse of the sum of squared shares), between one and all."""
    effect = np.array([abs(n.weight) * n.count for n in tree if n.is_leaf])
    if len(effect) < 2 or not effect.sum():
        return 1.0
    share = effect / effect.sum()
    return float((1 / (share**2).sum() - 1) / (len(effect) - 1))


def reliability(tree: list[Node]) -> float:
    """How steady the weights of splits are over folds; large gains and many rows count more."""
    splits = [n for n in tree if not n.is_leaf]
    if not splits:
        return 1.0
    by = [math.sqrt(max(n.gain, 0.0)) + math.log1p(max(n.count, 1)) for n in splits]
    return float(np.clip(np.average([_steady(n) for n in splits], weights=by), 0.5, 1.0))


def tree_generalization(tree: list[Node], kind: str) -> float:
    """Of the splits that made a tree's nodes: the best one's generalization for binary losses, where single strong splits
    decide, else the mean over rows. 0 for a tree without splits."""
    below = tree[1:]
    if not below:
        return 0.0
    values = [n.generalization for n in below]
    return max(values) if kind == "binary" else float(np.average(values, weights=[max(n.count, 1) for n in below]))


class History:
    """Trees so far: decides by how much the next is damped, and whether trees have shrunk to nothing."""

    def __init__(self, kind: str):
        self.kind = kind
        self.scores: deque[float] = deque(maxlen=RECENT)
        self.sizes: deque[int] = deque(maxlen=RECENT)
        self.best = 0.0

    def regressive(self, score: float) -> bool:
        """Weak, or behind the trend, after better trees."""
        if len(self.scores) < 3 or self.best < HEALTHY:
            return False
        return score < WEAK or score + BEHIND < max(float(np.mean(self.scores)), WEAK)

    def multiplier(self, tree: list[Node]) -> float:
        """Below 1 for a tree that generalises worse than those before it, is unsteady over folds or rests on few leaves."""
        if not self.scores:
            return 1.0
        score = tree_generalization(tree, self.kind)
        *strengths, floor = DAMP[self.kind]
        usual = max(float(np.mean(self.scores)), WEAK)
        behind = self.regressive(score)
        short = (max(0.0, (usual + max(self.best, usual)) / 2 - score) / SHORTFALL) if score < usual and (self.kind == "binary" or behind) else 0.0
        unsteady = min(1.0, max(0.0, UNSTEADY[0] - reliability(tree)) / UNSTEADY[1])
        pressures = (short, unsteady, 1 - specialization(tree))
        return max(floor, math.prod(1 / (1 + s * p**2) for s, p in zip(strengths, pressures)))

    def spent(self, budget: float, idle: int) -> bool:
        """Large budgets end where trees shrink, generalise worse and no longer improve."""
        if budget < 2 or len(self.sizes) < RECENT or idle < RECENT // 2:
            return False
        sizes, half = list(self.sizes), RECENT // 2
        return sum(sizes[half:]) < sum(sizes[:half]) and self.scores[-1] < max(float(np.mean(self.scores)), WEAK)

    def add(self, tree: list[Node]) -> None:
        score = tree_generalization(tree, self.kind)
        self.scores.append(score)
        self.sizes.append(len(tree))
        self.best = max(self.best, score)


def rescale(tree: list[Node], by: float) -> None:
    for n in tree:
        n.weight *= by
        n.fold_weights = [w * by for w in n.fold_weights]


# leaves refined: further Newton steps for the leaves of a grown tree


def leaf_steps(rows: DataFrame, leaf: Column, g: Column, h: Column, ridge: float = 0.0) -> DataFrame:
    """(leaf, step, n): a Newton step of each leaf at the present scores. Sums are combined before the shuffle, and there
    are as many rows as leaves."""
    sums = rows.select(leaf.alias("leaf"), g.alias("g"), h.alias("h")).groupBy("leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    return sums.select("leaf", F.when(F.col("h") > 0, -F.col("g") / (F.col("h") + ridge + 1e-12)).otherwise(0.0).alias("step"), "n")


def refine(rows: DataFrame, model: Model, tree: list[Node], passes: int, columns, ridge: float = 0.0) -> int:
    """Gives the tree's leaves up to ``passes`` further steps; columns(score) are loss, gradient and hessian of a row whose
    ``_score`` is without the tree. A pass is two jobs, each one aggregate with no row moved: sums by leaf, then the mean
    loss of no step and of every step size at once. The largest size that lowers it is taken. Returns the passes made."""
    for made in range(passes):
        score = F.col("_score") + model.route(tree, lambda n: F.lit(float(n.weight)))
        at = columns(score)
        got = {r["leaf"]: r["step"] * model.eta for r in leaf_steps(rows, model.route(tree, lambda n: F.lit(n.id)), at["gradient"], at["hessian"], ridge).collect()}
        got = {k: v for k, v in got.items() if v is not None and math.isfinite(v)}
        if max(map(abs, got.values()), default=0.0) <= 1e-8:
            return made
        step = model.route(tree, lambda n: F.lit(float(got.get(n.id, 0.0))))
        d = rows.withColumns({"_at": score, "_step": step})
        losses = d.agg(*[F.avg(columns(F.col("_at") + s * F.col("_step"))["loss"]) for s in (0.0, *STEPS)]).first()
        better = [s for s, v in zip(STEPS, losses[1:]) if v is not None and v + LEAST_CHANGE < losses[0]]
        if not better:
            return made
        for n in tree:
            if n.is_leaf and n.id in got:
                n.weight += better[0] * got[n.id]
                n.fold_weights = [w + better[0] * got[n.id] for w in n.fold_weights]
    return passes


# the best prefix of trees

# fixed values: what generalization adds to a log loss's proxy, and between which bounds; what mean loss takes from a robust loss's
PROXY_GAIN, PROXY_BOUNDS, PROXY_LOSS = 0.2, (-0.05, 0.15), 0.05
# fixed values: by how much a later prefix must be better: a budget's worth, at least, at most; areas out of bag, log losses, robust losses
MARGINS = {"area": (0.00025, 0.00015, 0.001), "binary": (0.00075, 0.00035, 0.003), "robust": (0.00075, 0.001, 0.003)}
MARGIN_OUT, MARGIN_OTHER = 1e-6, 1e-5


def prefix_proxy(objective: str, loss: float, generalization: float, sampled: bool = False, area: float | None = None) -> float:
    """How good the trees so far are thought to be; greater is better. Out of the last tree's sample: the area under the curve (log
    loss, where there is one) or the mean loss. Where trees see all rows, a log loss counts with how far the last tree
    generalises, and a robust loss gives way to it."""
    if sampled:
        return area if objective == "LogLoss" and area is not None else -loss
    if objective == "LogLoss":
        return PROXY_GAIN * min(max(generalization - WEAK, PROXY_BOUNDS[0]), PROXY_BOUNDS[1]) - loss
    return generalization - PROXY_LOSS * loss if family(objective) == "robust" else -loss


class PrefixWatch:
    """Remembers after which tree the proxy was best, by more than a margin over the best before; fewer than ``least`` don't count."""

    def __init__(self, objective: str, budget: float, sampled: bool, least: int = 1):
        self.objective, self.sampled, self.least, self.trees, self.best = objective, sampled, least, 0, -math.inf
        kind = "area" if sampled else "robust" if family(objective) == "robust" else "binary"
        if sampled and objective != "LogLoss":
            self.margin = MARGIN_OUT
        elif objective == "LogLoss" or kind == "robust":
            each, low, high = MARGINS[kind]
            self.margin = min(max(each * max(budget, 1.0), low), high)
        else:
            self.margin = MARGIN_OTHER

    def see(self, trees: int, loss: float | None, generalization: float, area: float | None = None) -> None:
        if trees < self.least or loss is None or not math.isfinite(loss):
            return
        proxy = prefix_proxy(self.objective, loss, generalization, self.sampled, area)
        if not self.trees or proxy > self.best + self.margin:
            self.trees, self.best = trees, proxy


def prefix_losses(model: Model, df: DataFrame, loss) -> DataFrame:
    """(trees, loss, n): the mean loss of the first trees, for every number of them, in one job. loss(score) is a column.
    Each row is walked once, in Arrow batches; a prefix's sums are combined before the shuffle."""
    names = model.features

    @F.pandas_udf("array<double>")
    def run(frame: pd.DataFrame) -> pd.Series:
        x = frame[names].to_numpy(dtype=float)
        out = np.full((len(x), len(model.trees) + 1), float(model.base_score))
        for t, tree in enumerate(model.trees):
            for n, at in model.visits(tree, x):
                if n.is_leaf:
                    out[at, t + 1] = n.weight
        return pd.Series(list(np.cumsum(out, axis=1)))

    scores = run(F.struct(*[F.col(f).cast("double").alias(f) for f in names]))
    each = df.select("*", F.posexplode(scores).alias("trees", "_score"))
    return each.select("trees", loss(F.col("_score")).alias("loss")).groupBy("trees").agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))


def best_prefix(model: Model, df: DataFrame, loss, least: int = 1) -> Model:
    """Keeps the fewest first trees, at least ``least``, of the lowest mean loss over df, which no tree should have seen."""
    if len(model.trees) > least:
        got = sorted((r["loss"], r["trees"]) for r in prefix_losses(model, df, loss).collect() if r["trees"] >= least and r["loss"] is not None)
        if got:
            model.trees = model.trees[: got[0][1]]
    return model
