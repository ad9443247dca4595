"""Boosting: executors aggregate, the driver decides."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.objectives import Objective, objective, robust_squared
from timberline.functions import metrics as M
from timberline.functions import primitives as P
from timberline.functions.primitives import TINY
from timberline.operators.binning import map_bin, sketched_cuts, weighted_cuts
from timberline.operators.histogram import FOLDS, fold_histogram, ordering_scores
from timberline.operators import schedule as S
from timberline.operators.sampling import drawn, split_rows
from timberline.operators.tree import Model, Node
from timberline.sources.tables import WRITTEN, cut_lineage, discard

CUT_EVERY = 8
#: Objectives whose hessian is 1; bins from which a category's small children are damped.
CONSTANT, SPARSE_BINS = ("SquaredLoss", "QuantileLoss", "AbsoluteLoss", "MapeLoss"), 48
# fixed values: when a small regression has a linear head, its ridge, its share and what it must gain
HEAD_BUDGET, HEAD_FEATURES, HEAD_ROWS = 1.0, (2, 12), (256, 2048)
HEAD_RIDGE, HEAD_BLEND, HEAD_GAIN = 1.0, 0.2, 0.999
#: The weight of a branch for missing values: its own, its parent's, or its siblings' mean (by count, or once the tree is grown).
TREATMENTS = ("None", "AssignToParent", "AverageNodeWeight", "AverageLeafWeight")


@dataclass
class Config:
    """budget sets the step (10**-budget) and how much loss a tree may take off; more is slower and finer.

    With missing_branch a split gives missing values a child of their own, which is split further unless missing_splits
    is off or the feature is in end_missing; missing_treatment sets its weight.

    ``refine`` gives leaves that many Newton steps in all; ``damp`` shrinks trees that generalise worse than those before;
    ``holdout`` is a share of rows that no tree sees and by which the number of trees is chosen. ``scheduled`` takes step,
    ridge, rounds, sample and refinement from the data's shape: iterations stays the most, other fields give way.
    ``prefix`` keeps the first trees at which a proxy was best, without rows held out: one more aggregate a round, over the rows that the
    round's sample leaves out or, without a sample, over all. ``redraw_folds`` gives each tree folds of its own.
    ``robust`` clips squared loss's gradients in rounds whose residuals have long tails. ``feature_share`` is how many of the features
    each tree may split, chosen by what they gained before; histograms are of these alone, which wide tables need most.
    """

    objective: str | Objective = "LogLoss"
    budget: float = 0.5
    max_bin: int = 64
    iterations: int = 100
    stopping_rounds: int = 3
    max_nodes: int = 63
    ridge: float = 0.0
    categorical: list[str] = field(default_factory=list)
    monotone: dict[str, int] = field(default_factory=dict)
    interactions: list[list[str]] | None = None
    weight: str | None = None
    missing_branch: bool = False
    missing_splits: bool = True
    missing_treatment: str = "None"
    end_missing: list[str] = field(default_factory=list)
    linear_head: bool = True
    subsample: float = 1.0
    refine: int = 1
    damp: bool = False
    holdout: float = 0.0
    scheduled: bool = False
    robust: bool = False
    feature_share: float = 1.0
    prefix: bool = False
    redraw_folds: bool = False
    seed: int = 0

    def __post_init__(self):
        if self.budget <= 0 or not 2 <= self.max_bin <= 65535 or not 0 < self.subsample <= 1 or self.iterations < 0 or self.refine < 1 or not 0 <= self.holdout < 1 or not 0 < self.feature_share <= 1:
            raise ValueError("a parameter is out of range")
        if self.missing_treatment not in TREATMENTS:
            raise ValueError(f"unknown missing treatment {self.missing_treatment}")
        if any(v not in (-1, 0, 1) for v in self.monotone.values()):
            raise ValueError("monotone directions are -1, 0 and 1")


@dataclass
class _Open:
    node: Node
    hist: list[np.ndarray] | None
    bounds: tuple[float, float] = (-np.inf, np.inf)
    used: frozenset = frozenset()
    parent_hist: list[np.ndarray] | None = None
    sibling: int = -1


def _evaluate(left: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
    """left, right: [..., fold, (g, h, n)]. Gain on all rows, generalization over folds, and both sides' fold weights."""
    lt, rt = left.sum(axis=-2), right.sum(axis=-2)
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + TINY)
    both = lt + rt
    gain = score(lt) + score(rt) - score(both)
    lo, ro = lt[..., None, :] - left, rt[..., None, :] - right
    ok = (left[..., 2] > 0) & (right[..., 2] > 0) & (lo[..., 2] > 0) & (ro[..., 2] > 0)
    wl, wr = -lo[..., 0] / (lo[..., 1] + TINY), -ro[..., 0] / (ro[..., 1] + TINY)
    n, m = np.maximum(lo[..., 2] + ro[..., 2], 1), np.maximum(left[..., 2] + right[..., 2], 1)
    train = np.where(ok, -0.5 * (score(lo) + score(ro)) / n, 0).sum(axis=-1) / FOLDS
    valid = np.where(ok, (left[..., 0] * wl + 0.5 * left[..., 1] * wl**2 + right[..., 0] * wr + 0.5 * right[..., 1] * wr**2) / m, 0).sum(axis=-1) / FOLDS
    parent = -0.5 * score(both) / np.maximum(both[..., 2], 1)
    under = parent - valid
    gen = np.where(under != 0, (parent - train) / np.where(under != 0, under, 1), 0.0)  # negative where held-out folds get worse
    steady = (_stability(wl) + _stability(wr)) / 2
    energy = np.sqrt((wl**2).mean(axis=-1)) + np.sqrt((wr**2).mean(axis=-1))
    return {"gain": gain, "gen": gen, "folds": ok.sum(axis=-1), "left": lt, "right": rt, "steady": steady, "energy": energy}


def _stability(w: np.ndarray) -> np.ndarray:
    size = np.abs(w).mean(axis=-1)
    return np.where(size > 0, np.clip(1 / (1 + w.std(axis=-1) / (size + 1e-6)), 0.5, 1.0), 1.0)


def _floor(steady: np.ndarray, depth: int, count: float, cat: bool) -> np.ndarray:
    need = P.FLOORS[cat] + P.UNSTABLE[cat] * (1 - steady)
    relief = P.RELIEF[cat] * (1 - min(count, P.RELIEF_ROWS) / P.RELIEF_ROWS) * (0.5 + 0.5 * min(depth, P.RELIEF_DEPTH) / P.RELIEF_DEPTH)
    return np.clip(need - relief * steady, P.LEAST_FLOOR[cat], P.FLOORS[0])


def _rank(e: dict[str, np.ndarray], cat: bool, sparse: bool) -> np.ndarray:
    """By what a feature's cuts are compared where hessians vary; features are compared by gain."""
    gen = np.clip(e["gen"], P.FLOORS[cat] + P.UNSTABLE[cat] * (1 - e["steady"]), P.CAP[cat])
    out = e["gain"] * (1 - P.STEADY[cat] + P.STEADY[cat] * e["steady"]) * gen ** P.POWER[cat]
    if cat:
        out = out / (1 + P.ENERGY * e["energy"])
    if sparse:
        fewer = np.minimum(e["left"][:, 2], e["right"][:, 2])
        share = fewer / np.maximum(e["left"][:, 2] + e["right"][:, 2], 1)
        near = np.minimum(np.sqrt(share / P.SPARSE_SHARE), np.sqrt(fewer / P.SPARSE_ROWS))
        least = P.SPARSE_LEAST[0]
        out = out * np.where((share >= P.SPARSE_SHARE) | (fewer >= P.SPARSE_ROWS), 1.0, least + (1 - least) * np.minimum(near, 1))
    return out


def find_split(hist: list[np.ndarray], root: bool, cfg: Config, names: list[str], allowed: list[int], bounds=(-np.inf, np.inf), depth: int = 0) -> dict | None:
    """The best split of a node from hist[feature][bin, fold, (g, h, n)]; bin 0 is missing and goes where more is gained.

    Numeric bins are taken in order, a category's by descending mean and, where there are many, by a second statistic. A split must gain, must not go against a
    monotone direction, and, under the root, must hold on all folds and generalise by the floor,
    which is lower for small, deep, stable nodes. Cuts of one feature are ranked by gain, stability and generalization
    together where hessians vary, features by gain.
    """
    best = None
    name = cfg.objective if isinstance(cfg.objective, str) else cfg.objective.name
    varying = name not in CONSTANT or cfg.weight is not None
    for f in allowed:
        gone, bins = hist[f][0], hist[f][1:]
        cat = names[f] in cfg.categorical
        for order in category_orders(bins, cfg.ridge) if cat else [np.arange(len(bins))]:
            s = _best_cut(bins[order], gone, root, cfg, names[f], varying, bounds, depth)
            if s and (best is None or s["gain"] >= best["gain"]):
                best = s | {"feature": f, "order": order, "cat": cat}
    return best


def category_orders(bins: np.ndarray, ridge: float = 0.0) -> list[np.ndarray]:
    """Orders of a category's bins[bin, fold, (g, h, n)] to cut: by mean gradient over hessian and, from SPARSE_BINS bins
    with rows, also by the ordered statistic, the posterior mean or the lift, whichever histogram.category_scores prefers."""
    tot = bins.sum(axis=1)
    with_rows = np.flatnonzero(tot[:, 2] > 0)
    by = lambda v: with_rows[np.argsort(v[with_rows], kind="stable")]
    out = [by(tot[:, 0] / (tot[:, 1] + 1.0))]
    if len(with_rows) >= SPARSE_BINS:
        scores, mode = ordering_scores(bins[..., :2], ridge)
        other = by(scores[mode])
        if not np.array_equal(other, out[0]):
            out.append(other)
    return out


def _best_cut(bins: np.ndarray, gone: np.ndarray, root: bool, cfg: Config, name: str, varying: bool, bounds, depth: int) -> dict | None:
    """The best cut of one feature's bins as they are ordered; missing values on the side that gains more, or apart."""
    best, cat = None, name in cfg.categorical
    pre = np.cumsum(bins, axis=0)
    if len(pre) < 2:
        return None
    apart = cfg.missing_branch
    for to_left in (False, True) if gone[:, 2].sum() and not apart else (False,):
        left = pre[:-1] + gone if to_left else pre[:-1]
        right = pre[-1] - left if apart else pre[-1] + gone - left
        e = _evaluate(left, right)
        good = (e["gain"] > 1e-12) & (e["left"][:, 2] > 0) & (e["right"][:, 2] > 0)
        if not root:
            good &= (e["folds"] == FOLDS) & (e["gen"] >= _floor(e["steady"], depth, float(pre[-1][:, 2].sum() + gone[:, 2].sum()), cat))
        way = cfg.monotone.get(name, 0)
        wl, wr = (np.clip(-e[s][:, 0] / (e[s][:, 1] + cfg.ridge + TINY), *bounds) for s in ("left", "right"))
        if way:
            good &= wl <= wr if way > 0 else wl >= wr
        if not good.any():
            continue
        wm, more = 0.0, 0.0
        if apart:
            wm, more = _apart(e, gone.sum(axis=0), wl, wr, cfg, bounds)
            e["gain"] = e["gain"] + more
            good &= e["gain"] > 1e-12
            if not good.any():
                continue
        by = _rank(e, cat, cat and len(bins) >= SPARSE_BINS) if varying else e["gain"]
        i = int(np.where(good, by, -np.inf).argmax())
        if best is None or e["gain"][i] >= best["gain"]:
            best = {"at": i + 1, "missing_left": to_left, "gain": float(e["gain"][i]), "gen": float(e["gen"][i]), "wl": float(wl[i]), "wr": float(wr[i]), "left": left[i], "right": right[i], "way": way}
            if apart:
                best |= {"missing": gone, "wm": float(np.broadcast_to(wm, wl.shape)[i])}
    return best


def _apart(e: dict[str, np.ndarray], gone: np.ndarray, wl: np.ndarray, wr: np.ndarray, cfg: Config, bounds) -> tuple[np.ndarray, np.ndarray]:
    """The weight of a branch for missing values, and what it adds to the gain of splitting the rest."""
    newton = lambda s: np.clip(-s[..., 0] / (s[..., 1] + cfg.ridge + TINY), *bounds)
    rest = e["left"] + e["right"]
    whole = rest + gone
    parent = newton(whole)
    if cfg.missing_treatment == "AssignToParent" or not gone[2] and cfg.missing_treatment == "None":
        wm = parent
    elif cfg.missing_treatment == "None":
        wm = np.full(len(wl), newton(gone))
    else:
        wm = (wl * e["left"][:, 2] + wr * e["right"][:, 2]) / np.maximum(rest[:, 2], 1)
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + TINY)
    return wm, score(rest) - score(whole) - (2 * gone[0] * wm + (gone[1] + cfg.ridge + TINY) * wm**2)


def _treat(tree: list[Node], how: str) -> None:
    """Sets branches for missing values to their parents' weights, or to the mean leaf or node weight beside them."""
    def mean(i: int) -> float:
        n = tree[i]
        if n.is_leaf:
            return n.weight
        sides = [(tree[k].count, mean(k)) for k in (n.left, n.right)]
        value = sum(c * v for c, v in sides) / max(1, sum(c for c, _ in sides))
        if n.missing >= 0 and how == "AverageLeafWeight":
            mean(n.missing)
            put(n.missing, value)
        return value

    def put(i: int, weight: float) -> None:
        tree[i].weight, tree[i].fold_weights = weight, [weight] * FOLDS

    if how == "AverageLeafWeight":
        mean(0)
    elif how != "None":
        for n in tree:
            if n.missing >= 0:
                a, b = tree[n.left], tree[n.right]
                put(n.missing, n.weight if how == "AssignToParent" else (a.count * a.weight + b.count * b.weight) / max(1, a.count + b.count))


def fit(df: DataFrame, features: list[str], y: str, cfg: Config | None = None, row_id: str = "row_id", columns: Callable[[Column, Column, Column], dict[str, Column]] | None = None, start: Model | None = None, frame: Callable[[DataFrame], DataFrame] | None = None) -> Model:
    """Grows a model on df. Folds are row_id mod 5, so row_id must be a stable key.

    Each round: gradients as columns; then, best first, histograms of all open nodes in one job (the smaller of two
    siblings; the larger is the parent's less that), splits on the driver, and rows routed by an expression of the tree, so
    no row moves. The driver holds, for each open node, the sums of each feature's own bins and
    folds (a thousand features of 64 bins: 8 MB). ``columns`` replaces the objective's
    loss, gradient and hessian (a custom or causal objective); ``frame`` adds columns of these names to rows with
    ``_score``, once a round, for objectives over groups; ``start`` goes on from a model's trees.
    """
    cfg = cfg or Config()
    obj = cfg.objective if isinstance(cfg.objective, Objective) else objective(cfg.objective)
    if cfg.robust and obj.name == "SquaredLoss":
        obj = robust_squared()
    held, least, eta = None, 1, 10.0**-cfg.budget
    if cfg.scheduled:
        n, wide = df.count(), len(features)
        cfg = replace(cfg, budget=S.scheduled_budget(cfg.budget, obj.name, n, wide, len(cfg.categorical)), redraw_folds=cfg.redraw_folds or S.redraws_folds(obj.name, n, wide))
        plan = S.schedule(cfg.budget, obj, n, wide, len(cfg.categorical), bool(cfg.monotone))
        cfg = replace(cfg, ridge=plan.ridge, iterations=min(cfg.iterations, plan.iterations), stopping_rounds=plan.stopping_rounds, subsample=plan.subsample, refine=plan.refine)
        least, eta = max(1, plan.least_trees), plan.eta
    if cfg.prefix and frame:
        raise ValueError("objectives over groups have no proxy for a prefix")
    if cfg.holdout:
        if frame:
            raise ValueError("rows can't be held out of objectives over groups")
        df, held = split_rows(df, 1 - cfg.holdout, row_id, cfg.seed - 1)
    w = F.lit(1.0) if cfg.weight is None else F.col(cfg.weight).cast("double")
    make = columns or obj.columns
    if start is None:
        first = obj.start(df, F.col(y), w)
        if first is None or first in (float("inf"), float("-inf")):
            raise ValueError("the target has no rows or a single class")
        model = Model(list(features), obj.name, 0.0 if columns else float(first), eta)
    else:
        model = start
        model.head = None  # fitted anew on what the further trees leave
    if not (columns or frame):  # these may use any column; all else that a fit reads is named, and no more is written
        df = df.select(*dict.fromkeys([*features, *model.features, y, row_id, *([cfg.weight] if cfg.weight else [])]))
    rows, widths, cut_of, groups = binned(df, features, cfg, row_id)
    spark, since = df.sparkSession, len(WRITTEN)
    rows = cut_lineage(rows.withColumn("_score", model.raw_score()), "fit")
    sample = S.FeatureSample(len(features), round(cfg.feature_share * len(features)), cfg.seed) if cfg.feature_share < 1 else None
    idle, first_loss, past, history = 0, None, len(model.trees), S.History(S.family(obj))
    watch = S.PrefixWatch(obj.name, cfg.budget, cfg.subsample < 1, least) if cfg.prefix else None
    for round_ in range(cfg.iterations):
        if frame:
            made = frame(rows)
            got = {c: F.col(c) for c in ("loss", "gradient", "hessian")}
        else:
            if obj.adapt and not columns:
                make = obj.adapt(rows, F.col(y).cast("double"), F.col("_score")).columns
            made, got = rows, make(F.col(y).cast("double"), F.col("_score"), w)
        work = made.withColumns({"_g": got["gradient"], "_h": got["hessian"], "_l": got["loss"]})
        if cfg.subsample < 1:
            work = work.where(drawn(row_id, cfg.subsample, cfg.seed + round_))
        if cfg.redraw_folds:
            work = work.withColumn("_fold", F.pmod(F.xxhash64(row_id, F.lit(cfg.seed + round_), F.lit("fold")), F.lit(FOLDS)).cast("int"))
        tree, gained, loss = grow(work, features, cfg, model, widths, cut_of, groups, (lambda now: S.target_decrement(cfg.budget, first_loss if first_loss is not None else now, now)) if cfg.scheduled else None, sample.draw() if sample else None)
        if sample:
            sample.learn(tree)
        first_loss = loss if first_loss is None else first_loss
        if len(tree) < 2:
            idle += 1
            if idle >= cfg.stopping_rounds:
                break
            continue
        if cfg.damp:
            S.rescale(tree, history.multiplier(tree))
        if cfg.refine > 1 and not (frame or cfg.monotone):
            S.refine(work, model, tree, cfg.refine - 1, lambda score: make(F.col(y).cast("double"), score, w), cfg.ridge)
            _treat(tree, cfg.missing_treatment)
        history.add(tree)
        model.trees.append(tree)
        rows = rows.withColumn("_score", F.col("_score") + model.route(tree, lambda k: F.lit(float(k.weight))))
        if round_ % CUT_EVERY == CUT_EVERY - 1:
            rows = cut_lineage(rows, "fit")
            discard(spark, since, keep=1)
        if watch:
            seen = rows.where(~drawn(row_id, cfg.subsample, cfg.seed + round_)) if watch.sampled else rows
            of = make(F.col(y).cast("double"), F.col("_score"), w)["loss"]
            area = M.auc(seen.where(F.col(y).isNotNull()), y, "_score", cfg.weight).first()[0] if watch.sampled and obj.name == "LogLoss" else None
            watch.see(len(model.trees) - past, seen.agg(F.avg(of)).first()[0], S.tree_generalization(tree, S.family(obj)), area)
        idle = idle + 1 if gained < 1e-6 * max(loss, 1e-12) else 0
        if idle >= cfg.stopping_rounds or cfg.damp and history.spent(cfg.budget, idle):
            break
    if watch and 0 < watch.trees < len(model.trees) - past:
        model.trees = model.trees[: past + watch.trees]
        rows = rows.withColumn("_score", model.raw_score())
    if held is not None and not frame:
        whole = len(model.trees)
        S.best_prefix(model, held.where(F.col(y).isNotNull()), lambda score: make(F.col(y).cast("double"), score, w)["loss"], past + min(least, whole - past))
        if len(model.trees) < whole:
            rows = rows.withColumn("_score", model.raw_score())
    if cfg.linear_head and obj.name == "SquaredLoss" and not (columns or frame or cfg.categorical) and cfg.budget >= HEAD_BUDGET and HEAD_FEATURES[0] <= len(features) <= HEAD_FEATURES[1]:
        model.head = linear_head(rows, features, y)
    discard(spark, since)
    return model


def linear_head(rows: DataFrame, features: list[str], y: str) -> dict | None:
    """A ridge regression of what the trees leave, blended in where it lowers the mean squared error. One aggregate gives
    rows, means and deviations, one the products; a missing value stands at the mean."""
    x = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    rest = F.col(y).cast("double") - F.col("_score")
    a = rows.agg(F.count("*"), F.avg(rest), F.avg(rest**2), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    k = len(x)
    n, intercept, mse, means, scales = a[0], a[1], a[2], a[3 : 3 + k], a[3 + k :]
    if not HEAD_ROWS[0] <= n <= HEAD_ROWS[1] or n <= k + 1 or any(m is None for m in means):
        return None
    scales = [max(s, 1e-6) for s in scales]
    z = [F.coalesce((c - m) / s, F.lit(0.0)) for c, m, s in zip(x, means, scales)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    b = rows.agg(*[F.sum(z[i] * z[j]) for i, j in pairs], *[F.sum(c * (rest - intercept)) for c in z]).first()
    gram = np.eye(k) * HEAD_RIDGE
    for (i, j), v in zip(pairs, b):
        gram[i, j] += v
        if i != j:
            gram[j, i] += v
    head = {"means": list(means), "scales": scales, "coefficients": [float(v) for v in np.linalg.solve(gram, np.array(b[len(pairs) :], dtype=float))], "intercept": intercept, "blend": HEAD_BLEND}
    part = F.lit(intercept)
    for c, v in zip(head["coefficients"], z):
        part = part + c * v
    better = rows.agg(F.avg((rest - HEAD_BLEND * part) ** 2)).first()[0]
    return head if better + 1e-12 < mse * HEAD_GAIN else None


def binned(df: DataFrame, features: list[str], cfg: Config, row_id: str) -> tuple[DataFrame, list[int], dict[str, list[float]], list[frozenset] | None]:
    """df with a bin column a feature and a fold; how many bins each has; cuts; interaction groups as places of features."""
    numeric = [f for f in features if f not in cfg.categorical]
    # below the first cut is a bin of its own, so that bin 0 is left to missing values
    found = {} if not numeric else weighted_cuts(df, numeric, cfg.max_bin, cfg.weight) if cfg.weight else sketched_cuts(df, numeric, cfg.max_bin)
    cut_of = {f: [float("-inf"), *c] for f, c in found.items()}
    top = df.agg(*[F.max(F.col(c).cast("int")).alias(c) for c in cfg.categorical]).first().asDict() if cfg.categorical else {}
    widths = [int(top[f] or 0) + 2 if f in cfg.categorical else len(cut_of[f]) + 1 for f in features]
    if max(widths) > 65536:
        raise ValueError("a category's codes pass 65535: pool it first")
    bins = {f: F.col(f).cast("int") + 1 if f in cfg.categorical else map_bin(F.col(f), cut_of[f]) for f in features}
    rows = df.withColumns({f"_b{i}": F.coalesce(bins[f], F.lit(0)) for i, f in enumerate(features)})
    rows = rows.withColumn("_fold", F.pmod(F.col(row_id), F.lit(FOLDS)).cast("int"))
    groups = [frozenset(features.index(f) for f in g) for g in cfg.interactions] if cfg.interactions else None
    return rows, widths, cut_of, groups


def grow(work: DataFrame, features: list[str], cfg: Config, model: Model, widths: list[int], cut_of: dict, groups, most: Callable[[float], float] | None = None, use: list[int] | None = None) -> tuple[list[Node], float, float]:
    """One tree, what it takes off the mean loss, and that loss before it; most(loss) is how much it may, ``use`` the features it may split."""
    eta, tree, use = model.eta, [], list(range(len(features))) if use is None else use

    def histograms(ids: list[int]) -> dict[int, np.ndarray]:
        at = model.route(tree, lambda k: F.lit(k.id)) if tree else F.lit(0)
        here = work.withColumn("_node", at)
        here = here.where(F.col("_node").isin(ids)) if tree else here
        got = fold_histogram(here, {str(i): f"_b{i}" for i in use}, "_node", "_fold", "_g", "_h", () if tree else ("_l",)).toArrow()
        out = {i: [np.zeros((n, FOLDS, 3)) for n in widths] for i in ids}
        c = {k: got.column(k).to_numpy() for k in got.column_names}
        f = c["feature"].astype(int)
        order = np.lexsort((f, c["node"]))
        bounds = np.flatnonzero(np.diff(c["node"][order]) | np.diff(f[order])) + 1
        sums = np.stack([c["g"], c["h"], c["n"]], axis=1).astype(float)
        for rows_of in np.split(order, bounds) if len(order) else ():
            out[int(c["node"][rows_of[0]])][f[rows_of[0]]][c["bin"][rows_of], c["fold"][rows_of]] = sums[rows_of]
        if not tree:
            losses.append(float(np.nansum(c["_l"][f == use[0]].astype(float))))
        return out

    losses: list[float] = []
    hist = histograms([0])[0]
    total = hist[use[0]].sum(axis=0)
    loss = losses[0] / max(1.0, total[:, 2].sum())
    if not total[:, 2].sum():
        return [], 0.0, loss

    def node(i: int, parent: int, depth: int, sums: np.ndarray, weight: float, gain: float, gen: float) -> Node:
        whole = sums.sum(axis=0)
        rest = whole - sums
        folds = -rest[:, 0] / (rest[:, 1] + cfg.ridge + TINY) * eta
        return Node(i, parent, depth, weight * eta, float(whole[1]), int(whole[2]), [float(x) for x in np.where(rest[:, 2] > 0, folds, weight * eta)], generalization=gen)

    whole = total.sum(axis=0)
    tree.append(node(0, -1, 0, total, float(-whole[0] / (whole[1] + cfg.ridge + TINY)), 0.0, 1.0))
    open_ = {0: _Open(tree[0], hist)}
    heap = [(-float(whole[0] ** 2 / (whole[1] + TINY)), 0)]
    rows, gained = max(whole[2], 1.0), 0.0
    target = most(loss) if most else max(loss, 1e-12) * eta * 0.5
    while heap and len(tree) < cfg.max_nodes and gained < target:
        _, i = heapq.heappop(heap)
        o = open_[i]
        if o.hist is None:
            need = [j for _, j in [(0, i), *heap] if open_[j].hist is None]
            small = [j for j in need if open_[j].sibling < 0 or open_[j].sibling not in need or (open_[j].node.count, j) < (open_[open_[j].sibling].node.count, open_[j].sibling)]
            for j, x in histograms(small).items():
                open_[j].hist = x
            for j in need:
                if open_[j].hist is None:
                    open_[j].hist = [p - q for p, q in zip(open_[j].parent_hist, open_[open_[j].sibling].hist)]
            for j in need:
                open_[j].parent_hist = None
        allowed = use
        if groups and o.used:
            allowed = sorted(set().union(*[g for g in groups if o.used <= g]).intersection(use))
        s = find_split(o.hist, i == 0, cfg, features, allowed, o.bounds, o.node.depth)
        if s is None:
            continue
        n, f = tree[i], s["feature"]
        n.feature, n.gain, n.missing_left, n.left, n.right = f, s["gain"], s["missing_left"], len(tree), len(tree) + 1
        if s["cat"]:
            n.left_cats = sorted(int(b) for b in s["order"][: s["at"]])
        else:
            n.value = float(cut_of[features[f]][s["at"]]) if s["at"] < len(cut_of[features[f]]) else float("inf")
        mid = (s["wl"] + s["wr"]) / 2
        sides = [("left", n.left, s["wl"]), ("right", n.right, s["wr"])]
        if "missing" in s:
            n.missing = len(tree) + 2
            sides.append(("missing", n.missing, s["wm"]))
        for side, k, weight in sides:
            child = node(k, i, n.depth + 1, s[side], weight, 0.0, s["gen"])
            low, high = o.bounds
            if s["way"] and side != "missing":
                upper = (side == "left") == (s["way"] > 0)
                low, high = (low, min(high, mid)) if upper else (max(low, mid), high)
            tree.append(child)
            if side == "missing" and (not child.count or not cfg.missing_splits or features[f] in cfg.end_missing):
                continue
            beside = -1 if "missing" in s else n.right if side == "left" else n.left
            open_[k] = _Open(child, None, (low, high), o.used | {f}, None if "missing" in s else o.hist, beside)
            heapq.heappush(heap, (-float(s[side].sum(axis=0)[0] ** 2 / (s[side].sum(axis=0)[1] + TINY)), k))
        gained += 0.5 * eta * (2 - eta) * s["gain"] / rows
        o.hist = o.hist if any(open_[k].parent_hist is not None for k in (n.left, n.right)) else None
    _treat(tree, cfg.missing_treatment)
    return tree, gained, loss
