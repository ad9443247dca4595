"""More than two classes: one model a class or trees shared by all, probabilities, importances."""

from __future__ import annotations

import copy
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.primitives import softmax
from timberline.operators.calibrate import calibrate, intervals
from timberline.operators.drift import prune
from timberline.operators.explain import partial_dependence
from timberline.operators.trainer import CUT_EVERY, Config, binned, fit, grow
from timberline.operators.tree import NATIVE_NODES, Model, importance
from timberline.sources.tables import WRITTEN, classes_of, cut_lineage, discard

# fixed values: softmax temperatures by the most classes they serve; how far a class's odds and prior correct its probability
TEMPERATURES, MORE_CLASSES = ((4, 1.0), (5, 1.5), (8, 2.0)), 1.75
ODDS, PRIOR = {3: 0.25, 4: 0.5, 5: 0.5}, 0.25
FULL_HESSIAN = 5
EPSILON = 2.0**-52


@dataclass
class MultiModel:
    classes: list
    models: list[Model]
    priors: list[float]
    shared: bool = False

    @property
    def large(self) -> bool:
        return sum(len(t) for m in self.models for t in m.trees) > NATIVE_NODES

    def scores_of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([m.base_score + m.leaf_sums(x)[:, 0] for m in self.models], axis=1)

    def scores(self) -> Column:
        if self.large:
            return self.models[0]._udf(lambda x: list(self.scores_of(x)), "array<double>")
        return F.array(*[m.raw_score() for m in self.models])

    def predict(self) -> Column:
        """The class of the greatest score."""
        s = self.scores()
        return F.get(F.lit(self.classes), (F.array_position(s, F.array_max(s)) - 1).cast("int"))

    def probabilities_of(self, x: np.ndarray, temperature: float | None = None) -> np.ndarray:
        if self.shared or temperature is not None:
            s = self.scores_of(x) / (temperature or self.temperature)
            e = np.exp(s - s.max(axis=1, keepdims=True))
        else:
            p = np.stack([(1 / (1 + np.exp(-m.base_score - m.leaf_sums(x)[:, 1:]))).mean(axis=1) for m in self.models], axis=1)
            p = np.clip(p, EPSILON, 1 - EPSILON)
            e = p / (1 - p) ** ODDS.get(len(self.priors), 0.0) / np.maximum(self.priors, EPSILON) ** PRIOR
        return e / e.sum(axis=1, keepdims=True)

    @property
    def temperature(self) -> float:
        return next((t for k, t in TEMPERATURES if len(self.classes) <= k), MORE_CLASSES)

    def probabilities(self, temperature: float | None = None) -> Column:
        """Shared trees: softmax with a temperature. One against the rest: p / (1 - p)^a / prior^b, scaled to sum 1."""
        if self.large:
            return self.models[0]._udf(lambda x: list(self.probabilities_of(x, temperature)), "array<double>")
        if self.shared or temperature is not None:
            return softmax(self.scores(), temperature or self.temperature)
        return normalised(F.array(*[m.probability() for m in self.models]), self.priors)

    def partial_dependence(self, feature: str, values: list[float | None]) -> list[tuple[float | None, float]]:
        """Mean over classes of their models' dependence."""
        each = [partial_dependence(m, feature, values) for m in self.models]
        return [(v, sum(e[i][1] for e in each) / len(each)) for i, v in enumerate(values)]

    def prune(self, df: DataFrame, y: str, kind: str = "BottomUp") -> MultiModel:
        """Each class's model against its own rows and the rest."""
        self._apart("pruned")
        for c, m in zip(self.classes, self.models):
            prune(m, df.withColumn("_one", F.when(F.col(y) == c, 1.0).otherwise(0.0)), "_one", kind)
        return self

    def calibrate(self, df: DataFrame, y: str, alphas: list[float], method: str = "WeightVariance") -> MultiModel:
        self._apart("calibrated")
        for c, m in zip(self.classes, self.models):
            calibrate(m, df.withColumn("_one", F.when(F.col(y) == c, 1.0).otherwise(0.0)), "_one", alphas, method)
        return self

    def intervals(self, alpha: float) -> Column:
        """An array of (low, high), one for each class."""
        self._apart("calibrated")
        return F.array(*[intervals(m, alpha) for m in self.models])

    def _apart(self, done: str) -> None:
        if self.shared:
            raise ValueError(f"trees that classes share can't be {done}: their folds have one weight")

    def importance(self, spark) -> DataFrame:
        """Mean over classes of normalised importances."""
        parts = [importance(m.table(spark)) for m in self.models]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("feature").agg((F.sum("value") / len(parts)).alias("value"))


def normalised(ps: Column, priors: list[float]) -> Column:
    """Probabilities of classes from those of each against the rest, corrected for odds and priors."""
    tiny, a = EPSILON, ODDS.get(len(priors), 0.0)
    ps = F.transform(ps, lambda p: F.least(F.greatest(p, F.lit(tiny)), F.lit(1 - tiny)))
    ps = F.zip_with(ps, F.lit([float(max(p, tiny)) for p in priors]), lambda p, r: p / F.pow(1 - p, F.lit(a)) / F.pow(r, F.lit(PRIOR)))
    return F.transform(ps, lambda p: p / F.aggregate(ps, F.lit(0.0), lambda x, v: x + v))


def class_priors(df: DataFrame, y: str, classes: list) -> list[float]:
    return list(df.agg(*[F.avg(F.when(F.col(y) == c, 1.0).otherwise(0.0)) for c in classes]).first())


# fixed values: when trees are shared: features; rows with features, categories or classes; classes with rows; by rows a class
WIDE_FEATURES, SHARED_ROWS, SHARED_FEATURES, SHARED_CATEGORIES, SHARED_CLASSES = 96, 10_000, 24, 8, 6
MANY_CLASSES, MANY_ROWS = 12, 2000
BY_CLASS = ((6, None, 24, None, 10), (6, None, 48, 16, None), (4, 8, 96, 24, None))
# fixed values: classes, rows and features for which one model a class has a budget of 1 at most
CAPPED_CLASSES, CAPPED_ROWS, CAPPED_FEATURES, CAPPED_BUDGET = 3, 50_000, 24, 1.0


def shares_trees(classes: int, rows: int, features: int, categorical: int = 0) -> bool:
    """Whether trees that classes share serve a table better than a model a class."""
    if features >= WIDE_FEATURES or classes >= MANY_CLASSES and rows >= MANY_ROWS:
        return True
    if rows >= SHARED_ROWS and (features >= SHARED_FEATURES or categorical >= SHARED_CATEGORIES or classes >= SHARED_CLASSES):
        return True
    each = rows // max(classes, 1)
    return any(classes >= low and (high is None or classes <= high) and each >= n and (least is None or features >= least) and (most is None or features <= most) for low, high, n, least, most in BY_CLASS)


def class_budget(budget: float, classes: int, rows: int, features: int) -> float:
    """The budget of one model a class: three classes of a long, narrow table need no more than 1."""
    return min(budget, CAPPED_BUDGET) if classes == CAPPED_CLASSES and rows >= CAPPED_ROWS and features <= CAPPED_FEATURES else budget


def fit_multi(df: DataFrame, x: list[str], y: str, cfg: Config | None = None, row_id: str = "row_id") -> MultiModel:
    """Shared trees or a model a class, whichever suits the table's shape."""
    cfg = cfg or Config()
    df = df.where(F.col(y).isNotNull())
    rows, classes = df.count(), len(classes_of(df, y))
    if shares_trees(classes, rows, len(x), len(cfg.categorical)):
        return fit_shared(df, x, y, cfg, row_id)
    return fit_classes(df, x, y, replace(cfg, budget=class_budget(cfg.budget, classes, rows, len(x))), row_id)


def fit_classes(df: DataFrame, x: list[str], y: str, cfg: Config | None = None, row_id: str = "row_id") -> MultiModel:
    """One model against the rest for each class, in order of labels."""
    cfg = cfg or Config()
    classes = classes_of(df, y)
    models = [fit(df.withColumn("_one", F.when(F.col(y) == c, 1.0).otherwise(0.0)), x, "_one", replace(cfg, objective="LogLoss"), row_id) for c in classes]
    return MultiModel(classes, models, class_priors(df, y, classes))


def fit_shared(df: DataFrame, x: list[str], y: str, cfg: Config | None = None, row_id: str = "row_id", candidates: int | None = None, balanced: bool = True) -> MultiModel:
    """Trees with a weight for each class. Rows count by their class's blended weight (where ``balanced``) and by the
    parameters' weight column. Each round grows a tree on the gradients of each of the classes with the most loss
    (all of up to 8, 6 of up to 16, else 8), solves its leaves for all classes at once, and keeps the one that leaves the
    least softmax loss.

    A round scans the rows once for losses, once a level of each candidate, once for leaves and once for their losses; the
    driver holds leaves x classes squared sums (up to five classes; beyond, the Hessian's diagonal).
    """
    cfg = cfg or Config()
    df = df.where(F.col(y).isNotNull()).select(*dict.fromkeys([*x, y, row_id, *([cfg.weight] if cfg.weight else [])]))
    classes = classes_of(df, y)
    k = len(classes)
    priors = class_priors(df, y, classes)
    base = np.log(np.clip(priors, 1e-12, 1))
    models = [Model(list(x), "LogLoss", float(b), 10.0**-cfg.budget) for b in base - base.mean()]
    rows, widths, cut_of, groups = binned(df, x, cfg, row_id)
    label = F.array_position(F.lit(classes), F.col(y)) - 1
    of = {r["label"]: float(r["weight"]) for r in blended_class_weights(df, y).collect()} if balanced else {}
    weight = F.get(F.lit([of.get(c, 1.0) for c in classes]), label.cast("int")) * (F.col(cfg.weight).cast("double") if cfg.weight else F.lit(1.0))
    since = len(WRITTEN)
    rows = cut_lineage(rows.withColumns({"_w": weight, "_k": label.cast("int"), "_scores": F.array(*[F.lit(m.base_score) for m in models])}), "classes")
    limit = candidates or (k if k <= 8 else 6 if k <= 16 else 8)
    wanted = lambda scores: -F.ln(F.greatest(F.get(softmax(scores), F.col("_k")), F.lit(1e-300)))
    idle = 0
    for round_ in range(cfg.iterations):
        work = rows.withColumn("_p", softmax(F.col("_scores")))
        loss, *each = work.withColumn("_l", wanted(F.col("_scores")) * F.col("_w")).agg(F.avg("_l"), *[F.sum(F.when(F.col("_k") == i, F.col("_l")).otherwise(0.0)) for i in range(k)]).first()
        best = None
        for c in sorted(range(k), key=lambda i: -each[i])[:limit]:
            p = F.get("_p", c)
            own = work.withColumns({"_g": (p - (F.col("_k") == c).cast("double")) * F.col("_w"), "_h": p * (1 - p) * F.col("_w"), "_l": -F.ln(F.greatest(F.when(F.col("_k") == c, p).otherwise(1 - p), F.lit(1e-300))) * F.col("_w")})
            tree, _, _ = grow(own, x, cfg, models[0], widths, cut_of, groups)
            if len(tree) < 2:
                continue
            weights = _leaves(work, models[0], tree, k, cfg)
            after = rows.agg(F.avg(wanted(_added(models[0], tree, weights)) * F.col("_w"))).first()[0]
            if best is None or after < best[0]:
                best = (after, tree, weights)
        if best is None or best[0] >= loss - 1e-9:
            break
        after, tree, weights = best
        for i, m in enumerate(models):
            m.trees.append(_of_class(tree, {n: w[i] for n, w in weights.items()}))
        rows = rows.withColumn("_scores", _added(models[0], tree, weights))
        if round_ % CUT_EVERY == CUT_EVERY - 1:
            rows = cut_lineage(rows, "classes")
            discard(df.sparkSession, since, keep=1)
        idle = idle + 1 if loss - after < 1e-6 * max(loss, 1e-12) else 0
        if idle >= cfg.stopping_rounds:
            break
    discard(df.sparkSession, since)
    return MultiModel(classes, models, priors, True)


def _added(model: Model, tree: list, weights: dict[int, np.ndarray]) -> Column:
    step = model.route(tree, lambda n: F.lit([float(v) for v in weights[n.id]]))
    return F.zip_with("_scores", step, lambda s, w: s + w)


def _leaves(work: DataFrame, model: Model, tree: list, k: int, cfg: Config) -> dict[int, np.ndarray]:
    """Newton steps of all classes at each leaf, centred."""
    p = [F.get("_p", i) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i)] if k <= FULL_HESSIAN else []
    w = F.col("_w")
    sums = [F.sum((p[i] - (F.col("_k") == i).cast("double")) * w) for i in range(k)] + [F.sum(p[i] * (1 - p[i]) * w) for i in range(k)] + [F.sum(-p[i] * p[j] * w) for i, j in pairs]
    got = work.groupBy(model.route(tree, lambda n: F.lit(n.id)).alias("leaf")).agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).collect()
    out = {n.id: np.zeros(k) for n in tree}
    for r in got:
        v = np.array(r[1:], dtype=float)
        h = np.diag(v[k : 2 * k] + max(cfg.ridge, 1e-8))
        for (i, j), c in zip(pairs, v[2 * k :]):
            h[i, j] = h[j, i] = c
        w = np.linalg.solve(h, -v[:k]) if pairs else -v[:k] / np.diag(h)
        w = w - w.mean()
        out[r[0]] = w * model.eta
    return out


def _of_class(tree: list, weights: dict[int, float]) -> list:
    """The tree with a class's leaf weights; inner nodes have the cover-weighted mean of their children's, all folds the same."""
    tree = copy.deepcopy(tree)
    for n in reversed(tree):
        n.weight = float(weights[n.id]) if n.is_leaf else sum(tree[c].cover * tree[c].weight for c in n.children) / max(sum(tree[c].cover for c in n.children), 1e-300)
        n.fold_weights = [n.weight] * 5
    return tree


def class_weights(df: DataFrame, y: str, gate: float = 2.5) -> DataFrame:
    """(label, n, weight): effective-number weights of mean 1 where the most frequent class has over ``gate`` times the rarest's rows, else 1."""
    from pyspark.sql import Window

    every = Window.partitionBy()
    c = df.groupBy(F.col(y).alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(every)
    beta = F.least(F.greatest((total - 1) / total, F.lit(0.9)), F.lit(0.99999))
    c = c.withColumn("raw", (1 - beta) / (1 - F.pow(beta, F.col("n")))).withColumn("ratio", F.max("n").over(every) / F.min("n").over(every))
    mean = F.sum(F.col("raw") * F.col("n")).over(every) / F.sum("n").over(every)
    return c.select("label", "n", F.when(F.col("ratio") > gate, F.col("raw") / mean).otherwise(1.0).alias("weight"))


def blended_class_weights(df: DataFrame, y: str) -> DataFrame:
    """(label, n, weight): effective-number weights drawn to 1 by how balanced the classes are. A row a class."""
    strength = F.col("balance")
    both = class_weights(df, y, gate=0.0).crossJoin(F.broadcast(class_balance(df, y).select("balance")))  # one row
    return both.select("label", "n", F.when(strength <= 1e-6, 1.0).otherwise(1 + strength * (F.col("weight") - 1)).alias("weight"))


def class_balance(df: DataFrame, y: str) -> DataFrame:
    """0.75 times the gap of entropy to even classes, plus 0.25 times the pressure of the imbalance ratio."""
    c = df.groupBy(y).agg(F.count("*").cast("double").alias("n"))
    from pyspark.sql import Window

    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    a = c.withColumn("p", p).agg((-F.sum(F.col("p") * F.ln("p"))).alias("e"), F.count("*").alias("k"), (F.max("n") / F.min("n")).alias("r"))
    gap = F.when(F.col("k") > 1, 1 - F.col("e") / F.ln(F.greatest("k", F.lit(2)))).otherwise(1.0)
    return a.select((0.75 * gap + 0.25 * (1 - 1 / F.col("r"))).alias("balance"), F.col("r").alias("ratio"))
