"""Schedules, tree scores, damping, refined leaves, held-out prefixes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.functions.objectives import objective
from timberline.operators import histogram, trainer
from timberline.operators import schedule as S
from timberline.operators.sampling import drawn
from timberline.operators.trainer import Config, fit
from timberline.operators.tree import Model, Node


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 2))
    rows = [(i, float(a), float(b) if i % 8 else None, float(a + 0.3 * e > 0), float(2 * a + b + e)) for i, ((a, b), e) in enumerate(zip(x, rng.normal(size=600)))]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, z double, y double").cache()
    df.count()
    return df


def leaf(i, weight, n, parent=0, folds=None, **k):
    return Node(i, parent, 1, weight, n, n, folds or [weight] * 5, **k)


def stump(weights, counts, folds=None, generalization=1.0):
    root = Node(0, -1, 0, 0.0, sum(counts), sum(counts), folds or [0.1] * 5, gain=4.0, feature=0, value=0.0, left=1, right=2)
    return [root, *[leaf(i + 1, w, n, generalization=generalization) for i, (w, n) in enumerate(zip(weights, counts))]]


def test_numbers_of_a_schedule():
    assert S.step_size(0.5, "binary", 10**6, 10) == 10**-0.5
    assert S.step_size(2.0, "binary", 10**6, 10) > S.step_size(2.0, "other", 10**6, 10) == 0.01 > S.step_size(2.0, "robust", 1000, 10)
    assert S.leaf_ridge(1.0, "binary", 31, 4) == 0 < S.leaf_ridge(1.0, "binary", 1000, 4) < S.leaf_ridge(1.0, "binary", 10**5, 4) <= 0.12
    assert S.leaf_ridge(1.0, "binary", 10**40, 1) == 0.12
    n = 10 / 0.5
    series = 1 / n - (n / (n - 1) - (1 + 1 / n))
    assert np.isclose(S.target_decrement(0.5, 0.7, 0.7), series * 10**-0.5 * 0.7 * 1.2)
    assert S.target_decrement(0.5, 0.7, 0.1) < S.target_decrement(0.5, 0.7, 0.7)
    assert S.row_rate(1.0, 10**9, 50) == 0.95 and S.row_rate(1.0, 1000, 500) == 1.0
    small, large = S.schedule(1.0, "LogLoss", 1000, 5), S.schedule(2.0, "LogLoss", 10**9, 5)
    assert small.refine == 4 and large.refine == 1 and large.iterations > small.iterations == 1000 and large.stopping_rounds > small.stopping_rounds == 3
    assert S.schedule(1.0, "LogLoss", 1000, 5, monotone=True).refine == 1 and S.schedule(1.0, "PoissonLoss", 10, 1).least_trees == 0
    for budget in (0.1, 1, 3, 6):
        assert S.target_decrement(budget, 1.0, 0.5) > 0


def test_scores_of_trees():
    even, uneven = stump([0.5, -0.5], [100, 100]), stump([5.0, -0.01], [100, 100])
    assert S.specialization(even) == 1.0 > S.specialization(uneven) and S.specialization([leaf(0, 1.0, 5)]) == 1.0
    assert np.isclose(S.specialization(stump([0.3, 0.1], [100, 100])), 1 / (0.75**2 + 0.25**2) - 1)
    assert S.reliability(even) == 1.0 and S.reliability(stump([1, -1], [9, 9], [1.0, -1.0, 1.0, -1.0, 1.0])) < 0.6 and S.reliability([leaf(0, 1.0, 5)]) == 1.0
    good, weak = stump([0.5, -0.5], [9, 9], generalization=1.02), stump([0.5, -0.5], [9, 9], generalization=0.9)
    assert S.tree_generalization(good, "binary") == 1.02 and np.isclose(S.tree_generalization(weak, "robust"), 0.9) and S.tree_generalization([leaf(0, 1.0, 5)], "binary") == 0
    h = S.History("binary")
    assert h.multiplier(weak) == 1.0
    for _ in range(4):
        h.add(good)
    assert h.multiplier(good) == 1.0 and h.multiplier(weak) == 0.6 and h.regressive(0.9) and not h.regressive(1.02)
    big = [good[0], *good[1:], *[leaf(i, 0.1, 3) for i in range(3, 9)]]
    h = S.History("binary")
    for t in [big] * 4 + [weak] * 4:
        h.add(t)
    assert h.spent(2.0, 4) and not h.spent(1.0, 9) and not h.spent(2.0, 1)


def test_refined_leaves(data):
    """A Newton step of each leaf, as NumPy finds it; the mean loss falls with each pass."""
    tree = [Node(0, -1, 0, 0.0, 600, 600, [0.0] * 5, feature=0, value=0.0, left=1, right=2, gain=1.0), leaf(1, -0.1, 300), leaf(2, 0.1, 300)]
    m = Model(["a"], "LogLoss", 0.0, 0.5)
    o = objective("LogLoss")
    rows = data.withColumn("_score", F.lit(0.0))
    pdf = data.select("a", "z").toPandas()
    left = (pdf.a < 0).to_numpy()
    loss = lambda w: np.mean(np.log1p(np.exp(-np.where(pdf.z > 0, 1, -1) * w)))
    before = np.where(left, -0.1, 0.1)
    p = 1 / (1 + np.exp(-before))
    steps = [-(p - pdf.z)[k].sum() / (p * (1 - p))[k].sum() for k in (left, ~left)]
    assert S.refine(rows, m, tree, 1, lambda s: o.columns(F.col("z"), s)) == 1
    assert np.allclose([tree[1].weight, tree[2].weight], [-0.1 + 0.5 * steps[0], 0.1 + 0.5 * steps[1]])
    one = loss(np.where(left, tree[1].weight, tree[2].weight))
    S.refine(rows, m, tree, 2, lambda s: o.columns(F.col("z"), s))
    assert loss(np.where(left, tree[1].weight, tree[2].weight)) < one < loss(before)
    assert np.allclose(tree[1].fold_weights, tree[1].weight)
    assert S.refine(rows.limit(0), m, tree, 2, lambda s: o.columns(F.col("z"), s)) == 0


def test_prefixes(data):
    m = fit(data, ["a", "b"], "z", Config("LogLoss", budget=0.2, iterations=3, max_bin=8, max_nodes=5))
    m.trees.append([Node(0, -1, 0, 9.0, 1, 1, [9.0] * 5)])  # a tree that spoils the rest
    o = objective("LogLoss")
    loss = lambda s: o.columns(F.col("z"), s)["loss"]
    got = {r["trees"]: r["loss"] for r in S.prefix_losses(m, data, loss).collect()}
    for k in range(len(m.trees) + 1):
        part = Model(m.features, m.objective, m.base_score, m.eta, m.trees[:k])
        assert np.isclose(got[k], data.agg(F.avg(loss(part.raw_score()))).first()[0])
    kept = S.best_prefix(Model.from_json(m.to_json()), data, loss)
    assert len(kept.trees) == min(got, key=lambda k: (got[k] if k else 9, k)) < len(m.trees)
    assert len(S.best_prefix(Model.from_json(m.to_json()), data, loss, least=len(m.trees)).trees) == len(m.trees)
    assert len(S.best_prefix(Model.from_json(m.to_json()), data.limit(0), loss).trees) == len(m.trees)


def test_fits(data):
    plain = Config("LogLoss", budget=0.3, iterations=3, max_bin=8, max_nodes=5)
    o = objective("LogLoss")
    error = lambda m: data.agg(F.avg(o.columns(F.col("z"), m.raw_score())["loss"])).first()[0]
    fits = {name: fit(data, ["a", "b"], "z", Config(**(plain.__dict__ | more))) for name, more in {"plain": {}, "refined": {"refine": 4}, "damped": {"damp": True}, "held": {"holdout": 0.3}, "scheduled": {"scheduled": True}}.items()}
    errors = {k: error(m) for k, m in fits.items()}
    assert errors["refined"] < errors["plain"] and all(m.trees for m in fits.values()) and max(errors.values()) < 0.69
    none = data.agg(F.avg(o.columns(F.col("z"), F.lit(fits["plain"].base_score))["loss"])).first()[0]
    assert all(e < none for e in errors.values())
    for bad in ({"refine": 0}, {"holdout": 1.0}):
        with pytest.raises(ValueError):
            Config(**bad)


@pytest.mark.parametrize("bins", [5, 60])
def test_orders_of_categories(spark, bins):
    """The driver's statistics are those of the table's, and a second order is tried where there are many categories."""
    rng = np.random.default_rng(bins)
    cells = rng.normal(size=(bins, 5, 3))
    cells[..., 1:] = rng.integers(0, 4, size=(bins, 5, 1)) * np.array([0.2, 1.0])
    cells[..., 0] *= cells[..., 2] > 0
    table = [(0, "c", b + 1, j, *map(float, cells[b, j])) for b in range(bins) for j in range(5) if cells[b, j, 2]]
    hist = spark.createDataFrame(table, "node int, feature string, bin int, fold int, g double, h double, n double")
    got = {r["bin"]: r for r in histogram.category_scores(hist, 0.1).collect()}
    scores, mode = histogram.ordering_scores(cells[..., :2], 0.1)
    assert {r["mode"] for r in got.values()} == {mode}
    for k, v in scores.items():
        assert np.allclose([got[b + 1][k] if b + 1 in got else 0.0 for b in range(bins)], v)
    orders = trainer.category_orders(cells, 0.1)
    assert len(orders) == (1 if bins == 5 else 2) and all(sorted(o) == sorted(orders[0]) for o in orders)
    one = trainer.find_split(np.concatenate([np.zeros((1, 5, 3)), cells])[None], True, Config("LogLoss", categorical=["c"], ridge=0.1), ["c"], [0])
    assert one["cat"] and 0 < one["at"] < bins


def test_scheduled_budget():
    at = S.scheduled_budget
    assert at(0.9, "LogLoss", 500, 3) == 0.9 and at(2.0, "SquaredLoss", 500, 3) == 2.0 and at(2.0, "LogLoss", 500, 3) == 1.3
    assert at(2.0, "LogLoss", 900, 12) == 1.7 and at(2.0, "LogLoss", 1400, 20) == 1.8 and at(2.0, "LogLoss", 9000, 64) == 1.4
    assert at(2.0, "LogLoss", 60_000, 20, 12) == 1.5 and at(2.0, "LogLoss", 60_000, 20, 11) == 2.0


def test_sampled_features(spark):
    """Every feature is tried; those that gain are tried more often; a fit splits none but those of its tree's sample."""
    s = S.FeatureSample(20, 5, seed=3)
    for _ in range(60):
        got = s.draw()
        assert len(set(got)) == 5
        s.learn([Node(0, -1, 0, 0.0, 1, 1, [0.0] * 5, gain=10.0 if f in (2, 7) else 0.1, feature=f, left=1, right=2) for f in got])
    assert s.tried.min() > 0 and min(s.tried[[2, 7]]) > 1.5 * np.delete(s.tried, [2, 7]).mean()
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    d = spark.createDataFrame([(i, *map(float, r), float(r[4] + 0.1 * r[0])) for i, r in enumerate(x)], "row_id bigint, " + ", ".join(f"f{j} double" for j in range(6)) + ", y double")
    m = trainer.fit(d, [f"f{j}" for j in range(6)], "y", Config("SquaredLoss", budget=0.3, iterations=6, max_bin=8, max_nodes=5, feature_share=0.34))
    assert len(m.trees) >= 4 and all(len({n.feature for n in t if not n.is_leaf}) <= 2 for t in m.trees) and any(n.feature == 4 for t in m.trees for n in t)


def test_class_weights_of_rows(spark):
    from timberline.operators.sampling import class_label, class_weighted

    d = spark.createDataFrame([(float(i % 10 == 0), 2.0) for i in range(200)], "y double, w double")
    got = {r["y"]: r["v"] for r in class_weighted(d, "y", "v", "w").distinct().collect()}
    assert got[1.0] > 2 * got[0.0] and np.isclose(20 * got[1.0] + 180 * got[0.0], 400)
    assert class_weighted(d.withColumn("y", F.col("y") + 0.5), "y", "v").agg(F.max("v")).first()[0] == 1.0
    assert [r[0] for r in spark.createDataFrame([(1.0 + 1e-10,), (0.3,), (None,)], "y double").select(class_label(F.col("y"))).collect()] == [1, None, None]


def test_frontier_and_redrawn_folds():
    assert S.frontier_rate(1.0, "SquaredLoss", 800, 4) == 1 - 48 / 800 and S.frontier_rate(1.0, "SquaredLoss", 2048, 4) == 0.95
    for other in ((0.5, "SquaredLoss", 800, 4), (1.0, "LogLoss", 800, 4), (1.0, "SquaredLoss", 639, 4), (1.0, "SquaredLoss", 800, 13), (1.0, "SquaredLoss", 800, 4, 1)):
        assert S.frontier_rate(*other) == 1.0
    assert S.schedule(1.0, "SquaredLoss", 800, 4).subsample == 0.94
    assert S.redraws_folds("LogLoss", 5000, 4) and S.redraws_folds("LogLoss", 2000, 40)
    assert not (S.redraws_folds("LogLoss", 4096, 32) or S.redraws_folds("LogLoss", 1999, 40) or S.redraws_folds("SquaredLoss", 5000, 4))


def test_watch_of_prefixes():
    w = S.PrefixWatch("LogLoss", 1.0, False, least=2)
    for trees, loss in enumerate((0.1, 0.5, 0.4, 0.3996, 0.45), 1):
        w.see(trees, loss, 1.0)
    assert w.trees == 3  # the first is under the least, the fourth within the margin
    assert S.prefix_proxy("LogLoss", 0.4, 2.0) == 0.2 * 0.15 - 0.4 and S.prefix_proxy("LogLoss", 0.4, 1.0, True, 0.8) == 0.8
    assert S.prefix_proxy("SquaredLoss", 0.72, 1.01) > S.prefix_proxy("SquaredLoss", 0.70, 0.995) and S.prefix_proxy("PoissonLoss", 0.4, 9.0) == -0.4
    bag = S.PrefixWatch("LogLoss", 1.0, True)
    bag.see(1, 0.5, 1.0, 0.7)
    bag.see(2, 0.6, 1.0, 0.71)
    bag.see(3, None, 1.0)
    assert bag.trees == 2 and bag.margin == 0.00025
    assert S.PrefixWatch("SquaredLoss", 9.0, False).margin == 0.003 and S.PrefixWatch("PoissonLoss", 1.0, False).margin == 1e-5


def test_fit_keeps_the_best_prefix(data):
    """Against proxies worked out here from the whole fit: areas by pairs of rows out of bag, or mean loss and generalization."""
    noise = data.withColumn("z", (F.xxhash64("row_id") % 2 == 0).cast("double"))
    whole, kept = (fit(noise, ["a", "b"], "z", Config("LogLoss", budget=0.1, iterations=4, max_bin=16, max_nodes=9, subsample=0.6, prefix=p)) for p in (False, True))
    best = (0, -np.inf)
    for t in range(1, len(whole.trees) + 1):
        first = Model(whole.features, whole.objective, whole.base_score, whole.eta, whole.trees[:t])
        got = noise.where(~drawn("row_id", 0.6, t - 1)).select("z", first.raw_score().alias("s")).toPandas()
        pos, neg = got.s[got.z == 1].to_numpy(), got.s[got.z == 0].to_numpy()
        area = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
        best = (t, area) if area > best[1] + 0.00025 else best
    assert len(kept.trees) == best[0] and kept.trees == whole.trees[: best[0]]

    args = dict(budget=0.1, iterations=5, max_bin=16, max_nodes=9)
    whole, kept = (fit(data, ["a", "b"], "y", Config("SquaredLoss", **args, prefix=p)) for p in (False, True))
    losses = {r["trees"]: r["loss"] for r in S.prefix_losses(whole, data, lambda s: objective("SquaredLoss").columns(F.col("y"), s)["loss"]).collect()}
    best = (0, -np.inf)
    for t, tree in enumerate(whole.trees, 1):
        proxy = np.average([n.generalization for n in tree[1:]], weights=[n.count for n in tree[1:]]) - 0.05 * losses[t]
        best = (t, proxy) if proxy > best[1] + 0.001 else best
    assert kept.trees == whole.trees[: best[0]]
    with pytest.raises(ValueError):
        fit(data, ["a"], "y", Config("SquaredLoss", prefix=True), frame=lambda d: d)


def test_folds_of_each_tree(data):
    args = dict(budget=0.3, iterations=2, max_bin=16, max_nodes=5)
    same, redrawn, again = (fit(data, ["a", "b"], "z", Config("LogLoss", **args, redraw_folds=r)) for r in (False, True, True))
    assert redrawn.to_json() == again.to_json() and redrawn.trees[0][1].fold_weights != same.trees[0][1].fold_weights
