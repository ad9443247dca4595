"""Estimators: coding, class and regression models, shared trees, ranking, the linear head, draws, metric names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.functions import metrics
from timberline.operators import calibrate, encode, explain, multi
from timberline.operators.estimators import Classifier, Coder, Ranker, Regressor
from timberline.operators.trainer import Config, fit
from timberline.operators.tree import Model

SMALL = Config("LogLoss", budget=0.2, iterations=2, max_bin=8, max_nodes=5)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(420):
        a, b = rng.normal(size=2)
        c = "red" if a > 0.4 else "blue" if a < -0.4 else "green"
        rows.append((i, float(a), float(b) if i % 7 else None, c if i % 11 else None, "yes" if a > 0 else "no", ["x", "y", "z"][0 if a > 0.5 else 1 if a > -0.5 else 2], float(3 * a + 0.5 * b), i // 6, float(max(0, min(3, round(a + 1))))))
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, c string, two string, three string, y double, g int, rel double").cache()
    df.count()
    return df


def test_two_classes(data):
    m = Classifier(["a", "c"], SMALL).fit(data, "two")
    assert m.score(data, "two") > 0.9 and list(m.coder.maps) == ["c"]
    got = m.predict(data.select("row_id", "a", "c").limit(5)).collect()
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and r["prediction"] in ("yes", "no") for r in got)
    again = Classifier(["a", "c"]).load(m.to_json())
    assert again.score(data, "two") == m.score(data, "two")
    unseen = data.limit(1).withColumn("c", F.lit("never seen"))
    assert m.predict(unseen).count() == 1
    assert all(v <= 0 for v in m.coder.transform(data).select(m.log_probabilities()).first()[0])
    with pytest.raises(ValueError):
        m.predict(data.drop("a"))
    assert m.set_params(max_bin=16).get_params()["max_bin"] == 16


def test_rows_without_a_target_are_left_out(data):
    gaps = data.withColumn("two", F.when(F.col("row_id") % 5 != 0, F.col("two")))
    whole = Classifier(["a"], SMALL).fit(gaps.where("two is not null"), "two")
    assert Classifier(["a"], SMALL).fit(gaps, "two").to_json() == whole.to_json()
    with pytest.raises(ValueError):
        Classifier(["a"], SMALL).fit(data.limit(0), "two")
    with pytest.raises(ValueError):
        Regressor(["a"]).fit(data.limit(0), "y")


def test_shared_trees(data):
    assert not multi.shares_trees(3, 420, 2) and not Classifier(["a", "b"], SMALL).fit(data, "three").multi.shared  # left open, by the table's shape
    m = Classifier(["a", "b"], SMALL, shared=True).fit(data, "three")
    assert m.multi.shared and m.score(data, "three") > 0.8
    trees = [[(n.feature, n.value, n.left) for n in t] for k in m.multi.models for t in k.trees]
    n = len(m.multi.models[0].trees)
    assert n and trees[:n] == trees[n : 2 * n] == trees[2 * n :]
    for t in zip(*[k.trees for k in m.multi.models]):
        assert all(abs(sum(x.weight for x in nodes)) < 1e-9 for nodes in zip(*t) if nodes[0].is_leaf)
    assert Classifier(["a", "b"]).load(m.to_json()).score(data, "three") == m.score(data, "three")


def test_normalised_probabilities(spark):
    ps, priors = [0.2, 0.5, 0.4], [0.5, 0.3, 0.2]
    want = np.array([p / (1 - p) ** 0.25 / r**0.25 for p, r in zip(ps, priors)])
    got = spark.range(1).select(multi.normalised(F.lit(ps), priors)).first()[0]
    assert np.allclose(got, want / want.sum())


def test_regressors(data):
    m = Regressor(["a", "b", "c"], Config("SquaredLoss", budget=0.2, iterations=3, max_bin=16, max_nodes=9)).fit(data, "y")
    assert m.score(data, "y") > 0.5
    r = Regressor(["a"], Config("AdaptiveHuberLoss", budget=0.2, iterations=3, max_bin=16, max_nodes=9)).fit(data, "y")
    assert r.score(data, "y") > 0.3


def test_ranker(data):
    m = Ranker(["a", "b"], SMALL).fit(data, "rel", "g")
    flat = metrics.ndcg(data.withColumn("s", F.lit(0.0)), "g", "rel", "s", "row_id").first()[0]
    assert m.score(data, "rel", "g") > flat + 0.05
    with pytest.raises(ValueError):
        Ranker(["a"], SMALL).fit(data, "rel", "nothing")


def test_linear_head(data):
    d = data.where("b is not null")
    m = fit(d, ["a", "b"], "y", Config("SquaredLoss", budget=1.0, iterations=2, max_bin=8, max_nodes=5))
    assert m.head and set(m.head) == {"means", "scales", "coefficients", "intercept", "blend"}
    bare = Model.from_json(m.to_json())
    bare.head = None
    pdf = d.select("a", "b", "y", m.raw_score().alias("with"), bare.raw_score().alias("without")).toPandas()
    assert ((pdf.y - pdf["with"]) ** 2).mean() < ((pdf.y - pdf.without) ** 2).mean()
    x, rest = pdf[["a", "b"]].to_numpy(), (pdf.y - pdf.without).to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    coef = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (rest - rest.mean()))
    assert np.allclose(m.head["coefficients"], coef)
    assert np.allclose(explain.contributions_of(m, x, "Shapley").sum(axis=1), pdf["with"])


def test_draws(data):
    m = fit(data, ["a", "b"], "y", Config("SquaredLoss", budget=0.2, iterations=2, max_bin=8, max_nodes=5))
    one, two = (m.with_draws(data, 8, "row_id", 7).select("row_id", F.col("draws").alias("d")).orderBy("row_id").collect() for _ in range(2))
    assert one == two and all(len(r["d"]) == 8 for r in one)
    x = np.array(data.orderBy("row_id").select("a", "b").toPandas(), dtype=float)
    per = m.base_score + m.tree_folds(x).min(axis=2).sum(axis=1), m.base_score + m.tree_folds(x).max(axis=2).sum(axis=1)
    d = np.array([r["d"] for r in one])
    assert (d >= per[0][:, None] - 1e-9).all() and (d <= per[1][:, None] + 1e-9).all() and len(np.unique(d[0])) > 1


def test_metric_names(data):
    assert metrics.parse("NDCG@5") == ("ndcg", 5) and metrics.parse("LogLoss") == ("logloss", None)
    for bad in ("NDCG@0", "auc@3", "other"):
        with pytest.raises(ValueError):
            metrics.parse(bad)
    assert metrics.evaluate("RMSE", data, "y", "y").first()[0] == 0
    k1, k6 = (metrics.evaluate(f"NDCG@{k}", data, "rel", "b", group="g", row_id="row_id").first()[0] for k in (1, 6))
    assert k1 != k6


def test_large_models_score_in_batches(spark, data):
    """Beyond the nodes that expressions take, columns come from Arrow batches, calibrated ones included."""
    m = fit(data, ["a", "b"], "y", Config("SquaredLoss", budget=0.2, iterations=1, max_bin=8, max_nodes=5))
    big = Model(m.features, "LogLoss", 0.1, m.eta, m.trees * (1 + 256 // len(m.trees[0])))
    x = np.array(data.orderBy("row_id").select("a", "b").toPandas(), dtype=float)
    cols = data.orderBy("row_id").select(big.probability().alias("p"), calibrate.label_set(big.fold_scores(), 0.5).alias("s")).toPandas()
    want = (1 / (1 + np.exp(-0.1 - big.leaf_sums(x)[:, 1:]))).mean(axis=1)
    assert np.allclose(cols.p, want) and all(list(s) == [k for k, q in ((0, p), (1, 1 - p)) if q <= 0.5] for s, p in zip(cols.s, want))
    for method in calibrate.METHODS:
        c = calibrate.calibrate(Model.from_json(big.to_json()), data, "y", [0.1], method)
        assert data.select(calibrate.intervals(c, 0.1).alias("i")).where("i.low <= i.high").count() == 420
    k = multi.MultiModel(["u", "v"], [big, m], [0.5, 0.5])
    assert k.large and np.allclose([r[0] for r in data.orderBy("row_id").select(k.probabilities()).collect()], k.probabilities_of(x))
    small = multi.MultiModel(["u", "v", "w"], [m, m, m], [0.5, 0.3, 0.2])
    assert np.allclose([r[0] for r in data.orderBy("row_id").select(small.probabilities()).collect()], small.probabilities_of(x))


def test_low_support_and_many_categories(spark):
    low = spark.createDataFrame([(i, "ab"[i % 2], float(i % 2)) for i in range(104)], "row_id bigint, c string, y double")
    assert Coder.of(low, ["c"], y="y").maps["c"]["how"]["mode"] == "native"
    many = spark.createDataFrame([(i, f"k{i % 20}", float(i % 3)) for i in range(320)], "row_id bigint, c string, y double")
    coder = Coder.of(many, ["c"], y="y")
    codes = {r["c"] for r in coder.transform(many).select("c").collect()}
    assert coder.maps["c"]["how"]["mode"] == "pooled" and len(codes) <= 5


def test_target_means_of_pooled_categories(spark):
    names = ["common"] * 20 + ["rare_signal"] * 4 + [f"t{i}" for i in range(16)]
    d = spark.createDataFrame([(i, b, 1.0 if b == "rare_signal" else float(i % 2) / 2) for i, b in enumerate(names)], "row_id bigint, b string, y double")
    coder = Coder.of(d, ["b"], max_cat=4, y="y")
    assert coder.names == ["b", "b__target_mean"]
    score = {r["n"]: r["b__target_mean"] for r in coder.transform(d.withColumn("n", F.col("b"))).collect()}
    assert score["rare_signal"] > score["common"]
    out = coder.transform(spark.createDataFrame([(1, None, 0.0), (2, "new", 0.0)], d.schema)).select("b__target_mean").collect()
    assert all(0 <= r[0] <= 1 for r in out)
    assert coder.transform(d.limit(0)).count() == 0


def test_out_of_fold_means_leave_own_fold_out(spark):
    """Against NumPy; a row's target never enters its own feature."""
    rng = np.random.default_rng(3)
    n = 2400
    c, y = rng.integers(0, 12, n), rng.integers(0, 2, n).astype(float)
    d = spark.createDataFrame([(i, f"k{k:02d}", float(t)) for i, (k, t) in enumerate(zip(c, y))], "row_id bigint, c string, y double")
    coder = Coder.of(d, ["c"], y="y")
    assert coder.names == ["c", "c__target_mean"]
    got = np.array([r[0] for r in coder.fit_transform(d, "y", "row_id").orderBy("row_id").select("c__target_mean").collect()])
    fold, smooth = np.arange(n) % 5, coder.means["c__target_mean"]["smooth"]
    for i in range(0, n, 97):
        other = fold != fold[i]
        same = other & (c == c[i])
        assert np.isclose(got[i], (y[same].sum() + smooth * y[other].mean()) / (same.sum() + smooth))
    whole = coder.transform(d).select("c", "c__target_mean").distinct().collect()
    assert len(whole) == 12


def test_crosses_find_what_neither_category_shows(spark):
    rows = [(i, "ab"[i % 2], "xyz"[(i // 2) % 3], float((i % 2 == 0) == ((i // 2) % 3 == 0)), i % 2 == 0) for i in range(2700)]
    d = spark.createDataFrame(rows, "row_id bigint, a string, b string, y double, spare boolean")
    small = Config("LogLoss", budget=0.2, iterations=1, max_bin=8, max_nodes=3)
    m = Classifier(["a", "b"], small).fit(d.withColumn("t", F.when(F.col("y") > 0, "u").otherwise("v")), "t")
    assert m.coder.crosses == {"a__x__b": ["a", "b"]} and m.coder.names[:3] == ["a", "b", "a__x__b"]
    assert m.score(d.withColumn("t", F.when(F.col("y") > 0, "u").otherwise("v")), "t") == 1.0
    again = Classifier(["a", "b"]).load(m.to_json())
    gaps = d.limit(6).withColumn("a", F.when(F.col("row_id") > 2, F.col("a")))
    assert again.predict(gaps).count() == 6 and not Coder.of(d.limit(500), ["a", "b"], y="y").crosses
    r = Regressor(["a", "b"], Config("SquaredLoss", budget=0.2, iterations=1, max_bin=8, max_nodes=3)).fit(d, "y")
    assert "a__x__b" in r.coder.maps and r.score(d, "y") > 0.3


def test_pairs_are_ranked():
    of = lambda k, n=5000, mode="native": {"categories": k, "rows": n, "mode": mode}
    kinds = {"a": of(5), "b": of(5), "c": of(50), "few": of(5, 100), "one": of(1)}
    pairs = encode.best_pairs(kinds, {"a": 0.3, "b": 0.1, "c": 0.0, "few": 1.0, "one": 1.0})
    assert pairs[0] == ("a", "b") and len(pairs) == 3 and not any({"few", "one"} & set(p) for p in pairs)
    pooled = encode.best_pairs({"a": of(5), "b": of(5), "c": of(5, mode="pooled")}, {"a": 0.1, "b": 0.1, "c": 0.1})
    assert "c" in pooled[0] and encode.best_pairs({}, {}) == []


def test_models_of_classes(data):
    """Pruned, calibrated and explained class by class; shared trees refuse what their folds can't tell."""
    m = multi.fit_classes(data, ["a", "b"], "three", SMALL)
    pd = m.partial_dependence("a", [None, -1.0, 1.0])
    assert [v for v, _ in pd] == [None, -1.0, 1.0] and np.isclose(pd[1][1], np.mean([explain.partial_dependence(k, "a", [-1.0])[0][1] for k in m.models]))
    m.calibrate(data, "three", [0.1])
    got = data.select(m.intervals(0.1).alias("i"), m.scores().alias("s")).limit(20).collect()
    assert all(len(r["i"]) == 3 and all(i["low"] <= s <= i["high"] for i, s in zip(r["i"], r["s"])) for r in got)
    nodes = sum(len(t) for k in m.models for t in k.trees)
    assert sum(len(t) for k in m.prune(data, "three").models for t in k.trees) <= nodes
    shared = multi.fit_shared(data, ["a", "b"], "three", SMALL)
    for refused in (lambda: shared.prune(data, "three"), lambda: shared.calibrate(data, "three", [0.1]), lambda: shared.intervals(0.1)):
        with pytest.raises(ValueError):
            refused()


def test_which_classes_share():
    assert not multi.shares_trees(3, 1000, 10) and multi.shares_trees(3, 1000, 96) and multi.shares_trees(6, 10_000, 12) and multi.shares_trees(3, 10_000, 24)
    assert multi.shares_trees(12, 2000, 12) and multi.shares_trees(6, 200, 10) and not multi.shares_trees(6, 200, 12) and multi.shares_trees(6, 300, 16) and multi.shares_trees(5, 500, 24)
    assert multi.class_budget(1.5, 3, 60_000, 10) == 1.0 and multi.class_budget(1.5, 4, 60_000, 10) == 1.5 and multi.class_budget(0.5, 3, 60_000, 10) == 0.5


def test_start_values(spark):
    """Weighted quantiles as order statistics, by hand."""
    from timberline.functions import objectives as O

    d = spark.createDataFrame(list(zip([1.0, 2.0, 9.0, 3.2, 4.0], [0.0, 0.5, 1.0, 0.3, 0.5])), "y double, w double")
    at = lambda o, w=None: o.start(d, F.col("y"), w)
    assert at(O.quantile(0.1), F.col("w")) == 2.0 and at(O.quantile(0.9), F.col("w")) == 9.0
    assert at(O.OBJECTIVES["AbsoluteLoss"], F.col("w")) == 4.0 and at(O.OBJECTIVES["HuberLoss"]) == 3.2 and at(O.OBJECTIVES["AdaptiveHuberLoss"], F.col("w")) == 4.0
    assert O.residual_quantiles(d, F.col("y"), F.lit(0.0), [0.0, 0.5, 0.6, 1.0]) == [1.0, 3.2, 3.2, 9.0]
    with pytest.raises(TypeError):
        O.objective("AdaptiveHuberLoss", q=1)
    assert O.objective("AdaptiveHuberLoss", alpha=0.9).adapt is not None


def test_robust_rounds(spark):
    """Long tails clip gradients; plain residuals leave squared loss as it is. The adaptive Huber loss adapts in every fit."""
    from timberline.functions import objectives as O

    rng = np.random.default_rng(12)
    a = rng.normal(size=600)
    plain, long = a + 0.1 * rng.normal(size=600), a + 0.1 * rng.standard_cauchy(size=600)
    d = spark.createDataFrame([(i, float(x), float(p), float(q)) for i, (x, p, q) in enumerate(zip(a, plain, long))], "row_id bigint, a double, p double, q double")
    r = np.sort(np.abs(long))
    at = lambda s: r[int(599 * s + 0.5)]
    assert O.robust_delta(d, F.col("q"), F.lit(0.0)) == pytest.approx(max((at(0.9) + at(0.95)) / 2, 2 * at(0.75), 2 * at(0.5), 0.5))
    assert O.robust_delta(d.where("abs(a) > 1"), F.col("a"), F.signum("a") * 1.0001 * F.abs("a")) is None
    cfg = dict(budget=0.3, iterations=6, max_bin=16, max_nodes=7)
    error = lambda m: d.agg(F.avg((F.col("a") - m.raw_score()) ** 2)).first()[0]
    assert error(fit(d, ["a"], "q", Config("SquaredLoss", robust=True, **cfg))) < error(fit(d, ["a"], "q", Config("SquaredLoss", **cfg)))
    adapted, fixed = fit(d, ["a"], "q", Config("AdaptiveHuberLoss", **cfg)), fit(d, ["a"], "q", Config("HuberLoss", **cfg))
    assert adapted.objective == "AdaptiveHuberLoss" and adapted.trees[0][1].weight != fixed.trees[0][1].weight


def test_model_bytes_and_metadata(data):
    m = fit(data.withColumn("t", F.col("y")), ["a"], "t", Config("SquaredLoss", budget=0.3, iterations=1, max_bin=8, max_nodes=3))
    m.put("made", "today")
    again = Model.from_bytes(m.to_bytes())
    assert again.get("made") == "today" and again.to_json() == m.to_json()
    assert [tuple(r) for r in again.metadata_table(data.sparkSession).collect()] == [("made", "today")]
    with pytest.raises(KeyError):
        again.get("gone")
