"""Estimators of effects, fairness, missing branches, refresh, interactions, conformal shifts and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.functions import metrics as M
from timberline.operators import calibrate, causal, drift, explain
from timberline.operators.trainer import Config, fit
from timberline.operators.tree import Model
from timberline.streaming import scorer

REG = Config("SquaredLoss", budget=0.2, iterations=3, max_bin=8, max_nodes=5)
BIN = Config("LogLoss", budget=0.2, iterations=2, max_bin=8, max_nodes=5)


@pytest.fixture(scope="module")
def data(spark):
    """Outcome a + 2 w + noise; treatment w by chance; instrument z moves d, which moves e by 3."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        a, b, z, u = rng.normal(size=4)
        w = int(rng.random() < 0.5)
        d = z + 0.3 * u
        rows.append((i, float(a), float(b) if i % 4 else None, w, float(a + 2 * w + 0.1 * rng.normal()), float(z), float(d), float(3 * d + 0.2 * u), int(i % 2), float(a + 0.8 * (i % 2) + 0.3 * b > 0)))
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, w int, y double, z double, d double, e double, s int, k double").cache()
    df.count()
    return df


def mean(df, c):
    return df.agg(F.avg(c)).first()[0]


def test_meta_learners(data):
    x = ["a"]
    for effect in (causal.s_learner(data, x, "w", "y", REG), causal.x_learner(data, x, "w", "y", REG, BIN), causal.dr_learner(data, x, "w", "y", REG, BIN)):
        assert 1.2 < mean(data, effect) < 2.8


def test_residual_learners(data):
    assert 1.2 < mean(data, causal.r_learner(data, ["a"], "w", "y", REG, BIN).raw_score()) < 2.8
    m, ate = causal.dml(data, ["a"], "w", "y", REG)
    assert m.objective == "RLearner" and ate["low"] < ate["ate"] < ate["high"] and 1.2 < ate["ate"] < 2.8 and ate["se"] > 0


def test_instrument(data):
    _, second = causal.iv(data, ["a"], ["z"], "d", "e", REG)
    low, high = (mean(causal.iv_at(data, second, v), "outcome") for v in (-1.0, 1.0))
    assert high > low + 1


def test_policy_treats_who_gains(data):
    d = data.withColumn("o", F.col("w") * F.signum("a") + F.lit(0.01))
    for robust in (False, True):
        m = causal.policy_learner(d, ["a"], "w", "o", BIN, robust, BIN, REG)
        agree = F.avg(((m.raw_score() > 0) == (F.col("a") > 0)).cast("int"))
        assert d.agg(agree).first()[0] > 0.8


def test_fairness_narrows_the_gap(data):
    x, gaps = ["a", "s"], []
    data = data.withColumn("k", (F.col("a") + 3 * F.col("s") > 1.5).cast("double"))
    for strength, odds in ((0.0, False), (1.0, False), (1.0, True)):
        m = causal.fair_classifier(data, x, "k", "s", Config("LogLoss", budget=0.4, iterations=3, max_bin=8, max_nodes=5), strength, odds)
        p = 1 / (1 + F.exp(-m.raw_score()))
        r = data.agg(F.avg(F.when(F.col("s") == 1, p)), F.avg(F.when(F.col("s") == 0, p))).first()
        gaps.append(abs(r[0] - r[1]))
    assert gaps[1] < gaps[0] and gaps[2] < gaps[0]


@pytest.mark.parametrize("how", ["None", "AssignToParent", "AverageNodeWeight", "AverageLeafWeight"])
def test_missing_branch(data, how):
    d = data.withColumn("t", F.coalesce("b", F.lit(0.0 if how.startswith("Average") else 3.0)))
    m = fit(d, ["b"], "t", Config("SquaredLoss", budget=0.2, iterations=1, max_bin=8, max_nodes=7, missing_branch=True, missing_treatment=how))
    root = m.trees[0][0]
    assert len(root.children) == 3
    gone, left, right = (m.trees[0][i] for i in (root.missing, root.left, root.right))
    assert gone.count + left.count + right.count == root.count == 500 and gone.count == 125
    if how == "None":
        assert gone.weight > max(left.weight, right.weight)
    elif how == "AssignToParent":
        assert gone.weight == root.weight
    elif how == "AverageNodeWeight":
        assert min(left.weight, right.weight) <= gone.weight <= max(left.weight, right.weight)
    x = np.array(d.select("b").toPandas(), dtype=float)
    score = m.base_score + m.leaf_sums(x)[:, 0]
    assert np.allclose(sorted(score), sorted(r[0] for r in d.select(m.raw_score()).collect()))
    for method in ("Weight", "Average", "Shapley"):
        assert np.allclose(explain.contributions_of(m, x, method).sum(axis=1), score, atol=1e-7)
    assert np.isclose(explain.partial_dependence(m, "b", [None])[0][1], m.base_score + gone.weight if gone.is_leaf else score[np.isnan(x[:, 0])][0])
    assert Model.from_json(m.to_json()).trees[0][0].missing == root.missing
    assert drift.prune(Model.from_json(m.to_json()), d, "t").base_score is not None


def test_missing_branch_ends(data):
    d = data.withColumn("t", F.col("a"))
    m = fit(d, ["b", "a"], "t", Config("SquaredLoss", budget=0.2, iterations=1, max_bin=8, max_nodes=9, missing_branch=True, end_missing=["b", "a"]))
    assert all(t[n.missing].is_leaf for t in m.trees for n in t if n.missing >= 0)
    with pytest.raises(ValueError):
        Config(missing_treatment="Other")


def test_refresh_moves_to_new_data(data):
    m = fit(data, ["a"], "y", REG)
    late = data.withColumn("y", F.col("y") + 3)
    loss = lambda q: late.agg(F.avg((F.col("y") - q.raw_score()) ** 2)).first()[0]
    before = loss(m)
    assert loss(drift.refresh(Model.from_json(m.to_json()), late, "y")) < before


def test_interactions_hold(data):
    d = data.withColumn("t", F.col("a") * F.col("z") + F.col("d"))
    m = fit(d, ["a", "z", "d"], "t", Config("SquaredLoss", budget=0.2, iterations=2, max_bin=8, max_nodes=15, interactions=[["a", "z"], ["d"]]))
    for tree in m.trees:
        for leaf in (n for n in tree if n.is_leaf):
            seen, i = set(), leaf.parent
            while i >= 0:
                seen.add(tree[i].feature)
                i = tree[i].parent
            assert seen <= {0, 1} or seen <= {2}


def test_conformal_shift(data):
    q = calibrate.conformal_shift(data, F.lit(-0.1), F.lit(0.1), F.col("a"), 0.1)
    assert data.agg(F.avg(F.col("a").between(-0.1 - q, 0.1 + q).cast("int"))).first()[0] >= 0.9


def test_streams(spark, data, tmp_path):
    m = fit(data, ["a"], "y", REG)
    data.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("row_id"))).coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    assert stream.isStreaming
    q = scorer.score_stream(m, stream).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    assert np.isclose(mean(spark.table("scored"), "score"), mean(data, m.raw_score()))
    q = scorer.windowed_visits(m, stream, "at", "100 seconds", "10 seconds").writeStream.format("memory").outputMode("update").queryName("visits").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("visits").groupBy("tree_id", "window", "leaf").agg(F.max("n").alias("n")).where("tree_id = 0").agg(F.sum("n")).first()[0] == 500
    hold = {"model": Model.from_json(m.to_json())}
    scorer.refit_batches(stream, ["a"], "y", REG, hold, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(hold["model"].trees) > len(m.trees)


def test_uplift_ranges_suit_any_score(spark):
    """Scores within -1..1 spread over tasks, and their curve is that of one ordered pass."""
    rng = np.random.default_rng(2)
    y, w, s = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000), np.round(rng.uniform(-1, 1, 4000), 3)
    df = spark.createDataFrame([(i, int(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(y, w, s))], "row_id bigint, y int, w int, s double")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = M.uplift_curve(df.repartition(4), "y", "w", "s", "row_id").withColumn("task", F.spark_partition_id()).toPandas().sort_values("place")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    order = np.lexsort((np.arange(4000), -s))
    nt, nc = np.cumsum(w[order]), np.cumsum(1 - w[order])
    want = (np.cumsum((y * w)[order]) / np.maximum(nt, 1) - np.cumsum((y * (1 - w))[order]) / np.maximum(nc, 1)) * np.arange(1, 4001)
    assert (got["row_id"].to_numpy() == order).all() and np.allclose(got["value"], want)
    assert got["task"].value_counts().max() < 1000
    assert M.uplift_curve(df.limit(0), "y", "w", "s", "row_id").count() == 0


@pytest.mark.parametrize("kind", causal.KINDS)
def test_effect_estimators(data, kind):
    """Each kind fits, predicts, and predicts the same after JSON."""
    y, w, more = {"IV": ("e", "d", {"instruments": ["z"]}), "Fair": ("k", "s", {"options": {"strength": 2.0}}), "Policy": ("y", "w", {"options": {"doubly_robust": True}})}.get(kind, ("y", "w", {}))
    x = ["a", "s"] if kind == "Fair" else ["a"]
    m = causal.Effect(kind, x, w, REG, BIN, **more).fit(data, y)
    got = m.predict(data, "t")
    assert set(got.columns) == {*data.columns, "t"}
    again = causal.Effect.from_json(m.to_json())
    assert again.predict(data, "t").agg(F.sum("t")).first() == got.agg(F.sum("t")).first()
    low, high = {"IV": (1.5, 4.0), "Fair": (0.2, 0.8), "Policy": (0.9, 1.0)}.get(kind, (1.2, 2.8))
    assert low <= mean(got, "t") <= high
    if kind == "DML":
        assert again.average["low"] < again.average["ate"] < again.average["high"]
    if kind == "IV":
        assert mean(m.predict(data, "o", at=1.0), "o") - mean(m.predict(data, "o", at=0.0), "o") == pytest.approx(mean(got, "t"))
    with pytest.raises(ValueError):
        causal.Effect("Q", ["a"], "w")
    with pytest.raises(ValueError):
        causal.Effect("S", ["a"], "w").predict(data)
