"""Invariants of trained models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import calibrate, causal, drift, explain, multi
from timberline.operators.trainer import Config, fit
from timberline.operators.tree import Model

CFG = Config("SquaredLoss", budget=0.3, iterations=2, max_bin=8, max_nodes=7)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    w = rng.integers(0, 2, 400)
    rows = [(i, float(a) if i % 9 else None, float(b), int(k), int(i % 3), float(2 * a + k * b + 0.1 * e), float(a > 0)) for i, ((a, b), k, e) in enumerate(zip(x, w, rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, w int, c int, y double, z double").cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def model(data):
    return fit(data, ["a", "b", "c"], "y", Config("SquaredLoss", budget=0.3, iterations=2, max_bin=8, max_nodes=7, categorical=["c"]))


def test_learns_and_round_trips(data, model):
    err, var = data.agg(F.avg((F.col("y") - model.raw_score()) ** 2), F.var_pop("y")).first()
    assert model.trees and err < 0.8 * var
    again = Model.from_json(model.to_json())
    got = data.select(model.raw_score().alias("p"), again.raw_score().alias("q")).collect()
    assert all(r["p"] == r["q"] for r in got) and "leaf=" in model.text()


def test_contributions_sum(data, model):
    x = np.array(data.select("a", "b", "c").toPandas(), dtype=float)
    score = model.base_score + model.leaf_sums(x)[:, 0]
    for m in ("Weight", "Average", "Shapley"):
        assert np.allclose(explain.contributions_of(model, x, m).sum(axis=1), score, atol=1e-7)


def test_shapley_two_features():
    from timberline.plans.queries import MODEL

    x = np.array([[100000.0, 1.0], [20000.0, 2.0], [np.nan, 5.0]])
    phi = explain.contributions_of(MODEL, x, "Shapley")

    def value(row, known):
        def at(t, i):
            n = t[i]
            if n.is_leaf:
                return n.weight
            if n.feature in known:
                return at(t, n.left if MODEL.branches(n, row[None])[0][1][0] else n.right)
            a, b = t[n.left], t[n.right]
            return (a.cover * at(t, a.id) + b.cover * at(t, b.id)) / (a.cover + b.cover)

        return MODEL.base_score + sum(at(t, 0) for t in MODEL.trees)

    for row, p in zip(x, phi):
        v = {s: value(row, set(s)) for s in ((), (0,), (1,), (0, 1))}
        assert np.allclose(p, [(v[0,] - v[()] + v[0, 1] - v[1,]) / 2, (v[1,] - v[()] + v[0, 1] - v[0,]) / 2, v[()]])


def test_drift_and_prune(data, model):
    assert drift.drift(model, data).first()[0] < 0.1
    assert drift.drift(model, data.withColumn("a", F.col("a") + 5)).first()[0] > 1
    loss = lambda m: data.agg(F.avg((F.col("y") - m.raw_score()) ** 2)).first()[0]
    before = loss(model)
    assert loss(drift.prune(Model.from_json(model.to_json()), data, "y")) <= before + 1e-9


def test_intervals_cover(data, model):
    m = calibrate.calibrate(Model.from_json(model.to_json()), data, "y", [0.1])
    i = calibrate.intervals(m, 0.1)
    assert data.agg(F.avg(F.col("y").between(i["low"], i["high"]).cast("int"))).first()[0] >= 0.89


def test_monotone(data):
    m = fit(data, ["a", "b"], "y", Config("SquaredLoss", budget=0.3, iterations=1, max_bin=8, max_nodes=7, monotone={"a": -1}))
    ps = [p for _, p in explain.partial_dependence(m, "a", [-2.0, -1.0, 0.0, 1.0, 2.0])]
    assert all(x >= y - 1e-9 for x, y in zip(ps, ps[1:]))


def test_estimators(data):
    assert data.agg(F.avg(causal.t_learner(data, ["a", "b"], "w", "y", CFG))).first()[0] is not None
    with pytest.raises(ValueError):
        causal.check_treatment(data, "c")
    m = multi.fit_classes(data, ["a", "b"], "c", Config(budget=0.3, iterations=1, max_bin=8, max_nodes=3))
    assert len(m.models) == 3 and all(abs(sum(r[0]) - 1) < 1e-9 for r in data.select(m.probabilities()).collect())
