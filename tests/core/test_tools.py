"""Exports, samples, conformal pairs, pruning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from timberline.operators import calibrate, drift, sampling
from timberline.operators.trainer import Config, fit
from timberline.operators.tree import Model, Node
from timberline.plans.queries import MODEL
from timberline.sources import export


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, float(a), float(2 * a + e), int(i % 10 == 0)) for i, (a, e) in enumerate(rng.normal(size=(600, 2)))], "row_id bigint, a double, y double, k int").cache()
    df.count()
    return df


def walk(tree: dict, row: list[float]) -> float:
    """A reader of the exported schema: a listed category goes right, a missing value by default_left."""
    cats = {n: tree["categories"][s : s + k] for n, s, k in zip(tree["categories_nodes"], tree["categories_segments"], tree["categories_sizes"])}
    i = 0
    while tree["left_children"][i] >= 0:
        v = row[tree["split_indices"][i]]
        if np.isnan(v):
            left = bool(tree["default_left"][i])
        elif tree["split_type"][i]:
            left = int(v) not in cats[i]
        else:
            left = v < tree["split_conditions"][i]
        i = tree["left_children"][i] if left else tree["right_children"][i]
    return tree["split_conditions"][i]


def test_exported_document_scores_alike():
    d = export.xgboost_document(MODEL)["learner"]
    base = float(d["learner_model_param"]["base_score"])
    rows = [[p, c] for p in (1e4, 1e5, 2e5, 3e5, np.nan) for c in (0.0, 1.0, 2.0, 3.0, np.nan)]
    want = MODEL.base_score + MODEL.leaf_sums(np.array(rows))[:, 0]
    got = [np.log(base / (1 - base)) + sum(walk(t, r) for t in d["gradient_booster"]["model"]["trees"]) for r in rows]
    assert np.allclose(got, want) and d["feature_types"] == ["float", "c"] and d["objective"]["name"] == "binary:logistic"
    many = export.xgboost_document([MODEL, MODEL])["learner"]
    assert many["learner_model_param"]["num_class"] == "2" and len(many["gradient_booster"]["model"]["trees"]) == 8
    with pytest.raises(ValueError):
        export.xgboost_document(Model(["a"], "LogLoss", 0.0, 1.0, [], head={"blend": 0.2}))


def test_trees_frame(spark):
    rows = export.trees_frame(spark, MODEL).collect()
    assert len(rows) == sum(map(len, MODEL.trees)) and rows[3]["Left_Cats"] == [1, 3] and rows[3]["Right_Cats"] == [0, 2] and rows[3]["Missing"] == "1-1"


def test_samples(data):
    kept, rest = sampling.split_rows(data, 0.3, "row_id", 4)
    assert kept.count() + rest.count() == 600 and 120 < kept.count() < 240 and kept.join(rest, "row_id").isEmpty()
    rates = sampling.even_rates(data, "k", 0.2)
    assert rates[1] == 1.0 and abs(rates[0] * 540 - 60) < 1e-6
    got = {r["k"]: r["count"] for r in sampling.class_sample(data, "k", rates, "row_id").groupBy("k").count().collect()}
    assert got[1] == 60 and 35 < got[0] < 90


def test_quantile_pair_covers(data):
    train, held = sampling.split_rows(data, 0.6, "row_id")
    p = calibrate.fit_quantile_pair(train, held, ["a"], "y", 0.2, Config(budget=0.2, iterations=2, max_bin=8, max_nodes=5))
    i = held.select("y", p.interval().alias("i"))
    assert i.agg(F.avg(F.col("y").between(F.col("i.low"), F.col("i.high")).cast("int"))).first()[0] >= 0.8


def noisy() -> Model:
    """A split that helps, under which one helps and one hurts."""
    n = lambda i, parent, depth, w, **k: Node(i, parent, depth, w, 100.0, 100, [w] * 5, **k)
    return Model(["a"], "SquaredLoss", 0.0, 1.0, [[n(0, -1, 0, 0.0, feature=0, value=0.0, left=1, right=2), n(1, 0, 1, -1.5, feature=0, value=-1.0, left=3, right=4), n(2, 0, 1, 1.5, feature=0, value=1.0, left=5, right=6), n(3, 1, 2, -3.0), n(4, 1, 2, -0.9), n(5, 2, 2, 9.0), n(6, 2, 2, -9.0)]])


@pytest.mark.parametrize("kind", ["BottomUp", "TopDown", "Statistical"])
def test_prune_kinds(data, kind):
    m = drift.prune(noisy(), data, "y", kind)
    assert len(m.trees[0]) == 5 and sorted(n.weight for n in m.trees[0] if n.is_leaf) == [-3.0, -0.9, 1.5]
    with pytest.raises(ValueError):
        drift.prune(noisy(), data, "y", "Other")


def plain_pava(p, y):
    """Row by row over sums by p; each row of p's value."""
    at, inverse = np.unique(p, return_inverse=True)
    blocks = []
    for b, n in zip(np.bincount(inverse, y), np.bincount(inverse)):
        blocks.append([b, n, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    ends = np.cumsum([k for _, _, k in blocks])
    n = np.bincount(inverse)
    xs = [float(np.average(at[e - k : e], weights=n[e - k : e])) for e, (_, _, k) in zip(ends, blocks)]
    return xs, [float(b / n) for b, n, _ in blocks]


def test_isotonic_is_exact_for_rare_positives(spark):
    rng = np.random.default_rng(12)
    p = rng.random(60_000) * 1.2e-4
    p[::7] = np.round(p[::7], 6)
    y = (rng.random(60_000) < 20 * p).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y})).unionByName(spark.createDataFrame([(None, 1.0), (0.5, None), (float("nan"), 1.0)], "p double, y double"))
    xs, ys = calibrate.isotonic(df.repartition(5), "p", "y")
    want = plain_pava(p, y)
    at = np.linspace(0, 1.3e-4, 5001)
    assert len(set(want[1])) > 5 and sorted(set(ys)) == pytest.approx(sorted(set(want[1])), rel=1e-12)
    assert np.interp(at, xs, ys) == pytest.approx(np.interp(at, *want), rel=1e-6, abs=1e-12)
    assert len(xs) < 200
    level = calibrate.isotonic(spark.createDataFrame([(0.1, 0), (0.2, 0), (0.3, 1), (0.4, 1)], "p double, y int"), "p", "y")
    assert level == ([0.1, 0.2, 0.3, 0.4], [0.0, 0.0, 1.0, 1.0])
    assert calibrate.isotonic(df.limit(0), "p", "y") == ([], [])


def test_classes_are_calibrated(spark, data):
    d = data.withColumn("z", (F.col("y") > 1).cast("int"))
    m = fit(d, ["a"], "z", Config("LogLoss", budget=0.5, iterations=2, max_bin=8, max_nodes=5), "row_id")
    raw = d.select("z", m.probability().alias("p")).toPandas()
    for method in ("Conformal", *calibrate.METHODS):
        c = Model.from_json(calibrate.calibrate_classes(Model.from_json(m.to_json()), d, "z", [0.1], method).to_json())
        got = d.select("z", c.probability(True).alias("p"), c.probability().alias("raw"), calibrate.label_sets(c, 0.1).alias("s")).toPandas()
        assert np.allclose(got["raw"], raw["p"]) and np.allclose(got["p"], np.interp(raw["p"], *plain_pava(raw["p"].to_numpy(), raw["z"].to_numpy())), atol=1e-9)
        assert np.mean([z in s for z, s in zip(got["z"], got["s"])]) >= 0.89
    assert np.allclose(d.select(m.probability(True)).toPandas().iloc[:, 0], raw["p"])
