"""Percentiles and cuts against NumPy: ties, weights, missing values, empty tables."""

import numpy as np
import pytest

from timberline.operators import binning
from timberline.operators.trainer import Config, binned

PS = [0.01, 0.1, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    a, b, w = rng.normal(size=3000), np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 500, 3000)), rng.integers(1, 5, 3000).astype(float)
    rows = [(float(x) if i % 11 else None, float(y) if i % 13 else float("nan"), float(k), float(i % 6)) for i, (x, y, k) in enumerate(zip(a, b, w))]
    df = spark.createDataFrame(rows, "a double, b double, w double, c double").cache()
    df.count()
    return df


def brute(v, w, p):
    keep = ~np.isnan(v)
    o = np.argsort(v[keep], kind="stable")
    v, share = v[keep][o], np.cumsum(w[keep][o]) / w[keep].sum()
    last = np.append(v[1:] != v[:-1], True)
    return v[last][np.argmax(share[last] >= p)]


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("ordered", [0, binning.ORDERED])
def test_percentiles(data, weight, ordered, monkeypatch):
    """Buckets of the ordered pass leave no trace, not even where one value has two fifths of the rows."""
    monkeypatch.setattr(binning, "ORDERED", ordered)
    got = {(r["feature"], r["p"]): r["value"] for r in binning.weighted_percentiles(data, ["a", "b"], PS, weight).collect()}
    pdf = data.toPandas()
    w = pdf.w.to_numpy() if weight else np.ones(len(pdf))
    assert got == {(f, p): brute(pdf[f].to_numpy(dtype=float), w, p) for f in "ab" for p in PS}


def test_sketched_cuts(data):
    exact = {r["feature"]: r["cuts"] for r in binning.cuts(data, ["a", "b", "c"], 16).collect()}
    fast = binning.sketched_cuts(data, ["a", "b", "c"], 16)
    assert fast["c"] == exact["c"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and len(fast["a"]) == 16
    for f in "ab":
        v = np.sort(data.toPandas()[f].dropna())
        slack = 1 / 1600 + 1 / len(v)  # a hundredth of a bin, and one row
        low, high = (np.searchsorted(v, fast[f], side) / len(v) for side in ("left", "right"))
        for i in range(1, 17):
            assert ((low - slack <= i / 16) & (i / 16 <= high + slack)).any()


def test_nothing(data, monkeypatch):
    for ordered in (-1, binning.ORDERED):
        monkeypatch.setattr(binning, "ORDERED", ordered)
        assert binning.weighted_percentiles(data.limit(0), ["a"], PS).count() == 0
    assert binning.sketched_cuts(data.limit(0), ["a", "c"], 8) == {"a": [], "c": []}


def test_weights_reach_the_cuts(spark):
    """Of two classes of equal weight, the rare one has half of the cuts."""
    rng = np.random.default_rng(4)
    rows = [(i, float(v), 1.0) for i, v in enumerate(rng.random(4000))] + [(4000 + i, float(10 + v), 100.0) for i, v in enumerate(rng.random(40))]
    df = spark.createDataFrame(rows, "row_id bigint, a double, k double")
    cuts = binned(df, ["a"], Config(max_bin=16, weight="k"), "row_id")[2]["a"]
    v = sorted((a, k) for _, a, k in rows)
    upto = np.cumsum([k for _, k in v]) / 8000
    assert cuts[1:] == [v[int(np.searchsorted(upto, i / 16))][0] for i in range(1, 17)]
    assert sum(c > 5 for c in cuts) == 8
    assert binned(df.limit(0), ["a"], Config(max_bin=16, weight="k"), "row_id")[2]["a"] == [float("-inf")]


def test_order_statistics(spark, monkeypatch):
    """Exact at every place, with ties, whether a bracket is ordered at once or narrowed further."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), np.round(rng.normal(size=1500), 1)])
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(4)
    places = [1, 2, 700, 3000, 3500, 4200, len(x) - 1, len(x), len(x) + 9]
    want = [float(np.sort(x)[min(k, len(x)) - 1]) for k in places]
    for gathered, sketch in ((10_000, 10_000), (50, 100), (5, 20)):
        monkeypatch.setattr(binning, "GATHERED", gathered)
        monkeypatch.setattr(binning, "SKETCH", sketch)
        assert binning.order_statistics(d, "v", places, len(x)) == want
