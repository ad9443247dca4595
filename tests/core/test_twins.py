"""What a fit works out on the driver equals what the operators work out in Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.functions import primitives as P
from timberline.operators import histogram, trainer
from timberline.operators.trainer import Config

HIST = "node int, feature string, bin int, fold int, g double, h double, n bigint"


def cells(rng, bins):
    """[bin, fold, (g, h, n)] with a few empty cells; bin 0 is empty."""
    n = rng.poisson(6, (bins + 1, 5)) * (rng.random((bins + 1, 5)) < 0.9)
    n[0] = 0
    slope = np.linspace(-1, 1, bins + 1)[:, None]
    return np.stack([n * slope + rng.normal(size=n.shape) * np.sqrt(n), n * (0.5 + 0.1 * rng.random(n.shape)), n], axis=-1).astype(float)


def frame(spark, parts):
    rows = [(0, name, b, j, float(c[0]), float(c[1]), int(c[2])) for name, a in parts.items() for b, fold in enumerate(a) for j, c in enumerate(fold) if c[2]]
    return spark.createDataFrame(rows, HIST)


@pytest.mark.parametrize("seed", range(4))
def test_numeric_split(spark, seed):
    """The scan of each cut, and the best, with gains, generalization and fold weights' ranks."""
    rng = np.random.default_rng(seed)
    parts = {f: cells(rng, k) for f, k in (("a", 7), ("b", 20), ("c", 3))}
    scan = {(r["feature"], r["bin"]): r for r in histogram.split_scan(frame(spark, parts)).collect()}
    for f, a in parts.items():
        pre = np.cumsum(a[1:], axis=0)
        e = trainer._evaluate(pre[:-1], pre[-1] - pre[:-1])
        for i in range(len(pre) - 1):
            r = scan.get((f, i + 2))
            if r is None or not (e["left"][i, 2] > 0 and e["right"][i, 2] > 0):
                continue
            assert r["gain"] == pytest.approx(e["gain"][i], abs=1e-9) and (r["generalization"] or 0.0) == pytest.approx(e["gen"][i], rel=1e-6)
    best = histogram.best_split(histogram.split_scan(frame(spark, parts))).first()
    cfg = Config("SquaredLoss")
    mine = trainer.find_split([parts[f] for f in "abc"], True, cfg, list("abc"), [0, 1, 2])
    assert best["feature"] == "abc"[mine["feature"]] and best["gain"] == pytest.approx(mine["gain"])
    placed = sorted(b for f, b in scan if f == best["feature"])
    bins = np.flatnonzero(parts[best["feature"]][:, :, 2].sum(axis=1))
    assert best["bin"] in placed and (bins < best["bin"]).sum() == (bins - 1 < mine["at"]).sum()


def test_ranks_and_floors(spark):
    rng = np.random.default_rng(7)
    left, right = np.stack([cells(rng, 50)[1:] for _ in range(2)])
    e = trainer._evaluate(left, right)
    lo, ro = (x.sum(axis=1)[:, None, :] - x for x in (left, right))
    wl, wr = (-o[..., 0] / (o[..., 1] + P.TINY) for o in (lo, ro))
    rows = [(i, float(e["gain"][i]), float(e["gen"][i]), wl[i].tolist(), wr[i].tolist(), float(e["left"][i, 2]), float(e["right"][i, 2]), float(e["steady"][i])) for i in range(len(wl))]
    d = spark.createDataFrame(rows, "i int, gain double, gen double, a array<double>, b array<double>, nl double, nr double, steady double")
    for cat in (False, True):
        by = P.split_rank(F.col("gain"), F.col("gen"), F.col("a"), F.col("b"), cat)
        by = by * P.sparse_balance(F.col("nl"), F.col("nr")) if cat else by
        got = d.select("i", P.split_stability(F.col("a"), F.col("b")).alias("s"), by.alias("r"), P.generalization_floor(F.col("steady"), F.lit(2), F.lit(300), cat).alias("f")).orderBy("i").collect()
        assert np.allclose([r["s"] for r in got], e["steady"]) and np.allclose([r["r"] for r in got], trainer._rank(e, cat, cat))
        assert np.allclose([r["f"] for r in got], trainer._floor(e["steady"], 2, 300, cat))


@pytest.mark.parametrize("bins", [6, 60])
def test_category_orders(spark, bins):
    rng = np.random.default_rng(bins)
    a = cells(rng, bins)
    hist = frame(spark, {"a": a})
    order = [r["bin"] for r in histogram.category_order(hist).orderBy("place").collect()]
    mine = trainer.category_orders(a[1:])
    assert order == (mine[0] + 1).tolist()
    scores = histogram.category_scores(hist).collect()
    if bins >= trainer.SPARSE_BINS:
        by = {r["bin"]: r[r["mode"]] for r in scores}
        assert len(mine) == 1 or sorted(by, key=lambda b: (by[b], b)) == (mine[1] + 1).tolist()
