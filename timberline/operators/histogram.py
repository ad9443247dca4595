"""Fold-aware histograms and the split scan over them, as aggregates and windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.primitives import TINY

FOLDS = 5


def fold_histogram(df: DataFrame, bins: dict[str, str], node: str = "node", fold: str = "fold", g: str = "g", h: str = "h", also: tuple[str, ...] = ()) -> DataFrame:
    """(node, feature, bin, fold, g, h, n): sums of gradient and hessian and counts; bins names each feature's bin column.
    Columns named in also are summed too.

    Rows fan out by feature before a hash aggregate with numbers as keys, whose partial sums leave at most
    nodes x features x bins x folds rows a task for the shuffle; names are given to the sums.
    """
    long = df.select(F.col(node).alias("node"), F.col(fold).alias("fold"), g, h, *also, F.posexplode(F.array(*[F.col(b).cast("int") for b in bins.values()])).alias("at", "bin"))
    sums = long.groupBy("node", "at", "bin", "fold").agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in also])
    return sums.select("node", F.get(F.lit(list(bins)), "at").alias("feature"), "bin", "fold", "g", "h", "n", *also)


def subtract(parent: DataFrame, *children: DataFrame) -> DataFrame:
    """The remaining child's histogram: the parent's less the others', by feature, bin and fold."""
    key = ["feature", "bin", "fold"]
    out = parent.select(*key, "g", "h", "n")
    for c in children:
        out = out.join(c.select(*key, F.col("g").alias("_g"), F.col("h").alias("_h"), F.col("n").alias("_n")), key, "left")
        zero = F.lit(0)
        out = out.select(*key, (F.col("g") - F.coalesce("_g", zero)).alias("g"), (F.col("h") - F.coalesce("_h", zero)).alias("h"), (F.col("n") - F.coalesce("_n", zero)).alias("n"))
    return out


def node_totals(hist: DataFrame) -> DataFrame:
    """(node, g, h, n), by way of one feature."""
    one = hist.groupBy("node", "feature").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    return one.groupBy("node").agg(F.min_by("g", "feature").alias("g"), F.min_by("h", "feature").alias("h"), F.min_by("n", "feature").alias("n"))


def split_scan(hist: DataFrame) -> DataFrame:
    """(node, feature, bin, gain, train, valid, generalization) of sending what lies under a bin to the left.

    Prefix sums over bins by fold; for each fold the weights come from the others and are judged on it. Means over
    folds divide by five; folds with an empty side are left out.
    """
    cells = hist.groupBy("node", "feature", "bin").agg(*[F.coalesce(F.sum(F.when(F.col("fold") == j, F.col(x))), F.lit(0)).cast("double").alias(f"{x}{j}") for x in "ghn" for j in range(FOLDS)])
    left = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("node", "feature")
    cells = cells.select("node", "feature", "bin", *[F.coalesce(F.sum(f"{x}{j}").over(left), F.lit(0.0)).alias(f"l{x}{j}") for x in "ghn" for j in range(FOLDS)], *[F.sum(f"{x}{j}").over(every).alias(f"t{x}{j}") for x in "ghn" for j in range(FOLDS)])
    cells = cells.withColumns({f"{s}{x}": sum((F.col(f"{s}{x}{j}") for j in range(1, FOLDS)), F.col(f"{s}{x}0")) for s in "lt" for x in "ghn"})
    over = lambda g, h: g * g / (h + TINY)
    train, valid = [], []
    for j in range(FOLDS):
        own = {s + x: F.col(f"l{x}{j}") if s == "l" else F.col(f"t{x}{j}") - F.col(f"l{x}{j}") for s in "lr" for x in "ghn"}
        rest = {s + x: (F.col(f"l{x}") if s == "l" else F.col(f"t{x}") - F.col(f"l{x}")) - own[s + x] for s in "lr" for x in "ghn"}
        ok = (own["ln"] > 0) & (own["rn"] > 0) & (rest["ln"] > 0) & (rest["rn"] > 0)
        judged = F.lit(0.0)
        for s in "lr":
            w = -rest[s + "g"] / (rest[s + "h"] + TINY)
            judged = judged + own[s + "g"] * w + 0.5 * own[s + "h"] * w * w
        train.append(F.when(ok, -0.5 * (over(rest["lg"], rest["lh"]) + over(rest["rg"], rest["rh"])) / F.nullif(rest["ln"] + rest["rn"], F.lit(0.0))).otherwise(0.0))
        valid.append(F.when(ok, judged / F.nullif(own["ln"] + own["rn"], F.lit(0.0))).otherwise(0.0))
    parent = -0.5 * over(F.col("tg"), F.col("th")) / F.nullif("tn", F.lit(0.0))
    gain = over(F.col("lg"), F.col("lh")) + over(F.col("tg") - F.col("lg"), F.col("th") - F.col("lh")) - over(F.col("tg"), F.col("th"))
    out = cells.where("ln > 0 and tn > ln").select("node", "feature", "bin", gain.alias("gain"), (sum(train[1:], train[0]) / FOLDS).alias("train"), (sum(valid[1:], valid[0]) / FOLDS).alias("valid"), parent.alias("parent"))
    return out.select("node", "feature", "bin", "gain", "train", "valid", ((F.col("parent") - F.col("train")) / F.nullif(F.col("parent") - F.col("valid"), F.lit(0.0))).alias("generalization"))


def best_split(scan: DataFrame, floor: float | None = None) -> DataFrame:
    """The split of each node with the most gain; the last feature by name and the lowest bin of equals. A floor, where
    given, is asked of its generalization."""
    good = scan.where("gain > 0") if floor is None else scan.where((F.col("gain") > 0) & (F.col("generalization") >= floor))
    return good.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "gain", "generalization"), F.struct("gain", "feature", -F.col("bin"))).alias("s")).select("node", "s.*")


def category_order(hist: DataFrame, smooth: float = 1.0) -> DataFrame:
    """(node, feature, bin, place): bins by descending smoothed mean of -gradient over hessian, then by bin."""
    cells = hist.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return cells.select("node", "feature", "bin", F.row_number().over(Window.partitionBy("node", "feature").orderBy(F.desc(-F.col("g") / (F.col("h") + smooth)), "bin")).alias("place"))


# fixed values: parts of stability and agreement in a category's ordered statistic, shrinkage by the prior's strength; bins
# and shares of thinly supported bins from which other orders are preferred, and what thin support is
STEADY, AGREE, SHRINK = 0.55, 0.45, 0.35
MANY_BINS, LIFT_SHARE, MEAN_SHARE, THIN = 48, 0.7, 0.45, 1.5


def category_scores(hist: DataFrame, ridge: float = 0.0) -> DataFrame:
    """(node, feature, bin, ordered, posterior, lift, mode): what a category's bins can be ordered by, and the preferred way.

    posterior: the bin's mean gradient over hessian, drawn to that of all bins; lift: how far it lies from it, by support;
    ordered: its mean over leaving each fold out, times how steady these are and how well they agree with the fold left out.
    Bin 0 (missing) has no part in the prior. One row a bin; windows hold a feature's bins.
    """
    folds = range(FOLDS)
    own = [F.coalesce(F.sum(F.when(F.col("fold") == j, F.col(x))), F.lit(0.0)).alias(f"{x}{j}") for x in "gh" for j in folds]
    cells = hist.groupBy("node", "feature", "bin").agg(*own, F.sum("g").alias("G"), F.sum("h").alias("H"))
    every = Window.partitionBy("node", "feature")
    counts = (F.col("bin") != 0) & (F.col("H") > 0)
    over = lambda v: F.sum(F.when(counts, v)).over(every)
    used = over(F.lit(1))
    cells = cells.withColumns({"s": (1 + F.coalesce(over(F.col("H")), F.lit(0.0))) / F.greatest(F.coalesce(used, F.lit(1)), F.lit(1)), "m": F.coalesce(over(F.col("G")) / F.nullif(over(F.col("H")) + ridge, F.lit(0.0)), F.lit(0.0)), "used": F.coalesce(used, F.lit(0))})
    s, m, g, h = (F.col(c) for c in ("s", "m", "G", "H"))
    thin = F.coalesce(over(F.when(h <= THIN * F.greatest(s, F.lit(1.0)), 1).otherwise(0)), F.lit(0)) / F.greatest("used", F.lit(1))
    cells = cells.withColumn("mode", F.when(F.col("used") < MANY_BINS, "ordered").when(thin >= LIFT_SHARE, "lift").when(thin >= MEAN_SHARE, "posterior").otherwise("ordered"))
    posterior = (g + s * m) / (h + s + ridge)
    lift = (posterior - m) * F.sqrt(h) / (F.sqrt(h) + F.sqrt(F.greatest(s, F.lit(1.0))))
    out = {j: F.when(h - F.col(f"h{j}") > 0, (g - F.col(f"g{j}") + s * m) / (h - F.col(f"h{j}") + s + ridge)) for j in folds}
    cells = cells.withColumns({f"o{j}": v for j, v in out.items()})
    held = {j: F.when(F.col(f"h{j}") > 0, F.col(f"g{j}") / F.nullif(F.col(f"h{j}") + ridge, F.lit(0.0))).otherwise(m) for j in folds}
    agrees = {j: 1 / (1 + F.abs(held[j] - F.col(f"o{j}")) / (F.abs(F.col(f"o{j}")) + 1e-3)) for j in folds}
    total = lambda of: sum((F.coalesce(of[j], F.lit(0.0)) for j in folds), F.lit(0.0))
    n = F.nullif(total({j: F.when(F.col(f"o{j}").isNotNull(), 1.0) for j in folds}), F.lit(0.0))
    cells = cells.withColumns({"n": n, "mean": total({j: F.col(f"o{j}") for j in folds}) / n, "agree": total(agrees) / n})
    spread = F.sqrt(total({j: (F.col(f"o{j}") - F.col("mean")) ** 2 for j in folds}) / F.col("n"))
    steady = 1 / (1 + spread / (F.abs("mean") + 1e-6))
    ordered = F.col("mean") * (STEADY * steady + AGREE * F.col("agree")) * h / (h + SHRINK * F.greatest(s, F.lit(1.0)))
    zero = lambda v: F.when(h > 0, F.coalesce(v, F.lit(0.0))).otherwise(0.0)
    return cells.select("node", "feature", "bin", zero(ordered).alias("ordered"), zero(posterior).alias("posterior"), zero(lift).alias("lift"), "mode")


def ordering_scores(bins: np.ndarray, ridge: float = 0.0) -> tuple[dict[str, np.ndarray], str]:
    """category_scores for one node and feature on the driver: bins[bin, fold, (g, h)] without the missing bin."""
    g, h = bins[..., 0], bins[..., 1]
    whole_g, whole_h = g.sum(axis=1), h.sum(axis=1)
    known = whole_h > 0
    used = int(known.sum())
    s, total = (1 + whole_h[known].sum()) / max(used, 1), whole_h[known].sum() + ridge
    m = whole_g[known].sum() / total if total else 0.0
    thin = (whole_h[known] <= THIN * max(s, 1.0)).sum() / max(used, 1)
    mode = "ordered" if used < MANY_BINS else "lift" if thin >= LIFT_SHARE else "posterior" if thin >= MEAN_SHARE else "ordered"
    posterior = (whole_g + s * m) / (whole_h + s + ridge)
    lift = (posterior - m) * np.sqrt(whole_h) / (np.sqrt(whole_h) + np.sqrt(max(s, 1.0)))
    rest_g, rest_h = whole_g[:, None] - g, whole_h[:, None] - h
    has = rest_h > 0
    n = np.maximum(has.sum(axis=1), 1)
    mean_of = lambda v: np.where(has, v, 0.0).sum(axis=1) / n
    out = (rest_g + s * m) / (rest_h + s + ridge)
    held = np.where(h > 0, g / np.where(h > 0, h + ridge, 1.0), m)
    mean = mean_of(out)
    agree = mean_of(1 / (1 + np.abs(held - out) / (np.abs(out) + 1e-3)))
    steady = 1 / (1 + np.sqrt(mean_of((out - mean[:, None]) ** 2)) / (np.abs(mean) + 1e-6))
    ordered = mean * (STEADY * steady + AGREE * agree) * whole_h / (whole_h + SHRINK * max(s, 1.0))
    return {k: np.where(known, v, 0.0) for k, v in {"ordered": ordered, "posterior": posterior, "lift": lift}.items()}, mode
