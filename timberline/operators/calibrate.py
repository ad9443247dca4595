"""Calibration: intervals and label sets from the spread of fold scores, conformal shifts, isotonic steps."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.objectives import quantile
from timberline.functions.primitives import each_fold, fold_mean, fold_spread, sigmoid
from timberline.operators.binning import order_statistics
from timberline.operators.trainer import Config, fit
from timberline.operators.tree import Model
from timberline.sources.tables import WRITTEN, cut_lineage, discard

METHODS = ("WeightVariance", "MinMax", "GRP")
SHRINK = 0.985
LEAST_SPREAD = 1e-6


def interpolated(xs: Column, at: Column) -> Column:
    """Piecewise linear through a sorted array of five at 0, 1/4 .. 1; the end pieces go on outside."""
    i = F.least(F.greatest(F.floor(at * 4), F.lit(0)), F.lit(3)).cast("int")
    return F.get(xs, i) + (F.get(xs, i + 1) - F.get(xs, i)) * (at * 4 - i)


def position(xs: Column, y: Column) -> Column:
    """Where y lies between the least (0) and greatest (1) of an array."""
    return (y - F.array_min(xs)) / F.nullif(F.array_max(xs) - F.array_min(xs), F.lit(0.0))


def _at_shares(df: DataFrame, v: Column, shares) -> list[float]:
    """Order statistics of v at the places that shares(n) names; none of an empty table. Exact. v is worked out once, into a table of
    its own, which is removed at the end."""
    since = len(WRITTEN)
    d = cut_lineage(df.select(v.cast("double").alias("v")), "scores").where("v is not null and not isnan(v)")
    n = d.count()
    out = order_statistics(d, "v", shares(n), n) if n else []
    discard(df.sparkSession, since)
    return out


def conformal_quantile(df: DataFrame, v: Column, alpha: float) -> float:
    """The order statistic of v whose place is the least that covers 1 - alpha of n + 1 rows."""
    return (_at_shares(df, v, lambda n: [math.ceil((n + 1) * (1 - alpha))]) or [0.0])[0]


def regression_parameters(df: DataFrame, folds: Column, score: Column, y: Column, alpha: float, method: str) -> list[float]:
    """What an interval of a method needs: one quantile of scaled residuals, or two of positions."""
    d = df.select(folds.alias("fs"), score.alias("s"), y.alias("y"))
    if method == "WeightVariance":
        return [conformal_quantile(d, F.abs(F.col("y") - F.col("s")) / F.greatest(fold_spread(F.col("fs")), F.lit(LEAST_SPREAD)), alpha)]
    sign = -1 if method == "MinMax" else 1  # the one narrows, the other widens
    return _at_shares(d, position(F.col("fs"), F.col("y")), lambda n: [math.ceil(n * p - 1e-9) for p in (alpha / 2 - sign / n, 1 - alpha / 2 + sign / n)]) or [0.0, 1.0]


def interval(folds: Column, score: Column, parameters: list[float], method: str) -> Column:
    """(low, high) of each row."""
    if method == "WeightVariance":
        half = parameters[0] * F.greatest(fold_spread(folds), F.lit(LEAST_SPREAD))
        return F.struct((score - half).alias("low"), (score + half).alias("high"))
    if method == "MinMax":
        low, width = F.array_min(folds), F.array_max(folds) - F.array_min(folds)
        a, b = low + parameters[0] * width, low + parameters[1] * width
        mid, half = (a + b) / 2, (b - a) / 2 * SHRINK
        return F.struct((mid - half).alias("low"), (mid + half).alias("high"))
    xs = F.sort_array(folds)
    return F.struct(interpolated(xs, F.lit(parameters[0])).alias("low"), interpolated(xs, F.lit(parameters[1])).alias("high"))


def calibrate(model: Model, df: DataFrame, y: str, alphas: list[float], method: str = "WeightVariance") -> Model:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    folds = model.fold_scores(ordered=method == "GRP")
    for a in alphas:
        model.calibration[str(a)] = regression_parameters(df, folds, model.raw_score(), F.col(y), a, method)
    model.metadata["calibration"] = method
    return model


def intervals(model: Model, alpha: float) -> Column:
    """(low, high). GRP interpolates in sums of each tree's sorted fold weights, which differ from sorted sums."""
    method = model.metadata["calibration"]
    return interval(model.fold_scores(ordered=method == "GRP"), model.raw_score(), model.calibration[str(alpha)], method)


def label_score(probs: Column, p: Column, label: int, method: str) -> Column:
    """1 - P(label), over the folds' spread or range where the method asks for it (GRP's range is MinMax's)."""
    s = 1 - p if label else p
    if method == "Conformal":
        return s
    if method == "WeightVariance":
        return s / F.greatest(fold_spread(probs), F.lit(LEAST_SPREAD))
    return s / F.greatest(F.array_max(probs) - F.array_min(probs), F.lit(LEAST_SPREAD))


def label_threshold(df: DataFrame, folds: Column, y: Column, alpha: float, method: str = "Conformal") -> float:
    """The quantile of the true label's score that label sets stay under."""
    probs = each_fold(folds, sigmoid)
    p = fold_mean(probs)
    s = F.when(y == 1, label_score(probs, p, 1, method)).otherwise(label_score(probs, p, 0, method))
    return conformal_quantile(df, s, alpha)


def label_set(folds: Column, threshold: float, method: str = "Conformal") -> Column:
    """The labels whose score is at most the threshold; may be empty."""
    probs = each_fold(folds, sigmoid)
    p = fold_mean(probs)
    return F.array_compact(F.array(*[F.when(label_score(probs, p, k, method) <= threshold, k) for k in (0, 1)]))


def conformal_shift(df: DataFrame, low: Column, high: Column, y: Column, alpha: float) -> float:
    """How far quantile predictions must move out to cover: a quantile of max(low - y, y - high)."""
    return conformal_quantile(df, F.greatest(low - y, y - high), alpha)


@dataclass
class QuantilePair:
    """Two quantile models and how far their predictions move out."""

    low: Model
    high: Model
    shift: float

    def interval(self) -> Column:
        return F.struct((self.low.raw_score() - self.shift).alias("low"), (self.high.raw_score() + self.shift).alias("high"))


def fit_quantile_pair(train: DataFrame, held: DataFrame, features: list[str], y: str, alpha: float, cfg: Config | None = None, row_id: str = "row_id") -> QuantilePair:
    """Conformal quantile regression with the caller's parameters: quantiles at alpha/2 and 1 - alpha/2, fitted on ``train``, shifted by ``held``."""
    low, high = (fit(train, features, y, replace(cfg or Config(), objective=quantile(q)), row_id) for q in (alpha / 2, 1 - alpha / 2))
    d = held.select(low.raw_score().alias("low"), high.raw_score().alias("high"), F.col(y).alias("y")).where("y is not null")
    return QuantilePair(low, high, conformal_shift(d, F.col("low"), F.col("high"), F.col("y"), alpha))


def pooled(blocks) -> list[tuple]:
    """Pools adjacent violators among blocks (sum of x, sum of y, rows, first x, last x) in order of x.

    Neighbours of one level become one block that keeps the x of its ends. Pooling parts of the order first and their
    blocks afterwards gives the same fit.
    """
    out: list[tuple] = []
    for a, b, n, first, last in blocks:
        while out and out[-1][1] / out[-1][2] > b / n:
            p = out.pop()
            a, b, n = a + p[0], b + p[1], n + p[2]
            first = last = a / n
        if out and out[-1][1] / out[-1][2] == b / n:
            p = out.pop()
            a, b, n, first = a + p[0], b + p[1], n + p[2], p[3]
        out.append((a, b, n, first, last))
    return out


def isotonic(df: DataFrame, p: str, y: str) -> tuple[list[float], list[float]]:
    """Thresholds and values of a rising step fit, exact. Rows without p or y are left out.

    Rows are summed by probability, adjacent violators pooled within ranges of it in Spark, and the ranges' blocks pooled
    again here. A level that several blocks share has two thresholds, its ends: between them the value is the same.
    """

    def run(frames):
        blocks: list[tuple] = []
        for f in frames:
            blocks = pooled([*blocks, *zip(f["a"], f["b"], f["n"], f["x"], f["x"])])
        yield pd.DataFrame(blocks, columns=["a", "b", "n", "first", "last"]).astype(float)

    rows = df.select(F.col(p).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and not isnan(x) and y is not null")
    sums = rows.groupBy("x").agg(F.sum("y").alias("b"), F.count("*").cast("double").alias("n")).select("x", (F.col("x") * F.col("n")).alias("a"), "b", "n")
    got = sums.repartitionByRange("x").sortWithinPartitions("x").mapInPandas(run, "a double, b double, n double, first double, last double").collect()
    xs, ys = [], []
    for _, b, n, first, last in pooled(sorted((tuple(r) for r in got), key=lambda r: r[3])):
        for x in sorted({first, last}):
            xs.append(x)
            ys.append(b / n)
    return xs, ys


def calibrate_classes(model: Model, df: DataFrame, y: str, alphas: list[float], method: str = "Conformal") -> Model:
    """Fits isotonic steps of the model's probability (for every method), then each alpha's threshold of label sets."""
    if method not in ("Conformal", *METHODS):
        raise ValueError(f"unknown method {method}")
    d = df.where(F.col(y).isNotNull())
    model.isotonic = list(isotonic(d.select(model.probability().alias("p"), F.col(y).alias("y")), "p", "y"))
    d = d.select(model.fold_scores().alias("fs"), F.col(y).alias("y"))
    for a in alphas:
        model.calibration[str(a)] = [label_threshold(d, F.col("fs"), F.col("y"), a, method)]
    model.metadata["calibration"] = method
    return model


def label_sets(model: Model, alpha: float) -> Column:
    return label_set(model.fold_scores(), model.calibration[str(alpha)][0], model.metadata["calibration"])


def isotonic_value(p: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear between thresholds, level outside."""
    fn = F.pandas_udf(lambda s: s.__class__(np.interp(s.to_numpy(), xs, ys)), "double") if xs else None
    return fn(p) if fn else p
