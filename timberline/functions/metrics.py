"""Evaluation metrics: one row each, from aggregates and ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.objectives import LOG
from timberline.functions.primitives import sigmoid
from timberline.operators.binning import order_statistics


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Ranges of scores that curves are ordered in.
RANGES = 64


def _mean(df: DataFrame, value: Column, w, name: str, last=lambda c: c) -> DataFrame:
    w = F.lit(1.0) if w is None else _c(w)
    return df.agg(last(F.sum(value * w) / F.nullif(F.sum(w), F.lit(0.0))).alias(name))


def rmse(df, y, score, w=None):
    return _mean(df, (_c(score) - _c(y)) ** 2, w, "rmse", F.sqrt)


def rmsle(df, y, score, w=None):
    return _mean(df, (F.log1p(_c(score)) - F.log1p(_c(y))) ** 2, w, "rmsle", F.sqrt)


def log_loss(df, y, score, w=None):
    return _mean(df, LOG.loss(_c(y), _c(score)), w, "log_loss")


def brier(df, y, score, w=None):
    return _mean(df, (sigmoid(_c(score)) - _c(y)) ** 2, w, "brier")


def quantile_loss(df, y, score, q=0.5, w=None):
    """The pinball loss, as the objective has it (never negative)."""
    s = _c(y) - _c(score)
    return _mean(df, F.when(s >= 0, q * s).otherwise((q - 1) * s), w, "quantile_loss")


def _ranges(d: DataFrame, s: str) -> Column:
    """The range that a score lies in: ranges are cut at sketched percentiles, whatever the scale, so that an ordered pass is within
    one. Results are the same wherever the cuts lie."""
    at = d.agg(F.percentile_approx(F.col(s).cast("double"), [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    splits = F.lit(sorted({float(x) for x in at if x == x})).cast("array<double>")
    return F.when(F.col(s).isNotNull(), F.size(F.filter(splits, lambda x: x <= F.col(s).cast("double"))))


def auc(df, y, score, w=None):
    """Area under the ROC curve: equal scores are one step. Rows are summed by score; the ordered pass is within ranges of the
    score, offset by the small table of the ranges' sums."""
    k = F.lit(1.0) if w is None else _c(w)
    steps = df.groupBy(_c(score).alias("s")).agg(F.sum(_c(y) * k).alias("pos"), F.sum((1 - _c(y)) * k).alias("neg"))
    steps = steps.withColumn("_b", F.coalesce(_ranges(df.select(_c(score).alias("s")), "s"), F.lit(-1)))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # of RANGES rows
    ranges = steps.groupBy("_b").agg(F.sum("pos").alias("_pos")).select("_b", F.coalesce(F.sum("_pos").over(above), F.lit(0.0)).alias("_above"))
    up = Window.partitionBy("_b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.join(F.broadcast(ranges), "_b").withColumn("tp", F.sum("pos").over(up) + F.col("_above"))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / F.nullif(F.sum("neg") * F.sum("pos"), F.lit(0.0))
    return steps.agg(area.alias("auc"))


def ndcg(df, group, y, score, row_id, k=None, burges=True):
    """Mean over groups of gain at the first k by score over that by relevance; 0 where the ideal is 0."""
    gain = F.pow(F.lit(2.0), _c(y)) - 1 if burges else _c(y)
    ranked = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(F.desc(c), row_id))
    d = df.select(group, gain.alias("gain"), ranked(score).alias("r"), ranked(y).alias("i"))
    dcg = lambda r: F.sum(F.when(F.lit(True) if k is None else F.col(r) <= k, F.col("gain") / F.log2(F.col(r) + 1)).otherwise(0.0))
    per = d.groupBy(group).agg(dcg("r").alias("dcg"), dcg("i").alias("ideal"))
    return per.agg(F.avg(F.when(F.col("ideal") > 0, F.col("dcg") / F.nullif("ideal", F.lit(0.0))).otherwise(0.0)).alias("ndcg"))


def uplift_curve(df, y, w, score, row_id, qini=False):
    """Points of the cumulative gain or Qini curve by descending score.

    Sums of score ranges come first, so the ordered pass is within a range, offset by the small table of range sums.
    Ranges are cut at sketched percentiles of the score, whatever its scale; the result is the same wherever they lie.
    """
    d = df.select(_c(y).cast("double").alias("y"), _c(w).cast("double").alias("w"), _c(score).alias("s"), _c(row_id).alias("row_id"))
    d = d.withColumn("_b", _ranges(d, "s"))
    sums = {"nt": F.col("w"), "nc": 1 - F.col("w"), "yt": F.col("y") * F.col("w"), "yc": F.col("y") * (1 - F.col("w")), "n": F.lit(1.0)}
    ranges = d.groupBy("_b").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    before = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_b", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0.0)).alias(f"_{k}") for k in sums])
    within = Window.partitionBy("_b").orderBy(F.desc("s"), "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.join(F.broadcast(ranges), "_b").select("row_id", *[(F.sum(v).over(within) + F.col(f"_{k}")).alias(k) for k, v in sums.items()])
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(b, F.lit(0.0))).otherwise(0.0)
    if qini:
        value = F.col("yt") - over("yc", "nc") * F.col("nt")
    else:
        value = (over("yt", "nt") - over("yc", "nc")) * F.col("n")
    return d.select("row_id", F.col("n").cast("long").alias("place"), value.alias("value"))


def auuc(df, y, w, score, row_id, normalize=True):
    """Area under the gain curve over the share of rows, less half the average effect where normalised."""
    total = df.agg(F.count("*").alias("n"), (F.avg(F.when(_c(w) == 1, _c(y))) - F.avg(F.when(_c(w) == 0, _c(y)))).alias("ate"))
    curve = uplift_curve(df, y, w, score, row_id).crossJoin(F.broadcast(total))  # one row
    step = (F.col("value") / F.col("n")) * F.when(F.col("place") == F.col("n"), 0.5).otherwise(1.0) / F.col("n")
    area = F.sum(step) - (F.first("ate") / 2 if normalize else 0)
    return curve.agg(area.alias("auuc"))


def qini_coefficient(df, y, w, score, row_id):
    """Area between the Qini curve and its chord, over the share of rows."""
    total = df.agg(F.count("*").alias("n"))
    curve = uplift_curve(df, y, w, score, row_id, qini=True).crossJoin(F.broadcast(total))  # one row
    last = F.max_by("value", "place")
    step = F.col("value") * F.when(F.col("place") == F.col("n"), 0.5).otherwise(1.0) / F.col("n")
    return curve.agg((F.sum(step) - 0.5 * last).alias("qini"))


def calibration_curve(df, y, p, bins=10, strategy="uniform"):
    """(bin, n, mean_y, mean_p) of probabilities in bins of one width, or cut at their quantiles (linear between order
    statistics; a probability on a cut lies above it)."""
    if strategy not in ("uniform", "quantile"):
        raise ValueError(f"unknown strategy {strategy}")
    d = df.select(_c(y).cast("double").alias("y"), _c(p).cast("double").alias("p"))
    if strategy == "uniform":
        b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    else:
        n = d.where("p is not null").count()
        spots = [i / bins * (n - 1) for i in range(1, bins)] if n else []
        low = order_statistics(d, "p", [int(x) + 1 for x in spots], n) if n else []
        high = order_statistics(d, "p", [int(x) + 2 for x in spots], n) if n else []
        cuts = [a + (c - a) * (x - int(x)) for a, c, x in zip(low, high, spots)]
        b = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda x: x <= F.col("p")))
    return d.where("p is not null").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("mean_y"), F.avg("p").alias("mean_p"))


def ece(df, y, p, bins=10, strategy="uniform"):
    curve = calibration_curve(df, y, p, bins, strategy)
    return curve.agg((F.sum(F.col("n") * F.abs(F.col("mean_y") - F.col("mean_p"))) / F.nullif(F.sum("n"), F.lit(0))).alias("ece"))


METRICS = {"rmse": (rmse, False), "rmsle": (rmsle, False), "logloss": (log_loss, False), "brier": (brier, False), "quantile": (quantile_loss, False), "auc": (auc, True), "ndcg": (ndcg, True)}


def parse(name: str) -> tuple[str, int | None]:
    """A metric's name and, of "ndcg@k", its k."""
    short, _, k = name.lower().partition("@")
    short = {"brierloss": "brier", "rootmeansquarederror": "rmse", "rootmeansquaredlogerror": "rmsle", "quantileloss": "quantile"}.get(short, short)
    if short not in METRICS or k and (short != "ndcg" or not k.isdigit() or int(k) < 1):
        raise ValueError(f"unknown metric {name}")
    return short, int(k) if k else None


def evaluate(name: str, df, y, score, w=None, group=None, row_id=None, burges=True, q=0.5):
    """A metric by name; ranking takes a group and a key, and honours k and the gain."""
    short, k = parse(name)
    if short == "ndcg":
        return ndcg(df, group, y, score, row_id, k, burges)
    return quantile_loss(df, y, score, q, w) if short == "quantile" else METRICS[short][0](df, y, score, w)


def is_better(metric: str, new: float | None, old: float | None) -> bool:
    """Whether new beats old; a missing or NaN value never does."""
    if new is None or new != new:
        return False
    return old is None or old != old or (new > old if METRICS[metric][1] else new < old)
