"""Objectives: loss, gradient and hessian of a row as columns, and the initial score as one aggregate.

An objective's per-row values are multiplied by the weight unless it has formulas of its own for weighted rows. Group
softmaxes of rankings are columns that a plan adds first; the adaptive Huber loss takes an order statistic once a round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.primitives import sigmoid
from timberline.operators.binning import order_statistics, weighted_percentiles

Row = Callable[[Column, Column], Column]
EDGE = 1e-15


@dataclass(frozen=True)
class Objective:
    """initial: an aggregate of target and weight, or the share of weight whose quantile a fit starts from. weighted: columns
    of target, score and weight, where these aren't the plain ones times the weight. adapt: the objective as rows and scores
    make it, taken anew each round."""

    name: str
    loss: Row
    gradient: Row
    hessian: Row
    initial: Callable[[Column, Column], Column] | float
    metric: str = "rmse"
    weighs_hessian: bool = True
    weighted: Callable[[Column, Column, Column], dict[str, Column]] | None = None
    adapt: Callable[[DataFrame, Column, Column], Objective] | None = None

    def columns(self, y: Column, score: Column, w: Column | None = None) -> dict[str, Column]:
        if w is not None and self.weighted:
            return self.weighted(y, score, w)
        w = F.lit(1.0) if w is None else w
        h = self.hessian(y, score)
        return {"loss": self.loss(y, score) * w, "gradient": self.gradient(y, score) * w, "hessian": h * w if self.weighs_hessian else h}

    def start(self, df: DataFrame, y: Column, w: Column | None = None) -> float | None:
        """The score that a fit starts from; quantiles are exact."""
        d = df.select(y.cast("double").alias("y"), (F.lit(1.0) if w is None else w.cast("double")).alias("w"))
        if isinstance(self.initial, float):
            got = weighted_percentiles(d, ["y"], [self.initial], "w").first()
            return got["value"] if got else None
        return d.agg(self.initial(F.col("y"), F.col("w"))).first()[0]


def _mean(y: Column, w: Column) -> Column:
    return F.sum(y * w) / F.nullif(F.sum(w), F.lit(0.0))


def _log_mean(y: Column, w: Column) -> Column:
    m = _mean(y, w)
    return F.when(m > 0, F.ln(m)).otherwise(0.0)


def _logit_mean(y: Column, w: Column) -> Column:
    """Log odds of the weighted mean; infinite where only one class is there."""
    p = _mean(y, w)
    return F.when(p <= 0, float("-inf")).when(p >= 1, float("inf")).otherwise(F.ln(p / F.nullif(1 - p, F.lit(0.0))))


def _cross(y: Column, f: Column) -> Column:
    p = F.least(F.greatest(sigmoid(f), F.lit(EDGE)), F.lit(1 - EDGE))
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def _p(f: Column) -> Column:
    return sigmoid(f)


def quantile(q: float = 0.5) -> Objective:
    return Objective("QuantileLoss", lambda y, f: F.when(y - f >= 0, q * (y - f)).otherwise((q - 1) * (y - f)), lambda y, f: F.when(f - y >= 0, 1 - q).otherwise(-q), lambda y, f: F.lit(1.0), float(q), "quantile")


def huber(delta: float = 1.0) -> Objective:
    d = lambda y, f: F.abs(f - y)
    return Objective(
        "HuberLoss",
        lambda y, f: F.when(d(y, f) <= delta, 0.5 * (f - y) ** 2).otherwise(delta * (d(y, f) - 0.5 * delta)),
        lambda y, f: F.least(F.greatest(f - y, F.lit(-delta)), F.lit(delta)),
        lambda y, f: F.least(F.greatest(delta / F.greatest(d(y, f), F.lit(delta)), F.lit(0.05)), F.lit(1.0)),
        0.5,
    )


def adaptive_huber_delta(df: DataFrame, y: Column, score: Column, alpha: float = 0.5) -> float:
    """The order statistic of absolute residuals that the adaptive Huber loss uses: place floor(n alpha) mod n. Exact."""
    r = df.select(F.abs(y - score).alias("r")).where("r is not null")
    n = r.count()
    return order_statistics(r, "r", [int(n * alpha) % n + 1], n)[0] if n else 1.0


def adaptive_huber(alpha: float = 0.5) -> Objective:
    """Huber's loss whose delta is, each round, a quantile of the absolute residuals."""
    return replace(huber(), name="AdaptiveHuberLoss", adapt=lambda df, y, score: huber(adaptive_huber_delta(df, y, score, alpha) or 1.0))


# fixed values: rows that a robust delta needs; ratios of residual quantiles under which tails are plain; the least delta
ROBUST_ROWS, TAIL_RATIO, SKEW_RATIO, LEAST_DELTA = 32, 1.35, 2.5, 0.5


def residual_quantiles(df: DataFrame, y: Column, score: Column, shares: list[float]) -> list[float]:
    """Order statistics of absolute residuals at places round((n - 1) share), from 0; none of an empty table. Exact."""
    r = df.select(F.abs(y - score).alias("r")).where("r is not null")
    n = r.count()
    return order_statistics(r, "r", [int((n - 1) * min(max(q, 0.0), 1.0) + 0.5) + 1 for q in shares], n) if n else []


def robust_delta(df: DataFrame, y: Column, score: Column) -> float | None:
    """Where residuals have long tails, the size beyond which squared loss should turn linear; else None."""
    if df.count() < ROBUST_ROWS:
        return None
    got = residual_quantiles(df, y, score, [0.5, 0.75, 0.9, 0.95])
    if not got or got[2] <= 1.2e-7:
        return None
    half, most, tail, last = got
    if last / max(most, 1e-6) < TAIL_RATIO and tail / max(half, 1e-6) < SKEW_RATIO:
        return None
    return max((tail + last) / 2, 2 * most, 2 * half, LEAST_DELTA)


def robust_squared() -> Objective:
    """Squared loss whose gradients are, in rounds whose residuals have long tails, those of Huber's."""
    plain = OBJECTIVES["SquaredLoss"]

    def adapt(df: DataFrame, y: Column, score: Column) -> Objective:
        delta = robust_delta(df, y, score)
        return plain if delta is None else replace(huber(delta), name=plain.name, loss=plain.loss, initial=plain.initial)

    return replace(plain, adapt=adapt)


def fair(c: float = 1.0) -> Objective:
    return Objective("FairLoss", lambda y, f: c * F.abs(f - y) - c * c * F.log1p(F.abs(f - y) / c), lambda y, f: c * (f - y) / (F.abs(f - y) + c), lambda y, f: F.lit(c * c) / (F.abs(f - y) + c) ** 2, _mean)


def tweedie(p: float = 1.5) -> Objective:
    return Objective(
        "TweedieLoss",
        lambda y, f: -y * F.exp((1 - p) * f) / (1 - p) + F.exp((2 - p) * f) / (2 - p),
        lambda y, f: F.exp((2 - p) * f) - y * F.exp((1 - p) * f),
        lambda y, f: (2 - p) * F.exp((2 - p) * f) - (1 - p) * y * F.exp((1 - p) * f),
        _log_mean,
    )


def _lambda(y: Column, f: Column, w: Column) -> dict[str, Column]:
    """Cross entropy of z = 1 - (1 - p)**w: a row of weight w is seen in one of w independent chances. Where z rounds to 0 or 1, the
    plain loss times the weight."""
    ef, p = F.exp(f), sigmoid(f)
    none = F.exp(-w * F.log1p(ef))  # 1 - z
    z = -F.expm1(-w * F.log1p(ef))
    c, odds = 1 / none, z / none
    plain = {"loss": _cross(y, f) * w, "gradient": (p - y) * w, "hessian": p * (1 - p) * w}
    own = {"loss": -(y * F.ln(z) + (1 - y) * F.ln(none)), "gradient": (1 - y / z) * w * p, "hessian": w * ef / (1 + ef) ** 2 * (1 + y * c / odds**2 * (1 + w * ef - c))}
    return {k: F.when((z <= 0) | (none <= 0) | F.isnan(v), plain[k]).otherwise(v) for k, v in own.items()}


def _log_gap(y: Column, f: Column) -> Column:
    return F.log1p(y) - F.log1p(F.greatest(f, F.lit(-1 + 1e-6)))


def _signed(y: Column) -> Column:
    return F.when(y > 0, 1.0).otherwise(-1.0)


LOG = Objective("LogLoss", _cross, lambda y, f: _p(f) - y, lambda y, f: _p(f) * (1 - _p(f)), _logit_mean, "logloss")
OBJECTIVES: dict[str, Objective] = {
    o.name: o
    for o in (
        LOG,
        Objective("BrierLoss", lambda y, f: (y - _p(f)) ** 2, lambda y, f: 2 * (_p(f) - y) * _p(f) * (1 - _p(f)), lambda y, f: 2 * _p(f) * (1 - _p(f)) * (_p(f) * (1 - _p(f)) + (_p(f) - y) * (1 - 2 * _p(f))), _logit_mean, "brier"),
        Objective("SquaredLoss", lambda y, f: (f - y) ** 2, lambda y, f: f - y, lambda y, f: F.lit(1.0), _mean),
        quantile(),
        huber(),
        adaptive_huber(),
        Objective("AbsoluteLoss", lambda y, f: F.abs(f - y), lambda y, f: F.signum(f - y), lambda y, f: F.lit(1.0), 0.5),
        Objective("MapeLoss", lambda y, f: F.abs(f - y) / F.greatest(F.abs(y), F.lit(1e-4)), lambda y, f: F.signum(f - y) / F.greatest(F.abs(y), F.lit(1e-4)), lambda y, f: F.lit(1.0), _mean, weighs_hessian=False),
        fair(),
        Objective("PoissonLoss", lambda y, f: F.exp(f) - y * f, lambda y, f: F.exp(f) - y, lambda y, f: F.exp(f), _log_mean),
        Objective("GammaLoss", lambda y, f: y * F.exp(-f) + f, lambda y, f: 1 - y * F.exp(-f), lambda y, f: y * F.exp(-f), _log_mean),
        tweedie(),
        Objective("SquaredLogLoss", lambda y, f: 0.5 * _log_gap(y, f) ** 2, lambda y, f: -_log_gap(y, f) / (1 + F.greatest(f, F.lit(-1 + 1e-6))), lambda y, f: (1 + _log_gap(y, f)) / (1 + F.greatest(f, F.lit(-1 + 1e-6))) ** 2, lambda y, w: F.exp(_mean(F.log1p(y), w)) - 1, "rmsle"),
        Objective("CrossEntropyLoss", _cross, LOG.gradient, LOG.hessian, _logit_mean, "logloss"),
        Objective("CrossEntropyLambdaLoss", _cross, LOG.gradient, LOG.hessian, _logit_mean, "logloss", weighted=_lambda),
        Objective("HingeLoss", lambda y, f: F.greatest(F.lit(0.0), 1 - _signed(y) * f), lambda y, f: F.when(_signed(y) * f < 1, -_signed(y)).otherwise(0.0), lambda y, f: F.lit(1e-6), lambda y, w: F.signum(F.sum(_signed(y) * w)), "logloss"),
    )
}


def objective(name: str, **parameters) -> Objective:
    """By name; parameters go to the families (q, delta, alpha, c, p)."""
    families = {"QuantileLoss": quantile, "HuberLoss": huber, "AdaptiveHuberLoss": adaptive_huber, "FairLoss": fair, "TweedieLoss": tweedie}
    if name in families and parameters:
        return families[name](**parameters)
    if name not in OBJECTIVES:
        raise ValueError(f"unknown objective {name}")
    return OBJECTIVES[name]


def listnet(df: DataFrame, group: str, y: str, score: str, weight: str | None = None) -> DataFrame:
    """Adds loss, gradient and hessian of list-wise softmax cross-entropy; a group's loss is spread over its rows."""
    w = Window.partitionBy(group)
    for c, out in ((y, "_q"), (score, "_s")):
        df = df.withColumn(out, F.exp(F.col(c) - F.max(c).over(w)))
        df = df.withColumn(out, F.col(out) / F.sum(out).over(w))
    k = F.lit(1.0) if weight is None else F.col(weight)
    df = df.withColumn("loss", -F.sum(F.col("_q") * F.ln(F.greatest(F.col("_s"), F.lit(EDGE)))).over(w) / F.count("*").over(w) * k)
    return df.withColumn("gradient", (F.col("_s") - F.col("_q")) * k).withColumn("hessian", F.col("_s") * (1 - F.col("_s")) * k).drop("_q", "_s")


def residual_effect(y_res: Column, w_res: Column, tau: Column) -> dict[str, Column]:
    """The R-learner's and double machine learning's objective on residuals."""
    return {"loss": (y_res - tau * w_res) ** 2, "gradient": -w_res * y_res + tau * w_res**2, "hessian": F.greatest(w_res**2, F.lit(1e-6))}


def policy_target(y: Column, w: Column, p: Column, mu1: Column | None = None, mu0: Column | None = None, clip: float = 1e-3) -> Column:
    """Inverse-propensity pseudo-outcome, or the doubly robust one where outcome models are given."""
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    if mu1 is None or mu0 is None:
        return y * w / p - y * (1 - w) / (1 - p)
    return mu1 - mu0 + w * (y - mu1) / p - (1 - w) * (y - mu0) / (1 - p)


def policy(gamma: Column, score: Column) -> dict[str, Column]:
    """Logistic loss on the sign of a pseudo-outcome, weighted by its size."""
    up = F.when(gamma > 0, 1.0).otherwise(0.0)
    return LOG.columns(up, score, F.abs(gamma))


def with_fairness(df: DataFrame, y: str, score: str, sensitive: str, strength: float = 1.0, equal_odds: bool = False) -> DataFrame:
    """Adds loss, gradient and hessian of log loss with a penalty on the squared gap of mean probability between
    ``sensitive = 1`` and the rest (within each label, for equal odds). One small aggregate, joined by its keys."""
    keys = [y] if equal_odds else []
    df = df.withColumn("_p", sigmoid(F.col(score))).withColumn("_s", F.when(F.col(sensitive) == 1, 1).otherwise(0))
    side = lambda s, f: f(F.when(F.col("_s") == s, F.col("_p")))
    gaps = df.groupBy(*keys).agg((side(1, F.avg) - side(0, F.avg)).alias("_gap"), side(1, F.count).alias("_n1"), side(0, F.count).alias("_n0"), F.count("*").alias("_n"))
    df = df.join(gaps, keys) if keys else df.crossJoin(F.broadcast(gaps))  # one row
    gap = F.coalesce("_gap", F.lit(0.0))
    sign = F.when(F.col("_s") == 1, 1 / F.nullif("_n1", F.lit(0))).otherwise(-1 / F.nullif("_n0", F.lit(0)))
    base = LOG.columns(F.col(y), F.col(score))
    out = df.withColumn("loss", base["loss"] + strength * gap**2).withColumn("gradient", base["gradient"] + 2 * strength * gap * sign * F.col("_p") * (1 - F.col("_p")) * F.col("_n")).withColumn("hessian", base["hessian"])
    return out.drop("_p", "_s", "_gap", "_n1", "_n0", "_n")
