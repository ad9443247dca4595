"""Causal estimators: pipelines of fits, scores and residual columns on one frame; no joins."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.objectives import LOG, policy, policy_target, residual_effect, with_fairness
from timberline.functions.primitives import sigmoid
from timberline.operators.trainer import Config, fit
from timberline.operators.tree import Model
from timberline.sources.tables import cut_lineage

REGRESSION, BINARY = Config("SquaredLoss"), Config("LogLoss")


def check_treatment(df: DataFrame, w: str) -> None:
    if not df.where(F.col(w).isNull() | ~F.col(w).isin(0, 1)).isEmpty():
        raise ValueError("a treatment is 0 or 1")


def clipped(p: Column, clip: float) -> Column:
    return F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))


def s_models(df: DataFrame, x: list[str], w: str, y: str, cfg: Config = REGRESSION) -> dict[str, Model]:
    """One model with the treatment as a feature."""
    check_treatment(df, w)
    return {"outcome": fit(df.withColumn("_w", F.col(w).cast("double")), [*x, "_w"], y, cfg)}


def s_learner(df: DataFrame, x: list[str], w: str, y: str, cfg: Config = REGRESSION) -> Column:
    """Effect of treatment by one model: score at 1 less score at 0."""
    return effect_of("S", s_models(df, x, w, y, cfg))


def _with(m: Model, column: str, value: float) -> Column:
    """The model's score with a column set to a value: its name gives way to a literal in the routing expression."""
    out = F.lit(float(m.base_score))
    for tree in m.trees:

        def at(i: int, tree=tree) -> Column:
            n = tree[i]
            if n.is_leaf:
                return F.lit(float(n.weight))
            if m.features[n.feature] == column:
                return at(n.left if value < n.value else n.right)
            return m.choose(n, at)

        out = out + at(0)
    return out


def t_models(df: DataFrame, x: list[str], w: str, y: str, cfg: Config = REGRESSION) -> dict[str, Model]:
    """A model of each arm."""
    check_treatment(df, w)
    return {f"arm{k}": fit(df.where(F.col(w) == k), x, y, replace(cfg, seed=cfg.seed + k)) for k in (1, 0)}


def t_learner(df: DataFrame, x: list[str], w: str, y: str, cfg: Config = REGRESSION) -> Column:
    return effect_of("T", t_models(df, x, w, y, cfg))


def x_models(df: DataFrame, x: list[str], w: str, y: str, cfg: Config = REGRESSION, propensity: Config = BINARY) -> dict[str, Model]:
    """Models of arms and of the propensity, and of each arm's effects imputed by the other's model."""
    out = t_models(df, x, w, y, cfg) | {"propensity": fit(df, x, w, propensity)}
    out["effect1"] = fit(df.where(F.col(w) == 1).withColumn("_d", F.col(y) - out["arm0"].raw_score()), x, "_d", cfg)
    out["effect0"] = fit(df.where(F.col(w) == 0).withColumn("_d", out["arm1"].raw_score() - F.col(y)), x, "_d", cfg)
    return out


def x_learner(df: DataFrame, x: list[str], w: str, y: str, cfg: Config = REGRESSION, propensity: Config = BINARY) -> Column:
    """Imputed effects mixed by the propensity: p tau0 + (1 - p) tau1."""
    return effect_of("X", x_models(df, x, w, y, cfg, propensity))


def dr_models(df: DataFrame, x: list[str], w: str, y: str, cfg: Config = REGRESSION, propensity: Config = BINARY, clip: float = 1e-3) -> dict[str, Model]:
    """Models of arms and of the propensity, and one of the doubly robust pseudo-outcome."""
    out = t_models(df, x, w, y, cfg) | {"propensity": fit(df, x, w, propensity)}
    gamma = policy_target(F.col(y), F.col(w), sigmoid(out["propensity"].raw_score()), out["arm1"].raw_score(), out["arm0"].raw_score(), clip)
    return out | {"effect": fit(df.withColumn("_d", gamma), x, "_d", cfg)}


def dr_learner(df: DataFrame, x: list[str], w: str, y: str, cfg: Config = REGRESSION, propensity: Config = BINARY, clip: float = 1e-3) -> Column:
    return effect_of("DR", dr_models(df, x, w, y, cfg, propensity, clip))


def effect_of(kind: str, models: dict[str, Model]) -> Column:
    """A row's effect of treatment by the models of one of the learners."""
    if kind == "S":
        return _with(models["outcome"], "_w", 1.0) - _with(models["outcome"], "_w", 0.0)
    if kind == "T":
        return models["arm1"].raw_score() - models["arm0"].raw_score()
    if kind == "X":
        p = sigmoid(models["propensity"].raw_score())
        return p * models["effect0"].raw_score() + (1 - p) * models["effect1"].raw_score()
    return models["effect"].raw_score()


def r_learner(df: DataFrame, x: list[str], w: str, y: str, cfg: Config = REGRESSION, propensity: Config = BINARY) -> Model:
    """Uplift: outcome and propensity models, then effects on their residuals."""
    check_treatment(df, w)
    p = clipped(sigmoid(fit(df, x, w, propensity).raw_score()), 1e-6)
    res = df.withColumn("_yr", F.col(y) - fit(df, x, y, cfg).raw_score()).withColumn("_wr", F.col(w) - p)
    return _effect(cut_lineage(res, "residuals"), x, cfg)


def _effect(res: DataFrame, x: list[str], cfg: Config) -> Model:
    start = res.agg(F.sum(F.col("_yr") * F.col("_wr")) / F.nullif(F.sum(F.col("_wr") ** 2), F.lit(0.0))).first()[0] or 0.0
    own = lambda _y, s, _w: residual_effect(F.col("_yr"), F.col("_wr"), s)
    return fit(res, x, "_yr", cfg, columns=own, start=Model(list(x), "RLearner", float(start), 10.0**-cfg.budget))


def iv(df: DataFrame, x: list[str], z: list[str], w: str, y: str, cfg: Config = REGRESSION) -> tuple[Model, Model]:
    """Two stages by control function: the treatment from features and instruments, the outcome from features, its fit and residual."""
    first = fit(df, [*x, *z], w, cfg)
    two = df.withColumn("_wh", first.raw_score()).withColumn("_wr", F.col(w) - F.col("_wh"))
    return first, fit(cut_lineage(two, "iv"), [*x, "_wh", "_wr"], y, cfg)


def iv_at(df: DataFrame, second: Model, value: float) -> DataFrame:
    """df with outcome, the second stage at a treatment and no residual."""
    return df.withColumn("_wh", F.lit(float(value))).withColumn("_wr", F.lit(0.0)).withColumn("outcome", second.raw_score()).drop("_wh", "_wr")


def dml(df: DataFrame, x: list[str], w: str, y: str, cfg: Config = REGRESSION, folds: int = 2, clip: float = 0.01, row_id: str = "row_id") -> tuple[Model, dict[str, float]]:
    """Cross-fitted residuals, an effect model on them, and the average effect with its standard error and 95 % interval.

    se_reference is the spread of estimated effects over root n; se is that of the influence function.
    """
    k = F.pmod(F.xxhash64(row_id), F.lit(folds))
    yh, wh = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i in range(folds):
        rest = df.where(k != i)
        yh = F.when(k == i, fit(rest, x, y, cfg).raw_score()).otherwise(yh)
        wh = F.when(k == i, fit(rest, x, w, cfg).raw_score()).otherwise(wh)
    bound = 1 / clip
    res = df.withColumn("_yr", F.greatest(F.least(F.col(y) - yh, F.lit(bound)), F.lit(-bound))).withColumn("_wr", F.col(w) - wh)
    res = cut_lineage(res, "dml")
    m = _effect(res, x, cfg)
    theta = m.raw_score()
    r = res.select(theta.alias("t"), "_yr", "_wr").agg(F.avg("t").alias("ate"), F.stddev_pop("t").alias("sd"), F.count("*").alias("n"), F.avg(F.col("_wr") ** 2).alias("j"), F.avg(((F.col("_yr") - F.col("t") * F.col("_wr")) * F.col("_wr")) ** 2).alias("v")).first()
    n = max(1, r["n"])
    se = (r["v"] / n) ** 0.5 / r["j"] if r["j"] else 0.0
    return m, {"ate": r["ate"], "se": se, "se_reference": r["sd"] / n**0.5, "low": r["ate"] - 1.96 * se, "high": r["ate"] + 1.96 * se}


def policy_learner(df: DataFrame, x: list[str], w: str, y: str, cfg: Config = BINARY, doubly_robust: bool = False, propensity: Config = BINARY, outcome: Config = REGRESSION) -> Model:
    """Whom to treat: a positive score. Propensity and, for the doubly robust form, outcome models are fitted first."""
    check_treatment(df, w)
    p = sigmoid(fit(df, x, w, propensity).raw_score())
    mu = [fit(df.where(F.col(w) == k), x, y, outcome).raw_score() if doubly_robust else None for k in (1, 0)]
    d = cut_lineage(df.withColumn("_gamma", policy_target(F.col(y), F.col(w), p, *mu)), "policy")
    return fit(d, x, "_gamma", cfg, columns=lambda _y, s, _w: policy(F.col("_gamma"), s), start=Model(list(x), "Policy", 0.0, 10.0**-cfg.budget))


def fairness_gap(df: DataFrame, y: str, score: str, sensitive: str, strength: float = 1.0, equal_odds: bool = False) -> DataFrame:
    return with_fairness(df, y, score, sensitive, strength, equal_odds)


def fair_classifier(df: DataFrame, x: list[str], y: str, sensitive: str, cfg: Config = BINARY, strength: float = 1.0, equal_odds: bool = False) -> Model:
    """Log loss with a penalty on the gap of mean probability between groups (within labels, for equal odds).

    The gaps are one small aggregate a round and enter the round's gradients as literals. Probabilities are sigmoids of
    the score.
    """
    s = F.when(F.col(sensitive) == 1, 1).otherwise(0)
    label = F.when(F.col(y) > 0.5, 1).otherwise(0) if equal_odds else F.lit(0)

    def penalised(d: DataFrame) -> DataFrame:
        p = sigmoid(F.col("_score"))
        c = LOG.columns(F.col(y).cast("double"), F.col("_score"))
        loss, gradient = c["loss"], c["gradient"]
        of = {(r["k"], r["s"]): (r["p"], r["n"]) for r in d.groupBy(label.alias("k"), s.alias("s")).agg(F.avg(p).alias("p"), F.count("*").alias("n")).collect()}
        for k in {k for k, g in of if (k, 1 - g) in of}:
            (up, n1), (down, n0) = of[k, 1], of[k, 0]
            push = F.when(label == k, F.when(s == 1, 1 / n1).otherwise(-1 / n0)).otherwise(0.0)
            gradient = gradient + 2 * strength * (up - down) * push * p * (1 - p) * (n1 + n0)
            loss = loss + F.when(label == k, strength * (up - down) ** 2).otherwise(0.0)
        return d.withColumns({"loss": loss, "gradient": gradient, "hessian": c["hessian"]})

    return fit(df, x, y, cfg, frame=penalised, start=Model(list(x), "LogLoss", 0.0, 10.0**-cfg.budget))


KINDS = ("S", "T", "X", "DR", "R", "DML", "IV", "Policy", "Fair")


@dataclass
class Effect:
    """Causal estimators under one roof: fitted once, kept as JSON, replayed as a column on any frame with the features.

    kind: learners of a treatment's effect ("S", "T", "X", "DR", "R", "DML"), an instrument's two stages ("IV"), a policy
    ("Policy", whom to treat), or a classifier under a fairness penalty ("Fair", where ``treatment`` names the sensitive column).
    options go to the learner: clip, folds, doubly_robust, strength, equal_odds.
    """

    kind: str
    features: list[str]
    treatment: str
    config: Config = field(default_factory=lambda: Config("SquaredLoss"))
    nuisance: Config = field(default_factory=lambda: Config("LogLoss"))
    instruments: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    models: dict[str, Model] = field(default_factory=dict)
    average: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")
        if self.kind == "IV" and not self.instruments:
            raise ValueError("two stages need an instrument")

    def fit(self, df: DataFrame, y: str) -> Effect:
        x, w, cfg, own = self.features, self.treatment, self.config, self.options
        if self.kind in ("S", "T"):
            self.models = {"S": s_models, "T": t_models}[self.kind](df, x, w, y, cfg)
        elif self.kind in ("X", "DR"):
            self.models = {"X": x_models, "DR": dr_models}[self.kind](df, x, w, y, cfg, self.nuisance, **own)
        elif self.kind == "R":
            self.models = {"effect": r_learner(df, x, w, y, cfg, self.nuisance)}
        elif self.kind == "DML":
            effect, self.average = dml(df, x, w, y, cfg, **own)
            self.models = {"effect": effect}
        elif self.kind == "IV":
            self.models = dict(zip(("first", "second"), iv(df, x, self.instruments, w, y, cfg)))
        elif self.kind == "Policy":
            self.models = {"effect": policy_learner(df, x, w, y, self.nuisance, propensity=self.nuisance, outcome=cfg, **own)}
        else:
            self.models = {"effect": fair_classifier(df, x, y, w, self.nuisance, **own)}
        return self

    def predict(self, df: DataFrame, out: str = "effect", at: float | None = None) -> DataFrame:
        """Adds the effect; for IV the outcome at a treatment (or its difference between 1 and 0), for a policy 1 where
        treating pays, for the fair classifier a probability."""
        if not self.models:
            raise ValueError("not fitted")
        if self.kind == "IV":
            second = self.models["second"]
            if at is not None:
                return iv_at(df, second, at).withColumnRenamed("outcome", out)
            untreated = iv_at(df, second, 0.0).withColumnRenamed("outcome", "_untreated")
            return iv_at(untreated, second, 1.0).withColumn(out, F.col("outcome") - F.col("_untreated")).drop("outcome", "_untreated")
        if self.kind == "Policy":
            return df.withColumn(out, (self.models["effect"].raw_score() > 0).cast("int"))
        if self.kind == "Fair":
            return df.withColumn(out, sigmoid(self.models["effect"].raw_score()))
        return df.withColumn(out, effect_of(self.kind, self.models))

    def to_json(self) -> str:
        plain = {"kind": self.kind, "features": self.features, "treatment": self.treatment, "instruments": self.instruments, "options": self.options, "average": self.average}
        return json.dumps(plain | {"models": {k: json.loads(m.to_json()) for k, m in self.models.items()}})

    @classmethod
    def from_json(cls, text: str) -> Effect:
        d = json.loads(text)
        models = {k: Model.from_json(json.dumps(m)) for k, m in d.pop("models").items()}
        return cls(**d, models=models)
