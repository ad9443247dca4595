"""Estimators: categories coded at fit and again at scoring, a model, predictions as columns, a score, one JSON document."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.metrics import ndcg
from timberline.functions.objectives import listnet
from timberline.operators.encode import CROSS_FEATURES, MEAN_ROWS, WIDE, best_pairs, category_map, cross, encode, fold_of, full_means, mean_budget, signal_score, support_threshold, target_means, wants_mean
from timberline.operators.multi import MultiModel, class_weights, fit_classes, fit_multi, fit_shared
from timberline.operators.trainer import Config, fit
from timberline.operators.tree import Model
from timberline.sources.tables import FeatureSpec, classes_of, cut_lineage


@dataclass
class Coder:
    """Numeric features; for each categorical one and each cross of two, its codes; and target means of some of these.

    Codes and means are at most ``max_cat`` rows a feature (64 a cross), joined as small tables. Crosses and means need a
    numeric target: means are out of fold in the rows that a model learns from (``fit_transform``), whole at scoring.
    """

    numeric: list[str]
    maps: dict[str, dict] = field(default_factory=dict)
    crosses: dict[str, list[str]] = field(default_factory=dict)
    means: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, features: list[str], categorical: list[str] | str = "auto", max_cat: int = 1000, y: str | None = None, binary: bool = False) -> Coder:
        spec = FeatureSpec.of(df, features, categorical)
        out = cls(spec.numeric)
        for c in spec.categorical:
            out._map(df, c, max_cat)
        if y is None or not spec.categorical:
            return out
        kinds = {c: m["how"] for c, m in out.maps.items()}
        signals = {c: _signal(df, c, y, how) for c, how in kinds.items()}
        for a, b in best_pairs(kinds, signals) if len(features) <= CROSS_FEATURES else []:
            name = f"{a}__x__{b}"
            pair = df.select(F.col(y), _crossed(a, b).alias(name))
            how = category_map(pair, name, min(max_cat, 64))
            if how[1]["rows"] < MEAN_ROWS or how[1]["categories"] < 2:
                continue
            out.crosses[name] = [a, b]
            out._map(pair, name, min(max_cat, 64), how)
            signals[name] = _signal(pair, name, y, how[1])
        chosen = [c for c, m in out.maps.items() if wants_mean(m["how"])]
        if binary and len(features) >= WIDE:
            chosen = sorted(chosen, key=lambda c: (-signals[c], c))[: mean_budget(len(features))]
        if chosen:
            coded = out._codes(df)
            for c in chosen:
                how = out.maps[c]["how"]
                smooth = max(1.0, support_threshold(how["categories"], how["rows"]))
                rows = full_means(coded.select(F.coalesce(c, F.lit(0)).alias("bucket"), y), "bucket", y, smooth).collect()
                prior = coded.agg(F.avg(F.col(y).cast("double"))).first()[0]
                out.means[f"{c}__target_mean"] = {"of": c, "smooth": smooth, "prior": prior, "means": [[r["bucket"], r["target_mean"]] for r in rows]}
        return out

    def _map(self, df: DataFrame, c: str, max_cat: int, made: tuple[DataFrame, dict] | None = None) -> None:
        codes, how = made or category_map(df, c, max_cat)
        self.maps[c] = {"codes": [[r["category"], r["code"]] for r in codes.collect()], "how": how}

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.maps, *self.means]

    def _codes(self, df: DataFrame) -> DataFrame:
        FeatureSpec(self.numeric, [c for c in self.maps if c not in self.crosses]).check(df)
        df = df.withColumns({name: _crossed(a, b) for name, (a, b) in self.crosses.items()}) if self.crosses else df
        for c, m in self.maps.items():
            df = encode(df, c, df.sparkSession.createDataFrame([tuple(r) for r in m["codes"]], "category string, code int"), m["how"], c)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """df with categories as codes, and crosses and means beside them; the rest of its columns stay."""
        df = self._codes(df)
        for name, m in self.means.items():
            small = df.sparkSession.createDataFrame([tuple(r) for r in m["means"]], f"_bucket int, `{name}` double")
            df = df.withColumn("_bucket", F.coalesce(m["of"], F.lit(0))).join(small, "_bucket", "left").drop("_bucket")
            df = df.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(m["prior"])))
        return df

    def fit_transform(self, df: DataFrame, y: str, row_id: str) -> DataFrame:
        """As transform, with the mean of the other folds in place of the whole: a row's own target has no part in it."""
        df = self._codes(df)
        for name, m in self.means.items():
            d = df.withColumns({"_bucket": F.coalesce(m["of"], F.lit(0)), "_mean_fold": fold_of(F.col(row_id))})
            df = target_means(d, "_bucket", y, "_mean_fold", m["smooth"], name).drop("_bucket", "_mean_fold").withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(m["prior"])))
        return df


def _crossed(a: str, b: str) -> Column:
    known = lambda c: F.when(F.col(c).cast("string") != "nan", F.col(c).cast("string"))
    return cross(known(a), known(b))


def _signal(df: DataFrame, c: str, y: str, how: dict) -> float:
    return signal_score(df, c, y, support_threshold(how["categories"], how["rows"])).first()[0] or 0.0


@dataclass
class _Estimator:
    features: list[str]
    config: Config = field(default_factory=Config)
    categorical: list[str] | str = "auto"
    row_id: str = "row_id"
    max_cat: int = 1000
    coder: Coder | None = None
    model: Model | None = None

    def _coded(self, df: DataFrame, y: str, target: str | None = None) -> tuple[DataFrame, Config]:
        """Rows with a target, coded; the parameters with the categories named. A numeric ``target`` allows crosses and means."""
        df = df.where(F.col(y).isNotNull())
        self.coder = Coder.of(df, self.features, self.categorical, self.max_cat, target, binary=target not in (None, y))
        coded = self.coder.fit_transform(df, target, self.row_id) if target else self.coder.transform(df)
        return coded, replace(self.config, categorical=list(self.coder.maps))

    def get_params(self) -> dict:
        return asdict(self.config) | {"features": self.features, "categorical": self.categorical, "row_id": self.row_id, "max_cat": self.max_cat}

    def set_params(self, **values):
        own = {k: v for k, v in values.items() if k in ("features", "row_id", "max_cat")}
        for k, v in own.items():
            setattr(self, k, v)
        self.config = replace(self.config, **{k: v for k, v in values.items() if k not in own})
        return self

    def score_column(self, df: DataFrame, out: str = "score") -> DataFrame:
        return self.coder.transform(df).withColumn(out, self.model.raw_score())

    def to_json(self) -> str:
        return json.dumps({"coder": asdict(self.coder), "model": json.loads(self.model.to_json())})

    def load(self, text: str):
        d = json.loads(text)
        self.coder, self.model = Coder(**d["coder"]), Model.from_json(json.dumps(d["model"]))
        return self


@dataclass
class Regressor(_Estimator):
    config: Config = field(default_factory=lambda: Config("SquaredLoss"))

    def fit(self, df: DataFrame, y: str) -> Regressor:
        d, cfg = self._coded(df, y, y)
        self.model = fit(d, self.coder.names, y, cfg, self.row_id)
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.score_column(df, out)

    def score(self, df: DataFrame, y: str) -> float:
        """R squared."""
        return self.predict(df, "_p").agg(1 - F.sum((F.col(y) - F.col("_p")) ** 2) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).first()[0]


@dataclass
class Classifier(_Estimator):
    """Two classes: one model, of probability the mean of its folds' sigmoids. More: shared trees, or one model against the rest
    each, as ``shared`` says or, left open, as suits the table's shape."""

    balanced: bool = True
    shared: bool | None = None
    classes: list = field(default_factory=list)
    multi: MultiModel | None = None

    def fit(self, df: DataFrame, y: str) -> Classifier:
        self.classes = classes_of(df, y)
        if len(self.classes) < 2:
            raise ValueError("a classifier needs two classes")
        two = len(self.classes) == 2
        d, cfg = self._coded(df.withColumn("_one", (F.col(y) == self.classes[1]).cast("double")) if two else df, y, "_one" if two else None)
        if not two:
            self.multi = (fit_multi if self.shared is None else fit_shared if self.shared else fit_classes)(d, self.coder.names, y, cfg, self.row_id)
            return self
        if self.balanced and cfg.weight is None and cfg.objective == "LogLoss":
            of = {r["label"]: r["weight"] for r in class_weights(df.where(F.col(y).isNotNull()), y).collect()}
            d, cfg = d.withColumn("_balance", F.when(F.col("_one") > 0, of[self.classes[1]]).otherwise(of[self.classes[0]])), replace(cfg, weight="_balance")
        self.model = fit(d, self.coder.names, "_one", cfg, self.row_id)
        return self

    def probabilities(self) -> Column:
        """An array in order of classes."""
        if self.multi:
            return self.multi.probabilities()
        p = self.model.probability()
        return F.array(1 - p, p)

    def predict(self, df: DataFrame, out: str = "prediction", probability: str = "probabilities") -> DataFrame:
        d = self.coder.transform(df).withColumn(probability, self.probabilities())
        if self.multi:
            return d.withColumn(out, self.multi.predict())
        return d.withColumn(out, F.when(F.get(probability, 1) > 0.5, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))

    def log_probabilities(self) -> Column:
        return F.transform(self.probabilities(), lambda p: F.ln(F.greatest(p, F.lit(1e-300))))

    def score(self, df: DataFrame, y: str) -> float:
        """The share of rows whose class is found."""
        return self.predict(df, "_p").agg(F.avg((F.col("_p") == F.col(y)).cast("int"))).first()[0]

    def to_json(self) -> str:
        several = None if self.multi is None else {"classes": self.multi.classes, "priors": self.multi.priors, "shared": self.multi.shared, "models": [json.loads(m.to_json()) for m in self.multi.models]}
        return json.dumps({"coder": asdict(self.coder), "classes": self.classes, "multi": several, "model": None if self.model is None else json.loads(self.model.to_json())})

    def load(self, text: str) -> Classifier:
        d = json.loads(text)
        again = lambda m: Model.from_json(json.dumps(m))
        self.coder, self.classes, m = Coder(**d["coder"]), d["classes"], d["multi"]
        self.model = None if d["model"] is None else again(d["model"])
        self.multi = None if m is None else MultiModel(m["classes"], [again(x) for x in m["models"]], m["priors"], m["shared"])
        return self


@dataclass
class Ranker(_Estimator):
    """List-wise softmax over groups. A round shuffles rows by group once and is written, so that its histograms do not."""

    def fit(self, df: DataFrame, y: str, group: str) -> Ranker:
        if group not in df.columns:
            raise ValueError("ranking needs groups")
        d, cfg = self._coded(df, y)
        names = self.coder.names
        start = Model(list(names), "ListNetLoss", 0.0, 10.0**-cfg.budget)
        self.model = fit(d, names, y, cfg, self.row_id, frame=lambda rows: cut_lineage(listnet(rows, group, y, "_score", cfg.weight), "lists"), start=start)
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.score_column(df, out)

    def score(self, df: DataFrame, y: str, group: str, k: int | None = None) -> float:
        return ndcg(self.predict(df, "_p"), group, y, "_p", self.row_id, k).first()[0]


