"""Trees and ensembles: their tables, routing expressions, vectorised walks, JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.primitives import sigmoid

#: Nodes up to which an ensemble is scored by nested CASE expressions; beyond, by arrays in a pandas UDF.
NATIVE_NODES = 256


@dataclass
class Node:
    id: int
    parent: int
    depth: int
    weight: float
    cover: float
    count: int
    fold_weights: list[float]
    gain: float = 0.0
    generalization: float = 1.0
    feature: int = -1
    value: float = 0.0
    left: int = -1
    right: int = -1
    missing_left: bool = False
    left_cats: list[int] | None = None
    missing: int = -1

    @property
    def is_leaf(self) -> bool:
        return self.left < 0

    @property
    def children(self) -> list[int]:
        """Left, right and, where missing values have a branch of their own, that."""
        return [] if self.is_leaf else [i for i in (self.left, self.right, self.missing) if i >= 0]

    @property
    def gone(self) -> int:
        """Where missing values go."""
        return self.missing if self.missing >= 0 else self.left if self.missing_left else self.right


@dataclass
class Model:
    """An additive ensemble: base score, trees (node 0 is the root), features, objective; metadata, calibration and isotonic steps."""

    features: list[str]
    objective: str
    base_score: float
    eta: float
    trees: list[list[Node]] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    calibration: dict[str, list[float]] = field(default_factory=dict)
    head: dict | None = None
    isotonic: list[list[float]] | None = None

    # sinks and sources

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        return cls(**{**d, "trees": [[Node(**n) for n in t] for t in d["trees"]]})

    def to_bytes(self) -> bytes:
        return self.to_json().encode()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        return cls.from_json(data.decode())

    def put(self, key: str, value: str) -> None:
        self.metadata[key] = value

    def get(self, key: str) -> str:
        if key not in self.metadata:
            raise KeyError(f"no metadata {key}")
        return self.metadata[key]

    def metadata_table(self, spark: SparkSession) -> DataFrame:
        """model_meta: a row a key."""
        return spark.createDataFrame(sorted(self.metadata.items()), "key string, value string")

    def table(self, spark: SparkSession) -> DataFrame:
        """model_nodes: one row a node."""
        rows = [(t, n.id, n.parent, n.is_leaf, None if n.is_leaf else self.features[n.feature], None if n.is_leaf else float(n.value), n.left, n.right, n.gone, n.left_cats, float(n.weight), [float(x) for x in n.fold_weights], float(n.cover), float(n.gain), n.depth, int(n.count), float(n.generalization)) for t, tree in enumerate(self.trees) for n in tree]
        return spark.createDataFrame(rows, "tree_id int, node_id int, parent int, is_leaf boolean, split_feature string, split_value double, left int, right int, missing int, left_cats array<int>, weight double, fold_weights array<double>, cover double, gain double, depth int, count bigint, generalization double")

    def text(self) -> str:
        out = []
        for t, tree in enumerate(self.trees):
            out.append(f"tree {t}")
            todo = [0]
            while todo:
                n = tree[todo.pop()]
                pad = "  " * n.depth
                if n.is_leaf:
                    out.append(f"{pad}{n.id}: leaf={n.weight:.6g}, cover={n.cover:.6g}")
                else:
                    ask = f"in {n.left_cats}" if n.left_cats is not None else f"< {n.value:.6g}"
                    out.append(f"{pad}{n.id}: [{self.features[n.feature]} {ask}] yes={n.left}, no={n.right}, missing={n.gone}, gain={n.gain:.6g}, cover={n.cover:.6g}")
                    todo += n.children[::-1]
        return "\n".join(out)

    # routing

    def choose(self, n: Node, at) -> Column:
        """at(child) of the child that a row goes to."""
        v = F.col(self.features[n.feature])
        ask = v.cast("int").isin(n.left_cats or [-1]) if n.left_cats is not None else v < n.value
        gone = v.isNull() | F.isnan(v.cast("double"))
        if n.missing >= 0:
            return F.when(gone, at(n.missing)).when(ask, at(n.left)).otherwise(at(n.right))
        return F.when(F.when(gone, n.missing_left).otherwise(ask), at(n.left)).otherwise(at(n.right))

    def route(self, tree: list[Node], leaf) -> Column:
        """The leaf a row reaches, as nested CASE; leaf(node) gives its value."""

        def at(i: int) -> Column:
            n = tree[i]
            return leaf(n) if n.is_leaf else self.choose(n, at)

        return at(0)

    def raw_score(self) -> Column:
        """base + sum of leaf weights + the linear head, where there is one."""
        if sum(map(len, self.trees)) <= NATIVE_NODES:
            out = F.lit(float(self.base_score))
            for t in self.trees:
                out = out + self.route(t, lambda n: F.lit(float(n.weight)))
        else:
            out = self._udf(lambda x: self.base_score + self.leaf_sums(x)[:, 0], "double")
        if not self.head:
            return out
        h = self.head
        out = out + h["blend"] * h["intercept"]
        for f, m, s, c in zip(self.features, h["means"], h["scales"], h["coefficients"]):
            v = F.col(f).cast("double")
            out = out + F.when(v.isNull() | F.isnan(v), 0.0).otherwise(h["blend"] * c * (v - m) / s)
        return out

    def head_terms(self, x: np.ndarray) -> np.ndarray:
        """What the linear head adds for each feature, and its constant."""
        out = np.zeros((len(x), len(self.features) + 1))
        if self.head:
            h = self.head
            out[:, :-1] = np.nan_to_num((x - np.array(h["means"])) / np.array(h["scales"])) * h["coefficients"] * h["blend"]
            out[:, -1] = h["blend"] * h["intercept"]
        return out

    def with_draws(self, df: DataFrame, n: int, row_id: str, seed: int = 0, out: str = "draws") -> DataFrame:
        """Adds n scores, each with one of the five fold weights of every tree, chosen by a hash of row, tree, draw and seed."""
        names = self.features

        @F.pandas_udf("array<double>")
        def run(frame: pd.DataFrame, key: pd.Series) -> pd.Series:
            folds = self.tree_folds(frame[names].to_numpy(dtype=float))
            mix = key.to_numpy().view(np.uint64)[:, None]
            total = np.full((len(frame), n), float(self.base_score))
            for t in range(len(self.trees)):
                h = (mix ^ np.arange(t * n, t * n + n, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                total += np.take_along_axis(folds[:, t], ((h >> np.uint64(33)) % np.uint64(5)).astype(int), axis=1)
            return pd.Series(list(total))

        return df.withColumn(out, run(F.struct(*[F.col(f).cast("double").alias(f) for f in names]), F.xxhash64(F.col(row_id), F.lit(seed))))

    def tree_folds(self, x: np.ndarray) -> np.ndarray:
        """[row, tree, fold] weights of the leaves reached."""
        out = np.zeros((len(x), len(self.trees), 5))
        for t, tree in enumerate(self.trees):
            for n, rows in self.visits(tree, x):
                if n.is_leaf:
                    out[rows, t] = n.fold_weights
        return out

    def fold_scores(self, ordered: bool = False) -> Column:
        """base + sums of each of the five fold weights, or of each tree's in order of size. Large models need it as a column of
        its own before lambdas use it."""
        if sum(map(len, self.trees)) <= NATIVE_NODES:
            of = lambda n: sorted(n.fold_weights) if ordered else n.fold_weights
            one = lambda j: lambda n: F.lit(float(of(n)[j]))
            return F.array(*[sum((self.route(t, one(j)) for t in self.trees), F.lit(float(self.base_score))) for j in range(5)])
        return self._udf(lambda x: list(self.base_score + self.leaf_sums(x, ordered)[:, 1:]), "array<double>")

    def probability(self, calibrated: bool = False) -> Column:
        """The mean of the folds' sigmoids; calibrated: by the isotonic steps, where they are fitted."""
        if calibrated and self.isotonic:
            from timberline.operators.calibrate import isotonic_value

            return isotonic_value(self.probability(), *self.isotonic)
        if sum(map(len, self.trees)) > NATIVE_NODES:
            return self._udf(lambda x: (1 / (1 + np.exp(-self.base_score - self.leaf_sums(x)[:, 1:]))).mean(axis=1), "double")
        return F.aggregate(F.transform(self.fold_scores(), sigmoid), F.lit(0.0), lambda a, x: a + x) / 5

    def leaves(self) -> Column:
        """For each tree the leaf a row reaches."""
        if sum(map(len, self.trees)) <= NATIVE_NODES:
            return F.array(*[self.route(t, lambda n: F.lit(n.id)) for t in self.trees])
        return self._udf(lambda x: list(self.leaf_ids(x)), "array<int>")

    def node_paths(self) -> Column:
        """For each tree the nodes a row visits: its leaf's, from a literal."""
        paths = F.from_json(F.lit(json.dumps([ancestry(t) for t in self.trees])), "array<array<array<int>>>")
        return F.zip_with(self.leaves(), paths, lambda leaf, tree: F.get(tree, leaf))

    def _udf(self, fn, kind: str) -> Column:
        names = self.features

        @F.pandas_udf(kind)
        def run(frame: pd.DataFrame) -> pd.Series:
            got = fn(frame[names].to_numpy(dtype=float))
            return pd.Series(list(got)) if kind.startswith("array") else pd.Series(got)

        return run(F.struct(*[F.col(f).cast("double").alias(f) for f in names]))

    # walks over a matrix of features

    def branches(self, n: Node, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Each child of a node, and which rows of x go to it."""
        v = x[:, n.feature]
        with np.errstate(invalid="ignore"):
            ask = np.isin(v, n.left_cats) if n.left_cats is not None else v < n.value
        gone = np.isnan(v)
        if n.missing >= 0:
            return [(n.left, ask & ~gone), (n.right, ~ask & ~gone), (n.missing, gone)]
        left = np.where(gone, n.missing_left, ask)
        return [(n.left, left), (n.right, ~left)]

    def visits(self, tree: list[Node], x: np.ndarray):
        """(node, rows that reach it), parents first."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            i, rows = todo.pop()
            yield tree[i], rows
            if not tree[i].is_leaf:
                todo += [(k, rows[m]) for k, m in reversed(self.branches(tree[i], x[rows]))]

    def leaf_sums(self, x: np.ndarray, ordered: bool = False) -> np.ndarray:
        out = np.zeros((len(x), 6))
        for t in self.trees:
            for n, rows in self.visits(t, x):
                if n.is_leaf:
                    out[rows] += [n.weight, *(sorted(n.fold_weights) if ordered else n.fold_weights)]
        return out

    def leaf_ids(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.trees)), dtype=np.int32)
        for t, tree in enumerate(self.trees):
            for n, rows in self.visits(tree, x):
                if n.is_leaf:
                    out[rows, t] = n.id
        return out

    def paths(self, tree: list[Node], x: np.ndarray) -> np.ndarray:
        out = np.full((len(x), 1 + max(n.depth for n in tree)), -1)
        for n, rows in self.visits(tree, x):
            out[rows, n.depth] = n.id
        return out


def ancestry(tree: list[Node]) -> list[list[int]]:
    """For each node its way from the root, itself included; nodes stand after their parents."""
    out: list[list[int]] = []
    for n in tree:
        out.append([*(out[n.parent] if n.parent >= 0 else []), n.id])
    return out


def importance(nodes: DataFrame, kind: str = "Gain", normalise: bool = True) -> DataFrame:
    """(feature, value): Weight, Gain, Cover (means), TotalGain or TotalCover over splits, of sum 1 where normalised."""
    value = {"Weight": F.count("*").cast("double"), "Gain": F.avg("gain"), "Cover": F.avg("cover"), "TotalGain": F.sum("gain"), "TotalCover": F.sum("cover")}[kind]
    got = nodes.where("not is_leaf").groupBy(F.col("split_feature").alias("feature")).agg(value.alias("value"))
    return got.withColumn("value", F.col("value") / F.nullif(F.sum("value").over(_all()), F.lit(0.0))) if normalise else got


def importance_vector(model: Model, spark: SparkSession, kind: str = "Gain", normalise: bool = True) -> DataFrame:
    """(place, feature, value) for every feature in the model's order; 0 for those that no split uses."""
    names = spark.createDataFrame(list(enumerate(model.features)), "place int, feature string")
    found = importance(model.table(spark), kind, normalise)
    return names.join(F.broadcast(found), "feature", "left").select("place", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))  # a row a feature


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()
