"""Drift, refresh and pruning: node visits against a model's own counts and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.objectives import objective
from timberline.functions.primitives import TINY, chi_square
from timberline.operators.tree import Model, Node, ancestry
from timberline.sources.tables import WRITTEN, cut_lineage, discard


#: The part of a standard error that statistical pruning allows; trees after which a running score is written.
SHARE, CUT_EVERY = 0.05, 8


def node_visits(model: Model, df: DataFrame) -> DataFrame:
    """(tree_id, node_id, n): a row counts at every node of its path. Rows are counted by leaf, with partial sums before the
    shuffle, and the few counts then go to the leaves' ancestors."""
    spark = df.sparkSession
    counts = df.select(F.posexplode(model.leaves()).alias("tree_id", "leaf")).groupBy("tree_id", "leaf").agg(F.count("*").alias("n"))
    above = [(t, n.id, k) for t, tree in enumerate(model.trees) for n, way in zip(tree, ancestry(tree)) if n.is_leaf for k in way]
    ways = spark.createDataFrame(above, "tree_id int, leaf int, node_id int")
    return counts.join(F.broadcast(ways), ["tree_id", "leaf"]).groupBy("tree_id", "node_id").agg(F.sum("n").alias("n"))  # as many ways as leaves are deep


def _scored(df: DataFrame, model: Model, columns: list[str]):
    """Rows with a running score in a column, and a way to add a tree to it that cuts lineage now and then."""
    since = len(WRITTEN)
    rows = cut_lineage(df.select(*dict.fromkeys([*model.features, *columns])).withColumn("_s", F.lit(float(model.base_score))), "walk")

    def added(rows: DataFrame, t: int, one: Model) -> DataFrame:
        rows = rows.withColumn("_s", F.col("_s") + one.raw_score())
        if t % CUT_EVERY == CUT_EVERY - 1:
            rows = cut_lineage(rows, "walk")
            discard(df.sparkSession, since, keep=1)
        return rows

    return rows, added, lambda: discard(df.sparkSession, since)


def drift(model: Model, df: DataFrame, kind: str = "data", strict: bool = True) -> DataFrame:
    """Mean over internal nodes ("data") or parents of leaves ("concept") of the chi-square of going left or right then and now."""
    spark: SparkSession = df.sparkSession
    if kind not in ("data", "concept"):
        raise ValueError(f"unknown drift {kind}")
    if strict and not any(n.count for t in model.trees for n in t):
        raise ValueError("the model has no node counts")
    rows = [(t, n.id, n.left, n.right, float(tree[n.left].count), float(tree[n.right].count)) for t, tree in enumerate(model.trees) for n in tree if not n.is_leaf and (kind == "data" or any(tree[k].is_leaf for k in n.children))]
    nodes = spark.createDataFrame(rows, "tree_id int, node_id int, l int, r int, a double, b double")
    now = node_visits(model, df)
    side = lambda c, out: now.select("tree_id", F.col("node_id").alias(c), F.col("n").cast("double").alias(out))
    got = nodes.join(side("l", "c"), ["tree_id", "l"], "left").join(side("r", "d"), ["tree_id", "r"], "left").fillna(0.0, ["c", "d"])
    return got.agg(F.coalesce(F.avg(chi_square(F.col("a"), F.col("b"), F.col("c"), F.col("d"))), F.lit(0.0)).alias("drift"))


def refresh(model: Model, df: DataFrame, y: str, blend: float = 1.0) -> Model:
    """Adds a batch's Newton steps to every node, tree by tree: one small aggregate by leaf each, summed up to the root on the driver."""
    obj = objective(model.objective)
    rows, added, end = _scored(df, model, [y])
    for t, tree in enumerate(model.trees):
        one = Model(model.features, model.objective, 0.0, model.eta, [tree])
        c = obj.columns(F.col(y).cast("double"), F.col("_s"))
        sums = rows.select(one.route(tree, lambda n: F.lit(n.id)).alias("leaf"), c["gradient"].alias("g"), c["hessian"].alias("h")).groupBy("leaf").agg(F.sum("g"), F.sum("h"), F.count("*")).collect()
        at = {n.id: [0.0, 0.0, 0] for n in tree}
        ways = dict(zip((n.id for n in tree), ancestry(tree)))
        for leaf, *own in sums:
            for k in ways[leaf]:
                at[k] = [a + (b or 0) for a, b in zip(at[k], own)]
        for n in tree:
            g, h, count = at[n.id]
            if not count:
                continue
            share = h / (h + n.cover + TINY) * blend
            new = -g / (h + TINY) * model.eta
            n.fold_weights = [(1 - share) * w + share * new for w in n.fold_weights]
            n.weight, n.cover, n.count = (1 - share) * n.weight + share * new, n.cover + h, n.count + count
        rows = added(rows, t, one)
    end()
    return model


def prune(model: Model, df: DataFrame, y: str, kind: str = "BottomUp") -> Model:
    """A split goes if its node alone has no more loss on df than its leaves have ("BottomUp"), than those and a twentieth of
    their standard error ("Statistical"), or, from the root down, than its children have ("TopDown"). Losses are taken at
    every node of a row's path, so an internal node's own loss is known."""
    if kind not in ("BottomUp", "Statistical", "TopDown"):
        raise ValueError(f"unknown pruning {kind}")
    obj = objective(model.objective)
    rows, added, end = _scored(df, model, [y])
    kept = []
    for t, tree in enumerate(model.trees):
        one = Model(model.features, model.objective, 0.0, model.eta, [tree])
        weights = F.lit([float(n.weight) for n in tree]).cast("array<double>")
        nodes = rows.select(F.explode(F.get(one.node_paths(), 0)).alias("node_id"), F.col(y).cast("double").alias("y"), F.col("_s").alias("s"))
        loss = obj.loss(F.col("y"), F.col("s") + F.get(weights, F.col("node_id")))
        got = nodes.select("node_id", loss.alias("l")).groupBy("node_id").agg(F.sum("l"), F.sum(F.col("l") ** 2), F.count("l")).collect()
        sums = {r[0]: (r[1] or 0.0, r[2] or 0.0, r[3]) for r in got}
        under: dict[int, tuple[float, float, int]] = {}
        for n in tree if kind == "TopDown" else reversed(tree):
            own = sums.get(n.id, (0.0, 0.0, 0))
            if n.is_leaf:
                under[n.id] = own
                continue
            of = sums if kind == "TopDown" else under
            below = tuple(sum(of.get(k, (0.0, 0.0, 0))[j] for k in n.children) for j in range(3))
            seen = max(1, below[2])
            error = (max(0.0, below[1] / seen - (below[0] / seen) ** 2) / seen) ** 0.5 if kind == "Statistical" else 0.0
            cut = own[0] <= below[0] + SHARE * error * seen
            if cut:
                n.left = n.right = n.missing = n.feature = -1
                n.left_cats = None
            under[n.id] = own if cut else below
        tree = _compact(tree)
        if len(tree) > 1:
            kept.append(tree)
        else:
            model.base_score += tree[0].weight
        rows = added(rows, t, Model(model.features, model.objective, 0.0, model.eta, [tree]))
    end()
    model.trees = kept
    return model


def _compact(tree: list[Node]) -> list[Node]:
    """The nodes still reached, missing branches included, renumbered parents first."""
    order, todo = [], [0]
    while todo:
        n = tree[todo.pop(0)]
        order.append(n)
        todo += n.children
    new = {n.id: i for i, n in enumerate(order)}
    for n in order:
        n.parent = new.get(n.parent, -1)
        n.left, n.right, n.missing = (new.get(k, -1) for k in (n.left, n.right, n.missing))
    for n in order:
        n.id = new[n.id]
    return order
