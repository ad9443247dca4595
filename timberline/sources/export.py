"""Models as documents in the published JSON schema of XGBoost models, and nodes in its table of trees."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from timberline.operators.tree import Model, Node

# fixed values: objectives' names in that schema
NAMES = {"LogLoss": "binary:logistic", "CrossEntropyLoss": "binary:logistic", "SquaredLoss": "reg:squarederror", "AbsoluteLoss": "reg:absoluteerror", "PoissonLoss": "count:poisson", "GammaLoss": "reg:gamma", "TweedieLoss": "reg:tweedie", "SquaredLogLoss": "reg:squaredlogerror", "HingeLoss": "binary:hinge", "ListNetLoss": "rank:ndcg"}
ROOT = 2**31 - 1


def _top_code(model: Model) -> dict[int, int]:
    """The greatest category code that any split names, by feature."""
    out: dict[int, int] = {}
    for tree in model.trees:
        for n in tree:
            if n.left_cats:
                out[n.feature] = max(out.get(n.feature, 0), *n.left_cats)
    return out


def _tree(i: int, tree: list[Node], features: int, top: dict[int, int]) -> dict:
    """A categorical node there lists the codes that go right; those of no split here go right too, up to the greatest named."""
    cats, nodes, starts, sizes = [], [], [], []
    for n in tree:
        if n.left_cats is not None:
            right = [c for c in range(top.get(n.feature, 0) + 1) if c not in n.left_cats]
            nodes.append(n.id)
            starts.append(len(cats))
            sizes.append(len(right))
            cats += right
    inner = lambda fn, leaf: [leaf(n) if n.is_leaf else fn(n) for n in tree]
    return {
        "base_weights": [float(n.weight) for n in tree],
        "categories": cats,
        "categories_nodes": nodes,
        "categories_segments": starts,
        "categories_sizes": sizes,
        "default_left": [int(n.missing_left and not n.is_leaf) for n in tree],
        "id": i,
        "left_children": [n.left for n in tree],
        "loss_changes": [float(n.gain) for n in tree],
        "parents": [ROOT if n.parent < 0 else n.parent for n in tree],
        "right_children": [n.right for n in tree],
        "split_conditions": inner(lambda n: 0.0 if n.left_cats is not None else min(float(n.value), 3.4028234663852886e38), lambda n: float(n.weight)),
        "split_indices": inner(lambda n: n.feature, lambda n: 0),
        "split_type": inner(lambda n: int(n.left_cats is not None), lambda n: 0),
        "sum_hessian": [float(n.cover) for n in tree],
        "tree_param": {"num_deleted": "0", "num_feature": str(features), "num_nodes": str(len(tree)), "size_leaf_vector": "1"},
    }


def xgboost_document(model: Model | list[Model]) -> dict:
    """One model, or one a class (softmax). A branch of its own for missing values and a linear head have no place there
    and raise; a binary base score is a probability there."""
    models = model if isinstance(model, list) else [model]
    if any(m.head for m in models) or any(n.missing >= 0 for m in models for t in m.trees for n in t):
        raise ValueError("missing branches and linear heads cannot be exported")
    one = models[0]
    top = {f: max(t.get(f, 0) for t in map(_top_code, models)) for f in set().union(*map(_top_code, models))}
    name = "multi:softprob" if len(models) > 1 else NAMES.get(one.objective, "reg:squarederror")
    base = one.base_score
    if name == "binary:logistic":
        base = 1 / (1 + math.exp(-base))
    elif name in ("count:poisson", "reg:gamma", "reg:tweedie"):
        base = math.exp(base)
    trees, info = [], []
    if len(models) > 1:  # each class's base score is a first tree of one leaf
        base = 0.0
    for k, m in enumerate(models):
        own = [[Node(0, -1, 0, m.base_score, 0.0, 0, [m.base_score] * 5)]] if len(models) > 1 else []
        for t in own + m.trees:
            trees.append(_tree(len(trees), t, len(one.features), top))
            info.append(k)
    params = {"base_score": repr(float(base)), "boost_from_average": "1", "num_class": str(len(models) if len(models) > 1 else 0), "num_feature": str(len(one.features)), "num_target": "1"}
    return {
        "learner": {
            "attributes": dict(one.metadata),
            "feature_names": list(one.features),
            "feature_types": ["c" if f in top else "float" for f in range(len(one.features))],
            "gradient_booster": {"model": {"gbtree_model_param": {"num_parallel_tree": "1", "num_trees": str(len(trees))}, "tree_info": info, "trees": trees}, "name": "gbtree"},
            "learner_model_param": params,
            "objective": {"name": name, **({"softmax_multiclass_param": {"num_class": str(len(models))}} if len(models) > 1 else {"reg_loss_param": {"scale_pos_weight": "1"}})},
        },
        "version": [2, 1, 0],
    }


def trees_frame(spark: SparkSession, model: Model) -> DataFrame:
    """Tree, Node, ID, Feature, Split, Yes, No, Missing, Gain, Cover, Left_Cats, Right_Cats by tree and node; a leaf's gain is
    its weight, a category's right side the codes that splits name and the left lacks."""
    top = _top_code(model)
    rows = []
    for t, tree in enumerate(model.trees):
        at = lambda k, t=t: f"{t}-{k}"
        for n in tree:
            if n.is_leaf:
                rows.append((t, n.id, at(n.id), "Leaf", None, None, None, None, float(n.weight), float(n.cover), None, None))
                continue
            cat = n.left_cats is not None
            right = [c for c in range(top.get(n.feature, 0) + 1) if c not in n.left_cats] if cat else None
            rows.append((t, n.id, at(n.id), model.features[n.feature], None if cat else float(n.value), at(n.left), at(n.right), at(n.gone), float(n.gain), float(n.cover), n.left_cats, right))
    return spark.createDataFrame(rows, "Tree int, Node int, ID string, Feature string, Split double, Yes string, No string, Missing string, Gain double, Cover double, Left_Cats array<int>, Right_Cats array<int>").orderBy("Tree", "Node")
