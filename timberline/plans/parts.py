"""Queries over the parts that fits, explanations and calibrations are made of, each with SQL from its definition."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from timberline.functions import metrics as M
from timberline.functions import primitives as P
from timberline.functions.objectives import LOG
from timberline.operators import calibrate, causal, encode, explain, histogram, multi, sampling, schedule
from timberline.operators.trainer import Config, fit
from timberline.operators.tree import Model, importance_vector
from timberline.plans.queries import _W0, _W1, _W2, EVENTS, HIST, LABELLED, MODEL, ROUTED, SCORED, _events, _folds, _labelled, _logits, _orders, _rows, _scored, query
from timberline.sources.export import trees_frame, xgboost_document
from timberline.sources.tables import read_table

# leaves and splits


@query("""WITH d AS (SELECT l_returnflag, sum(l_quantity - 25) AS g, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(-g / (n + 0.5), 8) AS weight, round(g * g / (n + 0.5), 4) AS gain, round(-(2 * g * 0.2 + (n + 0.5) * 0.04), 4) AS gain_at FROM d""")
def leaf_primitives_constant(spark, sf_dir):
    """Weight and gain where the hessian is the number of rows."""
    d = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity") - 25).alias("g"), F.count("*").cast("double").alias("n"))
    g, n = F.col("g"), F.col("n")
    return d.select("l_returnflag", F.round(P.const_leaf_weight(g, n, 0.5), 8).alias("weight"), F.round(P.const_node_gain(g, n, 0.5), 4).alias("gain"), F.round(P.const_gain_at(g, n, F.lit(0.2), 0.5), 4).alias("gain_at"))


@query("""WITH d AS (SELECT l_linenumber, CAST(l_discount AS DOUBLE) AS a, CAST(l_tax AS DOUBLE) AS b, CAST(0.04 AS DOUBLE) AS p FROM lineitem),
m AS (SELECT *, p NOT BETWEEN least(a, b) AND greatest(a, b) AS off FROM d)
SELECT l_linenumber, count(*) AS n, count(*) FILTER (a > b) AS up_culled, count(*) FILTER (a < b) AS down_culled, count(*) FILTER (NOT off) AS inside,
  round(sum(CASE WHEN off AND abs(p - a) <= abs(p - b) THEN p ELSE a END), 4) AS left_bound, round(sum(CASE WHEN off AND abs(p - a) > abs(p - b) THEN p ELSE b END), 4) AS right_bound,
  round(sum(a + b - p), 4) AS gain, round(sum(a + b + 0.01 - p), 4) AS gain_missing FROM m GROUP BY 1""")
def split_bounds(spark, sf_dir):
    """Children against a monotone direction and against their parent's weight, and the gain of two and of three children."""
    d = read_table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_discount").cast("double").alias("a"), F.col("l_tax").cast("double").alias("b"))
    a, b, p, gone = F.col("a"), F.col("b"), F.lit(0.04), float("-inf")
    left, right = P.bound_to_parent(a, b, p)
    total = lambda c: F.round(F.sum(c), 4)
    return d.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if(P.culled(F.lit(1.0), a, b, 1) == gone).alias("up_culled"), F.count_if(P.culled(F.lit(1.0), a, b, -1) == gone).alias("down_culled"), F.count_if(P.between(p, a, b)).alias("inside"), total(left).alias("left_bound"), total(right).alias("right_bound"), total(P.split_gain(a, b, p)).alias("gain"), total(P.split_gain(a, b, p, F.lit(0.01))).alias("gain_missing"))


@query("""SELECT l_linenumber, count(*) FILTER (l_quantity < 10 OR l_quantity > 45) AS gone, count(*) FILTER (l_quantity < 10 OR l_quantity > 45 OR l_quantity = 20) AS gone_or_value FROM lineitem GROUP BY 1""")
def missing_values(spark, sf_dir):
    """Null, NaN and, where it is set, one value are missing."""
    q = F.col("l_quantity").cast("double")
    v = F.when(q < 10, F.lit(float("nan"))).when(q <= 45, q)
    return read_table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count_if(P.is_missing(v)).alias("gone"), F.count_if(P.is_missing(v, 20.0)).alias("gone_or_value"))


@query(f"WITH {HIST.replace('FROM orders)', 'FROM orders WHERE o_custkey % 3 = 2)')} SELECT feature, bin, fold, round(g, 5) AS g, n FROM hist")
def three_way_subtraction(spark, sf_dir):
    """The third child's histogram: the parent's less two."""
    d, b = _rows(spark, sf_dir), {"price": "b0", "priority": "b1"}
    whole, one, two = (histogram.fold_histogram(x, b) for x in (d, d.where("o_custkey % 3 = 0"), d.where("o_custkey % 3 = 1")))
    return histogram.subtract(whole, one, two).where("n > 0").select("feature", "bin", "fold", F.round("g", 5).alias("g"), "n")


@query("""WITH s AS (SELECT o_custkey, sum(o_totalprice) AS y, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, round((y + 10 * (SELECT avg(o_totalprice) FROM orders)) / (n + 10), 4) AS target_mean FROM s""")
def target_mean_full(spark, sf_dir):
    """Smoothed target means over all rows, for scoring."""
    return encode.full_means(read_table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 10.0).select("o_custkey", F.round("target_mean", 4).alias("target_mean"))


# what a fit takes from a table's shape, and what its trees are worth

SHAPES = [("orders", 8, 3), ("lineitem", 120, 0), ("customer", 4, 1)]


@query(f"""WITH t AS (SELECT n AS rows, f, c, name FROM (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem) AS l, (SELECT count(*) FROM customer) AS k) s, LATERAL (VALUES ('orders', o, 8, 3), ('lineitem', l, 120, 0), ('customer', k, 4, 1)) v(name, n, f, c)),
b AS (SELECT t.*, budget, kind, greatest(budget - 1, 0) AS more, ln(1 + greatest(rows / f, 1.0)) AS dense FROM t, (SELECT CAST(unnest([0.5, 1.0, 1.5]) AS DOUBLE) AS budget) x, (SELECT unnest(['LogLoss', 'SquaredLoss', 'PoissonLoss']) AS kind) y)
SELECT name, kind, budget,
  round(power(10, -(least(budget, 1) + more * CASE WHEN kind = 'LogLoss' AND f <= 96 THEN 0.65 WHEN kind = 'SquaredLoss' AND rows <= 16384 AND f <= 32 THEN 1.1 ELSE 1 END)), 9) AS eta,
  round(CASE WHEN rows < 32 THEN 0 ELSE least(0.12, CASE kind WHEN 'LogLoss' THEN 0.015 + 0.012 * dense + 0.02 * c / f WHEN 'SquaredLoss' THEN 0.008 + 0.008 * dense ELSE 0.01 + 0.01 * dense END / power(greatest(budget, 0.75), 0.35)) END, 9) AS ridge,
  CAST(round_even(1000 * least(power(10, 0.35 * more), 4.0), 0) AS BIGINT) AS iterations, CAST(ceil(3 * least(power(10, 0.5 * more), 6.0)) AS BIGINT) AS stopping_rounds,
  CAST(CASE WHEN rows * f > 180000 * power(greatest(budget, 0.5), 0.35) AND rows * 0.05 >= 2048 THEN 0.95 ELSE 1 END AS DOUBLE) AS subsample,
  CAST(CASE WHEN kind = 'PoissonLoss' OR rows > 100000 THEN 1 WHEN rows <= 2048 THEN 4 ELSE 2 END AS BIGINT) AS refine,
  CAST(CASE kind WHEN 'LogLoss' THEN least(96, round_even(2 * power(10, 0.5 * budget), 0)) WHEN 'SquaredLoss' THEN round_even(40 * power(10, 0.5 * more), 0) ELSE 0 END AS BIGINT) AS least_trees FROM b""")
def schedule_numbers(spark, sf_dir):
    """Step, ridge, rounds, idle rounds, sample, refinements and least trees for three tables, budgets and families of losses."""
    rows = []
    for name, features, categorical in SHAPES:
        n = read_table(spark, sf_dir, name).count()
        for budget in (0.5, 1.0, 1.5):
            for kind in ("LogLoss", "SquaredLoss", "PoissonLoss"):
                s = schedule.schedule(budget, kind, n, features, categorical)
                rows.append((name, kind, budget, round(s.eta, 9), round(s.ridge, 9), s.iterations, s.stopping_rounds, float(s.subsample), s.refine, s.least_trees))
    return spark.createDataFrame(rows, "name string, kind string, budget double, eta double, ridge double, iterations bigint, stopping_rounds bigint, subsample double, refine bigint, least_trees bigint")


@query("""WITH l AS (SELECT * FROM (VALUES (0, 0.4, 60), (0, 0.3, 40), (1, 0.2, 30), (1, 0.25, 20), (1, 0.05, 50), (2, 0.05, 80), (2, 0.15, 20)) v(tree_id, w, n)),
e AS (SELECT tree_id, CAST(w * n / sum(w * n) OVER (PARTITION BY tree_id) AS DOUBLE) AS share, count(*) OVER (PARTITION BY tree_id) AS k FROM l),
s AS (SELECT tree_id, (1 / sum(share * share) - 1) / (max(k) - 1) AS specialization FROM e GROUP BY 1),
p AS (SELECT * FROM (VALUES (0, 5.0, 100, 0.0), (1, 3.0, 100, 0.0), (1, 2.0, 70, 0.1), (2, 1.0, 100, 0.0)) v(tree_id, gain, n, w)),
r AS (SELECT tree_id, sum((sqrt(gain) + ln(1 + n)) * CASE WHEN w = 0 THEN 1.0 ELSE 1 / (1 + w * sqrt(CAST(0.02 AS DOUBLE)) / (w + 1e-6)) END) / sum(sqrt(gain) + ln(1 + n)) AS reliability FROM p GROUP BY 1)
SELECT CAST(tree_id AS INT) AS tree_id, round(specialization, 8) AS specialization, round(reliability, 8) AS reliability FROM s JOIN r USING (tree_id)""")
def tree_worth(spark, sf_dir):
    """How evenly the fixed model's trees spread their effect over leaves, and how steady their splits are over folds."""
    return spark.createDataFrame([(i, round(schedule.specialization(t), 8), round(schedule.reliability(t), 8)) for i, t in enumerate(MODEL.trees)], "tree_id int, specialization double, reliability double")


# explanations of the fixed model

_P0 = "CAST(0.1 AS DOUBLE)"
_SIG = "(1 / (1 + exp(-({}))))"
_S1, _S2 = f"{_P0} + {_W0}", f"{_P0} + {_W0} + {_W1}"
#: For each method: what price, priority and the bias get, by the leaves l0, l1 and l2 that a row reaches.
GIVEN = {
    "Average": ("CASE l0 WHEN 1 THEN 0.28 ELSE -0.42 END + CASE l1 WHEN 1 THEN 0 WHEN 3 THEN -0.25 + 7.5 / 70 ELSE -0.05 + 7.5 / 70 END + CASE l2 WHEN 1 THEN 0.04 ELSE -0.16 END", "CASE l1 WHEN 1 THEN 0.215 ELSE -7.5 / 70 + 0.015 END", "0.215"),
    "BranchDifference": ("CASE l0 WHEN 1 THEN 0.7 ELSE -0.7 END + CASE l1 WHEN 1 THEN 0 WHEN 3 THEN -0.2 ELSE 0.2 END + CASE l2 WHEN 1 THEN 0.2 ELSE -0.2 END", "CASE l1 WHEN 1 THEN 0.3 ELSE -0.3 END", "0.1"),
    "MidpointDifference": ("CASE l0 WHEN 1 THEN 0.28 ELSE -0.42 END + CASE l1 WHEN 1 THEN 0 WHEN 3 THEN -0.25 + 7.5 / 70 ELSE -0.05 + 7.5 / 70 END + CASE l2 WHEN 1 THEN 0.04 ELSE -0.16 END", "CASE l1 WHEN 1 THEN 0.21 ELSE -0.09 END", "0.1"),
    "ModeDifference": ("CASE l0 WHEN 1 THEN 0 ELSE -0.7 END + CASE l1 WHEN 3 THEN -0.2 ELSE 0 END + CASE l2 WHEN 1 THEN 0 ELSE -0.2 END", "CASE l1 WHEN 1 THEN 0.3 ELSE 0 END", "0.1"),
    "ProbabilityChange": (
        f"{_SIG.format(_S1)} - {_SIG.format(_P0)} + CASE l1 WHEN 1 THEN 0 ELSE {_SIG.format(_S2)} - {_SIG.format(_S1 + ' - 0.1')} END + {_SIG.format(f'{_S2} + {_W2}')} - {_SIG.format(_S2)}",
        f"CASE l1 WHEN 1 THEN {_SIG.format(_S1 + ' + 0.2')} ELSE {_SIG.format(_S1 + ' - 0.1')} END - {_SIG.format(_S1)}",
        _SIG.format(_P0),
    ),
}


def _given(method: str) -> None:
    def run(spark, sf_dir):
        c = explain.contributions(MODEL, method)
        return _orders(spark, sf_dir).select("o_orderkey", *[F.round(F.get(c, i), 6).alias(n) for i, n in enumerate(("price", "priority", "bias"))])

    run.__name__ = "contributions_" + {"Average": "average", "BranchDifference": "branch", "MidpointDifference": "midpoint", "ModeDifference": "mode", "ProbabilityChange": "probability"}[method]
    price, priority, bias = GIVEN[method]
    query(f"WITH {ROUTED} SELECT o_orderkey, round(CAST({price} AS DOUBLE), 6) AS price, round(CAST({priority} AS DOUBLE), 6) AS priority, round(CAST({bias} AS DOUBLE), 6) AS bias FROM z")(run)


for _method in GIVEN:
    _given(_method)


@query("""WITH s AS (SELECT * FROM (VALUES ('price', 5.0, 100), ('priority', 3.0, 100), ('price', 2.0, 70), ('price', 1.0, 100)) v(feature, gain, cover)), f AS (SELECT unnest(['price', 'priority', 'idle']) AS feature),
a AS (SELECT feature, count(gain) AS weight, coalesce(avg(gain), 0) AS gain, coalesce(avg(cover), 0) AS cover, coalesce(sum(gain), 0) AS total_gain, coalesce(sum(cover), 0) AS total_cover FROM f LEFT JOIN s USING (feature) GROUP BY 1)
SELECT feature, kind, round(value / sum(value) OVER (PARTITION BY kind), 9) AS value FROM (SELECT feature, unnest(['Weight', 'Gain', 'Cover', 'TotalGain', 'TotalCover']) AS kind, unnest([CAST(weight AS DOUBLE), gain, cover, total_gain, total_cover]) AS value FROM a)""")
def importance_kinds(spark, sf_dir):
    """All five kinds of importance for every feature, those that no split uses included."""
    m = Model([*MODEL.features, "idle"], MODEL.objective, MODEL.base_score, MODEL.eta, MODEL.trees)
    parts = [importance_vector(m, spark, k).select("feature", F.lit(k).alias("kind"), F.round("value", 9).alias("value")) for k in ("Weight", "Gain", "Cover", "TotalGain", "TotalCover")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {ROUTED} SELECT o_orderkey, round({_P0} + s, 6) AS from_json, round({_P0} + s, 6) AS from_bytes, 'orders' AS made_of FROM z")
def model_round_trip(spark, sf_dir):
    """Scores of the fixed model read back from JSON and from bytes, and a value put into its metadata before."""
    m = Model.from_json(MODEL.to_json())
    m.put("made_of", "orders")
    a, b = Model.from_json(m.to_json()), Model.from_bytes(m.to_bytes())
    return _orders(spark, sf_dir).select("o_orderkey", F.round(a.raw_score(), 6).alias("from_json"), F.round(b.raw_score(), 6).alias("from_bytes"), F.lit(b.get("made_of")).alias("made_of"))


@query("""SELECT CAST(t AS INT) AS tree_id, CAST(n AS INT) AS node_id, feature, CAST(split AS DOUBLE) AS split, yes, no, missing, CAST(gain AS DOUBLE) AS gain, CAST(cover AS DOUBLE) AS cover, codes FROM (VALUES
(0, 0, 'price', 150000.0, '0-1', '0-2', '0-2', 5.0, 100, NULL), (0, 1, 'Leaf', NULL, NULL, NULL, NULL, 0.4, 60, NULL), (0, 2, 'Leaf', NULL, NULL, NULL, NULL, -0.3, 40, NULL),
(1, 0, 'priority', NULL, '1-1', '1-2', '1-1', 3.0, 100, '1,3|0,2'), (1, 1, 'Leaf', NULL, NULL, NULL, NULL, 0.2, 30, NULL), (1, 2, 'price', 50000.0, '1-3', '1-4', '1-4', 2.0, 70, NULL), (1, 3, 'Leaf', NULL, NULL, NULL, NULL, -0.25, 20, NULL), (1, 4, 'Leaf', NULL, NULL, NULL, NULL, -0.05, 50, NULL),
(2, 0, 'price', 250000.0, '2-1', '2-2', '2-1', 1.0, 100, NULL), (2, 1, 'Leaf', NULL, NULL, NULL, NULL, 0.05, 80, NULL), (2, 2, 'Leaf', NULL, NULL, NULL, NULL, -0.15, 20, NULL)) v(t, n, feature, split, yes, no, missing, gain, cover, codes)""")
def model_nodes_export(spark, sf_dir):
    """The fixed model in the published table of trees."""
    both = F.concat(F.array_join("Left_Cats", ","), F.lit("|"), F.array_join("Right_Cats", ","))
    return trees_frame(spark, MODEL).select(F.col("Tree").alias("tree_id"), F.col("Node").alias("node_id"), F.col("Feature").alias("feature"), F.col("Split").alias("split"), F.col("Yes").alias("yes"), F.col("No").alias("no"), F.col("Missing").alias("missing"), F.col("Gain").alias("gain"), F.col("Cover").alias("cover"), both.alias("codes"))


@query(f"WITH {ROUTED} SELECT round(CAST(avg(1 / (1 + exp(-({_P0} + s)))) AS DOUBLE), 6) AS probability, count(*) AS n FROM z")
def model_document_export(spark, sf_dir):
    """The mean probability of orders by the fixed model's exported document, read by its published rules."""
    got = xgboost_document(MODEL)["learner"]
    base = float(got["learner_model_param"]["base_score"])
    out = F.lit(math.log(base / (1 - base)))
    for t in got["gradient_booster"]["model"]["trees"]:
        right = {n: t["categories"][s : s + k] for n, s, k in zip(t["categories_nodes"], t["categories_segments"], t["categories_sizes"])}

        def at(i: int, t=t, right=right):
            if t["left_children"][i] < 0:
                return F.lit(t["split_conditions"][i])
            v = F.col(got["feature_names"][t["split_indices"][i]])
            left = ~v.cast("int").isin(right[i]) if t["split_type"][i] else v < t["split_conditions"][i]
            return F.when(F.coalesce(left, F.lit(bool(t["default_left"][i]))), at(t["left_children"][i])).otherwise(at(t["right_children"][i]))

        out = out + at(0)
    # codes beyond those that splits name have no place in the document: priorities 4 and 5 go where 0 and 2 go
    d = _orders(spark, sf_dir).withColumn("priority", F.when(F.col("priority") > 3, 2.0).otherwise(F.col("priority")))
    return d.agg(F.round(F.avg(P.sigmoid(out)), 6).alias("probability"), F.count("*").alias("n"))


HEADED = Model(["q", "t"], "SquaredLoss", 1.0, 0.5, [], head={"means": [20.0, 0.03], "scales": [10.0, 0.02], "coefficients": [0.6, -0.4], "intercept": 0.5, "blend": 0.2})


@query("""SELECT l_linenumber, count(*) AS n, round(sum(1 + 0.2 * (0.5 + coalesce(0.6 * (q - 20) / 10, 0) - 0.4 * (t - 0.03) / 0.02)), 4) AS score, round(sum(coalesce(0.2 * 0.6 * (q - 20) / 10, 0)), 4) AS by_q, round(sum(CAST(1.1 AS DOUBLE)), 4) AS bias
FROM (SELECT l_linenumber, CASE WHEN l_partkey % 5 > 0 THEN CAST(l_quantity AS DOUBLE) END AS q, CAST(l_tax AS DOUBLE) AS t FROM lineitem) GROUP BY 1""")
def linear_head_scores(spark, sf_dir):
    """A linear head's scores, where a missing value stands at the mean, and its contributions."""
    d = read_table(spark, sf_dir, "lineitem").select("l_linenumber", F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity").cast("double")).alias("q"), F.col("l_tax").cast("double").alias("t"))
    c = explain.contributions(HEADED, "Weight")
    d = d.select("l_linenumber", HEADED.raw_score().alias("s"), c.alias("c"))
    return d.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("score"), F.round(F.sum(F.get("c", 0)), 4).alias("by_q"), F.round(F.sum(F.get("c", 2)), 4).alias("bias"))


# several classes: each has one of the fixed model's trees

CLASSES = multi.MultiModel(["a", "b", "c"], [Model(MODEL.features, "LogLoss", b, 0.3, [t]) for b, t in zip((0.0, 0.12, 0.2), MODEL.trees)], [0.5, 0.3, 0.2], True)


@query(f"""WITH {ROUTED}, s AS (SELECT *, CAST({_W0} AS DOUBLE) AS a, CAST(0.12 + {_W1} AS DOUBLE) AS b, CAST(0.2 + {_W2} AS DOUBLE) AS c FROM z),
p AS (SELECT CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS label, exp(a) / (exp(a) + exp(b) + exp(c)) AS p, exp(a / 2) / (exp(a / 2) + exp(b / 2) + exp(c / 2)) AS p2 FROM s)
SELECT label, count(*) AS n, round(sum(p), 4) AS probability, round(sum(p2), 4) AS flatter FROM p GROUP BY 1""")
def class_of_trees(spark, sf_dir):
    """The class of the greatest score, and the first class's probability at temperatures 1 and 2."""
    d = _orders(spark, sf_dir).select(CLASSES.predict().alias("label"), F.get(CLASSES.probabilities(), 0).alias("p"), F.get(CLASSES.probabilities(2.0), 0).alias("p2"))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("p"), 4).alias("probability"), F.round(F.sum("p2"), 4).alias("flatter"))


@query("SELECT feature, round(value, 9) AS value FROM (VALUES ('price', (1 + 2.0 / 5 + 1) / 3), ('priority', (3.0 / 5) / 3)) v(feature, value)")
def class_importance(spark, sf_dir):
    """The mean over classes of normalised importances by gain."""
    return CLASSES.importance(spark).select("feature", F.round("value", 9).alias("value"))


@query("""SELECT CAST(value AS DOUBLE) AS value, round(CAST((0.32 + CASE WHEN value < 150000 THEN 0.4 ELSE -0.3 END + 0.06 + 0.7 * CASE WHEN value < 50000 THEN -0.25 ELSE -0.05 END + CASE WHEN value < 250000 THEN 0.05 ELSE -0.15 END) / 3 AS DOUBLE), 9) AS score
FROM (VALUES (10000.0), (60000.0), (200000.0), (300000.0)) v(value)""")
def class_partial_dependence(spark, sf_dir):
    got = CLASSES.partial_dependence("price", [1e4, 6e4, 2e5, 3e5])
    return spark.createDataFrame([(v, round(s, 9)) for v, s in got], "value double, score double")


@query("SELECT o_orderstatus AS label, round(count(*) * 1.0 / (SELECT count(*) FROM orders), 9) AS prior FROM orders GROUP BY 1")
def class_priors(spark, sf_dir):
    d = read_table(spark, sf_dir, "orders")
    labels = sorted(r[0] for r in d.select("o_orderstatus").distinct().collect())
    return spark.createDataFrame([(k, round(p, 9)) for k, p in zip(labels, multi.class_priors(d, "o_orderstatus", labels))], "label string, prior double")


# samples

@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def class_sample(spark, sf_dir):
    """Rates of nothing and of all: one class goes, the others stay whole."""
    return sampling.class_sample(read_table(spark, sf_dir, "orders"), "o_orderstatus", {"F": 0.0, "O": 1.0}, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, true AS near FROM orders")
def row_sample(spark, sf_dir):
    """A sample and its rest: together all rows, none twice, the sample near its rate (five deviations)."""
    a, b = sampling.split_rows(read_table(spark, sf_dir, "orders"), 0.3, "o_orderkey")
    both = a.select("o_orderkey", F.lit(1).alias("s")).unionByName(b.select("o_orderkey", F.lit(0).alias("s")))
    return both.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), (F.abs(F.avg("s") - 0.3) < 5 * F.sqrt(0.21 / F.count("*"))).alias("near"))


@query("""WITH c AS (SELECT o_orderstatus AS label, count(*) AS n, row_number() OVER (ORDER BY count(*), o_orderstatus) AS k FROM orders GROUP BY 1),
a AS (SELECT max(n) FILTER (k = 1) AS n1, max(n) FILTER (k = 2) AS n2, max(n) FILTER (k = 3) AS n3, 0.2 * sum(n) AS room FROM c),
r AS (SELECT *, least(1.0, greatest(0.05, room / 3 / n1)) AS r1 FROM a), s AS (SELECT *, least(1.0, greatest(0.05, greatest(0, room - r1 * n1) / 2 / n2)) AS r2 FROM r),
t AS (SELECT *, least(1.0, greatest(0.05, greatest(0, room - r1 * n1 - r2 * n2) / n3)) AS r3 FROM s)
SELECT label, round(CAST(CASE k WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END AS DOUBLE), 9) AS rate FROM c, t""")
def class_rates(spark, sf_dir):
    """Rates that keep a fifth of the orders with classes as even as can be."""
    got = sampling.even_rates(read_table(spark, sf_dir, "orders"), "o_orderstatus", 0.2)
    return spark.createDataFrame([(k, round(float(v), 9)) for k, v in sorted(got.items())], "label string, rate double")


@query("SELECT CASE WHEN abs(v - round(v)) <= 1e-9 THEN CAST(round(v) AS INT) END AS label, count(*) AS n FROM (SELECT CAST(l_quantity / 10 AS DOUBLE) AS v FROM lineitem) GROUP BY 1")
def class_labels(spark, sf_dir):
    """Whole numbers among a target's values are classes."""
    return read_table(spark, sf_dir, "lineitem").groupBy(sampling.class_label(F.col("l_quantity") / 10).alias("label")).agg(F.count("*").alias("n"))


# calibration

_FOLDED = "(SELECT l_orderkey, y, p, least_p, most_p, sqrt(list_avg(list_transform(ps, lambda x: (x - p) * (x - p)))) AS sd FROM (SELECT l_orderkey, y, ps, list_avg(ps) AS p, list_min(ps) AS least_p, list_max(ps) AS most_p FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, [" + ", ".join(f"1 / (1 + exp(-(l_quantity - 25) / 20 * {0.8 + 0.1 * j:.1f}))" for j in range(5)) + "] AS ps FROM lineitem)))"


@query(f"""WITH s AS (SELECT unnest(['WeightVariance', 'MinMax', 'GRP']) AS method, unnest([s / greatest(sd, 1e-6), s / greatest(most_p - least_p, 1e-6), s / greatest(most_p - least_p, 1e-6)]) AS v FROM (SELECT *, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM {_FOLDED}) q),
o AS (SELECT method, v, row_number() OVER (PARTITION BY method ORDER BY v) AS k, count(*) OVER (PARTITION BY method) AS n FROM s)
SELECT method, round(v, 4) AS threshold FROM o WHERE k = least(n, ceil((n + 1) * 0.9))""")
def label_thresholds(spark, sf_dir):
    """Thresholds of label sets whose scores are scaled by the folds' spread or range."""
    d, y = read_table(spark, sf_dir, "lineitem"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return spark.createDataFrame([(m, round(calibrate.label_threshold(d, _logits(), y, 0.1, m), 4)) for m in ("WeightVariance", "MinMax", "GRP")], "method string, threshold double")


@query("""WITH d AS (SELECT CAST((l_extendedprice / 1e4 - 0.8 * l_quantity / 10) / (0.4 * l_quantity / 10) AS DOUBLE) AS v FROM lineitem), o AS (SELECT v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n FROM d)
SELECT method, place, round(v, 5) AS value FROM o, (VALUES ('MinMax', 'low', 1), ('MinMax', 'high', -1), ('GRP', 'low', -1), ('GRP', 'high', 1)) m(method, place, s)
WHERE k = greatest(1, least(n, CAST(ceil(n * (CASE place WHEN 'low' THEN 0.05 + s * CAST(1 AS DOUBLE) / n ELSE 0.95 + s * CAST(1 AS DOUBLE) / n END) - 1e-9) AS BIGINT)))""")
def interval_places(spark, sf_dir):
    """Where in the folds' range intervals of two methods end."""
    d, rows = read_table(spark, sf_dir, "lineitem"), []
    for m in ("MinMax", "GRP"):
        got = calibrate.regression_parameters(d, _folds(), F.col("l_quantity") / 10, F.col("l_extendedprice") / 1e4, 0.1, m)
        rows += [(m, place, round(v, 5)) for place, v in zip(("low", "high"), got)]
    return spark.createDataFrame(rows, "method string, place string, value double")


@query("""WITH d AS (SELECT CAST(greatest(l_quantity / 12 - l_extendedprice / 1e4, l_extendedprice / 1e4 - l_quantity / 8) AS DOUBLE) AS v FROM lineitem), o AS (SELECT v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n FROM d)
SELECT round(v, 6) AS shift FROM o WHERE k = least(n, ceil((n + 1) * 0.8))""")
def conformal_shift(spark, sf_dir):
    """How far two quantiles move out to cover four rows of five."""
    q, y = F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1e4
    return spark.createDataFrame([(round(calibrate.conformal_shift(read_table(spark, sf_dir, "lineitem"), q / 12, q / 8, y, 0.2), 6),)], "shift double")


@query(f"""SELECT CAST(y AS INT) AS y, count(*) AS n, round(sum(CASE WHEN p <= 0.2 THEN 0.3 WHEN p <= 0.5 THEN 0.3 + (p - 0.2) / 0.3 * 0.2 WHEN p <= 0.9 THEN 0.5 + (p - 0.5) / 0.4 * 0.45 ELSE 0.95 END), 5) AS value FROM {LABELLED} GROUP BY 1""")
def isotonic_values(spark, sf_dir):
    """Probabilities through steps that are straight between thresholds and level outside."""
    d = _labelled(spark, sf_dir)
    return d.groupBy(F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum(calibrate.isotonic_value(F.col("p"), [0.2, 0.5, 0.9], [0.3, 0.5, 0.95])), 5).alias("value"))


@query(f"SELECT round(avg(CASE WHEN i > 0 THEN x / i ELSE 0 END), 8) AS ndcg FROM (SELECT sum(r / log2(a + 1)) AS x, sum(r / log2(b + 1)) AS i FROM (SELECT o_custkey, r, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY r DESC, o_orderkey) AS b FROM {SCORED}) GROUP BY o_custkey)")
def metric_ndcg_linear(spark, sf_dir):
    """Relevance itself as the gain, whole lists."""
    return M.ndcg(_scored(spark, sf_dir), "o_custkey", "r", "s", "o_orderkey", None, False).select(F.round("ndcg", 8).alias("ndcg"))


# effects where all nuisance models are constants, which have closed forms

FLAT, FLAT_BINARY = Config("SquaredLoss", iterations=0), Config("LogLoss", iterations=0)
_ARMS = f"SELECT avg(y) FILTER (w = 1) AS y1, avg(y) FILTER (w = 0) AS y0, avg(w) AS p, avg(y) AS y FROM {EVENTS} t"


@query(f"""WITH a AS ({_ARMS}), e AS (SELECT avg(y1 - y0 + w * (t.y - y1) / a.p - (1 - w) * (t.y - y0) / (1 - a.p)) AS dr, sum((w - a.p) * (t.y - a.y)) / sum((w - a.p) * (w - a.p)) AS r FROM {EVENTS} t, a)
SELECT learner, round(CAST(effect AS DOUBLE), 7) AS effect FROM a, e, LATERAL (VALUES ('S', 0.0), ('T', y1 - y0), ('X', y1 - y0), ('DR', dr), ('R', r)) v(learner, effect)""")
def effects_of_constants(spark, sf_dir):
    """The mean effect by each learner from models without a tree."""
    d = _events(spark, sf_dir).withColumns({"row_id": F.col("event_id"), "w": F.col("w").cast("int")})
    made = {
        "S": causal.s_learner(d, ["value"], "w", "y", FLAT),
        "T": causal.t_learner(d, ["value"], "w", "y", FLAT),
        "X": causal.x_learner(d, ["value"], "w", "y", FLAT, FLAT_BINARY),
        "DR": causal.dr_learner(d, ["value"], "w", "y", FLAT, FLAT_BINARY),
        "R": causal.r_learner(d, ["value"], "w", "y", FLAT, FLAT_BINARY).raw_score(),
    }
    means = d.agg(*[F.round(F.avg(c), 7).alias(k) for k, c in made.items()])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("learner"), F.col(k).alias("effect")) for k in made])).alias("e")).select("e.*")


# the first split of a fit of prices, under options

_PRICED = "(SELECT CASE WHEN l_partkey % 5 > 0 THEN CAST(l_quantity AS DOUBLE) END AS q, CAST(l_discount AS DOUBLE) AS d, l_linenumber AS k, l_extendedprice / 1e4 AS y FROM lineitem)"
_STEP = "power(10, -0.5)"


def _priced(spark, sf_dir):
    d = read_table(spark, sf_dir, "lineitem")
    return d.select(F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity").cast("double")).alias("q"), F.col("l_discount").cast("double").alias("d"), F.col("l_linenumber").alias("k"), (F.col("l_extendedprice") / 1e4).alias("y"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"))


def _first(spark, model: Model):
    """Weight and rows of each child, with the root's gain and value."""
    root, *leaves = model.trees[0]
    rows = [(side, round(root.gain, 3), float(root.value) if root.left_cats is None else None, round(n.weight, 6), n.count) for side, n in zip(("left", "right", "missing"), leaves)]
    return spark.createDataFrame(rows, "side string, gain double, value double, weight double, n bigint")


@query(f"""WITH r AS (SELECT q, (SELECT avg(y) FROM {_PRICED} b) - y AS g FROM {_PRICED} t), m AS (SELECT sum(g) FILTER (q IS NULL) AS mg, count(*) FILTER (q IS NULL) AS mn, sum(g) FILTER (q IS NOT NULL) AS tg, count(q) AS tn, sum(g) AS ag, count(*) AS an FROM r),
s AS (SELECT q AS v, sum(sum(g)) OVER w AS lg, sum(count(*)) OVER w AS ln FROM r WHERE q IS NOT NULL GROUP BY q WINDOW w AS (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, lg * lg / (ln + 1e-8) + power(tg - lg, 2) / (tn - ln + 1e-8) + mg * mg / (mn + 1e-8) - ag * ag / (an + 1e-8) AS gain FROM s, m WHERE ln > 0 ORDER BY gain DESC LIMIT 1)
SELECT side, round(gain, 3) AS gain, v AS value, round(-g / (n + 1e-8) * {_STEP}, 6) AS weight, CAST(n AS BIGINT) AS n FROM k, LATERAL (VALUES ('left', lg, ln), ('right', tg - lg, tn - ln), ('missing', mg, mn)) x(side, g, n)""")
def fit_one_split_missing(spark, sf_dir):
    """With a branch of its own for missing values."""
    return _first(spark, fit(_priced(spark, sf_dir), ["q"], "y", Config("SquaredLoss", iterations=1, max_bin=64, max_nodes=4, missing_branch=True)))


@query(f"""WITH r AS (SELECT q, (SELECT avg(y) FROM {_PRICED} b) - y AS g FROM {_PRICED} t), m AS (SELECT coalesce(sum(g) FILTER (q IS NULL), 0) AS mg, count(*) FILTER (q IS NULL) AS mn, sum(g) AS ag, count(*) AS an FROM r),
s AS (SELECT q AS v, sum(sum(g)) OVER w AS lg, sum(count(*)) OVER w AS ln FROM r WHERE q IS NOT NULL GROUP BY q WINDOW w AS (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT v, gone_left, lg + CASE WHEN gone_left THEN mg ELSE 0 END AS lg, ln + CASE WHEN gone_left THEN mn ELSE 0 END AS ln, ag, an FROM s, m, (SELECT unnest([false, true]) AS gone_left) x WHERE ln > 0),
k AS (SELECT *, lg * lg / (ln + 1e-8) + power(ag - lg, 2) / (an - ln + 1e-8) - ag * ag / (an + 1e-8) AS gain FROM b ORDER BY gain DESC LIMIT 1)
SELECT side, round(gain, 3) AS gain, v AS value, round(-g / (n + 5 + 1e-8) * {_STEP}, 6) AS weight, CAST(n AS BIGINT) AS n FROM k, LATERAL (VALUES ('left', lg, ln), ('right', ag - lg, an - ln)) x(side, g, n)""")
def fit_one_split_imputed(spark, sf_dir):
    """Missing values go to the side that gains more; leaves have a ridge."""
    return _first(spark, fit(_priced(spark, sf_dir), ["q"], "y", Config("SquaredLoss", iterations=1, max_bin=64, max_nodes=3, ridge=5.0)))


@query(f"""WITH r AS (SELECT d, (SELECT avg(y) FROM {_PRICED} b) - y AS g FROM {_PRICED} t), m AS (SELECT sum(g) AS ag, count(*) AS an FROM r),
s AS (SELECT d AS v, sum(sum(g)) OVER w AS lg, sum(count(*)) OVER w AS ln FROM r GROUP BY d WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT direction, v, lg, ln, ag, an, lg * lg / (ln + 1e-8) + power(ag - lg, 2) / (an - ln + 1e-8) - ag * ag / (an + 1e-8) AS gain FROM s, m, (SELECT unnest([1, -1]) AS direction) x WHERE ln > 0 AND direction * (-lg / ln) <= direction * (-(ag - lg) / (an - ln)))
SELECT CAST(direction AS INT) AS direction, round(max(gain), 3) AS gain, max_by(v, gain) AS value, round(max_by(-lg / (ln + 1e-8) * {_STEP}, gain), 6) AS low, round(max_by(-(ag - lg) / (an - ln + 1e-8) * {_STEP}, gain), 6) AS high FROM k GROUP BY 1""")
def fit_one_split_monotone(spark, sf_dir):
    """The best split that goes either direction."""
    d, rows = _priced(spark, sf_dir), []
    for way in (1, -1):
        m = fit(d, ["d"], "y", Config("SquaredLoss", iterations=1, max_bin=64, max_nodes=3, monotone={"d": way}))
        if m.trees:
            root, left, right = m.trees[0]
            rows.append((way, round(root.gain, 3), float(root.value), round(left.weight, 6), round(right.weight, 6)))
    return spark.createDataFrame(rows, "direction int, gain double, value double, low double, high double")


@query(f"""WITH r AS (SELECT k, (SELECT avg(y) FROM {_PRICED} b) - y AS g FROM {_PRICED} t), m AS (SELECT sum(g) AS ag, count(*) AS an FROM r), c AS (SELECT k, sum(g) AS g, count(*) AS n, sum(g) / (count(*) + 1) AS mean FROM r GROUP BY k),
s AS (SELECT k, sum(g) OVER w AS lg, sum(n) OVER w AS ln, string_agg(CAST(k AS VARCHAR), ',') OVER w AS ks FROM c WINDOW w AS (ORDER BY mean ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x AS (SELECT *, lg * lg / (ln + 1e-8) + power(ag - lg, 2) / (an - ln + 1e-8) - ag * ag / (an + 1e-8) AS gain FROM s, m WHERE ln < an ORDER BY gain DESC LIMIT 1)
SELECT array_to_string(list_sort(string_split(ks, ',')), ',') AS left_codes, round(gain, 3) AS gain, round(-lg / (ln + 1e-8) * {_STEP}, 6) AS left_weight, round(-(ag - lg) / (an - ln + 1e-8) * {_STEP}, 6) AS right_weight, CAST(ln AS BIGINT) AS left_count FROM x""")
def fit_one_split_category(spark, sf_dir):
    """A category's codes in order of their mean, cut where most is gained."""
    m = fit(_priced(spark, sf_dir), ["k"], "y", Config("SquaredLoss", iterations=1, max_nodes=3, categorical=["k"]))
    root, left, right = m.trees[0]
    row = (",".join(map(str, root.left_cats)), round(root.gain, 3), round(left.weight, 6), round(right.weight, 6), left.count)
    return spark.createDataFrame([row], "left_codes string, gain double, left_weight double, right_weight double, left_count bigint")


@query(f"""WITH {ROUTED}, k AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y, unnest([1, 2, 3]) AS trees, unnest([{_S1}, {_S2}, {_S2} + {_W2}]) AS s FROM z),
l AS (SELECT trees, avg(-(y * ln(1 / (1 + exp(-s))) + (1 - y) * ln(1 - 1 / (1 + exp(-s))))) AS loss FROM k GROUP BY 1)
SELECT CAST(trees AS INT) AS trees, round(0.2 * 0.01 - loss, 6) AS everywhere, round(-loss, 6) AS out_of_bag, round(1 - 0.05 * loss, 6) AS robust FROM l""")
def prefix_proxies(spark, sf_dir):
    """What the fixed model's first trees are thought to be worth by their mean loss and generalization."""
    got = schedule.prefix_losses(MODEL, _orders(spark, sf_dir), lambda s: LOG.columns(F.col("y"), s)["loss"]).where("trees > 0").collect()
    worth = lambda name, r, sampled=False: round(schedule.prefix_proxy(name, r["loss"], schedule.tree_generalization(MODEL.trees[r["trees"] - 1], schedule.family(name)), sampled), 6)
    return spark.createDataFrame([(r["trees"], worth("LogLoss", r), worth("LogLoss", r, True), worth("SquaredLoss", r)) for r in got], "trees int, everywhere double, out_of_bag double, robust double")
