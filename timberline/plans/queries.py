"""Named queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import metrics as M
from timberline.functions import objectives as O
from timberline.functions import primitives as P
from timberline.operators import binning, calibrate, causal, encode, explain, histogram, multi, schedule
from timberline.operators import drift as D
from timberline.operators.trainer import Config, fit
from timberline.operators.tree import Model, Node, importance
from timberline.sources.tables import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# objectives: y and score from lineitem, a label from the return flag

LINES = "(SELECT l_returnflag, l_extendedprice / 1e4 AS yr, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS yb, l_quantity / 10 AS f, 1.0 + l_discount AS w, 1 / (1 + exp(-l_quantity / 10)) AS p FROM lineitem)"
#: For each objective: whether its target is the label; loss, gradient and hessian; whether weights enter the hessian.
CE = ("yb", "-(yb * ln(p) + (1 - yb) * ln(1 - p))", "p - yb", "p * (1 - p)", True)
DELTA = f"(SELECT abs(f - yr) FROM {LINES} d ORDER BY 1 LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM {LINES} c))"
FORMULAS = {
    "LogLoss": CE,
    "BrierLoss": ("yb", "(yb - p) * (yb - p)", "2 * (p - yb) * p * (1 - p)", "2 * p * (1 - p) * ((p - yb) * (1 - 2 * p) + p * (1 - p))", True),
    "SquaredLoss": ("yr", "(f - yr) * (f - yr)", "f - yr", "1.0", True),
    "QuantileLoss": ("yr", "CASE WHEN yr >= f THEN 0.5 * (yr - f) ELSE -0.5 * (yr - f) END", "CASE WHEN f >= yr THEN 0.5 ELSE -0.5 END", "1.0", True),
    "HuberLoss": ("yr", "CASE WHEN abs(f - yr) <= 1 THEN 0.5 * (f - yr) * (f - yr) ELSE abs(f - yr) - 0.5 END", "greatest(-1.0, least(1.0, f - yr))", "least(1.0, greatest(0.05, 1 / greatest(abs(f - yr), 1.0)))", True),
    "AdaptiveHuberLoss": ("yr", f"CASE WHEN abs(f - yr) <= {DELTA} THEN 0.5 * (f - yr) * (f - yr) ELSE {DELTA} * (abs(f - yr) - 0.5 * {DELTA}) END", f"greatest(-{DELTA}, least({DELTA}, f - yr))", f"least(1.0, greatest(0.05, {DELTA} / greatest(abs(f - yr), {DELTA})))", True),
    "AbsoluteLoss": ("yr", "abs(f - yr)", "sign(f - yr)", "1.0", True),
    "MapeLoss": ("yr", "abs(f - yr) / greatest(abs(yr), 1e-4)", "sign(f - yr) / greatest(abs(yr), 1e-4)", "CAST(1 AS DOUBLE)", False),
    "FairLoss": ("yr", "abs(f - yr) - ln(1 + abs(f - yr))", "(f - yr) / (abs(f - yr) + 1)", "1 / ((abs(f - yr) + 1) * (abs(f - yr) + 1))", True),
    "PoissonLoss": ("yr", "exp(f) - yr * f", "exp(f) - yr", "exp(f)", True),
    "GammaLoss": ("yr", "yr * exp(-f) + f", "1 - yr * exp(-f)", "yr * exp(-f)", True),
    "TweedieLoss": ("yr", "2 * yr * exp(-0.5 * f) + 2 * exp(0.5 * f)", "exp(0.5 * f) - yr * exp(-0.5 * f)", "0.5 * exp(0.5 * f) + 0.5 * yr * exp(-0.5 * f)", True),
    "SquaredLogLoss": ("yr", "0.5 * power(ln(1 + yr) - ln(1 + f), 2)", "(ln(1 + f) - ln(1 + yr)) / (1 + f)", "(1 + ln(1 + yr) - ln(1 + f)) / power(1 + f, 2)", True),
    "CrossEntropyLoss": CE,
    "CrossEntropyLambdaLoss": ("yb", "-(yb * ln(1 - power(1 - p, w)) + (1 - yb) * w * ln(1 - p)) / w", "(1 - yb / (1 - power(1 - p, w))) * p", "p * (1 - p) * (1 + yb * power(1 - p, w) / power(1 - power(1 - p, w), 2) * (1 + w * p / (1 - p) - power(1 - p, -w)))", True),
    "HingeLoss": ("yb", "greatest(0.0, 1 - (2 * yb - 1) * f)", "CASE WHEN (2 * yb - 1) * f < 1 THEN 1 - 2 * yb ELSE 0.0 END", "1e-6", True),
}
LOG_MEAN = "ln(sum({y} * w) / sum(w))"
MEAN = "sum({y} * w) / sum(w)"
#: The least target at which the weight so far reaches half of all.
WEIGHTED_MEDIAN = f"(SELECT min(v) FROM (SELECT {{y}} AS v, sum(w) OVER (ORDER BY {{y}}) AS upto, sum(w) OVER () AS whole FROM {LINES} m) WHERE upto >= 0.5 * whole)"
INITIAL = {"SquaredLoss": MEAN, "MapeLoss": MEAN, "FairLoss": MEAN, "PoissonLoss": LOG_MEAN, "GammaLoss": LOG_MEAN, "TweedieLoss": LOG_MEAN, "SquaredLogLoss": "exp(sum(ln(1 + {y}) * w) / sum(w)) - 1", "HingeLoss": "CAST(sign(sum((2 * {y} - 1) * w)) AS DOUBLE)"} | {k: "ln(sum({y} * w) / (sum(w) - sum({y} * w)))" for k in ("LogLoss", "BrierLoss", "CrossEntropyLoss", "CrossEntropyLambdaLoss")} | {k: WEIGHTED_MEDIAN for k in ("QuantileLoss", "HuberLoss", "AdaptiveHuberLoss", "AbsoluteLoss")}


def _lines(spark, sf_dir) -> DataFrame:
    d = read_table(spark, sf_dir, "lineitem")
    return d.select("l_returnflag", (F.col("l_extendedprice") / 1e4).alias("yr"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("yb"), (F.col("l_quantity") / 10).alias("f"), (1 + F.col("l_discount")).alias("w"))


def _objective(name: str):
    y, loss, grad, hess, weighs = FORMULAS[name]

    def run(spark, sf_dir):
        d = _lines(spark, sf_dir)
        o = O.OBJECTIVES[name]
        first = o.start(d, F.col(y), F.col("w"))
        o = o.adapt(d, F.col(y), F.col("f")) if o.adapt else o
        c = o.columns(F.col(y), F.col("f"), F.col("w"))
        return d.groupBy("l_returnflag").agg(F.count("*").alias("n"), *[F.round(F.sum(v), 3).alias(k) for k, v in c.items()], F.lit(round(first, 6)).alias("initial"))

    run.__name__ = f"obj_{name}"
    hw = f"({hess}) * w" if weighs else hess
    return query(f"SELECT l_returnflag, count(*) AS n, round(sum(({loss}) * w), 3) AS loss, round(sum(({grad}) * w), 3) AS gradient, round(sum({hw}), 3) AS hessian, (SELECT round({INITIAL[name].format(y=y)}, 6) FROM {LINES} t{' LIMIT 1' if INITIAL[name] is WEIGHTED_MEDIAN else ''}) AS initial FROM {LINES} s GROUP BY l_returnflag")(run)


for _name in FORMULAS:
    _objective(_name)


@query("""WITH d AS (SELECT o_custkey, o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS y, o_totalprice / 1e5 AS s FROM orders),
q AS (SELECT *, exp(y - max(y) OVER g) AS a, exp(s - max(s) OVER g) AS b FROM d WINDOW g AS (PARTITION BY o_custkey)),
r AS (SELECT *, a / sum(a) OVER g AS q, b / sum(b) OVER g AS t FROM q WINDOW g AS (PARTITION BY o_custkey)),
l AS (SELECT *, -sum(q * ln(greatest(t, 1e-15))) OVER g / count(*) OVER g AS loss FROM r WINDOW g AS (PARTITION BY o_custkey))
SELECT o_custkey, round(sum(loss), 6) AS loss, round(max(t - q), 6) AS top_gradient, round(sum(t * (1 - t)), 6) AS hessian FROM l GROUP BY o_custkey""")
def obj_ListNetLoss(spark, sf_dir):
    d = read_table(spark, sf_dir, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("double").alias("y"), (F.col("o_totalprice") / 1e5).alias("s"))
    d = O.listnet(d, "o_custkey", "y", "s")
    return d.groupBy("o_custkey").agg(F.round(F.sum("loss"), 6).alias("loss"), F.round(F.max("gradient"), 6).alias("top_gradient"), F.round(F.sum("hessian"), 6).alias("hessian"))


EVENTS = "(SELECT event_id, event_type, value, CAST(event_id % 2 AS DOUBLE) AS w, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS y FROM events)"


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", "event_type", "value", (F.col("event_id") % 2).cast("double").alias("w"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("y"), "user_id")


@query(f"""SELECT event_type, round(sum(y * w / 0.4 - y * (1 - w) / 0.6), 4) AS ipw, round(sum(0.3 - 0.2 + w * (y - 0.3) / 0.4 - (1 - w) * (y - 0.2) / 0.6), 4) AS dr FROM {EVENTS} t GROUP BY event_type""")
def policy_pseudo_outcome(spark, sf_dir):
    p, a, b = F.lit(0.4), F.lit(0.3), F.lit(0.2)
    y, w = F.col("y"), F.col("w")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.sum(O.policy_target(y, w, p)), 4).alias("ipw"), F.round(F.sum(O.policy_target(y, w, p, a, b)), 4).alias("dr"))


@query(f"""SELECT event_type, round(sum(power((y - 0.2) - 0.1 * (w - 0.5), 2)), 4) AS loss, round(sum(-(w - 0.5) * (y - 0.2) + 0.1 * power(w - 0.5, 2)), 4) AS gradient, round(sum(greatest(power(w - 0.5, 2), 1e-6)), 4) AS hessian FROM {EVENTS} t GROUP BY event_type""")
def residual_effect(spark, sf_dir):
    c = O.residual_effect(F.col("y") - 0.2, F.col("w") - 0.5, F.lit(0.1))
    return _events(spark, sf_dir).groupBy("event_type").agg(*[F.round(F.sum(v), 4).alias(k) for k, v in c.items()])


@query("""WITH d AS (SELECT CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END AS y, 1 / (1 + exp(-c_acctbal / 1e4)) AS p, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS s FROM customer),
g AS (SELECT avg(CASE WHEN s = 1 THEN p END) - avg(CASE WHEN s = 0 THEN p END) AS gap, sum(s) AS n1, sum(1 - s) AS n0, count(*) AS n FROM d)
SELECT s, round(sum(-(y * ln(p) + (1 - y) * ln(1 - p)) + gap * gap), 4) AS loss, round(sum(p - y + 2 * gap * (CASE WHEN s = 1 THEN 1.0 / n1 ELSE -1.0 / n0 END) * p * (1 - p) * n), 4) AS gradient FROM d, g GROUP BY s""")
def fairness_gradient(spark, sf_dir):
    d = read_table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 5000, 1.0).otherwise(0.0).alias("y"), (F.col("c_acctbal") / 1e4).alias("f"), F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("s"))
    return O.with_fairness(d, "y", "f", "s").groupBy("s").agg(F.round(F.sum("loss"), 4).alias("loss"), F.round(F.sum("gradient"), 4).alias("gradient"))


# primitives

@query("""WITH d AS (SELECT l_returnflag, sum(l_quantity - 25) AS g, sum(l_discount + 0.5) AS h FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(-g / (h + 0.1 + 1e-8), 8) AS weight, round(g * g / (h + 0.1 + 1e-8), 4) AS gain, round(-(2 * g * 0.2 + (h + 1e-8) * 0.04), 4) AS gain_at, CASE WHEN -g / (h + 1e-8) > 0.01 THEN 0.01 WHEN -g / (h + 1e-8) < -0.01 THEN -0.01 ELSE round(-g / (h + 1e-8), 8) END AS bound FROM d""")
def leaf_primitives(spark, sf_dir):
    d = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity") - 25).alias("g"), F.sum(F.col("l_discount") + 0.5).alias("h"))
    g, h = F.col("g"), F.col("h")
    return d.select("l_returnflag", F.round(P.leaf_weight(g, h, 0.1), 8).alias("weight"), F.round(P.node_gain(g, h, 0.1), 4).alias("gain"), F.round(P.gain_at(g, h, F.lit(0.2)), 4).alias("gain_at"), F.round(P.constrained(P.leaf_weight(g, h), F.lit(-0.01), F.lit(0.01), 1), 8).alias("bound"))


@query("""WITH d AS (SELECT l_returnflag, count(*) FILTER (l_quantity < 25 AND l_shipdate < TIMESTAMP '1996-01-01') AS a, count(*) FILTER (l_quantity >= 25 AND l_shipdate < TIMESTAMP '1996-01-01') AS b, count(*) FILTER (l_quantity < 25 AND l_shipdate >= TIMESTAMP '1996-01-01') AS c, count(*) FILTER (l_quantity >= 25 AND l_shipdate >= TIMESTAMP '1996-01-01') AS d FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(CASE WHEN CAST(a+b AS DOUBLE)*(c+d)*(a+c)*(b+d) > 0 THEN CAST(a+b+c+d AS DOUBLE) * power(CAST(a AS DOUBLE)*d - CAST(b AS DOUBLE)*c, 2) / (CAST(a+b AS DOUBLE)*(c+d)*(a+c)*(b+d)) ELSE 0 END, 6) AS chi2 FROM d""")
def drift_chi2(spark, sf_dir):
    low, old = F.col("l_quantity") < 25, F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    d = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(n(low & old).alias("a"), n(~low & old).alias("b"), n(low & ~old).alias("c"), n(~low & ~old).alias("d"))
    return d.select("l_returnflag", F.round(P.chi_square(*map(F.col, "abcd")), 6).alias("chi2"))


# binning and encoding

PCTS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query(f"""WITH l AS (SELECT 'l_quantity' AS feature, l_quantity AS v, l_tax + 1 AS w FROM lineitem UNION ALL SELECT 'l_discount', l_discount, l_tax + 1 FROM lineitem),
s AS (SELECT feature, v, sum(w) AS w FROM l GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY feature ORDER BY v) / sum(w) OVER (PARTITION BY feature) AS share FROM s)
SELECT feature, p, min(v) AS value FROM c, (SELECT CAST(unnest({PCTS}) AS DOUBLE) AS p) t WHERE share >= p GROUP BY feature, p""")
def weighted_percentiles(spark, sf_dir):
    d = read_table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_tax") + 1)
    return binning.weighted_percentiles(d, ["l_quantity", "l_discount"], PCTS, "w").select("feature", F.col("p"), "value")


@query("""SELECT 'l_discount' AS feature, unnest(list_sort(list(DISTINCT l_discount))) AS cut FROM lineitem
UNION ALL SELECT 'l_extendedprice', unnest(list_sort(list_distinct(quantile_disc(l_extendedprice, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0])))) FROM lineitem""")
def bin_cuts(spark, sf_dir):
    d = read_table(spark, sf_dir, "lineitem")
    return binning.cuts(d, ["l_discount"], 16).unionByName(binning.cuts(d, ["l_extendedprice"], 8)).select("feature", F.explode("cuts").alias("cut"))


@query("""SELECT CASE WHEN l_quantity IS NULL OR l_quantity = 7 THEN 0 ELSE CAST(len(list_filter([1.0, 10.0, 25.5, 40.0], lambda c: c <= l_quantity)) AS INT) END AS bin, count(*) AS n FROM lineitem GROUP BY 1""")
def map_bin(spark, sf_dir):
    v = F.nullif("l_quantity", F.lit(7.0))
    return read_table(spark, sf_dir, "lineitem").groupBy(binning.map_bin(v, [1.0, 10.0, 25.5, 40.0]).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_quantity AS v, sum(l_tax + 1) AS w FROM lineitem GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v) / sum(w) OVER () AS share FROM s) SELECT min(v) AS weighted_median FROM c WHERE share >= 0.5""")
def weighted_median(spark, sf_dir):
    return binning.weighted_median(read_table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_tax") + 1), "l_quantity", "w")


@query("""SELECT p_brand AS category, CAST(row_number() OVER (ORDER BY p_brand) AS INT) AS code FROM (SELECT DISTINCT p_brand FROM part)
WHERE (SELECT count(*) < 128 OR count(*) / count(DISTINCT p_brand) >= CASE WHEN count(DISTINCT p_brand) <= 16 THEN 48 ELSE 64 END FROM part)""")
def category_native(spark, sf_dir):
    mapping, how = encode.category_map(read_table(spark, sf_dir, "part"), "p_brand")
    return mapping.where(F.lit(how["mode"] == "native"))


@query("""WITH c AS (SELECT p_name AS k, count(*) AS n FROM part GROUP BY 1), z AS (SELECT count(*) AS k, sum(n) AS rows, CASE WHEN sum(n) < 128 THEN 1 WHEN count(*) <= 16 THEN 48 ELSE 64 END AS threshold FROM c),
p AS (SELECT greatest(1, least(48, k, 64, rows // threshold)) AS pooled FROM z), h AS (SELECT pooled, CASE WHEN pooled < 4 THEN least(pooled, 1) ELSE least(pooled, 16, pooled // 4) END AS tail FROM p), f AS (SELECT least(32, pooled - tail) AS head FROM h),
t AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) AS r FROM c), m AS (SELECT k, n, CAST(row_number() OVER (ORDER BY k) AS INT) AS code FROM t, f WHERE r <= head)
SELECT code, CAST(n AS BIGINT) AS n FROM m UNION ALL SELECT 0, CAST(sum(n) AS BIGINT) FROM t, f WHERE r > head""")
def category_pool(spark, sf_dir):
    """Codes of frequent part names, and how many rows share the buckets of the rest (0)."""
    d = read_table(spark, sf_dir, "part")
    mapping, how = encode.category_map(d, "p_name", max_cat=48)
    coded = encode.encode(d, "p_name", mapping, how, "code")
    return coded.groupBy(F.when(F.col("code") < how["offset"], F.col("code")).otherwise(0).alias("code")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT o_custkey, CAST(o_orderkey % 5 AS INT) AS fold, o_totalprice AS y FROM orders),
s AS (SELECT o_custkey, fold, sum(y) AS y, count(*) AS n FROM d GROUP BY ALL), f AS (SELECT fold, sum(y) AS y, sum(n) AS n FROM s GROUP BY fold),
t AS (SELECT s.o_custkey, s.fold, s.n, (sum(s.y) OVER c - s.y + 10 * ((SELECT sum(y) FROM f) - f.y) / ((SELECT sum(n) FROM f) - f.n)) / (sum(s.n) OVER c - s.n + 10) AS m FROM s JOIN f USING (fold) WINDOW c AS (PARTITION BY s.o_custkey))
SELECT o_custkey, CAST(sum(n) AS BIGINT) AS n, round(sum(m * n), 2) AS total FROM t GROUP BY o_custkey""")
def target_mean_oof(spark, sf_dir):
    d = read_table(spark, sf_dir, "orders").withColumn("fold", encode.fold_of(F.col("o_orderkey")))
    return encode.target_means(d, "o_custkey", "o_totalprice", "fold", 10.0, "m").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("m"), 2).alias("total"))


@query("""WITH c AS (SELECT o_orderpriority AS k, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS y FROM orders GROUP BY 1), p AS (SELECT sum(y) / sum(n) AS p, sum(n) AS n FROM c)
SELECT round(sum(c.n * abs((y + 48 * p) / (c.n + 48) - p) * c.n / (c.n + 48)) / max(p.n), 9) AS signal FROM c, p""")
def category_signal(spark, sf_dir):
    d = read_table(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    return encode.signal_score(d, "o_orderpriority", "y", 48.0).select(F.round("signal", 9).alias("signal"))


@query("SELECT o_orderstatus || chr(31) || o_orderpriority AS pair, count(*) AS n FROM orders GROUP BY 1")
def category_cross(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").groupBy(encode.cross(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("pair")).agg(F.count("*").alias("n"))


# histograms and splits

HIST = """hb AS (SELECT 0 AS node, CAST(o_orderkey % 5 AS INT) AS fold, 1 / (1 + exp(-(o_totalprice / 3e5 - 0.5))) - CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS g,
  (1 / (1 + exp(-(o_totalprice / 3e5 - 0.5)))) * (1 - 1 / (1 + exp(-(o_totalprice / 3e5 - 0.5)))) AS h, CAST(least(31, floor(o_totalprice / 1e4)) AS INT) AS b0, CAST(substr(o_orderpriority, 1, 1) AS INT) AS b1 FROM orders),
hl AS (SELECT node, 'price' AS feature, b0 AS bin, fold, g, h FROM hb UNION ALL SELECT node, 'priority', b1, fold, g, h FROM hb),
hist AS (SELECT node, feature, bin, fold, sum(g) AS g, sum(h) AS h, count(*) AS n FROM hl GROUP BY ALL)"""


def _rows(spark, sf_dir) -> DataFrame:
    d = read_table(spark, sf_dir, "orders")
    y = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    c = O.LOG.columns(y, F.col("o_totalprice") / 3e5 - 0.5)
    return d.select(F.lit(0).alias("node"), encode.fold_of(F.col("o_orderkey")).alias("fold"), c["gradient"].alias("g"), c["hessian"].alias("h"), F.least(F.lit(31), F.floor(F.col("o_totalprice") / 1e4)).cast("int").alias("b0"), F.substring("o_orderpriority", 1, 1).cast("int").alias("b1"), "o_custkey")


def _hist(spark, sf_dir) -> DataFrame:
    return histogram.fold_histogram(_rows(spark, sf_dir), {"price": "b0", "priority": "b1"})


@query(f"WITH {HIST} SELECT node, feature, bin, fold, round(g, 5) AS g, round(h, 5) AS h, n FROM hist")
def fold_histogram(spark, sf_dir):
    return _hist(spark, sf_dir).select("node", "feature", "bin", "fold", F.round("g", 5).alias("g"), F.round("h", 5).alias("h"), "n")


@query(f"WITH {HIST.replace('FROM orders)', 'FROM orders WHERE o_custkey % 3 <> 0)')} SELECT feature, bin, fold, round(g, 5) AS g, n FROM hist")
def sibling_subtraction(spark, sf_dir):
    d = _rows(spark, sf_dir)
    b = {"price": "b0", "priority": "b1"}
    small = histogram.fold_histogram(d.where("o_custkey % 3 = 0"), b)
    return histogram.subtract(histogram.fold_histogram(d, b), small).where("n > 0").select("feature", "bin", "fold", F.round("g", 5).alias("g"), "n")


SCAN = HIST + """, c AS (SELECT node, feature, bin, fold, g, h, n, sum(g) OVER l AS lg, sum(h) OVER l AS lh, sum(n) OVER l AS ln, sum(g) OVER t AS tg, sum(h) OVER t AS th, sum(n) OVER t AS tn
  FROM (SELECT f.node, f.feature, f.bin, k.fold, coalesce(x.g, 0) AS g, coalesce(x.h, 0) AS h, coalesce(x.n, 0) AS n FROM (SELECT DISTINCT node, feature, bin FROM hist) f CROSS JOIN (SELECT unnest([0,1,2,3,4]) AS fold) k LEFT JOIN hist x ON x.node = f.node AND x.feature = f.feature AND x.bin = f.bin AND x.fold = k.fold)
  WINDOW l AS (PARTITION BY node, feature, fold ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY node, feature, fold)),
a AS (SELECT *, sum(lg) OVER b AS alg, sum(lh) OVER b AS alh, sum(ln) OVER b AS aln, sum(tg) OVER b AS atg, sum(th) OVER b AS ath, sum(tn) OVER b AS atn FROM c WHERE ln IS NOT NULL WINDOW b AS (PARTITION BY node, feature, bin)),
s AS (SELECT *, alg - lg AS olg, alh - lh AS olh, aln - ln AS oln, (atg - alg) - (tg - lg) AS org, (ath - alh) - (th - lh) AS orh, (atn - aln) - (tn - ln) AS orn FROM a),
v AS (SELECT *, CASE WHEN ln > 0 AND tn > ln AND oln > 0 AND orn > 0 THEN -0.5 * (olg * olg / (olh + 1e-8) + org * org / (orh + 1e-8)) / (oln + orn) ELSE 0 END AS tr,
  CASE WHEN ln > 0 AND tn > ln AND oln > 0 AND orn > 0 THEN (lg * (-olg / (olh + 1e-8)) + 0.5 * lh * power(olg / (olh + 1e-8), 2) + (tg - lg) * (-org / (orh + 1e-8)) + 0.5 * (th - lh) * power(org / (orh + 1e-8), 2)) / tn ELSE 0 END AS va FROM s),
scan AS (SELECT node, feature, bin, max(alg * alg / (alh + 1e-8) + power(atg - alg, 2) / (ath - alh + 1e-8) - atg * atg / (ath + 1e-8)) AS gain, sum(tr) / 5 AS train, sum(va) / 5 AS valid, max(-0.5 * atg * atg / (ath + 1e-8) / atn) AS parent FROM v WHERE aln > 0 AND atn > aln GROUP BY ALL)"""


@query(f"WITH {SCAN} SELECT node, feature, bin, round(gain, 4) AS gain, round(train, 7) AS train, round(valid, 7) AS valid FROM scan")
def split_gain_scan(spark, sf_dir):
    return histogram.split_scan(_hist(spark, sf_dir)).select("node", "feature", "bin", F.round("gain", 4).alias("gain"), F.round("train", 7).alias("train"), F.round("valid", 7).alias("valid"))


@query(f"WITH {SCAN} SELECT node, feature, bin, round(gain, 4) AS gain, round((parent - train) / nullif(parent - valid, 0), 4) AS generalization FROM scan WHERE gain > 0 ORDER BY scan.gain DESC, feature DESC, bin LIMIT 1")
def best_split(spark, sf_dir):
    return histogram.best_split(histogram.split_scan(_hist(spark, sf_dir))).select("node", "feature", "bin", F.round("gain", 4).alias("gain"), F.round("generalization", 4).alias("generalization"))


@query(f"WITH {HIST} SELECT node, feature, bin, CAST(row_number() OVER (PARTITION BY node, feature ORDER BY -sum(g) / (sum(h) + 1) DESC, bin) AS INT) AS place FROM hist GROUP BY node, feature, bin")
def category_order(spark, sf_dir):
    return histogram.category_order(_hist(spark, sf_dir))


@query(f"WITH {HIST} SELECT node, round(sum(g), 4) AS g, round(sum(h), 4) AS h, CAST(sum(n) AS BIGINT) AS n FROM hist WHERE feature = 'price' GROUP BY node")
def node_totals(spark, sf_dir):
    return histogram.node_totals(_hist(spark, sf_dir)).select("node", F.round("g", 4).alias("g"), F.round("h", 4).alias("h"), "n")


@query(f"""WITH {HIST}, b AS (SELECT node, feature, bin, sum(g) AS bg, sum(h) AS bh FROM hist GROUP BY ALL),
pr AS (SELECT *, (1 + coalesce(sum(CASE WHEN bin <> 0 AND bh > 0 THEN bh END) OVER w, 0)) / greatest(coalesce(sum(CASE WHEN bin <> 0 AND bh > 0 THEN 1 END) OVER w, 1), 1) AS s, coalesce(sum(CASE WHEN bin <> 0 AND bh > 0 THEN bg END) OVER w / sum(CASE WHEN bin <> 0 AND bh > 0 THEN bh END) OVER w, 0) AS m FROM b WINDOW w AS (PARTITION BY node, feature)),
fo AS (SELECT pr.*, CASE WHEN bh - coalesce(h.h, 0) > 0 THEN (bg - coalesce(h.g, 0) + s * m) / (bh - coalesce(h.h, 0) + s) END AS o, CASE WHEN coalesce(h.h, 0) > 0 THEN h.g / h.h ELSE m END AS held FROM pr CROSS JOIN range(5) f(j) LEFT JOIN hist h ON h.node = pr.node AND h.feature = pr.feature AND h.bin = pr.bin AND h.fold = f.j)
SELECT node, feature, bin, round(coalesce(avg(o) * (0.55 / (1 + stddev_pop(o) / (abs(avg(o)) + 1e-6)) + 0.45 * avg(CASE WHEN o IS NOT NULL THEN 1 / (1 + abs(held - o) / (abs(o) + 1e-3)) END)) * any_value(bh) / (any_value(bh) + 0.35 * greatest(any_value(s), 1)), 0), 6) AS ordered,
  round(any_value((bg + s * m) / (bh + s)), 6) AS posterior, round(any_value(((bg + s * m) / (bh + s) - m) * sqrt(bh) / (sqrt(bh) + sqrt(greatest(s, 1)))), 6) AS lift, 'ordered' AS mode FROM fo GROUP BY node, feature, bin""")
def category_scores(spark, sf_dir):
    return histogram.category_scores(_hist(spark, sf_dir)).select("node", "feature", "bin", *[F.round(c, 6).alias(c) for c in ("ordered", "posterior", "lift")], "mode")


# ranks of splits: fold weights and gains made of a line's columns

_SPLITS = f"""(SELECT l_orderkey, l_linenumber, gain, gen, n, d, nl, nr, (CASE WHEN ml > 0 THEN least(1.0, greatest(0.5, 1 / (1 + sqrt(vl) / (ml + 1e-6)))) ELSE 1.0 END + CASE WHEN mr > 0 THEN least(1.0, greatest(0.5, 1 / (1 + sqrt(vr) / (mr + 1e-6)))) ELSE 1.0 END) / 2 AS st, el + er AS en FROM (
  SELECT *, list_avg(list_transform(a, lambda x: abs(x))) AS ml, list_avg(list_transform(b, lambda x: abs(x))) AS mr, list_var_pop(a) AS vl, list_var_pop(b) AS vr, sqrt(list_avg(list_transform(a, lambda x: x * x))) AS el, sqrt(list_avg(list_transform(b, lambda x: x * x))) AS er FROM (
  SELECT l_orderkey, l_linenumber, l_extendedprice / 1e3 AS gain, 0.9 + CAST(l_tax AS DOUBLE) * 4 AS gen, l_partkey AS n, l_linenumber - 1 AS d, CAST(l_quantity AS DOUBLE) AS nl, CAST(l_partkey AS DOUBLE) AS nr,
    [CAST(l_discount AS DOUBLE), l_tax, 0.01, l_quantity / 100, 0.05] AS a, [-CAST(l_tax AS DOUBLE), 0.02, l_discount, -0.03, l_quantity / 50] AS b FROM lineitem)))"""


RANKED = ("stability", "floor_numeric", "floor_category", "rank_numeric", "rank_category", "balance")


@query(f"""WITH r AS (SELECT l_linenumber, st AS stability, least(1.0, greatest(0.98, 1.0 - 0.01 * (1 - least(n, 2048) / 2048) * (0.5 + 0.5 * least(d, 3) / 3) * st)) AS floor_numeric,
  least(1.0, greatest(0.984, 0.99 + 0.004 * (1 - st) - 0.006 * (1 - least(n, 2048) / 2048) * (0.5 + 0.5 * least(d, 3) / 3) * st)) AS floor_category,
  gain * (0.92 + 0.08 * st) * power(least(1.05, greatest(gen, 1.0)), 0.1) AS rank_numeric,
  gain * (0.75 + 0.25 * st) * power(least(1.12, greatest(gen, 0.99 + 0.004 * (1 - st))), 0.3) / (1 + 0.02 * en) AS rank_category,
  CASE WHEN least(nl, nr) / (nl + nr) >= 0.12 OR least(nl, nr) >= 96 THEN 1.0 ELSE 0.9 + 0.1 * least(1.0, least(sqrt(least(nl, nr) / (nl + nr) / 0.12), sqrt(least(nl, nr) / 96))) END AS balance FROM {_SPLITS})
SELECT l_linenumber, count(*) AS n, {", ".join(f"round(avg({c}), 6) AS {c}" for c in RANKED)} FROM r GROUP BY l_linenumber""")
def split_ranks(spark, sf_dir):
    c = lambda name: F.col(name).cast("double")
    d = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_extendedprice") / 1e3).alias("gain"), (0.9 + c("l_tax") * 4).alias("gen"), F.col("l_partkey").alias("n"), (F.col("l_linenumber") - 1).alias("d"), c("l_quantity").alias("nl"), c("l_partkey").alias("nr"), F.array(c("l_discount"), c("l_tax"), F.lit(0.01), c("l_quantity") / 100, F.lit(0.05)).alias("a"), F.array(-c("l_tax"), F.lit(0.02), c("l_discount"), F.lit(-0.03), c("l_quantity") / 50).alias("b"))
    st, gain, gen, a, b = P.split_stability(F.col("a"), F.col("b")), F.col("gain"), F.col("gen"), F.col("a"), F.col("b")
    floor = lambda cat: P.generalization_floor(st, F.col("d"), F.col("n"), cat)
    columns = (st, floor(False), floor(True), P.split_rank(gain, gen, a, b), P.split_rank(gain, gen, a, b, True), P.sparse_balance(F.col("nl"), F.col("nr")))
    return d.groupBy("l_linenumber").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(name) for name, c in zip(RANKED, columns)])


# a fixed model of three trees over orders: numeric split, category split, missing branch

def _n(i, parent, depth, w, cover, **k) -> Node:
    return Node(i, parent, depth, w, cover, int(cover), [w * (0.8 + 0.1 * j) for j in range(5)], **k)


MODEL = Model(
    ["price", "priority"],
    "LogLoss",
    0.1,
    0.3,
    [
        [_n(0, -1, 0, 0.0, 100, feature=0, value=150000.0, left=1, right=2, gain=5.0), _n(1, 0, 1, 0.4, 60), _n(2, 0, 1, -0.3, 40)],
        [_n(0, -1, 0, 0.0, 100, feature=1, left_cats=[1, 3], left=1, right=2, missing_left=True, gain=3.0), _n(1, 0, 1, 0.2, 30), _n(2, 0, 1, -0.1, 70, feature=0, value=50000.0, left=3, right=4, gain=2.0), _n(3, 2, 2, -0.25, 20), _n(4, 2, 2, -0.05, 50)],
        [_n(0, -1, 0, 0.0, 100, feature=0, value=250000.0, left=1, right=2, missing_left=True, gain=1.0), _n(1, 0, 1, 0.05, 80), _n(2, 0, 1, -0.15, 20)],
    ],
)
ROUTED = """r AS (SELECT o_orderkey, o_orderstatus, price, priority, CASE WHEN price IS NULL THEN 2 WHEN price < 150000 THEN 1 ELSE 2 END AS l0, CASE WHEN priority IN (1, 3) THEN 1 WHEN price IS NULL THEN 4 WHEN price < 50000 THEN 3 ELSE 4 END AS l1, CASE WHEN price IS NULL OR price < 250000 THEN 1 ELSE 2 END AS l2
  FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority FROM orders)),
z AS (SELECT *, CAST(CASE l0 WHEN 1 THEN 0.4 ELSE -0.3 END + CASE l1 WHEN 1 THEN 0.2 WHEN 3 THEN -0.25 ELSE -0.05 END + CASE l2 WHEN 1 THEN 0.05 ELSE -0.15 END AS DOUBLE) AS s FROM r)"""


def _orders(spark, sf_dir) -> DataFrame:
    d = read_table(spark, sf_dir, "orders")
    return d.select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"), F.col("o_orderkey").alias("row_id"))


@query(f"WITH {ROUTED} SELECT l0, l1, l2, count(*) AS n FROM z GROUP BY ALL")
def route_by_tree(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy(*[MODEL.route(t, lambda n: F.lit(n.id)).alias(f"l{i}") for i, t in enumerate(MODEL.trees)]).agg(F.count("*").alias("n"))


@query(f"WITH {ROUTED} SELECT o_orderkey, round(CAST(0.1 AS DOUBLE) + s, 6) AS score, round(((1 / (1 + exp(-0.1 - 0.8 * s))) + (1 / (1 + exp(-0.1 - 0.9 * s))) + (1 / (1 + exp(-0.1 - s))) + (1 / (1 + exp(-0.1 - 1.1 * s))) + (1 / (1 + exp(-0.1 - 1.2 * s)))) / 5, 6) AS probability FROM z")
def ensemble_score(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", F.round(MODEL.raw_score(), 6).alias("score"), F.round(MODEL.probability(), 6).alias("probability"))


@query(f"WITH {ROUTED}, g AS (SELECT l1 AS leaf, 1 / (1 + exp(-0.1 - s)) AS p, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM z) SELECT CAST(leaf AS INT) AS leaf, round(-sum(p - y) / (sum(p * (1 - p)) + 0.5 + 1e-12), 6) AS step, count(*) AS n FROM g GROUP BY leaf")
def leaf_steps(spark, sf_dir):
    """A further Newton step of each leaf of the second tree at the fixed model's scores."""
    c = O.OBJECTIVES["LogLoss"].columns(F.col("y"), MODEL.raw_score())
    return schedule.leaf_steps(_orders(spark, sf_dir), MODEL.route(MODEL.trees[1], lambda n: F.lit(n.id)), c["gradient"], c["hessian"], 0.5).withColumn("step", F.round("step", 6))


_W0, _W1, _W2 = "CASE l0 WHEN 1 THEN 0.4 ELSE -0.3 END", "CASE l1 WHEN 1 THEN 0.2 WHEN 3 THEN -0.25 ELSE -0.05 END", "CASE l2 WHEN 1 THEN 0.05 ELSE -0.15 END"


@query(f"""WITH {ROUTED}, k AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y, unnest([0, 1, 2, 3]) AS trees, unnest([CAST(0.1 AS DOUBLE), 0.1 + {_W0}, 0.1 + {_W0} + {_W1}, 0.1 + {_W0} + {_W1} + {_W2}]) AS s FROM z)
SELECT CAST(trees AS INT) AS trees, round(avg(-(y * ln(1 / (1 + exp(-s))) + (1 - y) * ln(1 - 1 / (1 + exp(-s))))), 6) AS loss, count(*) AS n FROM k GROUP BY trees""")
def prefix_losses(spark, sf_dir):
    """The fixed model's mean loss with its first 0, 1, 2 and 3 trees."""
    d = _orders(spark, sf_dir)
    return schedule.prefix_losses(MODEL, d, lambda s: O.OBJECTIVES["LogLoss"].columns(F.col("y"), s)["loss"]).withColumn("loss", F.round("loss", 6))


@query(f"WITH {ROUTED} SELECT tree_id, node_id, count(*) AS n FROM (SELECT 0 AS tree_id, unnest([0, l0]) AS node_id FROM z UNION ALL SELECT 1, unnest(CASE WHEN l1 = 1 THEN [0, 1] ELSE [0, 2, l1] END) FROM z UNION ALL SELECT 2, unnest([0, l2]) FROM z) GROUP BY ALL")
def node_visits(spark, sf_dir):
    return D.node_visits(MODEL, _orders(spark, sf_dir))


@query("SELECT 'price' AS feature, CAST(8 AS DOUBLE) / 11 AS value UNION ALL SELECT 'priority', CAST(3 AS DOUBLE) / 11")
def feature_importance(spark, sf_dir):
    return importance(MODEL.table(spark), "TotalGain")


@query("SELECT tree_id, node_id, split_feature, CAST(gain AS DOUBLE) AS gain FROM (VALUES (0, 0, 'price', 5.0), (1, 0, 'priority', 3.0), (1, 2, 'price', 2.0), (2, 0, 'price', 1.0)) t(tree_id, node_id, split_feature, gain)")
def trees_to_table(spark, sf_dir):
    return MODEL.table(spark).where("not is_leaf").select("tree_id", "node_id", "split_feature", "gain")


@query(f"WITH {ROUTED} SELECT o_orderkey, round(CAST(CASE l0 WHEN 1 THEN 0.4 ELSE -0.3 END + CASE l1 WHEN 1 THEN 0 WHEN 3 THEN -0.15 ELSE 0.05 END + CASE l2 WHEN 1 THEN 0.05 ELSE -0.15 END AS DOUBLE), 6) AS price, CAST(CASE l1 WHEN 1 THEN 0.2 ELSE -0.1 END AS DOUBLE) AS priority, CAST(0.1 AS DOUBLE) AS bias FROM z")
def contributions_weight(spark, sf_dir):
    c = explain.contributions(MODEL, "Weight")
    return _orders(spark, sf_dir).select("o_orderkey", *[F.round(F.get(c, i), 6).alias(n) for i, n in enumerate(("price", "priority", "bias"))])


@query(f"""WITH {ROUTED}, v AS (SELECT o_orderkey, {{w0}} - 0.12 + {{w2}} - 0.01 AS rest, CASE WHEN l1 = 1 THEN 0.2 ELSE -7.5 / 70 END AS known_priority, CASE WHEN price < 50000 THEN -0.25 ELSE -0.05 END AS right_leaf, l1 FROM z),
k AS (SELECT *, 0.06 + 0.7 * right_leaf AS known_price, CASE WHEN l1 = 1 THEN 0.2 ELSE right_leaf END AS known_both, -0.015 AS neither FROM v)
SELECT o_orderkey, round(CAST(rest + ((known_price - neither) + (known_both - known_priority)) / 2 AS DOUBLE), 6) AS price, round(CAST(((known_priority - neither) + (known_both - known_price)) / 2 AS DOUBLE), 6) AS priority, CAST(0.215 AS DOUBLE) AS bias FROM k""".format(w0=_W0, w2=_W2))
def shapley(spark, sf_dir):
    c = explain.contributions(MODEL, "Shapley")
    return _orders(spark, sf_dir).select("o_orderkey", *[F.round(F.get(c, i), 6).alias(n) for i, n in enumerate(("price", "priority", "bias"))])


@query(f"""WITH {ROUTED}, c AS (SELECT o_orderkey, 0.1 + s AS score, {{w0}} - 0.12 + {{w2}} - 0.01 + CASE l1 WHEN 1 THEN 0 WHEN 3 THEN -0.25 + 7.5 / 70 ELSE -0.05 + 7.5 / 70 END AS price, CASE l1 WHEN 1 THEN 0.215 ELSE -7.5 / 70 + 0.015 END AS priority FROM z)
SELECT o_orderkey, CASE WHEN score < 0 THEN CASE WHEN price < 0 AND priority < 0 THEN CASE WHEN price < priority THEN 'price,priority' ELSE 'priority,price' END WHEN price < 0 THEN 'price' WHEN priority < 0 THEN 'priority' ELSE '' END END AS reasons FROM c""".format(w0=_W0, w2=_W2))
def reason_codes(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(explain.reason_codes(MODEL, 0.0), ",").alias("reasons"))


@query("""WITH g AS (SELECT CAST(NULL AS DOUBLE) AS value UNION ALL SELECT min(o_totalprice) + (max(o_totalprice) - min(o_totalprice)) * i / 12 FROM orders, range(13) t(i) GROUP BY i)
SELECT round(value, 4) AS value, round(CAST(0.1 + CASE WHEN value < 150000 THEN 0.4 ELSE -0.3 END + 0.06 + 0.7 * CASE WHEN value < 50000 THEN -0.25 ELSE -0.05 END + CASE WHEN value IS NULL OR value < 250000 THEN 0.05 ELSE -0.15 END AS DOUBLE), 6) AS score FROM g""")
def partial_dependence(spark, sf_dir):
    """The fixed model's score over the range of prices, and where the price is missing."""
    low, high = read_table(spark, sf_dir, "orders").agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    got = explain.partial_dependence(MODEL, "price", [None, *[low + (high - low) * i / 12 for i in range(13)]])
    return spark.createDataFrame([(None if v is None else round(v, 4), round(s, 6)) for v, s in got], "value double, score double")


# a split with a branch of its own for missing values

THREE_WAY = Model(["price", "priority"], "SquaredLoss", 0.0, 1.0, [[_n(0, -1, 0, 0.0, 100, feature=0, value=150000.0, left=1, right=2, missing=3, gain=5.0), _n(1, 0, 1, 0.4, 50), _n(2, 0, 1, -0.3, 35), _n(3, 0, 1, 0.1, 15, feature=1, value=3.0, left=4, right=5, missing=6, gain=1.0), _n(4, 3, 2, 0.15, 8), _n(5, 3, 2, 0.05, 6), _n(6, 3, 2, 0.0, 1)]])


@query("""WITH r AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority FROM orders),
l AS (SELECT CASE WHEN price < 150000 THEN 1 WHEN price IS NOT NULL THEN 2 WHEN priority < 3 THEN 4 WHEN priority IS NOT NULL THEN 5 ELSE 6 END AS leaf FROM r)
SELECT leaf, count(*) AS n, round(CAST(CASE leaf WHEN 1 THEN 0.4 WHEN 2 THEN -0.3 WHEN 4 THEN 0.15 WHEN 5 THEN 0.05 ELSE 0 END AS DOUBLE), 6) AS score FROM l GROUP BY leaf""")
def route_missing_branch(spark, sf_dir):
    leaf = THREE_WAY.route(THREE_WAY.trees[0], lambda n: F.lit(n.id))
    return _orders(spark, sf_dir).groupBy(leaf.alias("leaf")).agg(F.count("*").alias("n"), F.round(F.max(THREE_WAY.raw_score()), 6).alias("score"))


_PS = [f"1 / (1 + exp(-(l_quantity - 25) / {d}))" for d in ("20.0", "-30.0", "40.0")]


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, {", ".join(f"{p} AS p{i}" for i, p in enumerate(_PS))} FROM lineitem), q AS (SELECT *, {", ".join(f"p{i} / power(1 - p{i}, 0.25) / power({r}, 0.25) AS q{i}" for i, r in enumerate((0.5, 0.3, 0.2)))} FROM p)
SELECT l_orderkey, l_linenumber, {", ".join(f"round(q{i} / (q0 + q1 + q2), 6) AS class{i}" for i in range(3))} FROM q""")
def class_probabilities(spark, sf_dir):
    """Probabilities of three classes from those of each against the rest, corrected for odds and priors."""
    d = read_table(spark, sf_dir, "lineitem")
    ps = multi.normalised(F.array(*[P.sigmoid((F.col("l_quantity").cast("double") - 25) / k) for k in (20.0, -30.0, 40.0)]), [0.5, 0.3, 0.2])
    return d.select("l_orderkey", "l_linenumber", ps.alias("ps")).select("l_orderkey", "l_linenumber", *[F.round(F.get("ps", i), 6).alias(f"class{i}") for i in range(3)])


# metrics

SCORED = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y, round(o_totalprice / 3e5 - 0.5, 2) AS s, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS r, 1 + o_orderkey % 3 AS w FROM orders) t"


def _scored(spark, sf_dir):
    d = read_table(spark, sf_dir, "orders")
    return d.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"), F.round(F.col("o_totalprice") / 3e5 - 0.5, 2).alias("s"), F.substring("o_orderpriority", 1, 1).cast("double").alias("r"), (1 + F.col("o_orderkey") % 3).alias("w"))


def _metric(name, fn, sql):
    def run(spark, sf_dir):
        d = fn(_scored(spark, sf_dir))
        return d.select(F.round(d.columns[0], 8).alias(d.columns[0]))

    run.__name__ = f"metric_{name}"
    query(sql)(run)


_metric("rmse", lambda d: M.rmse(d, "y", "s", "w"), f"SELECT round(sqrt(sum(w * power(s - y, 2)) / sum(w)), 8) AS rmse FROM {SCORED}")
_metric("rmsle", lambda d: M.rmsle(d, "y", "s", "w"), f"SELECT round(sqrt(sum(w * power(ln(1 + s) - ln(1 + y), 2)) / sum(w)), 8) AS rmsle FROM {SCORED}")
_metric("logloss", lambda d: M.log_loss(d, "y", "s", "w"), f"SELECT round(sum(w * -(y * ln(1 / (1 + exp(-s))) + (1 - y) * ln(1 - 1 / (1 + exp(-s))))) / sum(w), 8) AS log_loss FROM {SCORED}")
_metric("brier", lambda d: M.brier(d, "y", "s", "w"), f"SELECT round(sum(w * power(1 / (1 + exp(-s)) - y, 2)) / sum(w), 8) AS brier FROM {SCORED}")
_metric("quantile", lambda d: M.quantile_loss(d, "y", "s", 0.3, "w"), f"SELECT round(sum(w * CASE WHEN y >= s THEN 0.3 * (y - s) ELSE -0.7 * (y - s) END) / sum(w), 8) AS quantile_loss FROM {SCORED}")
_metric("auc", lambda d: M.auc(d, "y", "s", "w"), f"WITH g AS (SELECT s, sum(y * w) AS p, sum((1 - y) * w) AS n FROM {SCORED} GROUP BY s), c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp FROM g) SELECT round(sum(n * (tp - p / 2)) / (sum(n) * sum(p)), 8) AS auc FROM c")
_metric("ndcg", lambda d: M.ndcg(d, "o_custkey", "r", "s", "o_orderkey", 5), f"WITH d AS (SELECT o_custkey, power(2, r) - 1 AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY r DESC, o_orderkey) AS b FROM {SCORED}), q AS (SELECT sum(CASE WHEN a <= 5 THEN g / log2(a + 1) ELSE 0 END) AS x, sum(CASE WHEN b <= 5 THEN g / log2(b + 1) ELSE 0 END) AS i FROM d GROUP BY o_custkey) SELECT round(avg(CASE WHEN i > 0 THEN x / i ELSE 0 END), 8) AS ndcg FROM q")

CURVE = f"""e AS (SELECT event_id, row_number() OVER o AS k, count(*) OVER () AS n, sum(w) OVER o AS nt, sum(1 - w) OVER o AS nc, sum(y * w) OVER o AS yt, sum(y * (1 - w)) OVER o AS yc FROM {EVENTS} t WINDOW o AS (ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, (CASE WHEN nt > 0 THEN yt / nt ELSE 0 END - CASE WHEN nc > 0 THEN yc / nc ELSE 0 END) * k AS gain, yt - CASE WHEN nc > 0 THEN yc / nc ELSE 0 END * nt AS qini FROM e)"""


@query(f"WITH {CURVE} SELECT event_id AS row_id, k AS place, round(gain, 6) AS value FROM c")
def uplift_gain_curve(spark, sf_dir):
    return M.uplift_curve(_events(spark, sf_dir), "y", "w", "value", "event_id").withColumn("value", F.round("value", 6))


@query(f"WITH {CURVE} SELECT event_id AS row_id, k AS place, round(qini, 6) AS value FROM c")
def uplift_qini_curve(spark, sf_dir):
    return M.uplift_curve(_events(spark, sf_dir), "y", "w", "value", "event_id", True).withColumn("value", F.round("value", 6))


@query(f"WITH {CURVE} SELECT round(sum(gain / n * CASE WHEN k = n THEN 0.5 ELSE 1 END / n) - (SELECT avg(CASE WHEN w = 1 THEN y END) - avg(CASE WHEN w = 0 THEN y END) FROM {EVENTS} t) / 2, 8) AS auuc FROM c")
def uplift_auuc(spark, sf_dir):
    return M.auuc(_events(spark, sf_dir), "y", "w", "value", "event_id").select(F.round("auuc", 8).alias("auuc"))


@query(f"WITH {CURVE} SELECT round(sum(qini * CASE WHEN k = n THEN 0.5 ELSE 1 END / n) - 0.5 * max(CASE WHEN k = n THEN qini END), 6) AS qini FROM c")
def uplift_qini(spark, sf_dir):
    return M.qini_coefficient(_events(spark, sf_dir), "y", "w", "value", "event_id").select(F.round("qini", 6).alias("qini"))


LABELLED = "(SELECT quality AS y, d.n_chars / (d.n_chars + 2000.0) AS p FROM labels l JOIN documents d USING (doc_id)) t"


def _labelled(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("p"))
    return read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(d, "doc_id")


@query(f"SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(y), 8) AS mean_y, round(avg(p), 8) AS mean_p FROM {LABELLED} GROUP BY 1")
def calibration_curve(spark, sf_dir):
    return M.calibration_curve(_labelled(spark, sf_dir), "y", "p").select("bin", "n", F.round("mean_y", 8).alias("mean_y"), F.round("mean_p", 8).alias("mean_p"))


QUANTILE_BINS = f"WITH k AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM {LABELLED}), c AS (SELECT CAST(len(list_filter(cuts, lambda c: c <= p)) AS INT) AS bin, count(*) AS n, avg(y) AS mean_y, avg(p) AS mean_p FROM {LABELLED}, k GROUP BY 1)"


@query(f"{QUANTILE_BINS} SELECT bin, n, round(mean_y, 8) AS mean_y, round(mean_p, 8) AS mean_p FROM c")
def calibration_curve_quantile(spark, sf_dir):
    got = M.calibration_curve(_labelled(spark, sf_dir), "y", "p", strategy="quantile")
    return got.select("bin", "n", F.round("mean_y", 8).alias("mean_y"), F.round("mean_p", 8).alias("mean_p"))


@query(f"{QUANTILE_BINS} SELECT round(sum(n * abs(mean_y - mean_p)) / sum(n), 8) AS ece FROM c")
def ece_quantile(spark, sf_dir):
    return M.ece(_labelled(spark, sf_dir), "y", "p", strategy="quantile").select(F.round("ece", 8).alias("ece"))


@query(f"WITH c AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(y) AS y, avg(p) AS p FROM {LABELLED} GROUP BY 1) SELECT round(sum(n * abs(y - p)) / sum(n), 8) AS ece FROM c")
def ece(spark, sf_dir):
    return M.ece(_labelled(spark, sf_dir), "y", "p").select(F.round("ece", 8).alias("ece"))


# calibration

def _folds():
    return F.array(*[F.col("l_quantity") / 10 * (0.8 + 0.1 * j) for j in range(5)])


@query("""WITH d AS (SELECT abs(l_extendedprice / 1e4 - l_quantity / 10) / greatest(l_quantity / 10 * sqrt(CAST(0.02 AS DOUBLE)), 1e-6) AS r FROM lineitem), o AS (SELECT r, row_number() OVER (ORDER BY r) AS k, count(*) OVER () AS n FROM d)
SELECT round(r, 5) AS threshold FROM o WHERE k = least(n, ceil((n + 1) * 0.9))""")
def intervals_weight_variance(spark, sf_dir):
    d = read_table(spark, sf_dir, "lineitem")
    q = calibrate.regression_parameters(d, _folds(), F.col("l_quantity") / 10, F.col("l_extendedprice") / 1e4, 0.1, "WeightVariance")
    return spark.createDataFrame([(round(q[0], 5),)], "threshold double")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 10 - 0.985 * l_quantity / 10 * 0.12, 6) AS low, round(l_quantity / 10 + 0.985 * l_quantity / 10 * 0.12, 6) AS high, round(l_quantity / 10 * 0.88, 6) AS grp_low, round(l_quantity / 10 * 1.12, 6) AS grp_high FROM lineitem")
def intervals_range(spark, sf_dir):
    s = F.col("l_quantity") / 10
    a = calibrate.interval(_folds(), s, [0.2, 0.8], "MinMax")
    b = calibrate.interval(_folds(), s, [0.2, 0.8], "GRP")
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(a["low"], 6).alias("low"), F.round(a["high"], 6).alias("high"), F.round(b["low"], 6).alias("grp_low"), F.round(b["high"], 6).alias("grp_high"))


SETS = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, (" + " + ".join(f"1 / (1 + exp(-(l_quantity - 25) / 20 * {0.8 + 0.1 * j:.1f}))" for j in range(5)) + ") / 5 AS p FROM lineitem) t"


def _logits():
    return F.array(*[(F.col("l_quantity") - 25) / 20 * round(0.8 + 0.1 * j, 1) for j in range(5)])


@query(f"WITH o AS (SELECT s, row_number() OVER (ORDER BY s) AS k, count(*) OVER () AS n FROM (SELECT CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM {SETS}) q) SELECT round(s, 6) AS threshold FROM o WHERE k = least(n, ceil((n + 1) * 0.9))")
def conformal_threshold(spark, sf_dir):
    d = read_table(spark, sf_dir, "lineitem")
    t = calibrate.label_threshold(d, _logits(), F.when(F.col("l_returnflag") == "R", 1).otherwise(0), 0.1)
    return spark.createDataFrame([(round(t, 6),)], "threshold double")


@query(f"SELECT CAST(p <= 0.6 AS INT) AS zero, CAST(1 - p <= 0.6 AS INT) AS one, count(*) AS n FROM {SETS} GROUP BY ALL")
def label_sets(spark, sf_dir):
    s = calibrate.label_set(_logits(), 0.6)
    return read_table(spark, sf_dir, "lineitem").groupBy(F.array_contains(s, 0).cast("int").alias("zero"), F.array_contains(s, 1).cast("int").alias("one")).agg(F.count("*").alias("n"))


@query(f"""WITH g AS (SELECT p, sum(y) AS y, count(*) AS n FROM {LABELLED} GROUP BY p), o AS (SELECT row_number() OVER w AS i, sum(y) OVER w AS sy, sum(n) OVER w AS sn, y, n FROM g WINDOW w AS (ORDER BY p)),
m AS (SELECT a.i AS a, b.i AS b, CAST(b.sy - a.sy + a.y AS DOUBLE) / (b.sn - a.sn + a.n) AS v FROM o a JOIN o b ON a.i <= b.i), l AS (SELECT a, b AS i, min(v) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM m)
SELECT DISTINCT round(max(least), 9) AS value FROM l GROUP BY i""")
def isotonic_fit(spark, sf_dir):
    """The levels of the rising step fit of quality on length: for each row the greatest over starts of the least mean to any end."""
    _, ys = calibrate.isotonic(_labelled(spark, sf_dir), "p", "y")
    return spark.createDataFrame(sorted({(round(float(b), 9),) for b in ys}), "value double")


# classes

@query("""WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS t, max(n) * 1.0 / min(n) AS r FROM c), r AS (SELECT label, n, t, r, (1 - b) / (1 - power(b, n)) AS raw FROM (SELECT *, least(greatest(CAST(t - 1 AS DOUBLE) / t, 0.9), 0.99999) AS b FROM c, t))
SELECT label, n, round(CASE WHEN r > 2.5 THEN raw / (SELECT sum(raw * n) / sum(n) FROM r) ELSE 1.0 END, 8) AS weight FROM r""")
def class_weights(spark, sf_dir):
    return multi.class_weights(read_table(spark, sf_dir, "labels"), "toxic").select("label", "n", F.round("weight", 8).alias("weight"))


@query("""WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY toxic), p AS (SELECT n, n / sum(n) OVER () AS p FROM c)
SELECT round(0.75 * (1 - -sum(p * ln(p)) / ln(count(*))) + 0.25 * (1 - min(n) / max(n)), 8) AS balance, round(max(n) / min(n), 8) AS ratio FROM p""")
def class_balance(spark, sf_dir):
    return multi.class_balance(read_table(spark, sf_dir, "labels"), "toxic").select(F.round("balance", 8).alias("balance"), F.round("ratio", 8).alias("ratio"))


# fits

SHORT = Config("LogLoss", iterations=3, max_bin=32, max_nodes=15)


_ONE = "(SELECT l_quantity AS q, l_discount AS d, l_tax AS t, l_extendedprice / 1e4 AS y FROM lineitem)"


@query(f"""WITH b AS (SELECT avg(y) AS base, count(*) AS n FROM {_ONE} o), r AS (SELECT feature, v, base - y AS g FROM (UNPIVOT (SELECT CAST(q AS DOUBLE) AS l_quantity, CAST(d AS DOUBLE) AS l_discount, CAST(t AS DOUBLE) AS l_tax, y FROM {_ONE} o) ON l_quantity, l_discount, l_tax INTO NAME feature VALUE v) u, b),
s AS (SELECT feature, v, sum(sum(g)) OVER w AS lg, sum(count(*)) OVER w AS ln, sum(sum(g)) OVER f AS tg, sum(count(*)) OVER f AS tn FROM r GROUP BY feature, v WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY feature)),
k AS (SELECT *, lg * lg / (ln + 1e-8) + power(tg - lg, 2) / (tn - ln + 1e-8) - tg * tg / (tn + 1e-8) AS gain FROM s WHERE ln > 0 ORDER BY gain DESC LIMIT 1)
SELECT feature AS split_feature, round(v, 6) AS split_value, round(gain, 3) AS gain, round(-lg / (ln + 1e-8) * power(10, -0.5), 6) AS left_weight, round(-(tg - lg) / (tn - ln + 1e-8) * power(10, -0.5), 6) AS right_weight, CAST(ln AS BIGINT) AS left_count, CAST(tn - ln AS BIGINT) AS right_count, round((SELECT base FROM b), 6) AS base FROM k""")
def fit_one_split(spark, sf_dir):
    """The first split that a fit makes of prices, with its leaves."""
    d = read_table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1e4).alias("y"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"))
    m = fit(d, ["l_quantity", "l_discount", "l_tax"], "y", Config("SquaredLoss", iterations=1, max_bin=64, max_nodes=3))
    root, left, right = m.trees[0]
    row = (m.features[root.feature], round(root.value, 6), round(root.gain, 3), round(left.weight, 6), round(right.weight, 6), left.count, right.count, round(m.base_score, 6))
    return spark.createDataFrame([row], "split_feature string, split_value double, gain double, left_weight double, right_weight double, left_count bigint, right_count bigint, base double")


@query()
def fit_binary(spark, sf_dir):
    """A short model on orders: importances."""
    m = fit(_orders(spark, sf_dir), ["price", "priority"], "y", SHORT)
    return importance(m.table(spark)).select("feature", F.round("value", 6).alias("value"))


@query()
def fit_regression(spark, sf_dir):
    """A short model of prices: error of rows by return flag."""
    d = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1e4).alias("y"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"))
    m = fit(d, ["l_quantity", "l_discount", "l_tax"], "y", Config("SquaredLoss", iterations=3, max_bin=32, max_nodes=15))
    return d.groupBy("l_returnflag").agg(F.round(F.avg((F.col("y") - m.raw_score()) ** 2), 6).alias("mse"))


@query()
def fit_scheduled(spark, sf_dir):
    """A model with a schedule from its data's shape, leaves refined, trees damped and their number chosen by rows held out."""
    cfg = Config("LogLoss", iterations=3, max_bin=32, max_nodes=15, scheduled=True, damp=True, holdout=0.2)
    m = fit(_orders(spark, sf_dir), ["price", "priority"], "y", cfg)
    return m.table(spark).select("tree_id", "node_id", "split_feature", F.round("weight", 6).alias("weight"), "count")


def _chi(a: int, b: int, c: str, d: str) -> str:
    return f"CASE WHEN ({c} + {d}) > 0 AND ({a} + {c}) > 0 AND ({b} + {d}) > 0 THEN ({a} + {b} + {c} + {d}) * power({a} * {d} - {b} * {c}, 2) / (CAST({a} + {b} AS DOUBLE) * ({c} + {d}) * ({a} + {c}) * ({b} + {d})) ELSE 0 END"


@query(f"""WITH {ROUTED}, c AS (SELECT {", ".join(f"CAST(count(*) FILTER ({w}) AS DOUBLE) AS {n}" for n, w in {"a1": "l0 = 1", "a2": "l0 = 2", "b1": "l1 = 1", "b2": "l1 <> 1", "b3": "l1 = 3", "b4": "l1 = 4", "c1": "l2 = 1", "c2": "l2 = 2"}.items())} FROM z)
SELECT round(({_chi(60, 40, "a1", "a2")} + {_chi(30, 70, "b1", "b2")} + {_chi(20, 50, "b3", "b4")} + {_chi(80, 20, "c1", "c2")}) / 4, 4) AS data, round(({_chi(60, 40, "a1", "a2")} + {_chi(30, 70, "b1", "b2")} + {_chi(20, 50, "b3", "b4")} + {_chi(80, 20, "c1", "c2")}) / 4, 4) AS concept FROM c""")
def drift_score(spark, sf_dir):
    """How far orders have drifted from the fixed model's counts: at all splits, and at those above leaves."""
    d = _orders(spark, sf_dir)
    both = [D.drift(MODEL, d, kind).select(F.round("drift", 4).alias(kind)) for kind in ("data", "concept")]
    return both[0].crossJoin(F.broadcast(both[1]))  # one row each


@query()
def uplift_t_learner(spark, sf_dir):
    d = _events(spark, sf_dir).withColumn("row_id", F.col("event_id")).withColumn("user", F.col("user_id").cast("double"))
    effect = causal.t_learner(d, ["value", "user"], "w", "y", Config("SquaredLoss", iterations=2, max_bin=16, max_nodes=7))
    return d.groupBy("event_type").agg(F.round(F.avg(effect), 6).alias("effect"))


# models and estimators over whole tables; tests hold their invariants

TINY = Config("SquaredLoss", budget=0.3, iterations=2, max_bin=16, max_nodes=7)
TINY_BINARY = Config("LogLoss", budget=0.3, iterations=2, max_bin=16, max_nodes=7)


def _treated(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).withColumns({"row_id": F.col("event_id"), "user": F.col("user_id").cast("double"), "w": F.col("w").cast("int")})


def _mean_effect(name: str, make):
    def run(spark, sf_dir):
        d = _treated(spark, sf_dir)
        return d.groupBy("event_type").agg(F.round(F.avg(make(d)), 6).alias("effect"))

    run.__name__ = name
    query()(run)


for _name, _make in {
    "effect_s_learner": lambda d: causal.s_learner(d, ["value"], "w", "y", TINY),
    "effect_x_learner": lambda d: causal.x_learner(d, ["value"], "w", "y", TINY, TINY_BINARY),
    "effect_dr_learner": lambda d: causal.dr_learner(d, ["value"], "w", "y", TINY, TINY_BINARY),
    "effect_r_learner": lambda d: causal.r_learner(d, ["value"], "w", "y", TINY, TINY_BINARY).raw_score(),
    "effect_policy": lambda d: (causal.policy_learner(d, ["value"], "w", "y", TINY_BINARY, propensity=TINY_BINARY).raw_score() > 0).cast("double"),
}.items():
    _mean_effect(_name, _make)


@query()
def effect_double_learning(spark, sf_dir):
    """The average effect with both standard errors and its interval."""
    _, ate = causal.dml(_treated(spark, sf_dir), ["value"], "w", "y", TINY)
    return spark.createDataFrame([tuple(round(float(v), 6) for v in ate.values())], [f"{k}" for k in ate])


@query()
def effect_instrument(spark, sf_dir):
    """Outcomes were the treatment set to 0 and to 1, by two stages."""
    d = _treated(spark, sf_dir)
    _, second = causal.iv(d, ["value"], ["user"], "w", "y", TINY)
    parts = [causal.iv_at(d, second, v).agg(F.lit(v).alias("treatment"), F.round(F.avg("outcome"), 6).alias("outcome")) for v in (0.0, 1.0)]
    return parts[0].unionByName(parts[1])


@query()
def fit_fair(spark, sf_dir):
    """Mean probability by group under a parity penalty."""
    d = _orders(spark, sf_dir).withColumn("s", (F.col("priority") <= 2).cast("int"))
    m = causal.fair_classifier(d, ["price", "s"], "y", "s", TINY_BINARY)
    return d.groupBy("s").agg(F.round(F.avg(P.sigmoid(m.raw_score())), 6).alias("probability"))


@query()
def fit_classes_shared(spark, sf_dir):
    """Order status by trees that all classes share: how often each class is meant and found."""
    d = _orders(spark, sf_dir)
    m = multi.fit_shared(d, ["price", "priority"], "o_orderstatus", TINY_BINARY)
    return d.groupBy("o_orderstatus", m.predict().alias("predicted")).agg(F.count("*").alias("n"))


@query()
def fit_ranker(spark, sf_dir):
    """List-wise ranking of a customer's orders by urgency."""
    from timberline.operators.estimators import Ranker

    d = _orders(spark, sf_dir).withColumn("relevance", 5 - F.col("priority"))
    m = Ranker(["price"], TINY_BINARY).fit(d, "relevance", "o_custkey")
    return M.ndcg(m.predict(d, "s"), "o_custkey", "relevance", "s", "row_id").select(F.round("ndcg", 6).alias("ndcg"))


@query()
def fit_missing_branch(spark, sf_dir):
    """Nodes of a model whose splits have a branch of their own for missing values."""
    d = _orders(spark, sf_dir)
    m = fit(d, ["price", "priority"], "y", Config("LogLoss", budget=0.3, iterations=2, max_bin=16, max_nodes=9, missing_branch=True))
    return m.table(spark).select("tree_id", "node_id", "split_feature", "left", "right", "missing", "count")


@query()
def intervals_conformal(spark, sf_dir):
    """Coverage of conformal quantile regression, by a sample held out of its fit."""
    from timberline.operators.sampling import split_rows

    d = _orders(spark, sf_dir).withColumn("t", F.col("price") / 1e5).where("t is not null")
    train, held = split_rows(d, 0.7, "row_id")
    pair = calibrate.fit_quantile_pair(train, held, ["priority"], "t", 0.2, TINY)
    return held.select("t", pair.interval().alias("i")).agg(F.round(F.avg(F.col("t").between(F.col("i.low"), F.col("i.high")).cast("int")), 6).alias("coverage"))


@query()
def predict_draws(spark, sf_dir):
    """Four draws of each order's score."""
    return MODEL.with_draws(_orders(spark, sf_dir), 4, "o_orderkey").select("o_orderkey", "draws")


@query()
def prune_model(spark, sf_dir):
    """The nodes that each way of pruning keeps of the fixed model."""
    d = _orders(spark, sf_dir)
    kinds = ("BottomUp", "TopDown", "Statistical")
    return spark.createDataFrame([(k, sum(len(t) for t in D.prune(Model.from_json(MODEL.to_json()), d, "y", k).trees)) for k in kinds], "kind string, nodes int")


def _refreshed(leaf: str, before: dict[int, tuple[float, int]], prior: str, out: str) -> str:
    """A table of a tree's leaves after a step: SQL over z with the score before the tree in ``prior``."""
    old = " ".join(f"WHEN {k} THEN {w}" for k, (w, _) in before.items())
    cover = " ".join(f"WHEN {k} THEN {c}" for k, (_, c) in before.items())
    sums = f"SELECT {leaf} AS node_id, sum(1 / (1 + exp(-({prior}))) - CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS g, sum(1 / (1 + exp(-({prior}))) * (1 - 1 / (1 + exp(-({prior}))))) AS h, count(*) AS n FROM f GROUP BY 1"
    return f"{out} AS (SELECT CAST(node_id AS INT) AS node_id, CASE node_id {old} END * (1 - h / (h + CASE node_id {cover} END + 1e-8)) + h / (h + CASE node_id {cover} END + 1e-8) * (-g / (h + 1e-8) * 0.3) AS weight, CASE node_id {cover} END + n AS count FROM ({sums}))"


@query(f"""WITH {ROUTED}, f AS (SELECT *, CAST(0.1 AS DOUBLE) AS f0 FROM z), {_refreshed("l0", {1: (0.4, 60), 2: (-0.3, 40)}, "f0", "t0")},
{_refreshed("l1", {1: (0.2, 30), 3: (-0.25, 20), 4: (-0.05, 50)}, "f0 + (SELECT weight FROM t0 WHERE node_id = l0)", "t1")},
{_refreshed("l2", {1: (0.05, 80), 2: (-0.15, 20)}, "f0 + (SELECT weight FROM t0 WHERE node_id = l0) + (SELECT weight FROM t1 WHERE node_id = l1)", "t2")}
SELECT CAST(tree_id AS INT) AS tree_id, node_id, round(weight, 6) AS weight, CAST(count AS BIGINT) AS count FROM (SELECT 0 AS tree_id, * FROM t0 UNION ALL SELECT 1, * FROM t1 UNION ALL SELECT 2, * FROM t2)""")
def refresh_model(spark, sf_dir):
    """The fixed model's leaf weights after a batch of orders."""
    m = D.refresh(Model.from_json(MODEL.to_json()), _orders(spark, sf_dir), "y")
    return m.table(spark).where("is_leaf").select("tree_id", "node_id", F.round("weight", 6).alias("weight"), "count")
