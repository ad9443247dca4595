"""Weighted percentiles, cuts and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets that an ordered pass over one feature is split into; ranks that a sketch of percentiles keeps for each of its points.
BUCKETS, RANKS = 64, 100
#: Distinct values of a feature that one task orders; values that the driver orders; ranks that a sketch tells apart.
ORDERED, GATHERED, SKETCH = 200_000, 100_000, 10_000


def _number(v: str) -> Column:
    """v as a double, null where it is missing."""
    d = F.col(v).cast("double")
    return F.when(~F.isnan(d), d)


def _sketched(values: list[str], points: int, ranks: int = RANKS) -> list[Column]:
    """For each feature its percentiles at i/points, from one mergeable sketch a feature and no shuffle of values."""
    ps = F.lit([i / points for i in range(1, points + 1)])
    return [F.percentile_approx(_number(v), ps, points * ranks).alias(v) for v in values]


def weighted_percentiles(df: DataFrame, values: list[str], percents: list[float], w: str | None = None) -> DataFrame:
    """(feature, p, value): the least value whose share of cumulative weight reaches p. Exact.

    Equal values are summed before the ordered pass. Where a feature has over ORDERED distinct values, that pass is split
    at sketched percentiles, so that a task holds a share of them: each bucket starts from the weight of those before it,
    of which there are at most 65 a feature. The result is the same either way, wherever the buckets' bounds lie.
    """
    k = F.lit(1.0) if w is None else F.col(w)
    long = df.select(k.alias("w"), F.inline(F.array(*[F.struct(F.lit(v).alias("feature"), _number(v).alias("v")) for v in values]))).where("v is not null")
    sums = long.groupBy("feature", "v").agg(F.sum("w").alias("w"))
    every = Window.partitionBy("feature")
    upto = lambda by: by.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if max(df.agg(*[F.approx_count_distinct(_number(v)) for v in values]).first()) <= ORDERED:
        share = F.sum("w").over(upto(every)) / F.nullif(F.sum("w").over(every), F.lit(0.0))
        shares = sums.select("feature", "v", share.alias("share"))
    else:
        at = df.agg(*_sketched(values, BUCKETS, 4)).first().asDict()
        bucket = F.coalesce(*[F.when(F.col("feature") == v, map_bin(F.col("v"), sorted(set(at[v] or [])))) for v in values])
        sums = sums.withColumn("bucket", bucket)
        before = sums.groupBy("feature", "bucket").agg(F.sum("w").alias("own"))
        before = before.select("feature", "bucket", F.sum("own").over(every.orderBy("bucket")).alias("upto"), "own", F.sum("own").over(every).alias("total"))
        inside = sums.withColumn("inside", F.sum("w").over(upto(Window.partitionBy("feature", "bucket")))).join(F.broadcast(before), ["feature", "bucket"])  # at most 65 rows a feature
        shares = inside.select("feature", "v", ((F.col("upto") - F.col("own") + F.col("inside")) / F.nullif("total", F.lit(0.0))).alias("share"))
    return shares.withColumn("p", F.explode(F.lit(percents))).where("share >= p").groupBy("feature", "p").agg(F.min("v").alias("value"))


def order_statistics(df: DataFrame, v: str, places: list[int], n: int) -> list[float]:
    """The values at some places (from 1) of a column's n values in order. Exact, and no value is shuffled: a sketch brackets each
    place, one aggregate counts what lies below the bracket, and what lies within, some four in SKETCH
    of the values a pass, is ordered on the driver once it is at most GATHERED values."""
    return _at_places(df.select(_number(v).alias("v")).where("v is not null"), [min(max(k, 1), n) for k in places], n)


def _at_places(d: DataFrame, places: list[int], n: int) -> list[float]:
    if n <= GATHERED:
        values = d.agg(F.sort_array(F.collect_list("v"))).first()[0]
        return [values[k - 1] for k in places]
    ps = [min(max((k - 0.5) / n + e * 2 / SKETCH, 0.0), 1.0) for k in places for e in (-1, 1)]
    at = d.agg(F.percentile_approx("v", ps, SKETCH)).first()[0]
    ends = [(at[2 * i], at[2 * i + 1]) for i in range(len(places))]
    counts = d.agg(*[F.count_if(c) for low, high in ends for c in (F.col("v") < low, F.col("v") <= low, F.col("v") < high, F.col("v") <= high)]).first()
    out = []
    for i, (k, (low, high)) in enumerate(zip(places, ends)):
        under, upto_low, under_high, upto = counts[4 * i : 4 * i + 4]
        if under < k <= upto_low:
            out.append(low)
        elif under_high < k <= upto:
            out.append(high)
        else:  # within the bracket, or, should the sketch have missed, outside it
            part, before, rows = (d.where(F.col("v") < low), 0, under) if k <= under else (d.where(F.col("v") > high), upto, n - upto) if k > upto else (d.where((F.col("v") > low) & (F.col("v") < high)), upto_low, under_high - upto_low)
            out.append(_at_places(part, [k - before], rows)[0])
    return out


def cuts(df: DataFrame, values: list[str], bins: int = 256, w: str | None = None) -> DataFrame:
    """(feature, cuts): sorted distinct percentiles at i/bins, or the distinct values where there are at most bins + 1."""
    few = df.select(*[F.approx_count_distinct(v, 0.01).alias(v) for v in values]).first().asDict()
    exact = _distinct(df, few, bins)
    rest = [v for v in values if v not in exact]
    parts = [df.sparkSession.createDataFrame([(v, c) for v, c in exact.items()], "feature string, cuts array<double>")] if exact else []
    if rest:
        parts.append(weighted_percentiles(df, rest, [i / bins for i in range(1, bins + 1)], w).groupBy("feature").agg(F.sort_array(F.collect_set("value")).alias("cuts")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _distinct(df: DataFrame, few: dict[str, int], bins: int) -> dict[str, list[float]]:
    """Sorted distinct values of the features that have at most bins + 1 of them, given estimates of how many there are."""
    small = [v for v, n in few.items() if n <= 2 * bins + 2]
    if not small:
        return {}
    row = df.select(*[_values(v, bins).alias(v) for v in small]).first()
    return {v: row[v] for v in small if len(row[v]) <= bins + 1}


def _values(v: str, bins: int) -> Column:
    """Sorted distinct values, cut off where there are too many to be bins."""
    return F.slice(F.sort_array(F.collect_set(_number(v))), 1, 2 * bins + 8)


def sketched_cuts(df: DataFrame, values: list[str], bins: int = 256) -> dict[str, list[float]]:
    """cuts for training: two aggregates that shuffle no values, one to count distinct values and one to take those of
    features with few and sketch percentiles of those with more. Distinct values are exact, percentiles are off by at
    most a hundredth of a bin's rows, which moves a cut to a neighbouring value."""
    few = df.agg(*[F.approx_count_distinct(_number(v), 0.02).alias(v) for v in values]).first().asDict()
    small = [v for v in values if few[v] <= bins]
    row = df.agg(*[_values(v, bins).alias(v) for v in small], *[c for v, c in zip(values, _sketched(values, bins)) if v not in small]).first().asDict()
    return {v: row[v] if v in small and len(row[v]) <= bins + 1 else _thinned(row[v], bins) if v in small else sorted(set(row[v] or [])) for v in values}


def weighted_cuts(df: DataFrame, values: list[str], bins: int, w: str) -> dict[str, list[float]]:
    """cuts for training on weighted rows: percentiles of weight, exact, so that rare rows of high weight have cuts of their own."""
    got = {r["feature"]: r["cuts"] for r in cuts(df, values, bins, w).collect()}
    return {v: got.get(v) or [] for v in values}


def _thinned(xs: list[float], bins: int) -> list[float]:
    """Where an estimate was too low: as many of the distinct values as there are bins, evenly."""
    return sorted({xs[(i * len(xs) - 1) // bins] for i in range(1, bins + 1)})


def map_bin(v: Column, c: list[float]) -> Column:
    """How many cuts are at most v; 0 for missing values. Cuts are a literal, bounded by the number of bins."""
    at = F.size(F.filter(F.lit([float(x) for x in c]).cast("array<double>"), lambda x: x <= v))
    return F.when(v.isNull() | F.isnan(v.cast("double")), 0).otherwise(at)


def apply_cuts(df: DataFrame, cut_of: dict[str, list[float]], prefix: str = "b_") -> DataFrame:
    return df.withColumns({prefix + v: map_bin(F.col(v), c) for v, c in cut_of.items()})


def weighted_median(df: DataFrame, v: str, w: str) -> DataFrame:
    return weighted_percentiles(df, [v], [0.5], w).select(F.col("value").alias("weighted_median"))
