"""Categorical features: pooling, codes, out-of-fold target means, crosses."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD = 32
JOIN = "\x1f"


def support_threshold(categories: int, rows: int) -> float:
    """Rows a category should have: none asked of small tables, 48 for few categories, else 64."""
    return 0.0 if rows < 128 else 48.0 if categories <= 16 else 64.0


def pool_target(categories: int, rows: int, max_cat: int, threshold: float) -> int:
    return max(1, min(max_cat, categories, 64, int(rows // threshold) if threshold > 0 else categories))


def tail_floor(pooled: int) -> int:
    return 1 if pooled < 4 else min(16, pooled // 4)


def category_counts(df: DataFrame, c: str, y: str | None = None) -> DataFrame:
    """(category, n, total): one row a category; the text "nan" counts as missing."""
    own = F.col(c).cast("string")
    d = df.select(own.alias("category"), (F.col(y).cast("double") if y else F.lit(0.0)).alias("y")).where("category is not null and category <> 'nan'")
    return d.groupBy("category").agg(F.count("*").alias("n"), F.sum("y").alias("total"))


def category_map(df: DataFrame, c: str, max_cat: int = 1000) -> tuple[DataFrame, dict]:
    """(category, code) and how others are coded: native codes are places in sorted order from 1; where categories lack
    support the most frequent have codes of their own and the rest share buckets by their CRC32."""
    counts = category_counts(df, c)
    k, rows = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    threshold, seen = support_threshold(k, rows), {"categories": k, "rows": rows}
    if k <= max_cat and (not k or rows / k >= threshold):
        return counts.select("category", F.row_number().over(Window.orderBy("category")).alias("code")), {"mode": "native", "buckets": 0, "offset": k + 1} | seen
    pooled = pool_target(k, rows, max_cat, threshold or 1.0)
    tail = min(pooled, tail_floor(pooled))
    head = min(HEAD, pooled - tail)
    top = counts.orderBy(F.desc("n"), "category").limit(head)
    return top.select("category", F.row_number().over(Window.orderBy("category")).alias("code")), {"mode": "pooled", "buckets": tail, "offset": head + 1} | seen


def encode(df: DataFrame, c: str, mapping: DataFrame, how: dict, out: str) -> DataFrame:
    """Adds codes: null for missing and, in native mode, for categories not seen at fit."""
    own = F.col(c).cast("string")
    found = df.withColumn("_c", F.when(own != "nan", own)).join(mapping.select(F.col("category").alias("_c"), F.col("code").alias("_code")), "_c", "left")
    other = F.lit(None) if how["mode"] == "native" else F.when(F.col("_c").isNotNull(), how["offset"] + F.crc32("_c") % how["buckets"])
    return found.withColumn(out, F.coalesce("_code", other).cast("int")).drop("_c", "_code")


def signal_score(df: DataFrame, c: str, y: str, threshold: float) -> DataFrame:
    """Count-weighted mean over categories of how far their smoothed target mean lies from the whole's, times confidence."""
    counts = category_counts(df, c, y)
    whole = counts.agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("prior"))
    lift = F.abs((F.col("total") + threshold * F.col("prior")) / (F.col("n") + threshold) - F.col("prior"))
    return counts.crossJoin(F.broadcast(whole)).agg((F.sum(F.col("n") * lift * F.col("n") / (F.col("n") + threshold)) / F.nullif(F.sum("n"), F.lit(0))).alias("signal"))


def fold_of(row_id: Column, folds: int = 5) -> Column:
    return F.pmod(row_id, F.lit(folds)).cast("int")


def target_means(df: DataFrame, bucket: str, y: str, fold: str, smooth: float, out: str) -> DataFrame:
    """Adds the smoothed target mean of a row's bucket over the other folds. Sums by bucket and fold are small next to the rows;
    a bucket's totals come from a window over its five sums, the folds' from a table of five rows, and rows join on both keys."""
    sums = df.groupBy(bucket, fold).agg(F.sum(F.col(y).cast("double")).alias("_y"), F.count(y).alias("_n"))
    rest = [F.sum(c).over(Window.partitionBy()) - F.col(c) for c in ("_fy", "_fn")]  # of five rows
    folds = df.groupBy(fold).agg(F.sum(F.col(y).cast("double")).alias("_fy"), F.count(y).alias("_fn"))
    folds = folds.select(fold, (rest[0] / F.nullif(rest[1], F.lit(0))).alias("_prior"))
    by = Window.partitionBy(bucket)
    mean = (F.sum("_y").over(by) - F.col("_y") + smooth * F.col("_prior")) / F.nullif(F.sum("_n").over(by) - F.col("_n") + F.lit(smooth), F.lit(0.0))
    sums = sums.join(F.broadcast(folds), fold).select(bucket, fold, mean.alias(out))
    return df.join(sums, [bucket, fold], "left")


def full_means(df: DataFrame, bucket: str, y: str, smooth: float) -> DataFrame:
    """(bucket, target_mean) for scoring."""
    sums = df.groupBy(bucket).agg(F.sum(F.col(y).cast("double")).alias("_y"), F.count(y).alias("_n"))
    prior = sums.agg((F.sum("_y") / F.nullif(F.sum("_n"), F.lit(0))).alias("_p"))  # one row
    return sums.crossJoin(F.broadcast(prior)).select(bucket, ((F.col("_y") + smooth * F.col("_p")) / F.nullif(F.col("_n") + F.lit(smooth), F.lit(0.0))).alias("target_mean"))


def cross(a: Column, b: Column) -> Column:
    """Two categories as one; missing where either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(JOIN, a, b))


# fixed values: rows and categories from which a category with support has a target mean besides its codes; the most
# features with which categories are crossed, how many are tried as sources, and how many crosses are kept
MEAN_ROWS, MEAN_CATEGORIES, CROSS_FEATURES, CROSS_SOURCES, CROSSES = 2048, 10, 64, 6, 3
# fixed values: what a source without signal still counts, and how much more a pooled one
CROSS_LEAST, CROSS_POOLED, WIDE = 0.05, 1.15, 128


def wants_mean(how: dict) -> bool:
    """Pooled categories share codes, so their means always help; native ones where there are many with support."""
    k, n = how["categories"], how["rows"]
    return how["mode"] == "pooled" or n >= MEAN_ROWS and k >= MEAN_CATEGORIES and n / k >= support_threshold(k, n)


def best_pairs(kinds: dict[str, dict], signals: dict[str, float]) -> list[tuple[str, str]]:
    """Pairs of categories worth crossing: both with signal, and the smaller with many categories. Pure arithmetic on
    the few numbers known of each, so the pairs of at most six sources are all ranked."""
    fit_for = [c for c, how in kinds.items() if how["rows"] >= MEAN_ROWS and how["categories"] >= 2]
    sources = sorted(fit_for, key=lambda c: (-signals[c], -kinds[c]["categories"], c))[:CROSS_SOURCES]

    def worth(pair: tuple[str, str]) -> float:
        a, b = (kinds[c] for c in pair)
        strength = math.prod(signals[c] + CROSS_LEAST for c in pair) * math.log1p(min(a["categories"], b["categories"]))
        return strength * (CROSS_POOLED if "pooled" in (a["mode"], b["mode"]) else 1.0)

    return sorted(combinations(sources, 2), key=lambda p: (-worth(p), p))[:CROSSES]


def mean_budget(columns: int) -> int:
    """How many target means a wide binary task keeps."""
    return max(8, min(16, round(math.sqrt(columns))))
