"""Document fingerprints: sketches of word shingles under one threshold. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import SPACE, read_table, spread

#: One in so many shingle hashes is kept. At 1 all are, so likeness is exact for short texts too (but for 32-bit collisions).
SCALE = 1
SHINGLE = 5


def with_sketch(df: DataFrame, text: str, out: str, scale: int = SCALE) -> DataFrame:
    """Adds out: the sorted distinct 32-bit hashes under 2**32 / scale of the five-word shingles of a column.

    Words are lower-cased and bounded by ASCII white space; fewer than five make one shingle, none make none.
    A sketch keeps every hash under the threshold, so the union of two sketches is the sketch of both
    documents, and containment is estimated alike whatever their lengths.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), "")
    df = df.withColumn("_wh", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_wh")
    one = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get("_wh", i + k) for k in range(SHINGLE)]), 32)
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))))
    kept = F.filter(F.transform(starts, one), lambda h: h < (1 << 32) // scale)
    return df.withColumn(out, F.sort_array(F.array_distinct(kept))).drop("_wh")


def printed(sketch: Column, text: Column) -> Column:
    """The sketch as a string: the text's hash, then the sketch's in hexadecimal. Equal texts give equal strings."""
    hexed = F.transform(sketch, lambda h: F.lower(F.hex(h)))
    return F.concat(F.lower(F.hex(F.xxhash64(F.coalesce(text, F.lit(""))))), F.lit("|"), F.array_join(hexed, ","))


def likeness(a: Column, b: Column, a_text: Column, b_text: Column) -> Column:
    """Containment of the smaller sketch in the larger; where either is empty, 1 for equal texts, else 0."""
    least = F.least(F.size(a), F.size(b))
    same = F.xxhash64(F.coalesce(a_text, F.lit(""))) == F.xxhash64(F.coalesce(b_text, F.lit("")))
    return F.when(same, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least).cast("double")


def _between(c: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are at most c (null: 0), in two steps of about the square root of their number."""
    if not splits:
        return F.lit(0)
    step = max(1, math.isqrt(len(splits)))
    parts = [splits[i : i + step] for i in range(0, len(splits), step)]
    longs = lambda xs: F.lit(xs).cast("array<bigint>")
    coarse = F.size(F.filter(longs([p[0] for p in parts]), lambda s: s <= c))
    fine = F.element_at(F.array(*map(longs, parts)), coarse)
    return F.when(c.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda s: s <= c)))


def with_next(docs: DataFrame, columns: list[str], rows_a_bucket: int = 2048, most: int = 16384) -> DataFrame:
    """Adds next_<c> for each of columns: that of the document after this one by doc_id (nulls first), then text;
    after the last, the first.

    No task sorts the whole table: documents go to ranges of doc_id, bounded by approximate quantiles, whose first
    document is also sent to the range before it (that of all, to the last). Only bounds come to the driver, at most
    ``most`` of them.
    """
    n, low, nulls = docs.agg(F.count("*"), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    k = min(most, n // rows_a_bucket)
    splits: list[int] = []
    if k > 1:
        splits = sorted({x for x in docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(10000, 10 * k))).first()[0] or []})
    b = docs.withColumn("_b", _between(F.col("doc_id"), splits)).withColumn("_g", F.lit(0))
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(low)
    starts = F.lit(False) if not splits else (F.col("_b") > 0) & (F.element_at(F.lit(splits).cast("array<bigint>"), F.greatest(F.col("_b"), F.lit(1))) == F.col("doc_id"))
    places = F.filter(F.array(F.struct("_b", F.lit(0).alias("_g")), F.when(starts, F.struct((F.col("_b") - 1).alias("_b"), F.lit(1).alias("_g"))), F.when(first, F.struct(F.lit(len(splits)).alias("_b"), F.lit(2).alias("_g")))), lambda x: x.isNotNull())
    b = b.withColumn("_p", F.explode(places)).withColumn("_b", F.col("_p._b")).withColumn("_g", F.col("_p._g"))
    w = Window.partitionBy("_b").orderBy("_g", F.col("doc_id").asc_nulls_first(), "text")
    for c in columns:
        b = b.withColumn(f"next_{c}", F.lead(c).over(w))
    return b.where("_g = 0").drop("_b", "_g", "_p")


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id, text, sketch of each document. A null text counts as empty."""
    return with_sketch(spread(docs, ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit(""))), "text", "sketch", scale)


def op8_fingerprint(spark, sf_dir):
    """Every document's fingerprint, that of its edited text, and how like they and the next document's are."""
    d = spread(read_table(spark, sf_dir, "documents"), ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    d = with_next(d, ["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    for c, out in (("text", "sketch"), ("edited", "edited_sketch"), ("next_text", "next_sketch")):  # after the shuffle: sketches are larger than texts
        d = with_sketch(d, c, out)
    text, edited = F.col("text"), F.col("edited")
    return d.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch"), text).alias("fingerprint"),
        printed(F.col("edited_sketch"), edited).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), text, edited).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), text, F.col("next_text")).alias("near_next"),
    )
