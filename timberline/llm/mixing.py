"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import SPACE, WORD, materialize, whole_row

BITS = 20


def fair_shares(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """sizes(sk, source, source_size) with each source's target.

    Sources by code point, null last, take the weights in turn and share the total of all sizes; none
    gets more than max_repeats times its size. The level at which the rest share by weight has a closed
    form: order the sources by cap over weight, and take the first that the level before it leaves under
    its cap. One task sorts the sources; there is one row for each.
    """
    ranked = sizes.withColumn("r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.select("sk", "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), ((F.col("r") - 1) % len(weights) + 1).cast("int")).cast("double").alias("w"), (F.col("source_size") * max_repeats).cast("double").alias("cap"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("w"))
    by = Window.orderBy("ratio", "sk")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    ranked = ranked.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sk", "level"))).over(every)["level"])
    return ranked.select("sk", "source", "source_size", F.least(F.col("w") * F.col("level"), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, bucket_rows: int = 128, seed: str = "", carry: bool = False) -> DataFrame:
    """One row for each document: size, source_size, target, start (its source's words queued before it),
    virtual_finish (of its first copy) and taken (words the mix takes, repeats counted).

    A source's documents queue in the order of a hash, again and again up to max_repeats times. A copy's
    virtual finish time is the source's words up to its end, over the source's target. The mix is the
    global order of finish times up to time 1, when each source has had its target and together they
    have had the budget; the copy that a source has in service at that time is cut there, so
    sources are met to the word.

    A source's running sum is taken in two steps, so that no task holds a source: sums of hash buckets,
    added up in a small table, then a window in a bucket. The hash is of the doc_id, of the text where that is null; rows of
    one doc_id queue by size and text, equal rows one after another. A null or empty text has size 0 and is never
    taken; a very long one counts whole; sources without words have target 0; an empty table gives
    an empty result. With carry, _doc holds the whole row (text crosses the shuffle); else only doc_id and source stay.
    """
    n = docs.count()
    bits = max(0, min(BITS, math.ceil(math.log2(max(1, n) / bucket_rows))))
    own = ["doc_id", "source", "_doc"] if carry else ["doc_id", "source"]
    docs = docs.select("doc_id", "source", "text", whole_row(docs))
    h = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit("null"))))
    rows = docs.select(
        *own,
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.substring(h, 1, 15).alias("_h"),
        F.xxhash64("text").alias("_text"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))).alias("_sk"),
    ).withColumn("_bucket", F.shiftright(F.conv(F.substring("_h", 1, BITS // 4), 16, 10).cast("int"), BITS - bits))
    if not carry:
        rows = materialize(rows, "mix-rows")
    totals = materialize(rows.groupBy("_sk", "source", "_bucket").agg(F.sum("_size").alias("_sum")), "mix-totals")
    shares = fair_shares(totals.groupBy(F.col("_sk").alias("sk"), "source").agg(F.sum("_sum").alias("source_size")), weights, max_repeats)
    shares = materialize(shares.select(F.col("sk").alias("_sk"), "source_size", "target"), "mix-shares")
    running = Window.partitionBy("_sk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select("_sk", "_bucket", (F.sum("_sum").over(running) - F.col("_sum")).alias("_offset")).join(shares, "_sk")
    queue = Window.partitionBy("_sk", "_bucket").orderBy("_h", "doc_id", "_size", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = rows.join(offsets, ["_sk", "_bucket"]).withColumn("start", F.col("_offset") + F.sum("_size").over(queue) - F.col("_size"))
    budget = F.floor("target").cast("long")
    taken = [F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), budget - F.col("start") - F.col("source_size") * e)) for e in range(max_repeats)]
    return got.select(*own, F.col("_size").alias("size"), "source_size", "target", "start", F.when(F.col("target") > 0, (F.col("start") + F.col("_size")) / F.col("target")).alias("virtual_finish"), F.array(*taken).alias("copies"), sum(taken[1:], taken[0]).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the order of virtual finish times: docs' columns, a row for each copy; the one copy in
    service at a source's end is cut after its last word taken, its white space kept. Rows without words aren't in the mix."""
    plan = mix(docs, carry=True, **options)
    copies = plan.select("doc_id", "_doc", "size", "start", "source_size", "target", F.posexplode("copies").alias("_e", "_words")).where("_words > 0")
    text = F.col("_doc.text")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"(?:{SPACE})?{WORD}"), F.lit(0)), 1, F.col("_words").cast("int")), "")
    finish = (F.col("start") + F.col("source_size") * F.col("_e") + F.col("_words")) / F.col("target")
    text = F.when(F.col("_words") < F.col("size"), cut).otherwise(text)
    doc = F.col("_doc").withField("text", text)
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.when(F.col("_words") < F.col("size"), F.length(text).cast("long")).otherwise(F.col("_doc.n_chars")))
    return copies.select(finish.alias("_finish"), "doc_id", doc.alias("_doc")).orderBy("_finish", "doc_id").select("_doc.*")


def op1_mix(spark, sf_dir):
    """Every document with the words that the mix takes of it, in the order of virtual finish times."""
    from timberline.llm.common import read_table

    return mix(read_table(spark, sf_dir, "documents")).orderBy("virtual_finish", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, 'null')), 1, 15) AS h,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS sk
  FROM documents),
s AS (SELECT sk, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
q AS (SELECT *, cap / w AS ratio FROM r),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY ratio, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (ORDER BY ratio, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM q),
v AS (SELECT lv FROM l WHERE lv <= ratio ORDER BY ratio, sk LIMIT 1),
t AS (SELECT sk, source_size, least(w * (SELECT lv FROM v), cap) AS target FROM l),
c AS (SELECT d.*, t.source_size, t.target,
        CAST(sum(d.size) OVER (PARTITION BY d.sk ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start
      FROM d JOIN t USING (sk)),
b AS (SELECT *, CAST(floor(target) AS BIGINT) - start AS room FROM c)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, room)) + greatest(0, least(size, room - source_size)) + greatest(0, least(size, room - 2 * source_size)) AS BIGINT) AS taken,
  CASE WHEN target > 0 THEN (start + size) / target END AS virtual_finish
FROM b
"""
