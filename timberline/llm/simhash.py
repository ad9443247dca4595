"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import connected_components, materialize, read_table, spread, whole_row

RADIUS = 4
SHINGLE = 4
#: Neighbours of a shared key that are compared to either side before full variants are emitted.
NEAR = 7
NO_ID = -(2**63)
#: The fingerprint's bits in three blocks. Two fingerprints that differ in at most 4 bits differ in at most 2 on some two blocks.
BLOCKS = ((0, 21), (21, 42), (42, 64))


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's four-word shingles, repeats included: a bit is 1 if set in over half of their XXH64.

    A-Z are lower-cased and ASCII white space bounds words; fewer than four words are one shingle; none give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest, starts = xxhash.xxh64_intdigest, [0, *ends[: 1 - SHINGLE - 1]]
    hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[SHINGLE - 1 :])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 255):  # so many fit a byte
        part = np.unpackbits(hashes[i : i + 255].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(part, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint, signed) of each document; keyed: also text_hash, the XXH64 of its text."""
    rows = spread(docs, ["doc_id", "text"])
    more = ["text_hash"] if keyed else []

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["doc_id", "fp", *more])

    return rows.select("*", *[F.xxhash64("text").alias(c) for c in more]).mapInArrow(run, ", ".join(f"{c} bigint" for c in ["doc_id", "fp", *more]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(bits, flips: range) -> list[int]:
    return [_signed(sum(1 << i for i in c)) for k in flips for c in combinations(bits, k)]


def _longs(xs: list[int]) -> Column:
    return F.lit(xs).cast("array<bigint>")


def _part(x: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(x, 64 - hi), 64 - hi + lo)


def _two_blocks(x: Column, c: Column) -> Column:
    """The two blocks of x other than block c, side by side, and c above them: one number."""
    (_, a), (_, b), _ = BLOCKS
    kept = F.when(c == 0, _part(x, a, 64)).when(c == 1, _part(x, 0, a).bitwiseOR(F.shiftleft(_part(x, b, 64), a))).otherwise(_part(x, 0, b))
    return kept.bitwiseOR(F.shiftleft(c.cast("long"), 60))


def _with_third(key: Column, fp: Column) -> list[Column]:
    """c, and v: a key's blocks in their places with block c of fp."""
    (_, a), (_, b), _ = BLOCKS
    c = F.shiftrightunsigned(key, 60).cast("int")
    kept = _part(key, 0, 60)
    v = F.when(c == 0, F.shiftleft(kept, a).bitwiseOR(_part(fp, 0, a)))
    v = v.when(c == 1, _part(kept, 0, a).bitwiseOR(F.shiftleft(_part(kept, a, 60), b)).bitwiseOR(F.shiftleft(_part(fp, a, b), a)))
    return [c.alias("c"), v.otherwise(kept.bitwiseOR(F.shiftleft(_part(fp, b, 64), b))).alias("v")]


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp at most RADIUS bits apart, whose components are those of all such pairs.

    Each fingerprint emits its variants within half the radius; two within the radius share one, and all that share
    one are within the radius, so each links to the least of them and no pairs are made. Variants are emitted in two
    steps, so that those which can't meet another are never shuffled: first their two-block keys, of which there are
    132 (each choice of two blocks, up to one bit flipped; the other one or two flips are the partner's or the
    third block's); then, only where a key is shared by a fingerprint within the radius, the full 64-bit variants that have it.
    A key has 42 or 43 bits, so among ten thousand million fingerprints most keys are shared by chance: NEAR neighbours to
    either side in a key's order are compared, and a fingerprint with none in the radius goes on only where its key
    holds others farther off. A key is shared by at most 2**22 * 44 fingerprints and a variant by 2081, whatever the input's size.
    """
    masks = [_masks([i for i in range(64) if not lo <= i < hi], range(2)) for lo, hi in BLOCKS]
    picks = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(m).cast("long").alias("m")) for c, ms in enumerate(masks) for m in ms])
    first = fps.select("fp", F.explode(picks).alias("p")).select("fp", _two_blocks(F.col("fp").bitwiseXOR(F.col("p.m")), F.col("p.c")).alias("key"))
    w = Window.partitionBy("key").orderBy("fp")
    shared = first.withColumn("_a", F.lag("fp").over(w)).withColumn("_b", F.lead("fp").over(w)).where("_a is not null or _b is not null").drop("_a", "_b")
    beside = [f("fp", i).over(w).alias(f"_{f.__name__}{i}") for f in (F.lag, F.lead) for i in range(1, NEAR + 2)]
    near = lambda c: F.bit_count(F.col("fp").bitwiseXOR(F.col(c))) <= RADIUS
    close = F.col(f"_lag{NEAR + 1}").isNotNull() | F.col(f"_lead{NEAR + 1}").isNotNull()
    for i in range(1, NEAR + 1):
        close = close | F.coalesce(near(f"_lag{i}"), F.lit(False)) | F.coalesce(near(f"_lead{i}"), F.lit(False))
    shared = shared.select("fp", "key", *beside).where(close)
    shared = shared.select("fp", *_with_third(F.col("key"), F.col("fp")))
    few, more = (F.array(*[_longs(_masks(range(lo, hi), range(n))) for lo, hi in BLOCKS]) for n in (2, 3))
    flips = F.when(F.col("v") == F.col("fp"), F.get(more, "c")).otherwise(F.get(few, "c"))
    second = shared.select("fp", "v", F.explode(flips).alias("m")).select("fp", F.col("v").bitwiseXOR(F.col("m")).alias("v"))
    by = Window.partitionBy("v").orderBy("fp")
    met = second.select(F.col("fp").alias("a"), F.first("fp").over(by).alias("b")).where("a <> b").distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of each document.

    Equal fingerprints are one node, so copies cost no pairs. Texts without words all have fingerprint 0 and are
    linked like any other. Rows with a null doc_id keep it; they count as smaller than all, so a component that
    holds one has a null component_id. Repeated rows stay; long texts count whole; extra columns are ignored; an empty table
    gives none.
    """
    known = materialize(fingerprints(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "fp"), "simhash-fp")
    nodes = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp")), "simhash-cc")
    named = roots.join(nodes, roots.node == nodes.fp).select("fp", "root", "rep")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    whole = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    out = known.join(whole, "fp")
    return out.select(*[F.nullif(c, F.lit(NO_ID)).alias(c) for c in ("doc_id", "component_id")], "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns: that of the smallest doc_id (nulls first), then the smallest XXH64 of its
    text, then the smallest other columns as JSON.

    Components are told apart by fingerprints, never by doc_id, so no row goes for sharing a null or repeated doc_id
    with a row of another component.
    """
    known = materialize(fingerprints(docs, keyed=True).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_k"), "fp", F.col("text_hash").alias("_h")), "simhash-fp")
    nodes = materialize(known.groupBy("fp").agg(F.min(F.struct("_k", "_h")).alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp")), "simhash-cc")
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), "least")
    kept = placed.groupBy("root").agg(F.min("least").alias("least")).select("least._k", "least._h")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    last = F.to_json(F.struct(*rest)) if rest else F.lit("")
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_k"), F.xxhash64(F.col("text").cast("string")).alias("_h"), last.alias("_last"), whole_row(docs))
    return own.join(kept, ["_k", "_h"], "left_semi").groupBy("_k", "_h").agg(F.min_by("_doc", "_last").alias("_doc")).select("_doc.*")


def op7_simhash(spark, sf_dir):
    """Every document's fingerprint and component."""
    got = near_duplicates(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
