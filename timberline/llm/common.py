"""Shared plumbing: table access, lineage cuts in the cluster's shared folder, connected components."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word as white space in ASCII bounds it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, local mode takes a temporary one; a cluster must name it,
    since a folder of one machine would lose what the others write."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths of the tables written by this process and not yet removed.
WRITTEN: list[str] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table that ``materialize`` wrote; frames that read it are spent."""
    WRITTEN.remove(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(spark: SparkSession, since: int = 0) -> None:
    """Removes all tables written since there were ``since`` of them: for the end of a job whose results are stored."""
    for path in WRITTEN[since:]:
        remove(spark, path)


def sampled(key: str, share: float):
    """Whether a row is in a sample of some share by a hash of its key, of 64 bits, so that no share of a large table
    rounds to nothing."""
    return F.xxhash64(key) <= F.lit(min(2**63 - 1, math.ceil(share * 2**64) - 2**63))


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns alone, those df lacks as nulls; any others, clashing names included, are left out."""
    kinds = {"doc_id": "bigint", "n_chars": "bigint", "vec_id": "bigint", "conv_id": "bigint", "turn": "bigint"}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in columns])


def whole_row(df: DataFrame):
    """df's row as one column, _doc, so that no column of it clashes with an operator's own; ``_doc.*`` restores it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc")


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds until nothing changes. Each is an aggregate with map-side combine and a
    join on its result, so that a hub's rows can be split; a round's edges go to the shared folder, those of the round
    before it are removed, and only a count and a checksum come to the driver.
    """

    def checksum(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    def stars(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(least, "a")
        small = kept.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return small.distinct()

    spark, seen = edges.sparkSession, None
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), tag)
    now = checksum(e)
    while now[0] and now != seen:
        last, seen = WRITTEN[-1], now
        e = materialize(stars(e), tag)
        now = checksum(e)
        remove(spark, last)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
