"""Tables: reading, cutting lineage through the shared folder, feature specifications, model files."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables written by this process and not yet removed.
WRITTEN: list[str] = []


def cut_lineage(df: DataFrame, tag: str) -> DataFrame:
    """Writes df into the folder of ``spark.checkpoint.dir`` and reads it back; survives lost executors. Where the folder is unset,
    local mode takes a temporary one; a cluster must name it."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Removes the tables written since there were ``since`` of them, but for the last ``keep``; frames that read them are spent."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in WRITTEN[since : len(WRITTEN) - keep]:
        WRITTEN.remove(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@dataclass
class FeatureSpec:
    """Names and kinds of features, taken from a frame at fit and checked at scoring."""

    numeric: list[str]
    categorical: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, df: DataFrame, features: list[str], categorical: list[str] | str = "auto") -> FeatureSpec:
        kinds = {f.name: f.dataType for f in df.schema}
        cats = [f for f in features if not isinstance(kinds[f], NumericType)] if categorical == "auto" else list(categorical)
        return cls([f for f in features if f not in cats], cats)

    @property
    def names(self) -> list[str]:
        return self.numeric + self.categorical

    def check(self, df: DataFrame) -> None:
        if gone := [f for f in self.names if f not in df.columns]:
            raise ValueError(f"features missing: {', '.join(gone)}")


def normalised(df: DataFrame, features: list[str], missing: float | None = None) -> DataFrame:
    """Features as doubles with null for missing values (NaN, or the configured value)."""
    v = lambda c: F.col(c).cast("double")
    gone = lambda c: F.isnan(v(c)) if missing is None else F.isnan(v(c)) | (v(c) == missing)
    return df.withColumns({c: F.when(~gone(c), v(c)) for c in features})


def classes_of(df: DataFrame, y: str, most: int = 4096) -> list:
    """Sorted class labels, of which there are at most ``most``."""
    got = sorted(r[0] for r in df.select(y).where(F.col(y).isNotNull()).distinct().limit(most + 1).collect())
    if len(got) > most:
        raise ValueError(f"{y} has over {most} classes")
    return got


def save_json(document: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(document, f)


def load_json(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
