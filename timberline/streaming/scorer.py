"""Streams: scoring is stateless, so a model's columns work on a stream as they are; visits are counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.trainer import Config, fit
from timberline.operators.tree import Model


def score_stream(model: Model, stream: DataFrame, out: str = "score") -> DataFrame:
    return stream.withColumn(out, model.raw_score())


def windowed_visits(model: Model, stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(window, tree_id, leaf, n) for watching drift: state is bounded by the watermark and the number of leaves."""
    d = stream.withWatermark(time, late)
    leaves = F.array(*[F.struct(F.lit(i).alias("tree_id"), model.route(t, lambda n: F.lit(n.id)).alias("leaf")) for i, t in enumerate(model.trees)])
    return d.select(time, F.explode(leaves).alias("l")).groupBy(F.window(time, width), F.col("l.tree_id"), F.col("l.leaf")).agg(F.count("*").alias("n"))


def refit_batches(stream: DataFrame, features: list[str], y: str, cfg: Config, hold: dict, checkpoint: str):
    """A query that goes on from ``hold["model"]`` with each micro-batch's trees."""

    def run(batch: DataFrame, _epoch: int) -> None:
        if not batch.isEmpty():
            hold["model"] = fit(batch, features, y, cfg, start=hold.get("model"))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
