"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import read_table, sampled, spread

#: Labelled documents that teach, at most about; and the shape of the model.
SAMPLE, ROUNDS, DEPTH, BINS, RATE, RIDGE, LEAST = 24_000, 60, 4, 64, 0.15, 1.0, 8
CLASSES = np.full(256, 7, dtype=np.uint8)
for _i, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b".,;:'\"()-", range(128, 256))):
    CLASSES[list(_set)] = _i
NAMES = ("bytes", "words", "lower", "upper", "digit", "space", "break", "point", "high", "odd", "word_bytes", "distinct", "top_word", "next_word", "run_words", "lines", "line_words", "same_lines", "shouted", "stops", "long_words", "pair_repeat", "letters_only", "bang")


def statistics(text: str | None) -> list[float]:
    """The document statistics of a whole text (null: empty), in the order of NAMES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    kinds = np.bincount(CLASSES[np.frombuffer(raw, dtype=np.uint8)], minlength=8) / n
    words = (text or "").split()
    m = max(1, len(words))
    seen = Counter(words)
    top = seen.most_common(2) + [("", 0)] * 2
    runs = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    k = max(1, len(lines))
    return [np.log1p(len(raw)), np.log1p(len(words)), *kinds, n / m, len(seen) / m, top[0][1] / m, top[1][1] / m, runs / m, np.log1p(len(lines)), m / k, 1 - len(set(lines)) / k, sum(map(str.isupper, words)) / m, raw.count(b".") / m, sum(len(w) > 16 for w in words) / m, 1 - pairs / max(1, len(words) - 1), sum(map(str.isalpha, words)) / m, raw.count(b"!") / m]


@dataclass
class Forest:
    """Trees of one depth as arrays [tree, node], nodes numbered from the root level by level: the feature asked, the value at
    which its right branch begins, and, for the last level, what a leaf adds. All rows go down a level at a time."""

    feature: np.ndarray
    value: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, v, leaf in zip(self.feature, self.value, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] >= v[node])
            logit += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-logit))


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees grown level by level on binned features from sums of gradients and hessians of the log loss."""
    rate = (y.sum() + 1) / (len(y) + 2)
    logit = np.full(len(y), float(np.log(rate / (1 - rate))))
    forest = Forest(np.zeros((ROUNDS, 2**DEPTH - 1), np.int64), np.full((ROUNDS, 2**DEPTH - 1), np.inf), np.zeros((ROUNDS, 2**DEPTH)), logit[0] if len(y) else 0.0)
    if not len(y):
        forest.base = 0.0
        return forest
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T)], axis=1)
    width = x.shape[1] * BINS
    flat = binned + np.arange(x.shape[1]) * BINS
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            at = (node[:, None] * width + flat).ravel()
            size = 2**level * width
            sums = [np.bincount(at, np.repeat(v, x.shape[1]), size).reshape(2**level, x.shape[1], BINS) for v in (g, h, np.ones(len(y)))]
            left = [np.cumsum(s, axis=2)[:, :, :-1] for s in sums]
            whole = [s.sum(axis=2, keepdims=True) for s in sums]
            right = [w - s for w, s in zip(whole, left)]
            gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
            gain[(left[2] < LEAST) | (right[2] < LEAST)] = 0
            best = gain.reshape(2**level, -1).argmax(axis=1)
            f, b = np.divmod(best, BINS - 1)
            good = gain.reshape(2**level, -1).max(axis=1) > 1e-9
            first = 2**level - 1
            for i in np.flatnonzero(good):
                forest.feature[t, first + i] = f[i]
                forest.value[t, first + i] = cuts[f[i]][b[i]] if b[i] < len(cuts[f[i]]) else np.inf
            value, feature = forest.value[t, first : first + 2**level], forest.feature[t, first : first + 2**level]
            node = 2 * node + (x[np.arange(len(y)), feature[node]] >= value[node])
        sums = [np.bincount(node, v, 2**DEPTH) for v in (g, h)]
        forest.leaf[t] = -RATE * sums[0] / (sums[1] + RIDGE)
        logit += forest.leaf[t][node]
    return forest


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (an array, NAMES) of each document."""

    def run(batches):
        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return spread(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id bigint, stats array<double>")


def learnable(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, where: Column, sample: int = SAMPLE) -> Forest:
    """A forest from about ``sample`` labelled documents that meet ``where``, picked by a hash of their ids.

    Only text and quality teach. Of a doc_id's several labels the greatest counts, of its several texts that of the least
    statistics, so a repeated id teaches once. The sample's ids, some 24,000 pairs of numbers, are broadcast; statistics are taken
    of their texts alone.
    """
    known = labels.select("doc_id", "quality").where(where & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    share = min(1.0, sample / max(1, known.agg(F.count_distinct("doc_id")).first()[0]))
    picked = known.where(sampled("doc_id", share)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = spread(docs, ["doc_id", "text"]).where(where & sampled("doc_id", share)).join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    rows = with_statistics(texts).groupBy("doc_id").agg(F.min("stats").alias("stats")).join(F.broadcast(picked), "doc_id").orderBy("doc_id").select("stats", "quality").toArrow()
    x = np.array(rows.column("stats").to_pylist(), dtype=float).reshape(-1, len(NAMES))
    return boost(x, rows.column("quality").to_numpy().astype(float))


def classify(docs: DataFrame, forest: Forest, least: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score is at least ``least``) of each document.

    A null text counts as empty; without labels every score is 0.5. Rows are judged one by one, by their whole text, however
    long; equal texts have equal scores, repeated rows a score each. Extra columns are ignored, an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # some thousand numbers

    def run(batches):
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)], dtype=float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    got = spread(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id bigint, score double")
    return got.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))


def op2_quality(spark, sf_dir):
    """Every document's quality, by a forest of the labelled documents that aren't held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    got = classify(docs, train(docs, labels, learnable(F.col("doc_id"))))
    return got.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
