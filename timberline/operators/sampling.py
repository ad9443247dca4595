"""Row samples by a hash of a key, so that a lost task draws the same rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def drawn(row_id: str, rate: float | Column, seed: int = 0) -> Column:
    """Whether a row is in a sample of some rate, by 53 bits of a hash, so that no rate rounds to nothing."""
    return F.shiftrightunsigned(F.xxhash64(row_id, F.lit(seed)), 11) < (F.lit(float(rate)) if isinstance(rate, float | int) else rate) * float(2**53)


def split_rows(df: DataFrame, rate: float, row_id: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The sample, and the rest."""
    return df.where(drawn(row_id, rate, seed)), df.where(~drawn(row_id, rate, seed))


def class_sample(df: DataFrame, y: str, rates: dict, row_id: str, seed: int = 0) -> DataFrame:
    """A sample of another rate for each class; classes without one stay whole, rows without a class go."""
    rate = F.lit(1.0)
    for label, r in rates.items():
        rate = F.when(F.col(y) == label, float(r)).otherwise(rate)
    return df.where(F.col(y).isNotNull() & drawn(row_id, rate, seed))


def even_rates(df: DataFrame, y: str, rate: float, least: float = 0.05, most: float = 1.0) -> dict:
    """Rates of classes that together keep about ``rate`` of the rows and all classes as even as ``least`` and ``most`` allow."""
    counts = {r[0]: r[1] for r in df.where(F.col(y).isNotNull()).groupBy(y).count().collect()}
    room, out, open_ = rate * sum(counts.values()), {}, sorted(counts, key=lambda k: (counts[k], str(k)))
    while open_:
        k = open_.pop(0)
        out[k] = min(most, max(least, room / (len(open_) + 1) / counts[k]))
        room = max(0.0, room - out[k] * counts[k])
    return out


def class_label(y: Column) -> Column:
    """The class of a target within 1e-9 of a whole number; else null."""
    whole = F.round(y.cast("double"))
    return F.when((F.abs(y.cast("double") - whole) <= 1e-9) & (F.abs(whole) < 2**31), whole.cast("int"))


def class_weighted(df: DataFrame, y: str, out: str, weight: str | None = None) -> DataFrame:
    """Adds out: a row's weight times its class's, where all targets are classes, of which there are two; else the weight alone."""
    base = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    labelled = df.where(F.col(y).isNotNull()).select(class_label(F.col(y)).alias("label"))
    found = labelled.groupBy("label").count().limit(3).collect()
    if len(found) != 2 or any(r["label"] is None for r in found):
        return df.withColumn(out, base)
    from timberline.operators.multi import class_weights

    factor = F.lit(1.0)
    for r in class_weights(labelled, "label").collect():
        factor = F.when(class_label(F.col(y)) == r["label"], float(r["weight"])).otherwise(factor)
    return df.withColumn(out, base * factor)
