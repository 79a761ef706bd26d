"""Bounded samples of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage


def hash_sample(df: DataFrame, text: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of different texts: those whose text has the smallest hashes, so the
    choice depends on the texts alone. Adds ``_h``. NULL texts are never chosen. Two scans; what
    reaches the driver is one number."""
    hashed = df.where(F.col(text).isNotNull()).withColumn("_h", F.xxhash64(text))
    first = hashed.select("_h").distinct().orderBy("_h").limit(rows)
    top = first.agg(F.max("_h")).first()[0]
    return hashed.where(F.col("_h") <= F.lit(top)) if top is not None else hashed.where("false")


def labelled_sample(docs: DataFrame, key: str, text: str, marks: DataFrame, label: str, rows: int) -> DataFrame:
    """``(text, label, _h)``: for each of the labels 0 and 1 in ``marks(key, label)`` at most ``rows``
    different texts, those with the smallest hashes.

    Keys, hashes and labels are joined first, without the texts; the chosen ones, at most
    ``2 * rows`` short rows, are then broadcast to fetch their texts. NULL texts are never chosen.
    """
    narrow = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.xxhash64(text).alias("_h"))
    known = narrow.join(marks.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")), "_k")
    # of the rows with one text and label, one stands for all
    single = known.where("_y in (0, 1)").groupBy("_y", "_h").agg(F.min("_k").alias("_k"))
    parts = [single.where(F.col("_y") == y).orderBy("_h").limit(rows) for y in (0, 1)]
    chosen = stage(parts[0].union(parts[1]))
    told = docs.select(F.col(key).alias("_k"), F.col(text).alias("text"))
    met = told.join(F.broadcast(chosen), ["_k"]).where(F.xxhash64("text") == F.col("_h"))
    return met.select("text", F.col("_y").alias(label), "_h").dropDuplicates(["_h", label])
