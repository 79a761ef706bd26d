"""Exact order statistics of groups of any size.

A plain window over a group would sort the whole group in one task. Here values are put in
buckets that follow their order, equal values are merged into one row with a count, and running
counts are kept in two steps: over the few buckets, then inside each bucket. No task sorts more
than one bucket of one group. Quantiles look only into the buckets that hold a wanted rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .cells import with_values

_FINE = 256  # buckets per power of two
MOST = 200_000  # rows of different values in a bucket


def value_bucket(v: Column) -> Column:
    """Integer that never falls as ``v`` rises: a step of the logarithm, mirrored below zero."""
    step = F.floor(F.least(F.log2(F.abs(v)), F.lit(1025.0)) * _FINE) + 1100 * _FINE
    return F.coalesce(F.signum(v) * step, F.lit(0.0)).cast("long")


def group_key(by: list[str] | tuple[str, ...]) -> Column:
    """Grouping columns as one struct: NULLs compare equal and joins stay plain equi-joins."""
    return F.struct(*[F.col(c) for c in by]) if by else F.lit(0)


def _bucketed(
    df: DataFrame, by: list[str] | tuple[str, ...], value: str, most: int = MOST
) -> DataFrame:
    """Rows ``_key, _v, _b`` with buckets ``_b`` that follow the order of the values.

    The first cut is a step of the logarithm. Any bucket of more than ``most`` rows with different
    values is cut again between its own smallest and largest value, until none is left; so a
    bucket is bounded wherever a group's values lie. Rows are staged: they are read several times.
    """
    rows = with_values(df, [], value).select(
        group_key(by).alias("_key"), F.col(value).cast("double").alias("_v")
    )
    rows = rows if hasattr(df, "_phenogrid_path") else stage(rows)
    rows = rows.withColumn("_b", F.array(value_bucket(F.col("_v"))))
    while True:
        sizes = rows.groupBy("_key", "_b").agg(
            F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        parts = F.ceil(F.col("_n") / (most / 4)).cast("long").alias("_parts")
        full = stage(sizes.where((F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))).select("*", parts))
        if full.isEmpty():
            return rows
        step = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_parts"))
        step = F.least(step, F.col("_parts") - 1)
        finer = F.when(F.col("_parts").isNull(), F.col("_b")).otherwise(F.concat("_b", F.array(step)))
        rows = stage(rows.join(full, ["_key", "_b"], "left").select("_key", "_v", finer.alias("_b")))


def _bucket_starts(rows: DataFrame) -> DataFrame:
    """Rows before each bucket, in it (``bw``), and in the whole group. Counted map-side, so the
    shuffle carries one row per task and bucket."""
    across = Window.partitionBy("_key")
    counts = rows.groupBy("_key", "_b").agg(F.count("*").alias("bw"))
    return counts.select(
        "_key",
        "_b",
        "bw",
        (F.sum("bw").over(across.orderBy("_b")) - F.col("bw")).alias("_before"),
        F.sum("bw").over(across).alias("total"),
    )


def _with_running_count(rows: DataFrame, starts: DataFrame, carry: list[str]) -> DataFrame:
    merged = rows.groupBy("_key", "_b", "_v").agg(F.count("*").alias("w"))
    inside = Window.partitionBy("_key", "_b").orderBy("_v")
    joined = merged.join(starts.select("_key", "_b", "_before", *carry), ["_key", "_b"])
    return joined.withColumn("upto", F.col("_before") + F.sum("w").over(inside)).drop("_before")


def running_counts(df: DataFrame, by: list[str] | tuple[str, ...], value: str) -> DataFrame:
    """One row per group and distinct value: ``_key, _v, _b, w, upto, total``.

    ``w`` rows hold the value, ``upto`` rows hold it or a smaller one, ``total`` rows are in
    the group. Missing values are left out.
    """
    rows = _bucketed(df, by, value)
    return _with_running_count(rows, _bucket_starts(rows), ["total"])


def quantile_points(
    df: DataFrame, by: list[str] | tuple[str, ...], value: str, probs: list[float]
) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbours, as rows ``_key, n, i, q``
    with ``i`` the place in ``probs``.

    The first scan counts buckets. The second keeps only the rows of buckets that hold a wanted
    rank (a broadcast filter while those buckets are few), so little is shuffled or sorted.
    """
    rows = _bucketed(df, by, value)
    place = (F.col("total") - 1).cast("double")

    def goal(p: Column, i: Column) -> Column:
        at = place * p
        return F.struct(
            i.alias("i"), (F.floor(at) + 1).alias("lo"), (F.ceil(at) + 1).alias("hi"), (at - F.floor(at)).alias("part")
        )

    def within(rank: Column, before: Column, size: Column) -> Column:
        return (rank > before) & (rank <= before + size)

    goals = F.transform(F.lit([float(p) for p in probs]), goal)
    near = lambda before, size: lambda g: within(g["lo"], before, size) | within(g["hi"], before, size)
    wanted = (
        _bucket_starts(rows)
        .withColumn("goals", F.filter(goals, near(F.col("_before"), F.col("bw"))))
        .where(F.size("goals") > 0)
        .drop("bw")
    )
    wanted = stage(wanted)
    kept = rows.join(wanted.select("_key", "_b"), ["_key", "_b"], "left_semi")
    counted = _with_running_count(kept, wanted, ["total", "goals"])
    before = F.col("upto") - F.col("w")
    hits = counted.select(
        "_key", "_v", "total", "w", before.alias("before"),
        F.explode(F.filter("goals", near(before, F.col("w")))).alias("g"),
    )
    ends = hits.groupBy("_key", F.col("g.i").alias("i")).agg(
        F.max("total").alias("n"),
        F.max(F.when(within(F.col("g.lo"), F.col("before"), F.col("w")), F.col("_v"))).alias("lo"),
        F.max(F.when(within(F.col("g.hi"), F.col("before"), F.col("w")), F.col("_v"))).alias("hi"),
        F.max("g.part").alias("part"),
    )
    return ends.select("_key", "n", "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("q"))


def group_quantiles(
    df: DataFrame, by: list[str] | tuple[str, ...], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles, one column per name, beside the count ``n``."""
    points = quantile_points(df, by, value, list(probs.values()))
    named = [F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(probs)]
    wide = points.groupBy("_key").agg(F.max("n").alias("n"), *named)
    return wide.select(*[F.col("_key")[c].alias(c) for c in by], "n", *probs)
