"""Correction of p-values across families of tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null
from ..plans.staging import attach, stage
from .ordering import group_key, running_counts


def p_adjust(
    df: DataFrame,
    p: str,
    method: str = "fdr",
    within: tuple[str, ...] = (),
    n: int | None = None,
    out: str = "p_adj",
) -> DataFrame:
    """Add Holm, false-discovery-rate or Bonferroni adjusted p-values, per family.

    ``n`` overrides the number of tests. Equal p-values get equal results. A family of any
    size is ranked in order-preserving buckets, with running extrema carried between them.
    The table of p-values is staged first: it is needed several times, and the tests behind it
    should run once.
    """
    if method not in ("holm", "fdr", "bonferroni"):
        raise ValueError(f"unknown method: {method}")
    if method == "bonferroni" and n is not None:
        return df.withColumn(out, F.least(F.lit(1.0), finite_or_null(p) * n))
    df = stage(df)
    if method == "bonferroni":
        sizes = df.groupBy(*within).agg(F.count(finite_or_null(p)).alias("_m"))
        sized = attach(df, sizes, list(within))
        return sized.withColumn(out, F.least(F.lit(1.0), finite_or_null(p) * F.col("_m"))).drop("_m")

    ranked = running_counts(df, within, p)
    tests = F.col("total") if n is None else F.lit(n)
    inside = Window.partitionBy("_key", "_b")
    across = Window.partitionBy("_key")
    if method == "fdr":  # running minimum from the largest p down
        raw, best, last = tests / F.col("upto") * F.col("_v"), F.min, 1.0
        inside, across = inside.orderBy(F.desc("_v")), across.orderBy(F.desc("_b"))
    else:  # running maximum from the smallest p up
        raw, best, last = (tests - F.col("upto") + F.col("w")) * F.col("_v"), F.max, 0.0
        inside, across = inside.orderBy("_v"), across.orderBy("_b")
    ranked = ranked.withColumn("_raw", raw)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranked.groupBy("_key", "_b")
        .agg(best("_raw").alias("_own"))
        .select("_key", "_b", F.coalesce(best("_own").over(before), F.lit(last)).alias("_carry"))
    )
    pick = F.least if method == "fdr" else F.greatest
    adjusted = ranked.join(carried, ["_key", "_b"]).select(
        F.col("_key").alias("_k"),
        F.col("_v").alias("_p"),
        F.least(pick(best("_raw").over(inside), "_carry"), F.lit(1.0)).alias(out),
    )
    keyed = df.withColumns({"_k0": group_key(within), "_p0": finite_or_null(p)})
    same = (F.col("_k0") == F.col("_k")) & (F.col("_p0") == F.col("_p"))
    return keyed.join(adjusted, same, "left").drop("_k0", "_p0", "_k", "_p")
