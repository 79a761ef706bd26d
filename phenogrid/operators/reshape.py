"""Wide and long forms, stacking, ordering and selection of top rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import listed, no_clash

_SINGLE = {
    "mean": F.avg,
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "first": F.first,
    "sd": F.stddev_samp,
}


def to_long(
    df: DataFrame, ids: list[str], columns: list[str], feature: str = "feature", value: str = "value"
) -> DataFrame:
    return df.unpivot(ids, columns, feature, value)


def to_wide(
    df: DataFrame, ids: list[str], feature: str, value: str, levels: list, agg: str = "max", others: bool = True
) -> DataFrame:
    """One column per level. Levels are given, so no job runs to discover them; a row with a level
    that is not listed is an error, or is left out with ``others=False``."""
    if others:
        df = df.withColumn(feature, listed(feature, levels))
    return df.groupBy(*ids).pivot(feature, levels).agg(_SINGLE[agg](value))


def explode_keys(df: DataFrame, col: str, sep: str = r",\s*") -> DataFrame:
    """One row per part of a multi-valued cell such as ``"98, 100"``; a NULL cell keeps its row."""
    return df.withColumn(col, F.explode_outer(F.split(F.col(col), sep)))


def stats_wide(
    df: DataFrame,
    rows: list[str],
    names: list[str],
    stats: dict[str, Column],
    levels: list[str],
    stat_first: bool = True,
    others: bool = True,
) -> DataFrame:
    """Several statistics by one or two name columns, as ``stat_level`` or ``level_stat``.

    One aggregation; ``levels`` lists the joined names (``a`` or ``a_b``) in output order. A name
    that is not listed is an error, or is left out with ``others=False``.
    """
    name = F.concat_ws("_", *[F.col(c) for c in names])
    df = df.withColumn("_name", name)
    if others:
        df = df.withColumn("_name", listed("_name", levels))
    wide = (
        df
        .groupBy(*rows)
        .pivot("_name", levels)
        .agg(*[c.alias(s) for s, c in stats.items()])
    )
    picked = []
    for stat in stats:
        for level in levels:
            made = f"{level}_{stat}" if len(stats) > 1 else level
            picked.append(F.col(f"`{made}`").alias(f"{stat}_{level}" if stat_first else f"{level}_{stat}"))
    return wide.select(*rows, *picked)


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def top_features(df: DataFrame, stat: str, k: int, tie_break: list[str]) -> DataFrame:
    """Rows with the ``k`` largest values; a top-k per task, then one merge."""
    return df.orderBy(F.desc(stat), *tie_break).limit(k)


def top_in_group(df: DataFrame, group: list[str], stat: str, n: int) -> DataFrame:
    """Per group the rows ranked in the first ``n``, ties kept.

    Spark cuts each group to its first ranks before the shuffle, so a hot group stays small
    unless the cut itself is full of ties.
    """
    no_clash(df.columns, ("rank",))
    rank = F.rank().over(Window.partitionBy(*group).orderBy(F.desc(stat)))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
