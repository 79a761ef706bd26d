"""Cell statistics: the one aggregation over measurement rows that every test starts from."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null, no_clash


def with_values(df: DataFrame, required: list[str], value: str) -> DataFrame:
    """Rows with a number and all required columns; the NULL checks reach the file scan."""
    kept = F.col(value).isNotNull() & finite_or_null(value).isNotNull()
    for c in required:
        kept = kept & F.col(c).isNotNull()
    return df.where(kept)


def cell_stats(
    df: DataFrame, keys: list[str], factors: list[str], value: str
) -> DataFrame:
    """``n``, ``mean`` and ``m2`` (sum of squared deviations) per group and factor cell.

    Rows without a value or a factor level take no part. The moments are merged map-side, so
    what is shuffled is one small row per task and cell, however many rows a cell has.
    """
    no_clash([*keys, *factors], ("n", "mean", "m2"))
    rows = with_values(df, [*factors], value).select(*keys, *factors, F.col(value).cast("double").alias("_v"))
    return (
        rows.groupBy(*keys, *factors)
        .agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.var_pop("_v").alias("_var"))
        .select(*keys, *factors, "n", "mean", (F.col("_var") * F.col("n")).alias("m2"))
    )


def plain_keys(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators called as ``fn(df, feature, value, factor, by, ...)``: inside, grouping columns
    have names that no statistic has, so a feature column may be called ``k`` or ``mse``. Fails if
    one is called like a column of the result."""

    @wraps(fn)
    def run(df: DataFrame, feature: str, value: str, factor, by: tuple[str, ...] = (), *args, **kwargs):
        factors = [factor] if isinstance(factor, str) else list(factor)
        keys = {k: f"_key_{i}" for i, k in enumerate([*by, feature])}
        renamed = [F.col(k).alias(v) for k, v in keys.items()]
        rows = df.select(*renamed, *factors, F.col(value).alias("_value"))
        *inner, last = keys.values()
        out = fn(rows, last, "_value", factor, tuple(inner), *args, **kwargs)
        no_clash(list(keys), tuple(c for c in out.columns if c not in keys.values()))
        return out.withColumnsRenamed({v: k for k, v in keys.items()})

    return run
