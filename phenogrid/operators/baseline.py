"""Change from a control group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null
from ..plans.staging import attach
from .relate import keep_features
from .reshape import stats_wide
from .summarize import standard_error


def baseline_stats(df: DataFrame, by: list[str], value: str, control: Column) -> DataFrame:
    """Mean and standard error of the control rows. ``by`` sets the scope: a feature over all
    times, or a feature at each time."""
    v = finite_or_null(value)
    return (
        df.where(control)
        .groupBy(*by)
        .agg(F.avg(v).alias("base_mean"), standard_error(v).alias("base_se"))
    )


def delta_from_baseline(
    df: DataFrame, by: list[str], value: str, control: Column, zero_baseline: bool = False
) -> DataFrame:
    """Add ``base_mean``, ``base_se`` and ``delta``; rows without a control have a NULL delta.

    ``zero_baseline`` sets control rows to 0, as the published tables do. That removes the
    control group's variance and so overstates significance in later tests.
    """
    is_control = F.coalesce(control, F.lit(False))
    flagged = df.withColumn("_control", is_control)
    joined = attach(flagged, baseline_stats(df, by, value, control), by)
    delta = finite_or_null(value) - F.col("base_mean")
    if zero_baseline:
        delta = F.when(F.col("_control"), F.lit(0.0)).otherwise(delta)
    return joined.withColumn("delta", delta).drop("_control")


def delta_table(
    deltas: DataFrame,
    feature: str,
    names: list[str],
    levels: list[str],
    significant: DataFrame | None = None,
    value: str = "delta",
) -> DataFrame:
    """Mean and standard error of change per level (or level and time), one row per feature."""
    if significant is not None:
        deltas = keep_features(deltas, significant, [feature])
    stats = {"avgchange": F.avg(value), "sechange": standard_error(value)}
    return stats_wide(deltas, [feature], names, stats, levels)
