"""Grouped summaries. Every one is a map-side combined aggregation, so hot groups are cheap."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null
from ..plans.staging import attach, stage
from .ordering import group_quantiles, quantile_points


def standard_error(value: str | Column) -> Column:
    """sqrt(var / n) over the rows that hold a value."""
    return F.sqrt(F.var_samp(value) / F.count(value))


def summarize(
    df: DataFrame, by: list[str], value: str, stats: tuple[str, ...] = ("n", "mean", "sd", "se")
) -> DataFrame:
    """Statistics by group; ``rows`` counts all rows, ``n`` those with a value."""
    v = finite_or_null(value)
    known = {
        "rows": F.count("*"),
        "n": F.count(v),
        "sum": F.sum(v),
        "mean": F.avg(v),
        "sd": F.stddev_samp(v),
        "se": standard_error(v),
        "min": F.min(v),
        "max": F.max(v),
    }
    return df.groupBy(*by).agg(*[known[s].alias(s) for s in stats])


def interval(df: DataFrame, by: list[str], value: str, kind: str = "sd", z: float = 1.96) -> DataFrame:
    """Mean with limits at ``z`` standard deviations or standard errors."""
    spread = summarize(df, by, value, ("n", "mean", kind))
    return spread.withColumns(
        {"lo": F.col("mean") - z * F.col(kind), "hi": F.col("mean") + z * F.col(kind)}
    )


def replicates(df: DataFrame, by: list[str], sample: str, exact: bool = True) -> DataFrame:
    """Distinct samples per group. Exact counting spreads a hot group over its samples."""
    if not exact:
        return df.groupBy(*by).agg(F.approx_count_distinct(sample).alias("reps"))
    once = df.where(F.col(sample).isNotNull()).groupBy(*by, sample).agg(F.count("*").alias("_c"))
    return once.groupBy(*by).agg(F.count("*").alias("reps"))


def count_by_each(df: DataFrame, factors: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per level of each factor in turn, stacked as ``group, level, n``; one pass."""
    sets = [[*by, f] for f in factors]
    counted = df.groupingSets(sets, *by, *factors).agg(
        F.count("*").alias("n"), *[F.grouping(f).alias(f"_g_{f}") for f in factors]
    )
    name, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in factors:
        own = F.col(f"_g_{f}") == 0
        name = F.when(own, F.lit(f)).otherwise(name)
        level = F.when(own, F.col(f).cast("string")).otherwise(level)
    return counted.select(*by, name.alias("group"), level.alias("level"), "n")


def class_means(df: DataFrame, sample: list[str], class_col: str, value: str) -> DataFrame:
    """Replicate features averaged within class and sample."""
    return df.groupBy(*sample, class_col).agg(F.avg(finite_or_null(value)).alias("mean"))


def five_number(
    df: DataFrame, by: list[str], value: str, exact: bool = True, accuracy: int = 10000
) -> DataFrame:
    """Minimum, quartiles, maximum and whisker ends (last values within 1.5 IQR of the box).

    With ``exact=False`` the quartiles are off by at most n / ``accuracy`` ranks.
    """
    # read by every pass; what came before, such as a join, runs once
    df = stage(df.select(*by, finite_or_null(value).alias(value)))
    if exact:
        probs = {"min": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "max": 1.0}
        box = group_quantiles(df, by, value, probs)
    else:
        v = finite_or_null(value)
        box = (
            df.groupBy(*by)
            .agg(
                F.count(v).alias("n"),
                F.min(v).alias("min"),
                F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("_q"),
                F.max(v).alias("max"),
            )
            .where(F.col("n") > 0)
            .select(
                *by,
                "n",
                "min",
                F.col("_q")[0].alias("q1"),
                F.col("_q")[1].alias("med"),
                F.col("_q")[2].alias("q3"),
                "max",
            )
        )
    v = finite_or_null(value)
    boxed = attach(df.select(*by, v.alias("_v")), box, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        boxed.where(F.col("_v").isNotNull())
        .groupBy(*by, "n", "min", "q1", "med", "q3", "max")
        .agg(
            F.min(F.when(near, F.col("_v"))).alias("lo_whisker"),
            F.max(F.when(near, F.col("_v"))).alias("hi_whisker"),
        )
    )


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    by: tuple[str, ...] = (),
    lo: float | None = None,
    hi: float | None = None,
) -> DataFrame:
    """Counts in equal-width bins 1..``bins`` between given limits or each group's own range.

    The upper limit falls in the last bin; values beyond given limits go to bins 0 and bins+1.
    """
    v = df.select(*by, finite_or_null(value).alias("_v")).where(F.col("_v").isNotNull())
    if lo is None or hi is None:
        ends = v.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        v = attach(v, ends, list(by))
        low, high = F.col("_lo"), F.col("_hi")
    else:
        low, high = F.lit(float(lo)), F.lit(float(hi))
    slot = F.floor((F.col("_v") - low) * bins / F.nullif(high - low, F.lit(0.0))) + 1
    slot = (
        F.when(high == low, F.lit(1))
        .when(F.col("_v") < low, F.lit(0))
        .when(F.col("_v") > high, F.lit(bins + 1))
        .otherwise(F.least(slot, F.lit(bins)))
    )
    return v.groupBy(*by, slot.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def qq_points(df: DataFrame, value: str, points: int = 99, by: tuple[str, ...] = ()) -> DataFrame:
    """Quantile-quantile points against the normal: exact sample quantiles at a fixed grid.

    The grid keeps the result small whatever the group size.
    """
    probs = [(i - 0.5) / points for i in range(1, points + 1)]
    normal = F.lit([NormalDist().inv_cdf(p) for p in probs])
    found = quantile_points(df, by, value, probs)
    return found.select(
        *[F.col("_key")[c].alias(c) for c in by],
        (F.col("i") + 1).alias("point"),
        F.element_at(normal, (F.col("i") + 1).cast("int")).alias("theoretical"),
        F.col("q").alias("sample_quantile"),
    )


def error_bars(df: DataFrame, mean: str = "mean", se: str = "se") -> DataFrame:
    """Bars drawn away from zero only: upper end for positive means, lower end for negative."""
    m, s = F.col(mean), F.col(se)
    return df.withColumns(
        {"ymax": m + F.when(m > 0, s).otherwise(0.0), "ymin": m - F.when(m < 0, s).otherwise(0.0)}
    )
