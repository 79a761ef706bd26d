"""Simple linear regression and correlation for every feature, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null, no_clash
from ..functions.tails import t_critical, t_tail


def linear_regression(
    df: DataFrame, feature: str, x: str, y: str, by: tuple[str, ...] = (), p: bool = True
) -> DataFrame:
    """Fit ``y ~ x``. Rows lacking either value are left out; a constant ``x`` gives NULLs.

    Points exactly on a sloping line have an infinite ``t`` and p = 0.
    """
    no_clash([*by, feature], ("n", "slope", "intercept", "r2", "adj_r2", "se", "t", "p"))
    a, b = finite_or_null(x), finite_or_null(y)
    fit = df.groupBy(*by, feature).agg(
        F.regr_count(b, a).alias("n"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.least(F.regr_r2(b, a), F.lit(1.0)).alias("r2"),  # rounding may pass one
        F.regr_sxx(b, a).alias("_sxx"),
        F.regr_syy(b, a).alias("_syy"),
        F.regr_sxy(b, a).alias("_sxy"),
    )
    left = F.col("n") - 2
    usable = (left > 0) & (F.col("_sxx") > 0)
    rest = F.greatest(F.col("_syy") - F.col("_sxy") ** 2 / F.nullif("_sxx", F.lit(0.0)), F.lit(0.0))
    se = F.when(usable, F.sqrt(rest / left / F.col("_sxx")))
    exact = usable & (rest == 0) & (F.col("_syy") > 0)
    out = fit.select(
        *by,
        feature,
        "n",
        "slope",
        "intercept",
        "r2",
        F.when(usable, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / left).alias("adj_r2"),
        se.alias("se"),
        F.when(exact, F.signum("slope") * float("inf")).otherwise(F.col("slope") / F.nullif(se, F.lit(0.0))).alias("t"),
    )
    return _with_p(out) if p else out


def fitted_line(
    df: DataFrame, feature: str, x: str, y: str, by: tuple[str, ...] = (), points: int = 80, conf: float = 0.95
) -> DataFrame:
    """The line ``y ~ x`` of every feature at ``points`` equally spaced places between its smallest
    and largest ``x``, with the limits of its mean at confidence ``conf``: the data behind a
    regression line with a band. Columns ``point`` (from 1), ``x``, ``fit``, ``lwr``, ``upr``.

    Rows lacking either value are left out. Features with fewer than three of them have no limits; a
    constant ``x`` has no line. One aggregation; only its result is spread out.
    """
    no_clash([*by, feature], ("point", "x", "fit", "lwr", "upr"))
    a, b = finite_or_null(x), finite_or_null(y)
    both = a.isNotNull() & b.isNotNull()
    known = F.when(both, a)
    fit = df.groupBy(*by, feature).agg(
        F.regr_count(b, a).alias("_n"),
        F.regr_slope(b, a).alias("_slope"),
        F.regr_avgx(b, a).alias("_mx"),
        F.regr_avgy(b, a).alias("_my"),
        F.regr_sxx(b, a).alias("_sxx"),
        F.regr_syy(b, a).alias("_syy"),
        F.regr_sxy(b, a).alias("_sxy"),
        F.min(known).alias("_lo"),
        F.max(known).alias("_hi"),
    )
    left = F.when(F.col("_n") > 2, F.col("_n") - 2).cast("double")
    rest = F.greatest(F.col("_syy") - F.col("_sxy") ** 2 / F.nullif("_sxx", F.lit(0.0)), F.lit(0.0))
    told = fit.where("_sxx > 0").withColumn("_mse", rest / left).withColumn("_crit", t_critical(F.lit(1.0 - conf), left))
    at = F.explode(F.sequence(F.lit(1), F.lit(points))).alias("point")
    spread = told.select("*", at).withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("point") - 1) / max(points - 1, 1))
    away = F.col("x") - F.col("_mx")
    line = F.col("_my") + F.col("_slope") * away
    half = F.col("_crit") * F.sqrt(F.col("_mse") * (1 / F.col("_n") + away * away / F.col("_sxx")))
    return spread.select(*by, feature, "point", "x", line.alias("fit"), (line - half).alias("lwr"), (line + half).alias("upr"))


def _with_p(out: DataFrame) -> DataFrame:
    """Two-sided p of ``t`` on n - 2 degrees of freedom; 0 for an infinite ``t``."""
    endless = F.abs(F.col("t")) == float("inf")
    finite = out.withColumn("_t", F.when(~endless, F.col("t")))
    tail = t_tail("_t", (F.col("n") - 2).cast("double"))
    return finite.withColumn("p", tail).withColumn("p", F.when(endless, 0.0).otherwise(F.col("p"))).drop("_t")


def pearson(
    df: DataFrame, feature: str, x: str, y: str, by: tuple[str, ...] = (), p: bool = True
) -> DataFrame:
    """Correlation of ``x`` and ``y``; NULL if either is constant. |r| = 1 has p = 0."""
    no_clash([*by, feature], ("n", "r", "t", "p"))
    a, b = finite_or_null(x), finite_or_null(y)
    both = a.isNotNull() & b.isNotNull()
    found = df.groupBy(*by, feature).agg(
        F.regr_count(b, a).alias("n"),
        F.greatest(F.least(F.corr(F.when(both, a), F.when(both, b)), F.lit(1.0)), F.lit(-1.0)).alias("r"),
    )
    left = F.col("n") - 2
    t = F.col("r") * F.sqrt(F.when(left > 0, left) / F.nullif(1 - F.col("r") ** 2, F.lit(0.0)))
    endless = (left > 0) & (F.abs(F.col("r")) == 1)
    out = found.withColumn("t", F.when(endless, F.col("r") * float("inf")).otherwise(t))
    return _with_p(out) if p else out


def slope_sign(df: DataFrame, slope: str = "slope") -> DataFrame:
    """``pos`` or ``neg``; a flat line has no sign."""
    return df.withColumn("sign", F.when(F.col(slope) > 0, "pos").when(F.col(slope) < 0, "neg"))


def strong_fits(df: DataFrame, r2: float = 0.2, sign: str | None = None) -> DataFrame:
    kept = df.where(F.col("r2") > r2)
    return kept if sign is None else kept.where(F.col("sign") == sign)
