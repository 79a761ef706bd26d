"""Comparisons between levels after an analysis of variance, and two-sample tests."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import level_rank
from ..functions.tails import t_tail, tukey_critical, tukey_tail
from .anova import gathered_cells, layouts, model_terms, term_name, with_group_totals
from .cells import cell_stats, plain_keys
from .relate import level_pairs


def _or_null(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0.0))


def _paired_cells(df, keys, value, factor, levels) -> DataFrame:
    cells = with_group_totals(cell_stats(df, keys, [factor], value), keys)
    cells = cells.withColumn("_ord", level_rank(factor, levels))
    pairs = level_pairs(cells, keys, factor, "_ord", ["n", "mean", "k", "df2", "mse", "f"])
    return pairs.withColumnsRenamed({"k_1": "k", "df2_1": "df", "mse_1": "mse", "f_1": "f"})


@plain_keys
def tukey_oneway(
    df: DataFrame,
    feature: str,
    value: str,
    factor: str,
    by: tuple[str, ...] = (),
    conf: float = 0.95,
    levels: list[str] | None = None,
    p: bool = True,
) -> DataFrame:
    """Honest significant differences for one factor, named ``later-earlier``.

    ``p=False`` leaves out the distribution columns and with them all Python work.
    """
    keys = [*by, feature]
    pairs = _paired_cells(df, keys, value, factor, levels)
    out = pairs.select(
        *keys,
        F.lit(factor).alias("term"),
        F.concat_ws("-", f"{factor}_2", f"{factor}_1").alias("contrast"),
        (F.col("mean_2") - F.col("mean_1")).alias("diff"),
        F.sqrt(F.col("mse") / 2 * (1 / F.col("n_1") + 1 / F.col("n_2"))).alias("se"),
        "k",
        "df",
    )
    return _tukey_columns(out, conf) if p else out


def _tukey_columns(out: DataFrame, conf: float) -> DataFrame:
    half = tukey_critical(F.lit(conf), "k", "df") * F.col("se")
    return out.withColumns(
        {
            "lwr": F.col("diff") - half,
            "upr": F.col("diff") + half,
            "p_adj": tukey_tail(_or_null(F.abs("diff"), F.col("se")), "k", "df"),
        }
    )


@plain_keys
def tukey_hsd(
    df: DataFrame,
    feature: str,
    value: str,
    factors: list[str],
    by: tuple[str, ...] = (),
    conf: float = 0.95,
    levels: dict[str, list[str]] | None = None,
    p: bool = True,
) -> DataFrame:
    """Honest significant differences for every term of the full factorial.

    A term's level means come from its sequential effect plus those of the terms inside it.
    Interaction levels are written ``a:b`` with the first factor varying fastest; the family of
    an interaction counts all combinations of its factor levels.
    """
    levels = levels or {}
    if len(factors) == 1:
        return tukey_oneway(df, feature, value, factors[0], by, conf, levels.get(factors[0]), p)
    keys = [*by, feature]
    return tukey_from_cells(gathered_cells(df, keys, factors, value, levels), keys, factors, conf, levels, p)


def tukey_from_cells(
    packed: DataFrame,
    keys: list[str],
    factors: list[str],
    conf: float = 0.95,
    levels: dict[str, list[str]] | None = None,
    p: bool = True,
) -> DataFrame:
    """All comparisons of a factorial from cells gathered before."""
    levels = levels or {}
    ordered = {i: {v: j for j, v in enumerate(levels[f])} for i, f in enumerate(factors) if f in levels}

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, names, model in layouts(pdf, len(factors)):
                head = pdf.iloc[at][keys].reset_index(drop=True)
                resid = pdf["n_all"].to_numpy()[at] - len(names)
                mse = pdf["rss"].to_numpy()[at] / np.where(resid > 0, resid, np.nan)
                for term in model_terms(len(factors)):
                    label, number, family = _term_levels(names, term, ordered)
                    mean, rows = model.level_means(term, number)
                    for i in range(len(label)):
                        for j in range(i):
                            yield head.assign(
                                term=term_name(factors, term),
                                contrast=f"{label[i]}-{label[j]}",
                                diff=mean[:, i] - mean[:, j],
                                se=np.sqrt(mse / 2 * (1 / rows[:, i] + 1 / rows[:, j])),
                                k=family,
                                df=resid,
                            )

    schema = T.StructType(
        [
            *[packed.schema[k] for k in keys],
            T.StructField("term", T.StringType()),
            T.StructField("contrast", T.StringType()),
            T.StructField("diff", T.DoubleType()),
            T.StructField("se", T.DoubleType()),
            T.StructField("k", T.LongType()),
            T.StructField("df", T.LongType()),
        ]
    )
    out = packed.mapInPandas(compare, schema)
    return _tukey_columns(out, conf) if p else out


def _term_levels(names: np.ndarray, term: tuple[int, ...], ordered: dict) -> tuple[list[str], np.ndarray, int]:
    """Present levels of a term in comparison order, the level number of each cell, and the
    count of all combinations."""
    choices = []
    for i in term:
        seen = sorted(set(names[:, i]), key=lambda v: (ordered.get(i, {}).get(v, len(ordered.get(i, {}))), v))
        choices.append(seen)
    full = [c[::-1] for c in product(*choices[::-1])]
    cells = [tuple(row) for row in names[:, list(term)]]
    present = [c for c in full if c in set(cells)]
    number = {c: i for i, c in enumerate(present)}
    return [":".join(c) for c in present], np.array([number[c] for c in cells]), len(full)


@plain_keys
def pairwise_contrasts(
    df: DataFrame,
    feature: str,
    value: str,
    factor: str,
    by: tuple[str, ...] = (),
    levels: list[str] | None = None,
    p: bool = True,
) -> DataFrame:
    """Differences of marginal means, named ``earlier - later``, with the overall F statistic.

    With more than two levels p is adjusted for the family of comparisons; with two it is the
    plain t-test p, which the same tail gives.
    """
    keys = [*by, feature]
    pairs = _paired_cells(df, keys, value, factor, levels)
    se = F.sqrt(F.col("mse") * (1 / F.col("n_1") + 1 / F.col("n_2")))
    estimate = F.col("mean_1") - F.col("mean_2")
    out = pairs.select(
        *keys,
        "f",
        F.concat_ws(" - ", f"{factor}_1", f"{factor}_2").alias("contrast"),
        estimate.alias("estimate"),
        se.alias("se"),
        "df",
        _or_null(estimate, se).alias("t"),
        "k",
    )
    if not p:
        return out
    return out.withColumn("p", tukey_tail(F.abs("t") * (2**0.5), "k", "df"))


@plain_keys
def welch_t_test(
    df: DataFrame,
    feature: str,
    value: str,
    factor: str,
    by: tuple[str, ...] = (),
    levels: list[str] | None = None,
    p: bool = True,
) -> DataFrame:
    """Two-sample t-test with unequal variances, first level minus second.

    Give ``levels`` (two of them) to test only those; otherwise the column must hold two.
    Features that are constant in both samples get a NULL statistic.
    """
    keys = [*by, feature]
    rows = df if levels is None else df.where(F.col(factor).isin(levels))
    cells = cell_stats(rows, keys, [factor], value)
    cells = cells.withColumn("_ord", level_rank(factor, levels))
    pairs = level_pairs(cells, keys, factor, "_ord", ["n", "mean", "m2"])
    part = [
        F.col(f"m2_{i}") / F.nullif(F.col(f"n_{i}") - 1, F.lit(0)) / F.col(f"n_{i}") for i in (1, 2)
    ]
    both = pairs.withColumns({"_e1": part[0], "_e2": part[1]}).withColumn(
        "_se", F.sqrt(F.col("_e1") + F.col("_e2"))
    )
    scale = F.greatest(F.abs("mean_1"), F.abs("mean_2"))
    se = F.when(F.col("_se") > 10 * 2.0**-52 * scale, F.col("_se"))
    dof = F.pow("_se", F.lit(4.0)) / (
        F.pow("_e1", F.lit(2.0)) / (F.col("n_1") - 1) + F.pow("_e2", F.lit(2.0)) / (F.col("n_2") - 1)
    )
    out = both.select(
        *keys,
        F.col(f"{factor}_1").alias("level1"),
        F.col(f"{factor}_2").alias("level2"),
        F.col("mean_1").alias("mean1"),
        F.col("mean_2").alias("mean2"),
        ((F.col("mean_1") - F.col("mean_2")) / se).alias("t"),
        F.when(se.isNotNull(), dof).alias("df"),
    )
    return out.withColumn("p", t_tail("t", "df")) if p else out


def p_matrix(table: DataFrame, feature: str, column: str, levels: list[str], p: str = "p") -> DataFrame:
    """Feature by level table of p-values."""
    return table.groupBy(feature).pivot(column, levels).agg(F.max(p))

