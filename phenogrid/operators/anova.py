"""One-way and factorial analysis of variance for every feature at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import level_rank
from ..functions.tails import f_tail
from .cells import cell_stats, plain_keys


def with_group_totals(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Add to each cell of a one-factor layout the figures of its whole group:
    ``n_all, k, ssb, ssw, df1, df2, mse, f``.

    The statistic is NULL where the error is zero or undefined. All windows share one shuffle
    of the cells, and grouping by the same keys afterwards needs no other.
    """
    whole = Window.partitionBy(*keys)
    n_all = F.sum("n").over(whole)
    grand = F.sum(F.col("n") * F.col("mean")).over(whole) / n_all
    return (
        cells.withColumns(
            {"n_all": n_all, "k": F.count("*").over(whole), "ssw": F.sum("m2").over(whole), "_grand": grand}
        )
        .withColumn("ssb", F.sum(F.col("n") * (F.col("mean") - F.col("_grand")) ** 2).over(whole))
        .withColumns({"df1": F.col("k") - 1, "df2": F.col("n_all") - F.col("k")})
        .withColumn("mse", F.col("ssw") / F.nullif(F.col("df2"), F.lit(0)))
        .withColumn(
            "f",
            F.col("ssb") / F.nullif(F.col("df1"), F.lit(0)) / F.nullif(F.col("mse"), F.lit(0.0)),
        )
        .drop("_grand")
    )


def oneway_from_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    figures = ("ssb", "ssw", "df1", "df2", "f")
    table = with_group_totals(cells, keys)
    return table.groupBy(*keys).agg(*[F.max(c).alias(c) for c in figures])


@plain_keys
def anova_oneway(
    df: DataFrame, feature: str, value: str, factor: str, by: tuple[str, ...] = (), p: bool = True
) -> DataFrame:
    """Does the value differ between levels of ``factor``, for each feature (and stratum)?"""
    keys = [*by, feature]
    table = oneway_from_cells(cell_stats(df, keys, [factor], value), keys)
    return table.withColumn("p", f_tail("f", "df1", "df2")) if p else table


def model_terms(n_factors: int) -> list[tuple[int, ...]]:
    """Main effects, then interactions of rising order."""
    return [c for size in range(1, n_factors + 1) for c in combinations(range(n_factors), size)]


class LayoutFit:
    """Sequential weighted fit of the full factorial on cell means, for many features with the
    same set of cells. Every feature is a row of ``n`` and ``mean``; cells are the columns.

    Each term's indicator columns are made orthogonal to all before them; a column that adds
    nothing (an empty or implied combination) is left out, so degrees of freedom are ranks.
    """

    def __init__(self, levels: np.ndarray, n: np.ndarray, mean: np.ndarray):
        root = np.sqrt(n)
        self.n = n
        self.grand = (n * mean).sum(1, keepdims=True) / n.sum(1, keepdims=True)
        y = root * (mean - self.grand)
        basis = [root / np.linalg.norm(root, axis=1, keepdims=True)]
        self.ss, self.df, self.effect = {}, {}, {}
        for term in model_terms(levels.shape[1]):
            _, code = np.unique(levels[:, term], axis=0, return_inverse=True)
            code = code.reshape(-1)
            ss = np.zeros(len(n))
            df = np.zeros(len(n), dtype=int)
            part = np.zeros_like(y)
            for level in range(code.max() + 1):
                col = root * (code == level)
                size = np.linalg.norm(col, axis=1, keepdims=True)
                for _ in range(2):  # the second sweep removes what rounding left
                    for q in basis:
                        col = col - q * (q * col).sum(1, keepdims=True)
                left = np.linalg.norm(col, axis=1, keepdims=True)
                new = left > 1e-7 * size
                q = np.where(new, col / np.where(new, left, 1.0), 0.0)
                if not new.any():
                    continue
                basis.append(q)
                coef = (q * y).sum(1, keepdims=True)
                ss += coef[:, 0] ** 2
                df += new[:, 0]
                part += q * coef
            self.ss[term], self.df[term], self.effect[term] = ss, df, part / root

    def level_means(self, term: tuple[int, ...], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row-weighted means of the fitted effects of ``term`` and the terms it contains, at
        each of its levels (``at`` numbers the level of each cell), and the rows per level."""
        fitted = sum(self.effect[t] for t in self.effect if set(t) <= set(term))
        pick = (at[:, None] == np.arange(at.max() + 1)).astype(float)
        rows = self.n @ pick
        return self.grand + (self.n * fitted) @ pick / rows, rows


def gathered_cells(
    df: DataFrame,
    keys: list[str],
    factors: list[str],
    value: str,
    levels: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row per group: its cells as arrays in level order. A cell is an aggregate, so an
    array is as long as the factor layout (the product of the level counts), never as the data.
    """
    levels = levels or {}
    cells = cell_stats(df, keys, factors, value)
    place = [level_rank(f, levels.get(f)).alias(f"o{i}") for i, f in enumerate(factors)]
    names = [F.col(f).cast("string").alias(f"l{i}") for i, f in enumerate(factors)]
    packed = cells.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*place, *names, "n", "mean"))).alias("_c"),
        F.sum("m2").alias("rss"),
        F.sum("n").alias("n_all"),
    )
    return packed.select(
        *keys,
        *[F.col("_c")[f"l{i}"].alias(f"_l{i}") for i in range(len(factors))],
        F.col("_c")["n"].cast("array<double>").alias("_n"),
        F.col("_c")["mean"].alias("_mean"),
        "rss",
        "n_all",
    )


def layouts(pdf: pd.DataFrame, n_factors: int) -> Iterator[tuple[np.ndarray, np.ndarray, LayoutFit]]:
    """Split a batch of gathered groups by their cell layout and fit each layout in one go.

    Yields row numbers, the level names of each cell, and the fit.
    """
    names = [pdf[f"_l{i}"] for i in range(n_factors)]
    where: dict[tuple, list[int]] = {}
    for row, layout in enumerate(zip(*names)):
        where.setdefault(tuple(tuple(x) for x in layout), []).append(row)
    for layout, rows in where.items():
        levels = np.array(layout, dtype=object).T
        at = np.array(rows)
        n = np.stack(pdf["_n"].to_numpy()[at])
        mean = np.stack(pdf["_mean"].to_numpy()[at])
        codes = np.stack([pd.factorize(levels[:, i])[0] for i in range(n_factors)], axis=1)
        yield at, levels, LayoutFit(codes, n, mean)


def term_name(factors: list[str], term: tuple[int, ...]) -> str:
    return ":".join(factors[i] for i in term)


@plain_keys
def anova_factorial(
    df: DataFrame,
    feature: str,
    value: str,
    factors: list[str],
    by: tuple[str, ...] = (),
    p: bool = True,
) -> DataFrame:
    """Full factorial with sequential sums of squares, one row per feature and term.

    The order of ``factors`` matters in unbalanced data, as it does for any sequential table.
    Two and three factors give 3 and 7 terms.
    """
    keys = [*by, feature]
    return factorial_from_cells(gathered_cells(df, keys, factors, value), keys, factors, p)


def factorial_from_cells(packed: DataFrame, keys: list[str], factors: list[str], p: bool = True) -> DataFrame:
    """The factorial table from cells gathered before, so that they can serve comparisons too."""
    terms = model_terms(len(factors))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, levels, model in layouts(pdf, len(factors)):
                head = pdf.iloc[at][[*keys, "rss", "n_all"]].reset_index(drop=True)
                rank = len(levels)
                for i, term in enumerate(terms):
                    yield head.assign(
                        term_no=i + 1,
                        term=term_name(factors, term),
                        ss=model.ss[term],
                        df=model.df[term],
                        df_resid=head["n_all"] - rank,
                    )

    schema = T.StructType(
        [
            *[packed.schema[k] for k in keys],
            T.StructField("rss", T.DoubleType()),
            T.StructField("n_all", T.LongType()),
            T.StructField("term_no", T.IntegerType()),
            T.StructField("term", T.StringType()),
            T.StructField("ss", T.DoubleType()),
            T.StructField("df", T.LongType()),
            T.StructField("df_resid", T.LongType()),
        ]
    )
    fitted = packed.mapInPandas(fit, schema)
    error = F.nullif(F.col("rss") / F.nullif(F.col("df_resid"), F.lit(0)), F.lit(0.0))
    ratio = F.col("ss") / F.nullif(F.col("df"), F.lit(0)) / error
    out = fitted.select(*keys, "term_no", "term", "ss", "df", ratio.alias("f"), "rss", "df_resid")
    return out.withColumn("p", f_tail("f", "df", "df_resid")) if p else out


def factorial_wide(
    table: DataFrame, keys: list[str], factors: list[str], short: dict[str, str], round_to: int | None = 3
) -> DataFrame:
    """One row per feature with ``fStat<term>`` and ``pval<term>`` columns, rounded as printed."""
    terms = [term_name(factors, t) for t in model_terms(len(factors))]
    wide = table.groupBy(*keys).pivot("term", terms).agg(F.max("f").alias("f"), F.max("p").alias("p"))
    cols = []
    for term in terms:
        label = short.get(term, "_".join(short.get(f, f) for f in term.split(":")))
        for stat, prefix in (("f", "fStat"), ("p", "pval")):
            c = F.col(f"`{term}_{stat}`")
            cols.append((c if round_to is None else F.round(c, round_to)).alias(prefix + label))
    return wide.select(*keys, *cols)


def stratum_p_table(table: DataFrame, feature: str, stratum: str, levels: list[str]) -> DataFrame:
    """p-values of separate fits per stratum, one column each: ``pval<level>``."""
    wide = table.groupBy(feature).pivot(stratum, levels).agg(F.max("p"))
    return wide.select(feature, *[F.col(f"`{v}`").alias(f"pval{v}") for v in levels])


def significant(df: DataFrame, p: str = "p", alpha: float = 0.05, digits: int | None = None) -> DataFrame:
    """Rows below ``alpha``; ``digits`` rounds first, as printed tables were filtered."""
    c = F.col(p) if digits is None else F.round(F.col(p), digits)
    return df.where(c < alpha)


def any_significant(df: DataFrame, p_cols: list[str], alpha: float = 0.05) -> DataFrame:
    """Rows where at least one of several p-values is below ``alpha``."""
    smallest = F.least(*[F.col(c) for c in p_cols]) if len(p_cols) > 1 else F.col(p_cols[0])
    return df.where(smallest < alpha)
