"""Whole analyses built from the operators, each from a long measurement table to its tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from ..operators import anova, baseline, permanova, posthoc, scale
from .staging import stage


class FactorialStudy(NamedTuple):
    table: DataFrame  # feature, term, ss, df, f, rss, df_resid, p
    posthoc: DataFrame  # significant comparisons only


def factorial_study(
    df: DataFrame,
    feature: str,
    value: str,
    factors: list[str],
    by: tuple[str, ...] = (),
    alpha: float = 0.05,
    levels: dict[str, list[str]] | None = None,
) -> FactorialStudy:
    """Analysis of variance of every feature, and its significant level comparisons.

    Both come from the same staged cells: the measurements are scanned once.
    """
    keys = [*by, feature]
    cells = stage(anova.gathered_cells(df, keys, factors, value, levels))
    table = anova.factorial_from_cells(cells, keys, factors)
    pairs = posthoc.tukey_from_cells(cells, keys, factors, levels=levels)
    return FactorialStudy(table, anova.significant(pairs, "p_adj", alpha))


class ChangeStudy(NamedTuple):
    tests: DataFrame  # every comparison, with its feature's F
    table: DataFrame  # mean and standard error of change, features with a significant comparison


def change_study(
    df: DataFrame,
    feature: str,
    value: str,
    group: str,
    control: Column,
    levels: list[str],
    alpha: float = 0.05,
    zero_baseline: bool = False,
    baseline_by: tuple[str, ...] = (),
    rows: Column | None = None,
) -> ChangeStudy:
    """Change from the control group: tests between groups and the table of changes.

    ``baseline_by`` narrows the scope of the control mean; ``rows`` picks the rows tested after
    the control mean is taken (one day out of several, for example).
    """
    deltas = baseline.delta_from_baseline(df, [*baseline_by, feature], value, control, zero_baseline)
    if rows is not None:
        deltas = deltas.where(rows)
    tests = stage(posthoc.pairwise_contrasts(deltas, feature, "delta", group))
    hits = anova.significant(tests, "p", alpha).select(feature).distinct()
    return ChangeStudy(tests, baseline.delta_table(deltas, feature, [group], levels, hits))


def community_study(
    df: DataFrame,
    sample: str,
    group: str,
    feature: str,
    value: str,
    features: list[str],
    metric: str = "bray",
    permutations: int = 999,
    seed: int = 0,
    p: bool = True,
) -> DataFrame:
    """Whole samples compared between groups: scale features, pack samples, test each two groups."""
    scaled = scale.range_scale(df, feature, value)
    packed = scale.pack_vectors(scaled, [sample, group], feature, "scaled", features)
    return permanova.permanova_pairwise(packed, sample, "vector", group, metric, permutations, seed, p)
