"""Joins between measurements, keys and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .clean import parse_sample_id


def attach_keys(df: DataFrame, keys: DataFrame, on: list[str] | dict[str, str], how: str = "inner") -> DataFrame:
    """Key lookup by equal columns; ``inner``, ``left`` or ``right``. ``on`` names columns that both
    sides have, or, as a dict, the column of ``df`` and that of ``keys`` it equals; the key columns
    come out once, under their names in ``df``.

    No strategy is forced: small key tables are broadcast by their size on disk, larger ones
    are shuffled and skewed keys split by AQE.
    """
    if isinstance(on, dict):
        taken = [c for c in keys.columns if c in on and on[c] != c and c not in on.values()]
        if taken:
            raise ValueError(f"columns of the keys named like the table's keys: {', '.join(taken)}")
        keys = keys.withColumnsRenamed({theirs: ours for ours, theirs in on.items()})
        on = list(on)
    return df.join(keys, on, how)


def keep_features(df: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key occurs in ``wanted``, each once (semi join).

    ``wanted`` usually comes out of a test on the same rows, so its size is unknown to the
    optimizer; its distinct keys are staged and broadcast if they turn out small.
    """
    return df.join(stage(wanted.select(*on).distinct()), on, "left_semi")


def level_pairs(
    cells: DataFrame, group: list[str], level: str, order: str, carry: list[str]
) -> DataFrame:
    """All pairs of levels within a group, first level before second by ``order``.

    Works on aggregated cells (one row per level), never on measurement rows; the cells are
    staged, so the measurements behind them are scanned once and not once per side. The result
    holds ``{level}_1``, ``{level}_2`` and ``{c}_1``, ``{c}_2`` for each carried column.
    """
    cells = stage(cells)
    cols = list(dict.fromkeys([level, order, *carry]))
    first = cells.select(*group, *[F.col(c).alias(f"{c}_1") for c in cols])
    second = cells.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], *[F.col(c).alias(f"{c}_2") for c in cols]
    )
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    cond = reduce(lambda a, b: a & b, same, F.col(f"{order}_1") < F.col(f"{order}_2"))
    return first.join(second, cond, "inner").drop(*[f"_g_{g}" for g in group])


def attach_covariate(
    df: DataFrame,
    covariate: DataFrame,
    id_col: str,
    subject: str,
    time: str,
    tumor_time: str = "D35",
) -> DataFrame:
    """Covariate of the same subject and time; tumour samples count as taken at ``tumor_time``.

    The covariate table is staged, so that its true size decides how it is joined.
    """
    parsed = parse_sample_id(df, id_col, tumor_time=tumor_time)
    renamed = stage(covariate.withColumnsRenamed({subject: "subject_id", time: "time"}))
    return parsed.join(renamed, ["subject_id", "time"], "left")
