"""Column expressions for cleaning identifiers, names and labels. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def piece(c: Column | str, sep: str, index: int) -> Column:
    """The ``index``-th piece (from 1) after splitting on a literal separator, NULL if absent."""
    return _none_if_empty(F.split_part(_col(c), F.lit(sep), F.lit(index)))


def first_word(c: Column | str) -> Column:
    return piece(c, " ", 1)


def extract_first(c: Column | str, pattern: str, group: int = 0) -> Column:
    return _none_if_empty(F.regexp_extract(_col(c), pattern, group))


def extract_all(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0))


def detect(c: Column | str, pattern: str) -> Column:
    return _col(c).rlike(pattern)


def replace_all(c: Column | str, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(_col(c), pattern, by)


def replace_first(c: Column | str, pattern: str, by: str = "") -> Column:
    """Replace the first match only; ``pattern`` must hold no capture groups or anchors."""
    return F.regexp_replace(_col(c), f"(?s)^(.*?)(?:{pattern})", f"$1{by}")


def paste(*cols: Column | str, sep: str = "_") -> Column:
    """Join texts with a separator, leaving NULLs out."""
    return F.concat_ws(sep, *[_col(c) for c in cols])


def to_number(c: Column | str) -> Column:
    """Text to double; text that is no number becomes NULL."""
    return _col(c).try_cast("double")


def round_half_even(c: Column | str, digits: int) -> Column:
    return F.bround(_col(c), digits)


def is_member(c: Column | str, values: list) -> Column:
    """Membership that answers false, not NULL, for a missing value."""
    return F.coalesce(_col(c).isin(values), F.lit(False))


def level_rank(c: Column | str, levels: list[str] | None) -> Column:
    """Sort key of a factor level: place in ``levels``, or the text itself without a list.

    Levels missing from the list sort last.
    """
    if levels is None:
        return _col(c)
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(c))
    return F.when(place > 0, place).otherwise(F.lit(len(levels) + 1))


def finite_or_null(c: Column | str) -> Column:
    """Double with NaN and infinities read as missing, as model fits and summaries expect."""
    x = _col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def no_clash(names: list[str], made: tuple[str, ...]) -> None:
    """Fail if a column that stays in the result has the name of one the operator makes."""
    taken = {m.lower() for m in made}
    both = [n for n in names if n.lower() in taken]
    if both:
        raise ValueError(f"rename these columns first, the result has columns of that name: {both}")


def listed(c: str, levels: list) -> Column:
    """The column itself, failing on a value that is not in ``levels``; NULL passes."""
    told = F.concat(F.lit(f"level of {c} that is not listed: "), F.col(c).cast("string"))
    return F.when(F.col(c).isNull() | F.col(c).isin(levels), F.col(c)).otherwise(F.raise_error(told))
