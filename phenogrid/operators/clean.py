"""Sample ids, feature names, treatments and annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import detect, extract_first, first_word, piece, replace_all

# How sample ids, feature names and treatments are written in the data.
SUBJECT_PATTERN = r"15-02-M\d+"
TUMOR_PATTERN = "_tumor"
PLASMA_PATTERN = "_plasma"
TIME_PATTERN = r"_plasma(D\d+)"
ADDED_PREFIX = r"^X(?=\d)"
LOW_CONFIDENCE_CLASS = "w/o"


def parse_sample_id(
    df: DataFrame, col: str = "id", subject: str = SUBJECT_PATTERN, tumor_time: str | None = None
) -> DataFrame:
    """Add ``subject_id``, ``tissue`` and ``time`` read from an id like ``15-02-M20_plasmaD35``.

    Tumours carry no time in their id; ``tumor_time`` names the one they were taken at.
    """
    is_tumor = detect(col, TUMOR_PATTERN)
    tissue = F.when(is_tumor, "tumor").when(detect(col, PLASMA_PATTERN), "plasma")
    time = extract_first(col, TIME_PATTERN, 1)
    if tumor_time is not None:
        time = F.when(is_tumor, F.lit(tumor_time)).otherwise(time)
    return df.withColumns({"subject_id": extract_first(col, subject), "tissue": tissue, "time": time})


def clean_name(c: Column | str) -> Column:
    """Undo the renaming of a text reader: added leading X, dots for dashes, trailing dash."""
    plain = replace_all(replace_all(c, ADDED_PREFIX), r"\.", "-")
    return replace_all(plain, "-$")


def clean_feature_name(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, clean_name(col))


def split_treatment(df: DataFrame, col: str, sep: str = "_") -> DataFrame:
    """Two factors from a combined treatment label."""
    return df.withColumns({"factor_a": piece(col, sep, 1), "factor_b": piece(col, sep, 2)})


def relabel_treatment(c: Column | str) -> Column:
    """Labels as printed: PA for EX and a plus sign between the factors."""
    return replace_all(replace_all(c, "^EX", "PA"), "_", "+")


def lipid_class(df: DataFrame, name: str, out: str = "feature_class") -> DataFrame:
    """Class = first word of the name; names of low confidence are left out."""
    return df.withColumn(out, first_word(name)).where(F.col(out) != LOW_CONFIDENCE_CLASS)


def parse_instrument_sample(df: DataFrame, sample: str, run: str) -> DataFrame:
    """Tissue, subject and time from a name like ``D35_M1`` (plasma) or ``M7`` (tumour), ion mode
    and short run id from an instrument file name like ``POS_12.wiff``."""
    is_plasma = detect(sample, "_")
    return df.withColumns(
        {
            "tissue": F.when(is_plasma, "plasma").otherwise("tumor"),
            "subject_id": F.when(is_plasma, piece(sample, "_", 2)).otherwise(F.col(sample)),
            "time": F.when(is_plasma, piece(sample, "_", 1)),
            "ion": F.when(detect(run, "POS"), "POS").otherwise("NEG"),
            "short_id": piece(run, ".wiff", 1),
        }
    )


def annotate(
    df: DataFrame, dim: DataFrame, feature: str, on: str, preferred: str, out: str = "feature_name"
) -> DataFrame:
    """Clean the feature name, look it up in ``dim[on]`` and prefer the name found there."""
    cleaned = df.withColumn("clean_feature", clean_name(feature))
    found = cleaned.join(dim, cleaned["clean_feature"] == dim[on], "left")
    return found.withColumn(out, F.coalesce(F.col(preferred), F.col("clean_feature")))


def assign_class(df: DataFrame, dim: DataFrame, on: str, class_col: str) -> DataFrame:
    """Attach a class to each row through ``on``; rows of unknown class are dropped."""
    known = dim.where(F.col(class_col).isNotNull()).select(on, class_col).distinct()
    return df.join(known, on, "inner")
