"""Reading and writing measurement, key and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage

# Conventional long layout. Operators take column names, so other names work too.
MEASURE_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("subject_id", T.StringType()),
        T.StructField("tissue", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("treatment", T.StringType()),
        T.StructField("factor_a", T.StringType()),
        T.StructField("factor_b", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def read_measurements(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str | None = None,
    sep: str = ",",
    header: bool = True,
    null_value: str = "NA",
    corrupt: str | None = None,
) -> DataFrame:
    """Read delimited text or Parquet with a declared schema, so no inference pass runs.

    The format follows the suffix unless ``fmt`` is given; anything that is not Parquet or
    ORC is read as delimited text, with ``null_value`` standing for a missing entry. A line that
    does not fit the schema is an error; with ``corrupt``, the name of one more text column, such
    lines are kept there instead.
    """
    if fmt is None:
        suffix = path.rstrip("/").rsplit(".", 1)[-1]
        fmt = suffix if suffix in ("parquet", "orc") else "csv"
    reader = spark.read.schema(schema)
    if fmt != "csv":
        return reader.format(fmt).load(path)
    reader = reader.option("mode", "FAILFAST")
    if corrupt is not None:
        whole = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    return (
        reader.option("sep", sep)
        .option("header", header)
        .option("nullValue", null_value)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


def drop_label_records(df: DataFrame, col: str, labels: list[str]) -> DataFrame:
    """Remove blank-sample and grouping records by content; files have no stable row order."""
    return df.where(~F.coalesce(F.col(col).isin(labels), F.lit(False)))


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: tuple[str, ...] = (),
    sep: str = "\t",
    mode: str = "overwrite",
) -> None:
    """Write a result table, partitioned on disk by low-cardinality columns if asked."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        # quotes inside quoted text are doubled, as in the files this reads
        writer = writer.option("sep", sep).option("header", True).option("nullValue", "NA").option("escape", '"')
    writer.format(fmt).save(path)


def cached_dataset(df: DataFrame) -> DataFrame:
    """Parse once: keep the parsed table as Parquet in the shared scratch folder."""
    return stage(df)
