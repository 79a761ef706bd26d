"""Staging of intermediate results in the cluster's shared folder.

A staged table has a known size on disk. Catalyst compares that size with
``spark.sql.autoBroadcastJoinThreshold``, so a join with it is a broadcast only when the table
really is small and a shuffled join (with AQE skew handling) otherwise. Staging also cuts
lineage, and it survives the loss of executors because it lives in shared storage.

The folder is the one named by ``spark.checkpoint.dir``. Only a session whose executors are
threads of the driver (``local`` or ``local[n]``) may leave it unset; everywhere else a missing
folder is an error. Staged tables are removed by :func:`unstage` or :func:`stage_alone`, and at the latest when the
driver's JVM ends, whether or not the session was stopped before. The shuffle files of the job that
writes a staged table go as that job ends.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, str] = {}
_swept: set[str] = set()


class _Scopes(threading.local):
    """Per thread: the tables staged within each open ``stage_alone``."""

    def __init__(self):
        self.open: list[list[DataFrame]] = []


_scopes = _Scopes()


def scratch_folder(spark: SparkSession) -> str:
    """Folder for staged tables: the session's checkpoint folder, or, in local mode without
    one, a temporary folder of this process."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="phenogrid-")
        shared = _local_folders[app]
    return f"{shared.rstrip('/')}/phenogrid-{app}"


def _place(spark: SparkSession, path: str):
    """Spark's file system for a path, and the path in it."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession) -> str:
    """A new path in the scratch folder, which goes when the driver's JVM ends."""
    folder = scratch_folder(spark)
    if folder not in _swept:
        files, target = _place(spark, folder)
        files.mkdirs(target)
        files.deleteOnExit(target)
        _swept.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside removes its shuffle files as it ends. Left to the garbage collection of the
    driver, those of many jobs pile up on the executors' disks."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return it as a scan. Runs a job. ``options`` are
    those of the Parquet writer."""
    path = scratch_path(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        df.write.options(**options).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._phenogrid_path = path
    if _scopes.open:
        _scopes.open[-1].append(staged)
    return staged


def stage_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """Stage what ``make`` returns, unless ``make`` has, and remove the tables it staged on the way, which
    nothing else may read."""
    _scopes.open.append([])
    made = None
    try:
        found = make()
        made = found if any(found is table for table in _scopes.open[-1]) else stage(found)
    finally:
        for table in _scopes.open.pop():
            if table is not made:
                unstage(table)
    if _scopes.open:
        _scopes.open[-1].append(made)
    return made


def unstage(df: DataFrame) -> None:
    """Delete a table made by :func:`stage`, once no plan reads it any more."""
    files, target = _place(df.sparkSession, df._phenogrid_path)
    files.delete(target, True)


def attach(df: DataFrame, stats: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """Left join of per-group statistics onto the rows they describe; NULL keys match.

    ``stats`` has one row per group. It is staged first, so the big side is not shuffled
    when the statistics fit under the broadcast threshold.
    """
    if not keys:
        row = stats.first()  # an aggregate without groups is one row
        return df.withColumns({c: F.lit(row[c]).cast(stats.schema[c].dataType) for c in stats.columns})
    small = stage(stats)
    renamed = small.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    cond = None
    for k in keys:
        term = df[k].eqNullSafe(renamed[f"_key_{k}"])
        cond = term if cond is None else cond & term
    return df.join(renamed, cond, "left").drop(*[f"_key_{k}" for k in keys])
