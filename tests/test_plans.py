"""Shape of physical plans and of files."""

import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid import sources
from phenogrid.catalog.registry import Data
from phenogrid.operators import anova, cells, distance, relate, reshape
from phenogrid.plans import staging

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def data(spark):
    return Data(spark, FOLDER)


def test_cells_are_combined_before_the_shuffle(data):
    text = plan(cells.cell_stats(data.li(), ["feature"], ["a", "b"], "value"))
    assert "partial_var_pop" in text and "Python" not in text
    assert "IsNotNull(l_extendedprice)" in text and "IsNotNull(l_returnflag)" in text
    assert "l_discount" not in text and "l_shipdate" not in text


def test_python_only_above_the_aggregate(data):
    text = plan(anova.anova_oneway(data.li(), "feature", "value", "a"))
    assert text.index("ArrowEvalPython") < text.index("HashAggregate") < text.index("FileScan")


def test_semi_join_is_a_broadcast(data):
    li = data.li()
    derived = li.groupBy("feature").agg(F.avg("value").alias("m")).where("m > 50000")
    text = plan(relate.keep_features(li, derived, ["feature"]))
    assert "LeftSemi" in text and "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_top_k_is_not_a_full_sort(data):
    assert "TakeOrderedAndProject" in plan(reshape.top_features(data.li(), "value", 5, ["sample"]))


def test_group_top_is_cut_before_the_shuffle(data):
    assert "WindowGroupLimit" in plan(reshape.top_in_group(data.li(), ["feature"], "value", 3))


def test_distances_have_no_cross_join(data):
    text = plan(distance.pairwise_distance(data.em(), "sample", "vector"))
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_attached_statistics_do_not_shuffle_the_rows(data):
    li = data.li()
    out = staging.attach(li, li.groupBy("feature").agg(F.avg("value").alias("m")), ["feature"])
    assert "Exchange hashpartitioning" not in plan(out)


def test_large_statistics_are_not_broadcast(spark, data):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        li = data.table("lineitem").select("l_orderkey", "l_quantity")
        out = staging.attach(li, li.groupBy("l_orderkey").agg(F.avg("l_quantity").alias("m")), ["l_orderkey"])
        text = plan(out)
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
        assert out.count() == li.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


class Session:
    """What the staging code asks of a session."""

    def __init__(self, master, folder=None, context_folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master, self.applicationId = master, "app-1"
        self.getCheckpointDir = lambda: context_folder


def test_staging_folder():
    assert staging.scratch_folder(Session("yarn", "s3://shared/x/")) == "s3://shared/x/phenogrid-app-1"
    assert staging.scratch_folder(Session("yarn", None, "hdfs://c")) == "hdfs://c/phenogrid-app-1"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):  # never a local folder on a cluster
        staging.scratch_folder(Session("yarn"))
    local = staging.scratch_folder(Session("local[2]"))
    assert local and staging.scratch_folder(Session("local[2]")) == local


def test_staged_table_is_a_scan(spark):
    out = staging.stage(spark.range(5))
    folder = staging.scratch_folder(spark)
    assert all(folder.removeprefix("file:") in f for f in out.inputFiles()) and out.count() == 5


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_staging_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    counts = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n"))
    made = staging.stage(counts.join(counts.withColumnRenamed("n", "m"), "k"))
    for _ in range(50):  # executors remove them in the background
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and made.count() == 700
    assert spark.conf.get(staging._CLEANUP, None) is None  # set for the job alone


def test_tables_on_the_way_are_removed(spark):
    def make():
        inner = staging.stage_alone(lambda: staging.stage(spark.range(3)).union(staging.stage(spark.range(4))))
        return staging.stage(inner.where("id > 0"))

    folder = Path(staging.scratch_folder(spark).removeprefix("file:"))
    staging.stage(spark.range(1))
    before = set(folder.iterdir())
    made = staging.stage_alone(make)
    assert len(set(folder.iterdir()) - before) == 1 and made.count() == 5
    with pytest.raises(ZeroDivisionError):
        staging.stage_alone(lambda: staging.stage(spark.range(3)).where(1 // 0))
    assert len(set(folder.iterdir()) - before) == 1 and not staging._scopes.open


@pytest.mark.parametrize("stop", [True, False])
def test_nothing_stays_after_a_script(tmp_path, stop):
    script = f"""
from pyspark.sql import SparkSession
from phenogrid.plans.staging import stage
conf = {{"spark.master": "local[1]", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}/shared"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
assert stage(spark.range(3)).count() == 3
{"spark.stop()" if stop else ""}
"""
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", script], cwd=root, check=True, timeout=120, capture_output=True)
    for _ in range(50):  # the JVM may outlive Python by a moment
        if not list((tmp_path / "shared").glob("phenogrid-*")):
            return
        time.sleep(0.2)
    raise AssertionError(list((tmp_path / "shared").rglob("*")))


def test_text_files_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("runs", T.StringType()), T.StructField("v", T.DoubleType())])
    (tmp_path / "in.csv").write_text('id,runs,v\nBLANK,NA,NA\nM1,"98, 100",10479264768\nM2,7,NA\n')
    df = sources.read_measurements(spark, str(tmp_path / "in.csv"), schema)
    kept = sources.drop_label_records(df, "id", ["BLANK"])
    assert [tuple(r) for r in kept.collect()] == [("M1", "98, 100", 10479264768.0), ("M2", "7", None)]
    sources.write_table(kept, str(tmp_path / "out"), fmt="csv")
    back = sources.read_measurements(spark, str(tmp_path / "out"), schema, fmt="csv", sep="\t")
    assert sorted(tuple(r) for r in back.collect()) == [("M1", "98, 100", 10479264768.0), ("M2", "7", None)]
    sources.write_table(kept, str(tmp_path / "parts"), partition_by=("id",))
    assert (tmp_path / "parts" / "id=M1").is_dir()
