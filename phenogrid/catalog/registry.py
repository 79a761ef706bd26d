"""Registration of queries, and the roles the test tables play in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(data) -> DataFrame`` and, if given, the SQL with the same result."""

    def register(fn: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, digits) for c in cols})


TIMES = ["D7", "D21", "D35"]
TREATMENTS = ["EX_AL", "EX_ER", "SED_AL", "SED_ER"]
CONTROL = "SED_AL"
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
DIMS = [str(i) for i in range(64)]


class Data:
    """Test tables under one folder, in the roles of a study."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def li(self) -> DataFrame:
        """Measurements: price by brand (feature), return flag and line status (factors)."""
        part = self.table("part").select("p_partkey", F.col("p_brand").alias("feature"))
        item = self.table("lineitem")
        return item.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("sample"),
            "feature",
            F.col("l_returnflag").alias("a"),
            F.col("l_linestatus").alias("b"),
            F.col("l_extendedprice").alias("value"),
            F.col("l_quantity").alias("x"),
            F.col("l_discount").alias("x2"),
            F.year("l_shipdate").alias("yr"),
        )

    def ev(self) -> DataFrame:
        """Measurements in a 2 x 2 trial over time: event value by event type (feature)."""
        user = F.col("user_id")
        day = F.dayofmonth("ts")
        time = F.when(day <= 10, "D7").when(day <= 20, "D21").otherwise("D35")
        a = F.when(user % 2 == 0, "EX").otherwise("SED")
        b = F.when(F.floor(user / 2) % 2 == 0, "AL").otherwise("ER")
        subject = F.concat(F.lit("15-02-M"), user.cast("string"))
        place = F.when(F.col("event_type") == "purchase", "tumor").otherwise(F.concat(F.lit("plasma"), time))
        return self.table("events").select(
            "event_id",
            "user_id",
            F.concat_ws("_", subject, place).alias("id"),
            subject.alias("subject"),
            a.alias("a"),
            b.alias("b"),
            F.concat_ws("_", a, b).alias("treatment"),
            time.alias("time"),
            F.col("event_type").alias("feature"),
            "value",
        )

    def em(self) -> DataFrame:
        """Packed samples: one array per vector, label as group."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("sample"),
            F.col("label").alias("grp"),
            F.col("embedding").cast("array<double>").alias("vector"),
        )

    def em_long(self) -> DataFrame:
        long = self.em().select("sample", "grp", F.posexplode("vector").alias("dim", "value"))
        return long.withColumn("feature", F.col("dim").cast("string"))

    def pvals(self) -> DataFrame:
        """p-values in families by market segment."""
        p = ((F.col("c_custkey") * 7919) % 9973 + 1) / F.lit(9975.0)
        return self.table("customer").select(
            F.col("c_custkey").alias("test"), F.col("c_mktsegment").alias("family"), p.alias("p")
        )

    def cu(self) -> DataFrame:
        """Customers with the total of their orders as covariate."""
        spent = self.table("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
        cust = self.table("customer")
        return cust.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select(
            "c_custkey", F.col("c_mktsegment").alias("segment"), "c_acctbal", "spent"
        )


# The same roles in SQL.
LI = """li AS (SELECT l_orderkey AS sample, p_brand AS feature, l_returnflag AS a, l_linestatus AS b,
 l_extendedprice AS value, l_quantity AS x, l_discount AS x2, CAST(year(l_shipdate) AS INTEGER) AS yr
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""
EV = """ev AS (SELECT *, a || '_' || b AS treatment,
 subject || '_' || CASE WHEN feature = 'purchase' THEN 'tumor' ELSE 'plasma' || time END AS id
 FROM (SELECT event_id, user_id, '15-02-M' || user_id AS subject,
 CASE WHEN user_id % 2 = 0 THEN 'EX' ELSE 'SED' END AS a,
 CASE WHEN (user_id // 2) % 2 = 0 THEN 'AL' ELSE 'ER' END AS b,
 CASE WHEN day(ts) <= 10 THEN 'D7' WHEN day(ts) <= 20 THEN 'D21' ELSE 'D35' END AS time,
 event_type AS feature, value FROM events))"""
EM = """em AS (SELECT vec_id AS sample, label AS grp, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"""
EML = EM + """, eml AS (SELECT sample, grp, CAST(dim - 1 AS INTEGER) AS dim, value FROM
 (SELECT sample, grp, unnest(vector) AS value, generate_subscripts(vector, 1) AS dim FROM em))"""
PA = """pa AS (SELECT c_custkey AS test, c_mktsegment AS family, ((c_custkey * 7919) % 9973 + 1) / 9975.0 AS p
 FROM customer)"""
CU = """cu AS (SELECT c_custkey, c_mktsegment AS segment, c_acctbal, spent FROM customer
 LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def t_tail_sql(source: str, keys: str) -> str:
    """CTE ``tails(keys, p)``: two-sided t tail of ``source(keys, t, df)`` by Simpson's rule in
    the angle atan(t / sqrt(df)), where the density is a power of the cosine."""
    return f"""angles AS (SELECT {keys}, df, atan(abs(t) / sqrt(df)) AS top FROM {source}),
 tails AS (SELECT {keys}, greatest(0.0, 1 - 2 * any_value(exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()))
 * sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(top * i / 4000), df - 1))
 * any_value(top) / 12000) AS p FROM angles, range(0, 4001) r(i) GROUP BY {keys})"""
