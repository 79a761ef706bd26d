"""Wide and long forms, stacking, top rows, and change from control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline, reshape, scale
from ..operators.summarize import summarize
from .registry import BRANDS, CONTROL, EML, EV, EVENT_TYPES, LI, TIMES, TREATMENTS, Data, query, rnd, rounded


@query(
    "k1_wide_to_long",
    """SELECT l_orderkey, l_linenumber, feature, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
 UNPIVOT (value FOR feature IN (l_quantity, l_discount, l_tax))""",
)
def k1(d: Data):
    return reshape.to_long(d.table("lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query(
    "k2_long_to_wide",
    f"""WITH {EV} SELECT subject, time, {', '.join(f"max(CASE WHEN feature = '{e}' THEN value END) AS {e}" for e in EVENT_TYPES)}
 FROM ev GROUP BY 1, 2""",
)
def k2(d: Data):
    return reshape.to_wide(d.ev(), ["subject", "time"], "feature", "value", EVENT_TYPES)


@query(
    "k3_explode_keys",
    """SELECT o_custkey, run FROM (SELECT o_custkey, unnest(string_split(o_orderkey || ', ' || (o_orderkey + 1), ', ')) AS run FROM orders)""",
)
def k3(d: Data):
    cell = F.concat_ws(", ", F.col("o_orderkey").cast("string"), (F.col("o_orderkey") + 1).cast("string"))
    return reshape.explode_keys(d.table("orders").select("o_custkey", cell.alias("run")), "run")


_PAIRS = [f"{t}_{day}" for t in TREATMENTS for day in TIMES]


@query(
    "k4_stats_wide",
    f"""WITH {EV} SELECT feature, {', '.join(
        f"round(avg(CASE WHEN treatment || '_' || time = '{x}' THEN value END), 6) AS mean_{x}" for x in _PAIRS)},
 {', '.join(f"count(CASE WHEN treatment || '_' || time = '{x}' THEN value END) AS n_{x}" for x in _PAIRS)} FROM ev GROUP BY 1""",
)
def k4(d: Data):
    stats = {"mean": F.avg("value"), "n": F.count("value")}
    wide = reshape.stats_wide(d.ev(), ["feature"], ["treatment", "time"], stats, _PAIRS)
    return rounded(wide, *[f"mean_{x}" for x in _PAIRS])


@query(
    "k5_mean_sd_table",
    f"""WITH {LI} SELECT feature, {', '.join(
        f"round(avg(CASE WHEN a = '{x}' THEN value END), 4) AS {x}_mean, round(stddev_samp(CASE WHEN a = '{x}' THEN value END), 4) AS {x}_sd"
        for x in 'ANR')} FROM li GROUP BY 1""",
)
def k5(d: Data):
    stats = {"mean": F.avg("value"), "sd": F.stddev_samp("value")}
    wide = reshape.stats_wide(d.li(), ["feature"], ["a"], stats, ["A", "N", "R"], stat_first=False)
    return rounded(wide, *[c for c in wide.columns if c != "feature"], digits=4)


@query(
    "k6_row_bind",
    """SELECT l_orderkey AS k, 'POS' AS ion, l_extendedprice AS v FROM lineitem UNION ALL
 SELECT o_orderkey, 'NEG', o_totalprice FROM orders""",
)
def k6(d: Data):
    pos = d.table("lineitem").select(F.col("l_orderkey").alias("k"), F.lit("POS").alias("ion"), F.col("l_extendedprice").alias("v"))
    neg = d.table("orders").select(F.lit("NEG").alias("ion"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return reshape.stack([pos, neg])


@query("k7_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def k7(d: Data):
    return d.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query(
    "k8_top_features",
    f"""WITH {LI} SELECT feature, a, round(avg(value), 4) AS mean FROM li GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25""",
)
def k8(d: Data):
    means = rounded(summarize(d.li(), ["feature", "a"], "value", ("mean",)), "mean", digits=4)
    return reshape.top_features(means, "mean", 25, ["feature", "a"])


@query(
    "k9_top_in_group",
    """SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT *, rank() OVER (PARTITION BY o_orderpriority
 ORDER BY o_totalprice DESC)::INT AS rank FROM orders) WHERE rank <= 25""",
)
def k9(d: Data):
    rows = d.table("orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return reshape.top_in_group(rows, ["o_orderpriority"], "o_totalprice", 25)


_BASE = f"""{EV}, base AS (SELECT feature, avg(value) AS base_mean, sqrt(var_samp(value) / count(value)) AS base_se
 FROM ev WHERE treatment = '{CONTROL}' GROUP BY 1)"""


def _control():
    return F.col("treatment") == CONTROL


@query("b1_baseline_stats", f"WITH {_BASE} SELECT feature, round(base_mean, 6) AS base_mean, round(base_se, 6) AS base_se FROM base")
def b1(d: Data):
    return rounded(baseline.baseline_stats(d.ev(), ["feature"], "value", _control()), "base_mean", "base_se")


@query(
    "b2_delta_from_baseline",
    f"WITH {_BASE} SELECT event_id, round(value - base_mean, 6) AS delta FROM ev LEFT JOIN base USING (feature)",
)
def b2(d: Data):
    rows = d.ev().select("event_id", "treatment", "feature", "value")
    out = baseline.delta_from_baseline(rows, ["feature"], "value", _control())
    return rounded(out.select("event_id", "delta"), "delta")


@query(
    "b2_delta_zeroed",
    f"""WITH {_BASE} SELECT event_id, round(CASE WHEN treatment = '{CONTROL}' THEN 0 ELSE value - base_mean END, 6) AS delta
 FROM ev LEFT JOIN base USING (feature)""",
)
def b2z(d: Data):
    rows = d.ev().select("event_id", "treatment", "feature", "value")
    out = baseline.delta_from_baseline(rows, ["feature"], "value", _control(), zero_baseline=True)
    return rounded(out.select("event_id", "delta"), "delta")


@query(
    "b3_delta_table",
    f"""WITH {_BASE}, del AS (SELECT feature, treatment || '_' || time AS g, value - base_mean AS delta FROM ev JOIN base USING (feature)
 WHERE feature IN (SELECT feature FROM ev GROUP BY 1 HAVING avg(value) > 49.5))
 SELECT feature, {', '.join(f"round(avg(CASE WHEN g = '{x}' THEN delta END), 6) AS avgchange_{x}" for x in _PAIRS)},
 {', '.join(f"round(sqrt(var_samp(CASE WHEN g = '{x}' THEN delta END) / count(CASE WHEN g = '{x}' THEN delta END)), 6) AS sechange_{x}" for x in _PAIRS)}
 FROM del GROUP BY 1""",
)
def b3(d: Data):
    ev = d.ev()
    wanted = summarize(ev, ["feature"], "value", ("mean",)).where("mean > 49.5")
    deltas = baseline.delta_from_baseline(ev, ["feature"], "value", _control())
    wide = baseline.delta_table(deltas, "feature", ["treatment", "time"], _PAIRS, wanted)
    return rounded(wide, *[c for c in wide.columns if c != "feature"])


@query(
    "b4_baseline_scope",
    f"""WITH {EV}, base AS (SELECT feature, time, avg(value) AS base_mean FROM ev WHERE treatment = '{CONTROL}' GROUP BY 1, 2)
 SELECT event_id, round(value - base_mean, 6) AS delta FROM ev LEFT JOIN base USING (feature, time)""",
)
def b4(d: Data):
    out = baseline.delta_from_baseline(d.ev(), ["feature", "time"], "value", _control())
    return rounded(out.select("event_id", "delta"), "delta")


_TOP = 10


@query(
    "x3_feature_matrix",
    f"""WITH {LI}, top AS (SELECT feature FROM li GROUP BY 1 ORDER BY round(avg(value), 4) DESC, 1 LIMIT {_TOP})
 SELECT yr, b, {', '.join(f'''round(avg(CASE WHEN feature = '{f}' THEN value END), 4) AS "{f}"''' for f in BRANDS)}
 FROM li WHERE feature IN (SELECT feature FROM top) GROUP BY 1, 2""",
)
def x3(d: Data):
    li = d.li()
    means = rounded(summarize(li, ["feature"], "value", ("mean",)), "mean", digits=4)
    top = reshape.top_features(means, "mean", _TOP, ["feature"])
    wide = scale.feature_matrix(li, ["yr", "b"], "feature", "value", BRANDS, top)
    return wide.select("yr", "b", *[rnd(f"`{f}`", 4).alias(f) for f in BRANDS])


@query(
    "x1_range_scale",
    f"""WITH {EML} SELECT sample, dim, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS scaled
 FROM eml WINDOW w AS (PARTITION BY dim)""",
)
def x1(d: Data):
    rows = scale.range_scale(d.em_long(), "dim", "value")
    return rounded(rows.select("sample", "dim", "scaled"), "scaled")


@query(
    "x2_zscore",
    f"""WITH {EML} SELECT sample, dim, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS scaled
 FROM eml WINDOW w AS (PARTITION BY dim)""",
)
def x2(d: Data):
    return rounded(scale.zscore(d.em_long(), "dim", "value").select("sample", "dim", "scaled"), "scaled")


@query(
    "x4_pareto_scale",
    f"""WITH {LI} SELECT feature, count(*) AS n, round(min(s), 4) AS lo, round(max(s), 4) AS hi FROM (SELECT feature,
 (value - avg(value) OVER w) / nullif(sqrt(stddev_samp(value) OVER w), 0) AS s FROM li WINDOW w AS (PARTITION BY feature)) GROUP BY 1""",
)
def x4p(d: Data):
    rows = scale.pareto_scale(d.li(), "feature", "value")
    return rows.groupBy("feature").agg(
        F.count("*").alias("n"), rnd(F.min("scaled"), 4).alias("lo"), rnd(F.max("scaled"), 4).alias("hi")
    )


@query("x4_log_transform", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN log2(c_acctbal) END, 6) AS scaled FROM customer")
def x4l(d: Data):
    return rounded(scale.log_transform(d.table("customer"), "c_acctbal").select("c_custkey", "scaled"), "scaled")


@query(
    "x4_quantile_normalise",
    f"""WITH {EML}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value) AS rn,
 rank() OVER (PARTITION BY sample ORDER BY value) AS rk, count(*) OVER (PARTITION BY sample, value) AS w FROM eml),
 g AS (SELECT rn, avg(value) AS goal FROM r GROUP BY 1)
 SELECT sample, dim, round((lo.goal + hi.goal) / 2, 6) AS scaled FROM r
 JOIN g lo ON lo.rn = floor(rk + (w - 1) / 2.0) JOIN g hi ON hi.rn = ceil(rk + (w - 1) / 2.0)""",
)
def x4q(d: Data):
    rows = scale.quantile_normalise(d.em_long(), "sample", "value")
    return rounded(rows.select("sample", "dim", "scaled"), "scaled")


# Values fall out by a rule of their own, so samples differ in size; a few keep one value, or none.
_GAPS = "(sample * 31 + dim * 17) % 11 > sample % 5 AND (sample % 97 <> 5 OR dim = 7) AND sample % 89 <> 3"


@query(
    "x4_quantile_unequal",
    f"""WITH {EML}, k AS (SELECT sample, dim, CASE WHEN {_GAPS} THEN value END AS value FROM eml),
 r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value) AS rn, rank() OVER (PARTITION BY sample ORDER BY value) AS rk,
 count(*) OVER (PARTITION BY sample, value) AS w, count(*) OVER (PARTITION BY sample) AS n FROM k WHERE value IS NOT NULL),
 g AS (SELECT n, rn, sum(value) AS g FROM r GROUP BY 1, 2), s AS (SELECT count(DISTINCT sample) AS s FROM r),
 sizes AS (SELECT DISTINCT n AS m FROM g),
 spots AS (SELECT g.n, g.rn, m, CASE WHEN g.n = 1 THEN (m - 1) / 2.0 ELSE CAST((g.rn - 1) * (m - 1) AS DOUBLE) / (g.n - 1) END AS pos FROM g, sizes),
 goal AS (SELECT p.n, p.rn, sum(lo.g + (hi.g - lo.g) * (pos - floor(pos))) / any_value(s) AS goal FROM spots p
 JOIN g lo ON lo.n = m AND lo.rn = floor(pos) + 1 JOIN g hi ON hi.n = m AND hi.rn = ceil(pos) + 1, s GROUP BY 1, 2)
 SELECT k.sample, k.dim, round((lo.goal + hi.goal) / 2, 6) AS scaled FROM k LEFT JOIN r USING (sample, dim)
 LEFT JOIN goal lo ON lo.n = r.n AND lo.rn = floor(rk + (w - 1) / 2.0) LEFT JOIN goal hi ON hi.n = r.n AND hi.rn = ceil(rk + (w - 1) / 2.0)""",
)
def x4u(d: Data):
    kept = F.when(F.expr(_GAPS), F.col("value"))
    rows = scale.quantile_normalise(d.em_long().withColumn("value", kept), "sample", "value")
    return rounded(rows.select("sample", "dim", "scaled"), "scaled")
