"""Grouped summaries, distributions, multiple testing and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anova, multiple, regression, reshape, summarize
from ..sources import read_measurements
from .registry import CU, EV, LI, PA, Data, query, rnd, rounded, t_tail_sql
from .tukey_sql import normal_quantiles_sql


_CLASSES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("a1_group_mean", f"WITH {LI} SELECT feature, a, round(avg(value), 4) AS mean FROM li GROUP BY 1, 2")
def a1(d: Data):
    return rounded(summarize.summarize(d.li(), ["feature", "a"], "value", ("mean",)), "mean", digits=4)


@query(
    "a2_mean_sd",
    f"WITH {LI} SELECT feature, a, b, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd FROM li GROUP BY 1, 2, 3",
)
def a2(d: Data):
    return rounded(summarize.summarize(d.li(), ["feature", "a", "b"], "value", ("mean", "sd")), "mean", "sd", digits=4)


@query(
    "a3_mean_se",
    f"""WITH {LI} SELECT feature, a, count(value) AS n, round(avg(value), 4) AS mean, round(sqrt(var_samp(value) / count(value)), 4) AS se
 FROM li GROUP BY 1, 2""",
)
def a3(d: Data):
    return rounded(summarize.summarize(d.li(), ["feature", "a"], "value", ("n", "mean", "se")), "mean", "se", digits=4)


@query(
    "a4_interval",
    f"""WITH {EV} SELECT feature, treatment, round(avg(value) - 1.96 * stddev_samp(value), 6) AS lo,
 round(avg(value) + 1.96 * stddev_samp(value), 6) AS hi FROM ev GROUP BY 1, 2""",
)
def a4(d: Data):
    out = summarize.interval(d.ev(), ["feature", "treatment"], "value")
    return rounded(out.select("feature", "treatment", "lo", "hi"), "lo", "hi")


@query("a5_row_count", f"WITH {EV} SELECT treatment, time, count(*) AS rows FROM ev GROUP BY 1, 2")
def a5(d: Data):
    return summarize.summarize(d.ev(), ["treatment", "time"], "value", ("rows",))


@query("a6_replicates", f"WITH {EV} SELECT treatment, time, count(DISTINCT subject) AS reps FROM ev GROUP BY 1, 2")
def a6(d: Data):
    return summarize.replicates(d.ev(), ["treatment", "time"], "subject")


@query(
    "a7_count_by_each",
    """SELECT 'source' AS "group", source AS level, count(*) AS n FROM documents GROUP BY 2
 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2""",
)
def a7(d: Data):
    return summarize.count_by_each(d.table("documents"), ["source", "lang"])


@query(
    "a8_class_means_wide",
    "SELECT l_orderkey AS sample, "
    + ", ".join(f"round(avg(CASE WHEN p_type = '{c}' THEN l_extendedprice END), 4) AS \"{c}\"" for c in _CLASSES)
    + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def a8(d: Data):
    part = d.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("class"))
    rows = d.table("lineitem").join(part, "l_partkey").withColumnRenamed("l_orderkey", "sample")
    means = summarize.class_means(rows, ["sample"], "class", "l_extendedprice")
    return rounded(reshape.to_wide(means, ["sample"], "class", "mean", _CLASSES), *_CLASSES, digits=4)


@query("a9_group_sum", f"WITH {LI} SELECT feature, a, round(sum(value), 2) AS sum FROM li GROUP BY 1, 2")
def a9(d: Data):
    return rounded(summarize.summarize(d.li(), ["feature", "a"], "value", ("sum",)), "sum", digits=2)


@query(
    "a10_five_number",
    f"""WITH {LI}, q AS (SELECT feature, count(value) AS n, min(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
 quantile_cont(value, 0.75) AS q3, max(value) AS max FROM li GROUP BY 1)
 SELECT feature, n, q.min, round(q1, 4) AS q1, round(med, 4) AS med, round(q3, 4) AS q3, q.max,
 min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lo_whisker,
 max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS hi_whisker
 FROM li JOIN q USING (feature) GROUP BY ALL""",
)
def a10(d: Data):
    return rounded(summarize.five_number(d.li(), ["feature"], "value"), "q1", "med", "q3", digits=4)


@query(
    "a10_five_number_skewed",
    f"""WITH {EV}, q AS (SELECT treatment, count(value) AS n, min(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
 quantile_cont(value, 0.75) AS q3, max(value) AS max FROM ev GROUP BY 1)
 SELECT treatment, n, q.min, round(q1, 4) AS q1, round(med, 4) AS med, round(q3, 4) AS q3, q.max,
 min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lo_whisker,
 max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS hi_whisker
 FROM ev JOIN q USING (treatment) GROUP BY ALL""",
)
def a10s(d: Data):
    return rounded(summarize.five_number(d.ev(), ["treatment"], "value"), "q1", "med", "q3", digits=4)


@query(
    "a11_histogram",
    """WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
 SELECT least(floor((l_quantity - lo) * 20 / (hi - lo)) + 1, 20)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""",
)
def a11(d: Data):
    return summarize.histogram(d.table("lineitem"), "l_quantity", 20)


@query(
    "a11_histogram_by_group",
    f"""WITH {EV}, e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM ev GROUP BY 1)
 SELECT feature, least(floor((value - lo) * 10 / (hi - lo)) + 1, 10)::INT AS bin, count(*) AS n FROM ev JOIN e USING (feature) GROUP BY 1, 2""",
)
def a11g(d: Data):
    return summarize.histogram(d.ev(), "value", 10, by=("feature",))


@query(
    "a12_qq_points",
    f"""WITH {LI} SELECT feature, CAST(i AS INTEGER) AS point, round(quantile_cont(value, [{', '.join(str((i - 0.5) / 19) for i in range(1, 20))}])[i], 4)
 AS sample_quantile FROM li, range(1, 20) r(i) GROUP BY feature, i""",
)
def a12(d: Data):
    points = summarize.qq_points(d.li(), "value", 19, by=("feature",))
    return rounded(points.select("feature", "point", "sample_quantile"), "sample_quantile", digits=4)


@query(
    "a12_qq_points_normal",
    f"""WITH {LI}, {normal_quantiles_sql(99)}, q AS (SELECT quantile_cont(value, [{', '.join(str((i - 0.5) / 99) for i in range(1, 100))}]) AS v FROM li)
 SELECT point, round(theoretical, 6) AS theoretical, round(v[point], 4) AS sample_quantile FROM normal, q""",
)
def a12n(d: Data):
    points = summarize.qq_points(d.li(), "value", 99)
    return points.select("point", rnd("theoretical").alias("theoretical"), rnd("sample_quantile", 4).alias("sample_quantile"))


@query(
    "a13_error_bars",
    f"""WITH {EV}, d AS (SELECT feature, treatment, avg(value - 50) AS m, sqrt(var_samp(value) / count(value)) AS s FROM ev GROUP BY 1, 2)
 SELECT feature, treatment, round(m + CASE WHEN m > 0 THEN s ELSE 0 END, 6) AS ymax, round(m - CASE WHEN m < 0 THEN s ELSE 0 END, 6) AS ymin FROM d""",
)
def a13(d: Data):
    moved = d.ev().withColumn("value", F.col("value") - 50)
    bars = summarize.error_bars(summarize.summarize(moved, ["feature", "treatment"], "value", ("mean", "se")))
    return rounded(bars.select("feature", "treatment", "ymax", "ymin"), "ymax", "ymin")


@query(
    "m1_holm",
    f"""WITH {PA}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS i, count(*) OVER (PARTITION BY family) AS n FROM pa)
 SELECT test, family, round(least(1, max((n - i + 1) * p) OVER (PARTITION BY family ORDER BY p, i)), 8) AS p_adj FROM r""",
)
def m1h(d: Data):
    out = multiple.p_adjust(d.pvals(), "p", "holm", within=("family",))
    return rounded(out.select("test", "family", "p_adj"), "p_adj", digits=8)


@query(
    "m1_fdr",
    f"""WITH {PA}, r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM pa)
 SELECT test, round(least(1, min(n / i * p) OVER (ORDER BY p DESC, i DESC)), 8) AS p_adj FROM r""",
)
def m1f(d: Data):
    return rounded(multiple.p_adjust(d.pvals(), "p", "fdr").select("test", "p_adj"), "p_adj", digits=8)


@query(
    "m1_fdr_by_family",
    f"""WITH {PA}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS i, count(*) OVER (PARTITION BY family) AS n FROM pa)
 SELECT test, family, round(least(1, min(n / i * p) OVER (PARTITION BY family ORDER BY p DESC, i DESC)), 8) AS p_adj FROM r""",
)
def m1ff(d: Data):
    out = multiple.p_adjust(d.pvals(), "p", "fdr", within=("family",))
    return rounded(out.select("test", "family", "p_adj"), "p_adj", digits=8)


@query(
    "m2_fdr_given_n",
    f"""WITH {PA}, r AS (SELECT *, row_number() OVER (ORDER BY p) AS i FROM pa)
 SELECT test, round(least(1, min(100000 / i * p) OVER (ORDER BY p DESC, i DESC)), 8) AS p_adj FROM r""",
)
def m2(d: Data):
    return rounded(multiple.p_adjust(d.pvals(), "p", "fdr", n=100000).select("test", "p_adj"), "p_adj", digits=8)


@query(
    "m3_bonferroni",
    f"WITH {PA} SELECT test, round(least(1, p * count(*) OVER (PARTITION BY family)), 8) AS p_adj FROM pa",
)
def m3(d: Data):
    out = multiple.p_adjust(d.pvals(), "p", "bonferroni", within=("family",))
    return rounded(out.select("test", "p_adj"), "p_adj", digits=8)


@query(
    "g5_load_and_readjust",
    f"""WITH {PA}, r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM pa)
 SELECT test, round(least(1, max((n - i + 1) * p) OVER (ORDER BY p, i)), 8) AS holm,
 round(least(1, min(n / i * p) OVER (ORDER BY p DESC, i DESC)), 8) AS fdr FROM r""",
)
def g5(d: Data):
    schema = d.table("customer").schema
    read = read_measurements(d.spark, f"{d.folder}/customer.parquet", schema)
    p = ((F.col("c_custkey") * 7919) % 9973 + 1) / F.lit(9975.0)
    rows = read.select(F.col("c_custkey").alias("test"), p.alias("p"))
    both = multiple.p_adjust(multiple.p_adjust(rows, "p", "holm", out="holm"), "p", "fdr", out="fdr")
    return rounded(both.select("test", "holm", "fdr"), "holm", "fdr", digits=8)


def _fit_sql(x: str, keys: str = "feature") -> str:
    return f"""fit AS (SELECT {keys}, regr_count(value, {x})::BIGINT AS n, regr_slope(value, {x}) AS slope, regr_intercept(value, {x}) AS intercept,
 regr_r2(value, {x}) AS r2, sqrt((regr_syy(value, {x}) - regr_sxy(value, {x}) ^ 2 / regr_sxx(value, {x})) / (count(*) - 2) / regr_sxx(value, {x})) AS se
 FROM li GROUP BY {keys})"""


@query(
    "r1_linear_regression",
    f"""WITH {LI}, {_fit_sql('x')} SELECT feature, n, round(slope, 5) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2,
 round(se, 6) AS se, round(slope / se, 4) AS t FROM fit""",
)
def r1(d: Data):
    fit = regression.linear_regression(d.li(), "feature", "x", "value", p=False)
    return fit.select(
        "feature", "n", rnd("slope", 5).alias("slope"), rnd("intercept", 4).alias("intercept"),
        rnd("r2").alias("r2"), rnd("se").alias("se"), rnd("t", 4).alias("t"),
    )


@query(
    "r1_linear_regression_p",
    f"""WITH {LI}, {_fit_sql('x2')}, s AS (SELECT feature, slope / se AS t, n - 2 AS df FROM fit), {t_tail_sql('s', 'feature')}
 SELECT feature, round(t, 5) AS t, round(p, 6) AS p FROM s JOIN tails USING (feature)""",
)
def r1p(d: Data):
    fit = regression.linear_regression(d.li(), "feature", "x2", "value")
    return fit.select("feature", rnd("t", 5).alias("t"), rnd("p").alias("p"))


@query(
    "r2_regression_by_time",
    f"""WITH {LI}, {_fit_sql('x', 'feature, yr')} SELECT feature, yr, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2 FROM fit""",
)
def r2(d: Data):
    fit = regression.linear_regression(d.li(), "feature", "x", "value", by=("yr",), p=False)
    return rounded(fit.select("feature", "yr", "adj_r2"), "adj_r2")


@query(
    "r3_slope_sign",
    f"""WITH {LI}, {_fit_sql('x2', 'feature, yr')} SELECT feature, yr, CASE WHEN slope > 0 THEN 'pos' WHEN slope < 0 THEN 'neg' END AS sign FROM fit
 WHERE r2 > 0.002""",
)
def r3(d: Data):
    fit = regression.linear_regression(d.li(), "feature", "x2", "value", by=("yr",), p=False)
    return regression.strong_fits(regression.slope_sign(fit), 0.002).select("feature", "yr", "sign")


@query(
    "r4_pearson",
    f"""WITH {LI}, c AS (SELECT feature, count(*) AS n, corr(value, x2) AS r FROM li GROUP BY 1),
 s AS (SELECT feature, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM c), {t_tail_sql('s', 'feature')}
 SELECT feature, n, round(r, 6) AS r, round(t, 5) AS t, round(p, 6) AS p FROM c JOIN s USING (feature) JOIN tails USING (feature)""",
)
def r4(d: Data):
    found = regression.pearson(d.li(), "feature", "x2", "value")
    return found.select("feature", "n", rnd("r").alias("r"), rnd("t", 5).alias("t"), rnd("p").alias("p"))


@query(
    "r4_pearson_covariate",
    f"""WITH {CU}, c AS (SELECT segment, regr_count(c_acctbal, spent)::BIGINT AS n, corr(c_acctbal, spent) AS r FROM cu GROUP BY 1)
 SELECT segment, n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t FROM c""",
)
def r4c(d: Data):
    found = regression.pearson(d.cu(), "segment", "spent", "c_acctbal", p=False)
    return found.select("segment", "n", rnd("r").alias("r"), rnd("t", 5).alias("t"))


@query("t10_significant", f"WITH {PA} SELECT test, round(p, 8) AS p FROM pa WHERE p < 0.05")
def t10(d: Data):
    return rounded(anova.significant(d.pvals(), "p", 0.05).select("test", "p"), "p", digits=8)


@query(
    "t12_any_significant",
    f"""WITH {PA} SELECT family, test FROM (SELECT family, test, p AS p1, p * 2 AS p2, p / 3 AS p3 FROM pa) WHERE p1 < 0.05 OR p2 < 0.05 OR p3 < 0.05""",
)
def t12(d: Data):
    wide = d.pvals().select("family", "test", F.col("p").alias("p1"), (F.col("p") * 2).alias("p2"), (F.col("p") / 3).alias("p3"))
    return anova.any_significant(wide, ["p1", "p2", "p3"]).select("family", "test")
