"""Whole analyses on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import studies
from .registry import CONTROL, DIMS, EV, TIMES, TREATMENTS, Data, query, rnd, rounded
from .testing import _oneway_sql, _threeway_pairs_sql, _threeway_sql
from .tukey_sql import tukey_p_sql
from .vectors import _BRAY


@query(
    "s1_factorial_table",
    f"""WITH {_threeway_sql()} SELECT feature, term, df::BIGINT AS df, df2::BIGINT AS df_resid, round(rss, 2) AS rss, round(f, 5) AS f FROM terms""",
)
def s1(d: Data):
    out = studies.factorial_study(d.ev(), "feature", "value", ["a", "b", "time"], levels={"time": TIMES}).table
    return out.select("feature", "term", "df", "df_resid", rnd("rss", 2).alias("rss"), rnd("f", 5).alias("f"))


@query(
    "s1_factorial_significant_pairs",
    f"""WITH {_threeway_pairs_sql()}, ranges AS (SELECT feature, term, contrast, k, df, abs(diff) / se AS q FROM pairs),
 {tukey_p_sql('ranges', 'feature, term, contrast', [2, 3, 4, 6, 12])} SELECT feature, term, contrast, round(p, 5) AS p_adj FROM tukey WHERE p < 0.3""",
)
def s1p(d: Data):
    study = studies.factorial_study(d.ev(), "feature", "value", ["a", "b", "time"], alpha=0.3, levels={"time": TIMES})
    return study.posthoc.select("feature", "term", "contrast", rnd("p_adj", 5).alias("p_adj"))


_ALPHA = 0.3
_CHANGE = f"""{EV}, base AS (SELECT feature, avg(value) AS bm FROM ev WHERE treatment = '{CONTROL}' GROUP BY 1),
 del AS (SELECT feature, treatment, value - bm AS delta FROM ev JOIN base USING (feature) WHERE time = 'D35'),
 {_oneway_sql('del', 'feature', 'treatment', 'delta')},
 pairs AS (SELECT x.feature, x.lev || ' - ' || y.lev AS contrast, 4 AS k, df2 AS df,
 abs(x.m - y.m) / sqrt(ssw / df2 / 2 * (1 / x.n + 1 / y.n)) AS q FROM c x JOIN c y ON x.feature = y.feature AND x.lev < y.lev
 JOIN f ON f.feature = x.feature), {tukey_p_sql('pairs', 'feature, contrast', [4])}"""


@query("s2_change_tests", f"WITH {_CHANGE} SELECT feature, contrast, round(p, 5) AS p FROM tukey")
def s2(d: Data):
    out = studies.change_study(
        d.ev(), "feature", "value", "treatment", F.col("treatment") == CONTROL, TREATMENTS, rows=F.col("time") == "D35"
    )
    return out.tests.select("feature", "contrast", rnd("p", 5).alias("p"))


@query(
    "s2_change_table",
    f"""WITH {_CHANGE} SELECT feature, {', '.join(f"round(avg(delta) FILTER (treatment = '{t}'), 6) AS avgchange_{t}" for t in TREATMENTS)},
 {', '.join(f"round(sqrt(var_samp(delta) FILTER (treatment = '{t}') / count(delta) FILTER (treatment = '{t}')), 6) AS sechange_{t}" for t in TREATMENTS)}
 FROM del WHERE feature IN (SELECT feature FROM tukey WHERE p < {_ALPHA}) GROUP BY 1""",
)
def s2t(d: Data):
    out = studies.change_study(
        d.ev(), "feature", "value", "treatment", F.col("treatment") == CONTROL, TREATMENTS, _ALPHA, rows=F.col("time") == "D35"
    )
    return rounded(out.table, *[c for c in out.table.columns if c != "feature"])


@query(
    "s3_community_pairs",
    f"""WITH {_BRAY}, n AS (SELECT grp, count(*) AS n FROM vec GROUP BY 1),
 w AS (SELECT n.grp, n.n, coalesce(sum(d * d), 0) AS q FROM n LEFT JOIN bray ON gi = n.grp AND gj = n.grp GROUP BY 1, 2),
 x AS (SELECT least(gi, gj) AS a, greatest(gi, gj) AS b, sum(d * d) AS q FROM bray WHERE gi <> gj GROUP BY 1, 2),
 r AS (SELECT wa.grp || ' vs ' || wb.grp AS pair, wa.n + wb.n AS nn, (wa.q + wb.q + x.q) / (wa.n + wb.n) AS sst, wa.q / wa.n + wb.q / wb.n AS ssw
 FROM x JOIN w wa ON wa.grp = x.a JOIN w wb ON wb.grp = x.b)
 SELECT pair, round((sst - ssw) / (ssw / (nn - 2)), 6) AS f, round((sst - ssw) / sst, 6) AS r2 FROM r""",
)
def s3(d: Data):
    out = studies.community_study(d.em_long(), "sample", "grp", "feature", "value", DIMS, p=False)
    return out.where("term = 'group'").select("pair", rnd("f").alias("f"), rnd("r2").alias("r2"))
