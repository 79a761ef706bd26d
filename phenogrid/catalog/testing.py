"""Hypothesis tests per feature and the comparisons that follow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tails import f_tail, t_tail, tukey_critical, tukey_tail
from ..operators import anova, baseline, cells, posthoc, regression
from .registry import CONTROL, EV, LI, TIMES, TREATMENTS, Data, query, rnd, rounded, t_tail_sql
from .tukey_sql import tukey_p_sql

_YEARS = list(range(1995, 2002))


def _oneway_sql(source: str, keys: str, factor: str, value: str = "value") -> str:
    return f"""c AS (SELECT {keys}, {factor} AS lev, count({value}) AS n, avg({value}) AS m, var_pop({value}) * count({value}) AS m2
 FROM {source} GROUP BY {keys}, lev),
 g AS (SELECT {keys}, sum(n) AS nn, sum(n * m) / sum(n) AS gm, count(*) AS k, sum(m2) AS ssw FROM c GROUP BY {keys}),
 o AS (SELECT {keys}, any_value(nn) AS nn, any_value(k) AS k, any_value(ssw) AS ssw, sum(n * (m - gm) ^ 2) AS ssb
 FROM c JOIN g USING ({keys}) GROUP BY {keys}),
 f AS (SELECT *, k - 1 AS df1, nn - k AS df2, (ssb / (k - 1)) / nullif(ssw / (nn - k), 0) AS f FROM o)"""


# With 2 numerator degrees of freedom the F tail has this closed form.
_F2 = "pow(df2 / (df2 + 2 * f), df2 / 2)"


@query(
    "t0_cell_stats",
    f"""WITH {LI} SELECT feature, a, b, count(value) AS n, round(avg(value), 4) AS mean, round(var_pop(value) * count(value) / 1e6, 4) AS m2
 FROM li GROUP BY 1, 2, 3""",
)
def t0(d: Data):
    out = cells.cell_stats(d.li(), ["feature"], ["a", "b"], "value")
    return out.select("feature", "a", "b", "n", rnd("mean", 4).alias("mean"), rnd(F.col("m2") / 1e6, 4).alias("m2"))


@query(
    "t1_anova_oneway",
    f"""WITH {LI}, {_oneway_sql('li', 'feature', 'a')}
 SELECT feature, df1, df2::BIGINT AS df2, round(f, 5) AS f, round({_F2}, 6) AS p FROM f""",
)
def t1(d: Data):
    out = anova.anova_oneway(d.li(), "feature", "value", "a")
    return rounded(rounded(out.select("feature", "df1", "df2", "f", "p"), "f", digits=5), "p")


@query(
    "t1_anova_zeroed_change",
    f"""WITH {EV}, base AS (SELECT feature, avg(value) AS bm FROM ev WHERE treatment = '{CONTROL}' GROUP BY 1),
 del AS (SELECT feature, treatment, CASE WHEN treatment = '{CONTROL}' THEN 0 ELSE value - bm END AS delta FROM ev JOIN base USING (feature)),
 {_oneway_sql('del', 'feature', 'treatment', 'delta')} SELECT feature, df1, df2::BIGINT AS df2, round(f, 5) AS f FROM f""",
)
def t1z(d: Data):
    control = F.col("treatment") == CONTROL
    deltas = baseline.delta_from_baseline(d.ev(), ["feature"], "value", control, zero_baseline=True)
    out = anova.anova_oneway(deltas, "feature", "delta", "treatment", p=False)
    return rounded(out.select("feature", "df1", "df2", "f"), "f", digits=5)


_TWOWAY = f"""{LI}, c AS (SELECT feature, a, b, count(value) AS n, avg(value) AS m, var_pop(value) * count(value) AS m2 FROM li GROUP BY 1, 2, 3),
 w AS (SELECT feature, a, sum(n) FILTER (b = 'F') AS n1, sum(n) FILTER (b = 'O') AS n2, sum(m) FILTER (b = 'F') AS m1,
 sum(m) FILTER (b = 'O') AS mm2, sum(n) AS na, sum(n * m) / sum(n) AS ma FROM c GROUP BY 1, 2),
 d AS (SELECT *, n1 * n2 / na AS wt, mm2 - m1 AS df FROM w),
 g AS (SELECT feature, sum(n) AS nn, sum(n * m) / sum(n) AS gm, count(*) AS cells, sum(m2) AS rss FROM c GROUP BY 1),
 s AS (SELECT feature, sum(na * (ma - gm) ^ 2) AS ssa, sum(wt * df) ^ 2 / sum(wt) AS ssb,
 sum(wt * df * df) - sum(wt * df) ^ 2 / sum(wt) AS ssab, sum(wt * df) / sum(wt) AS shift, sum(wt) AS wsum,
 any_value(nn) AS nn, any_value(rss) AS rss, any_value(nn - cells) AS df2, sum(n1) AS nb1, sum(n2) AS nb2 FROM d JOIN g USING (feature) GROUP BY 1),
 terms AS (SELECT feature, 'a' AS term, 2 AS df, df2, ssa / 2 / (rss / df2) AS f FROM s
 UNION ALL SELECT feature, 'b', 1, df2, ssb / (rss / df2) FROM s
 UNION ALL SELECT feature, 'a:b', 2, df2, ssab / 2 / (rss / df2) FROM s)"""


@query(
    "t2_anova_twoway",
    f"""WITH {_TWOWAY}, s1 AS (SELECT feature, sqrt(f) AS t, df2 AS df FROM terms WHERE term = 'b'), {t_tail_sql('s1', 'feature')}
 SELECT feature, term, df::BIGINT AS df, df2::BIGINT AS df_resid, round(f, 5) AS f,
 round(CASE WHEN term = 'b' THEN p ELSE {_F2} END, 6) AS p FROM terms JOIN tails USING (feature)""",
)
def t2(d: Data):
    out = anova.anova_factorial(d.li(), "feature", "value", ["a", "b"])
    return out.select("feature", "term", "df", "df_resid", rnd("f", 5).alias("f"), rnd("p").alias("p"))


@query(
    "t2_anova_twoway_wide",
    f"""WITH {_TWOWAY} SELECT feature, round(max(f) FILTER (term = 'a'), 3) AS "fStatEx", round(max(f) FILTER (term = 'b'), 3) AS "fStatWt",
 round(max(f) FILTER (term = 'a:b'), 3) AS "fStatInt" FROM terms GROUP BY 1""",
)
def t2w(d: Data):
    out = anova.anova_factorial(d.li(), "feature", "value", ["a", "b"])
    wide = anova.factorial_wide(out, ["feature"], ["a", "b"], {"a": "Ex", "b": "Wt", "a:b": "Int"})
    return wide.select("feature", "fStatEx", "fStatWt", "fStatInt")


_CODES = {"a": ["(a = 'SED')::INT"], "b": ["(b = 'ER')::INT"], "time": ["(time = 'D21')::INT", "(time = 'D7')::INT"]}
_TERMS = ["a", "b", "time", "a:b", "a:time", "b:time", "a:b:time"]


def _threeway_columns() -> list[tuple[str, str]]:
    """The intercept and each coded column with the term it belongs to."""
    columns = [("", "1.0")]
    for term in _TERMS:
        products = [""]
        for factor in term.split(":"):
            products = [f"{p}{' * ' if p else ''}{c}" for p in products for c in _CODES[factor]]
        columns += [(term, f"1.0 * {p}") for p in products]
    return columns


def _threeway_basis_sql() -> str:
    """CTEs up to ``basis``: cells of a x b x time with columns q0, q1, ... made orthogonal one by
    one, each step a query over the last, with cell counts as weights."""
    steps, last = [], "x"
    for i, (_, expr) in enumerate(_threeway_columns()):
        less = "".join(f" - q{h} * sum(n * q{h} * ({expr})) OVER w / sum(n * q{h} * q{h}) OVER w" for h in range(i))
        steps.append(f"z{i} AS (SELECT *, {expr}{less} AS q{i} FROM {last} WINDOW w AS (PARTITION BY feature))")
        last = f"z{i}"
    return f"""{EV}, raw AS (SELECT feature, a, b, time, count(value) AS n, avg(value) AS m0, var_pop(value) * count(value) AS m2 FROM ev GROUP BY 1, 2, 3, 4),
 x AS (SELECT *, m0 - sum(n * m0) OVER w / sum(n) OVER w AS m FROM raw WINDOW w AS (PARTITION BY feature)), {', '.join(steps)},
 basis AS (SELECT * FROM {last})"""


def _threeway_sql() -> str:
    """CTE ``terms``: the sequential table of the three-way fit."""
    columns = _threeway_columns()
    shares = ", ".join(f"sum(n * q{i} * m) ^ 2 / sum(n * q{i} * q{i}) AS s{i}" for i in range(1, len(columns)))
    lines = " UNION ALL ".join(
        f"SELECT feature, '{t}' AS term, {sum(c == t for c, _ in columns)} AS df, df2, "
        f"({' + '.join(f's{i}' for i, (c, _) in enumerate(columns) if c == t)}) AS ss, rss FROM parts"
        for t in _TERMS
    )
    return f"""{_threeway_basis_sql()},
 parts AS (SELECT feature, {shares}, sum(m2) AS rss, sum(n) - count(*) AS df2 FROM basis GROUP BY 1),
 lines AS ({lines}), terms AS (SELECT *, ss / df / (rss / df2) AS f FROM lines)"""


def _threeway_pairs_sql() -> str:
    """CTE ``pairs``: comparisons of the level means of every term, built from the effects of the
    term and of those inside it."""
    columns = _threeway_columns()
    effects = ", ".join(
        f"q{i} * sum(n * q{i} * m) OVER w / sum(n * q{i} * q{i}) OVER w AS e{i}" for i in range(1, len(columns))
    )
    place = {"a": "(a = 'SED')::INT", "b": "10 * (b = 'ER')::INT", "time": "100 * list_position(['D7', 'D21', 'D35'], time)"}
    size = {"a": 2, "b": 2, "time": 3}
    means = []
    for term in _TERMS:
        factors = term.split(":")
        inside = [f"e{i}" for i, (c, _) in enumerate(columns) if c and set(c.split(":")) <= set(factors)]
        label = " || ':' || ".join(factors)
        order = " + ".join(place[f] for f in factors)
        k = 1
        for f in factors:
            k *= size[f]
        means.append(
            f"SELECT feature, '{term}' AS term, {label} AS lev, {order} AS ord, {k} AS k, sum(n * ({' + '.join(inside)})) / sum(n) AS mean, "
            f"sum(n) AS rows FROM fits GROUP BY ALL"
        )
    return f"""{_threeway_basis_sql()}, fits AS (SELECT *, {effects} FROM basis WINDOW w AS (PARTITION BY feature)),
 err AS (SELECT feature, sum(n) - count(*) AS df, sum(m2) / (sum(n) - count(*)) AS mse FROM basis GROUP BY 1),
 means AS ({' UNION ALL '.join(means)}),
 pairs AS (SELECT x.feature, x.term, y.lev || '-' || x.lev AS contrast, x.k, df, y.mean - x.mean AS diff, sqrt(mse / 2 * (1 / x.rows + 1 / y.rows)) AS se
 FROM means x JOIN means y ON x.feature = y.feature AND x.term = y.term AND x.ord < y.ord JOIN err ON err.feature = x.feature)"""


@query(
    "t3_anova_threeway",
    f"""WITH {_threeway_sql()}, s1 AS (SELECT feature, term, sqrt(f) AS t, df2 AS df FROM terms WHERE df = 1), {t_tail_sql('s1', 'feature, term')}
 SELECT feature, term, df::BIGINT AS df, df2::BIGINT AS df_resid, round(ss, 4) AS ss, round(f, 5) AS f,
 round(CASE WHEN df = 1 THEN p ELSE {_F2} END, 6) AS p FROM terms LEFT JOIN tails USING (feature, term)""",
)
def t3(d: Data):
    out = anova.anova_factorial(d.ev(), "feature", "value", ["a", "b", "time"])
    return out.select("feature", "term", "df", "df_resid", rnd("ss", 4).alias("ss"), rnd("f", 5).alias("f"), rnd("p").alias("p"))


@query(
    "t3_anova_threeway_first_term",
    f"""WITH {EV}, {_oneway_sql('ev', 'feature', 'a')}, e AS (SELECT feature, sum(m2) AS rss, sum(n) - count(*) AS df_resid FROM
 (SELECT feature, count(value) AS n, var_pop(value) * count(value) AS m2 FROM ev GROUP BY feature, a, b, time) GROUP BY 1)
 SELECT feature, df_resid::BIGINT AS df_resid, round(ssb / (rss / df_resid), 5) AS f FROM f JOIN e USING (feature)""",
)
def t3a(d: Data):
    out = anova.anova_factorial(d.ev(), "feature", "value", ["a", "b", "time"], p=False)
    return out.where("term = 'a'").select("feature", "df_resid", rnd("f", 5).alias("f"))


@query(
    "t4_anova_by_stratum",
    f"""WITH {LI}, {_oneway_sql('li', 'feature, yr', 'a')}
 SELECT feature, yr, df1, df2::BIGINT AS df2, round(f, 5) AS f, round({_F2}, 6) AS p FROM f""",
)
def t4(d: Data):
    out = anova.anova_oneway(d.li(), "feature", "value", "a", by=("yr",))
    return out.select("feature", "yr", "df1", "df2", rnd("f", 5).alias("f"), rnd("p").alias("p"))


@query(
    "t4_stratum_p_table",
    f"""WITH {LI}, {_oneway_sql('li', 'feature, yr', 'a')} SELECT feature,
 {', '.join(f'round(max({_F2}) FILTER (yr = {y}), 6) AS "pval{y}"' for y in _YEARS)} FROM f GROUP BY 1""",
)
def t4p(d: Data):
    out = anova.anova_oneway(d.li(), "feature", "value", "a", by=("yr",))
    wide = anova.stratum_p_table(out, "feature", "yr", _YEARS)
    return rounded(wide, *[f"pval{y}" for y in _YEARS])


_PAIR = """JOIN c y ON x.feature = y.feature AND x.lev < y.lev JOIN f ON f.feature = x.feature"""


@query(
    "t5_tukey_oneway",
    f"""WITH {LI}, {_oneway_sql('li', 'feature', 'a')}
 SELECT x.feature, y.lev || '-' || x.lev AS contrast, round(y.m - x.m, 4) AS diff,
 round(sqrt(ssw / df2 / 2 * (1 / x.n + 1 / y.n)), 5) AS se, k, df2::BIGINT AS df FROM c x {_PAIR}""",
)
def t5(d: Data):
    out = posthoc.tukey_hsd(d.li(), "feature", "value", ["a"], p=False)
    return out.select("feature", "contrast", rnd("diff", 4).alias("diff"), rnd("se", 5).alias("se"), "k", "df")


@query(
    "t5_tukey_oneway_p",
    f"""WITH {LI}, {_oneway_sql('li', 'feature', 'a')}, pairs AS (SELECT x.feature, y.lev || '-' || x.lev AS contrast, k, df2 AS df,
 abs(x.m - y.m) / sqrt(ssw / df2 / 2 * (1 / x.n + 1 / y.n)) AS q FROM c x {_PAIR}), {tukey_p_sql('pairs', 'feature, contrast', [3])}
 SELECT feature, contrast, round(p, 5) AS p_adj FROM tukey""",
)
def t5p(d: Data):
    out = posthoc.tukey_hsd(d.li(), "feature", "value", ["a"])
    return out.select("feature", "contrast", rnd("p_adj", 5).alias("p_adj"))


@query(
    "t5_tukey_ordered_levels",
    f"""WITH {EV}, {_oneway_sql('ev', 'treatment, feature', 'time')}, ordered AS (SELECT *, list_position(['D7', 'D21', 'D35'], lev) AS ord FROM c),
 pairs AS (SELECT x.treatment, x.feature, y.lev || '-' || x.lev AS contrast, k, df2 AS df, y.m - x.m AS diff,
 abs(x.m - y.m) / sqrt(ssw / df2 / 2 * (1 / x.n + 1 / y.n)) AS q FROM ordered x JOIN ordered y ON x.feature = y.feature AND x.treatment = y.treatment
 AND x.ord < y.ord JOIN f ON f.feature = x.feature AND f.treatment = x.treatment), {tukey_p_sql('pairs', 'treatment, feature, contrast', [3])}
 SELECT treatment, feature, contrast, round(diff, 6) AS diff, round(p, 5) AS p_adj FROM tukey JOIN pairs USING (treatment, feature, contrast)""",
)
def t5o(d: Data):
    out = posthoc.tukey_hsd(d.ev(), "feature", "value", ["time"], by=("treatment",), levels={"time": TIMES})
    return out.select("treatment", "feature", "contrast", rnd("diff").alias("diff"), rnd("p_adj", 5).alias("p_adj"))


@query(
    "t5_tukey_two_levels_p",
    f"""WITH {LI}, {_oneway_sql('li', 'feature', 'b')}, s AS (SELECT feature, sqrt(f) AS t, df2 AS df FROM f), {t_tail_sql('s', 'feature')}
 SELECT x.feature, y.lev || '-' || x.lev AS contrast, round(p, 6) AS p_adj FROM c x {_PAIR} JOIN tails ON tails.feature = x.feature""",
)
def t5t(d: Data):
    out = posthoc.tukey_hsd(d.li(), "feature", "value", ["b"])
    return out.select("feature", "contrast", rnd("p_adj").alias("p_adj"))


_TWOWAY_PAIRS = f"""{_TWOWAY}, pairs AS (
 SELECT x.feature, 'a' AS term, y.a || '-' || x.a AS contrast, 3 AS k, df2 AS df, y.ma - x.ma AS diff, sqrt(rss / df2 / 2 * (1 / x.na + 1 / y.na)) AS se
 FROM w x JOIN w y ON x.feature = y.feature AND x.a < y.a JOIN s ON s.feature = x.feature
 UNION ALL SELECT feature, 'b', 'O-F', 2, df2, shift * wsum * (1 / nb1 + 1 / nb2), sqrt(rss / df2 / 2 * (1 / nb1 + 1 / nb2)) FROM s
 UNION ALL SELECT x.feature, 'a:b', y.a || ':' || y.b || '-' || x.a || ':' || x.b, 6, df2, y.m - x.m, sqrt(rss / df2 / 2 * (1 / x.n + 1 / y.n))
 FROM c x JOIN c y ON x.feature = y.feature AND (x.b < y.b OR (x.b = y.b AND x.a < y.a)) JOIN s ON s.feature = x.feature)"""


@query(
    "t6_tukey_twoway",
    f"WITH {_TWOWAY_PAIRS} SELECT feature, term, contrast, round(diff, 4) AS diff, round(se, 5) AS se FROM pairs",
)
def t6(d: Data):
    out = posthoc.tukey_hsd(d.li(), "feature", "value", ["a", "b"], p=False)
    return out.select("feature", "term", "contrast", rnd("diff", 4).alias("diff"), rnd("se", 5).alias("se"))


@query(
    "t6_tukey_twoway_p",
    f"""WITH {_TWOWAY_PAIRS}, ranges AS (SELECT feature, term, contrast, k, df, abs(diff) / se AS q FROM pairs),
 {tukey_p_sql('ranges', 'feature, term, contrast', [2, 3, 6])} SELECT feature, term, contrast, round(p, 5) AS p_adj FROM tukey""",
)
def t6pp(d: Data):
    out = posthoc.tukey_hsd(d.li(), "feature", "value", ["a", "b"])
    return out.select("feature", "term", "contrast", rnd("p_adj", 5).alias("p_adj"))


@query(
    "t6_tukey_threeway_p",
    f"""WITH {_threeway_pairs_sql()}, ranges AS (SELECT feature, term, contrast, k, df, abs(diff) / se AS q FROM pairs),
 {tukey_p_sql('ranges', 'feature, term, contrast', [2, 3, 4, 6, 12])}
 SELECT feature, term, contrast, round(diff, 6) AS diff, round(se, 6) AS se, round(p, 5) AS p_adj FROM tukey JOIN pairs USING (feature, term, contrast)""",
)
def t6p(d: Data):
    out = posthoc.tukey_hsd(d.ev(), "feature", "value", ["a", "b", "time"], levels={"time": TIMES})
    return out.select("feature", "term", "contrast", rnd("diff").alias("diff"), rnd("se").alias("se"), rnd("p_adj", 5).alias("p_adj"))


@query(
    "t7_pairwise_contrasts",
    f"""WITH {LI}, {_oneway_sql('li', 'feature', 'a')}
 SELECT x.feature, round(f, 5) AS f, x.lev || ' - ' || y.lev AS contrast, round(x.m - y.m, 4) AS estimate,
 round(sqrt(ssw / df2 * (1 / x.n + 1 / y.n)), 5) AS se, df2::BIGINT AS df,
 round((x.m - y.m) / sqrt(ssw / df2 * (1 / x.n + 1 / y.n)), 6) AS t FROM c x {_PAIR}""",
)
def t7(d: Data):
    out = posthoc.pairwise_contrasts(d.li(), "feature", "value", "a", p=False)
    return out.select(
        "feature", rnd("f", 5).alias("f"), "contrast", rnd("estimate", 4).alias("estimate"),
        rnd("se", 5).alias("se"), "df", rnd("t").alias("t"),
    )


@query(
    "t7_pairwise_two_levels_p",
    f"""WITH {LI}, {_oneway_sql('li', 'feature', 'b')}, s AS (SELECT feature, sqrt(f) AS t, df2 AS df FROM f), {t_tail_sql('s', 'feature')}
 SELECT feature, round(p, 6) AS p FROM tails""",
)
def t7p(d: Data):
    return posthoc.pairwise_contrasts(d.li(), "feature", "value", "b").select("feature", rnd("p").alias("p"))


@query(
    "t7_pairwise_contrasts_p",
    f"""WITH {EV}, {_oneway_sql('ev', 'feature, time', 'treatment')}, pairs AS (SELECT x.feature, x.time, x.lev || ' - ' || y.lev AS contrast, k,
 df2 AS df, abs(x.m - y.m) / sqrt(ssw / df2 / 2 * (1 / x.n + 1 / y.n)) AS q FROM c x JOIN c y ON x.feature = y.feature AND x.time = y.time
 AND x.lev < y.lev JOIN f ON f.feature = x.feature AND f.time = x.time), {tukey_p_sql('pairs', 'feature, time, contrast', [4])}
 SELECT feature, time, contrast, round(p, 5) AS p FROM tukey""",
)
def t7pp(d: Data):
    out = posthoc.pairwise_contrasts(d.ev(), "feature", "value", "treatment", by=("time",))
    return out.select("feature", "time", "contrast", rnd("p", 5).alias("p"))


def _welch_sql(source: str, keys: str, factor: str, one: str, two: str) -> str:
    return f"""c AS (SELECT {keys}, {factor} AS lev, count(value) AS n, avg(value) AS m, var_samp(value) / count(value) AS e FROM {source} GROUP BY {keys}, lev),
 x AS (SELECT * FROM c WHERE lev = '{one}'), y AS (SELECT * FROM c WHERE lev = '{two}'),
 s AS (SELECT {keys}, x.m AS mean1, y.m AS mean2, (x.m - y.m) / sqrt(x.e + y.e) AS t,
 (x.e + y.e) ^ 2 / (x.e ^ 2 / (x.n - 1) + y.e ^ 2 / (y.n - 1)) AS df FROM x JOIN y USING ({keys}))"""


@query(
    "t8_welch_t_test",
    f"""WITH {LI}, {_welch_sql('li', 'feature', 'b', 'F', 'O')}, {t_tail_sql('s', 'feature')}
 SELECT feature, round(mean1, 4) AS mean1, round(mean2, 4) AS mean2, round(t, 6) AS t, round(df, 4) AS df, round(p, 6) AS p
 FROM s JOIN tails USING (feature)""",
)
def t8(d: Data):
    out = posthoc.welch_t_test(d.li(), "feature", "value", "b")
    return out.select(
        "feature", rnd("mean1", 4).alias("mean1"), rnd("mean2", 4).alias("mean2"),
        rnd("t").alias("t"), rnd("df", 4).alias("df"), rnd("p").alias("p"),
    )


@query(
    "t9_welch_per_treatment",
    f"""WITH {EV}, {_welch_sql('ev', 'treatment, feature', 'time', 'D35', 'D7')}, {t_tail_sql('s', 'treatment, feature')}
 SELECT treatment, feature, round(t, 6) AS t, round(df, 4) AS df, round(p, 6) AS p FROM s JOIN tails USING (treatment, feature)""",
)
def t9(d: Data):
    out = posthoc.welch_t_test(d.ev(), "feature", "value", "time", by=("treatment",), levels=["D35", "D7"])
    return out.select("treatment", "feature", rnd("t").alias("t"), rnd("df", 4).alias("df"), rnd("p").alias("p"))


@query(
    "t11_significance_matrix",
    f"""WITH {EV}, {_welch_sql('ev', 'treatment, feature', 'time', 'D35', 'D7')}, {t_tail_sql('s', 'treatment, feature')}
 SELECT feature, {', '.join(f'round(max(p) FILTER (treatment = {chr(39)}{t}{chr(39)}), 6) AS "{t}"' for t in TREATMENTS)} FROM tails GROUP BY 1""",
)
def t11(d: Data):
    out = posthoc.welch_t_test(d.ev(), "feature", "value", "time", by=("treatment",), levels=["D35", "D7"])
    return rounded(posthoc.p_matrix(out, "feature", "treatment", TREATMENTS), *TREATMENTS)


@query(
    "st1_t_tail",
    f"""WITH s AS (SELECT c_custkey, c_acctbal / 2000 AS t, c_nationkey + 1.5 AS df FROM customer), {t_tail_sql('s', 'c_custkey')}
 SELECT c_custkey, round(p, 7) AS p FROM tails""",
)
def st1(d: Data):
    rows = d.table("customer").select(
        "c_custkey", (F.col("c_acctbal") / 2000).alias("t"), (F.col("c_nationkey") + 1.5).alias("df")
    )
    return rows.select("c_custkey", rnd(t_tail("t", "df"), 7).alias("p"))


@query(
    "st2_f_tail",
    """SELECT p_partkey, round(pow(df2 / (df2 + 2 * f), df2 / 2), 7) AS p FROM (SELECT p_partkey, p_retailprice / 500 AS f, p_size + 3.5 AS df2 FROM part)""",
)
def st2(d: Data):
    rows = d.table("part").select("p_partkey", (F.col("p_retailprice") / 500).alias("f"), (F.col("p_size") + 3.5).alias("df2"))
    return rows.select("p_partkey", rnd(f_tail("f", F.lit(2.0), "df2"), 7).alias("p"))


@query(
    "st3_studentized_range_two",
    f"""WITH s AS (SELECT s_suppkey, s_acctbal / 2000 AS t, s_nationkey + 2.5 AS df FROM supplier), {t_tail_sql('s', 's_suppkey')}
 SELECT s_suppkey, round(p, 7) AS p FROM tails""",
)
def st3(d: Data):
    q = F.abs(F.col("s_acctbal") / 2000) * (2**0.5)
    rows = d.table("supplier").select("s_suppkey", q.alias("q"), (F.col("s_nationkey") + 2.5).alias("df"))
    return rows.select("s_suppkey", rnd(tukey_tail("q", F.lit(2.0), "df"), 7).alias("p"))


@query(
    "st3_studentized_range_three",
    f"""WITH s AS (SELECT s_suppkey, abs(s_acctbal) / 2000 AS q, 3 AS k, s_nationkey + 2.5 AS df FROM supplier), {tukey_p_sql('s', 's_suppkey', [3])}
 SELECT s_suppkey, round(p, 5) AS p FROM tukey""",
)
def st33(d: Data):
    q = F.abs(F.col("s_acctbal") / 2000)
    rows = d.table("supplier").select("s_suppkey", q.alias("q"), (F.col("s_nationkey") + 2.5).alias("df"))
    return rows.select("s_suppkey", rnd(tukey_tail("q", F.lit(3.0), "df"), 5).alias("p"))


@query("st3_critical_value", "SELECT s_suppkey, CAST(0.05 AS DOUBLE) AS p FROM supplier")
def st3c(d: Data):
    """The tail at the critical value is the level itself."""
    rows = d.table("supplier").select("s_suppkey", (F.col("s_nationkey") + 2.0).alias("df"))
    q = tukey_critical(F.lit(0.95), F.lit(4.0), "df")
    return rows.withColumn("q", q).select("s_suppkey", rnd(tukey_tail("q", F.lit(4.0), "df"), 5).alias("p"))


# Student's t for 95 % by its expansion around the normal quantile, for the hundreds of degrees of freedom here.
_Z = 1.959963984540054
_T = (
    f"({_Z} + {(_Z**3 + _Z) / 4} / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / pow(df, 2)"
    f" + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / pow(df, 3)"
    f" + {(79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160} / pow(df, 4))"
)


@query(
    "r1_fitted_line",
    f"""WITH {LI}, f AS (SELECT feature, count(*) AS n, count(*) - 2.0 AS df, regr_slope(value, x) AS slope, avg(x) AS mx, avg(value) AS my,
 regr_sxx(value, x) AS sxx, regr_syy(value, x) AS syy, regr_sxy(value, x) AS sxy, min(x) AS lo, max(x) AS hi FROM li GROUP BY 1),
 spots AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / df) AS s, lo + (hi - lo) * (point - 1) / 4 AS v FROM f, (SELECT unnest(range(1, 6)) AS point)),
 l AS (SELECT feature, point, v, my + slope * (v - mx) AS fit, {_T} * s * sqrt(1.0 / n + (v - mx) * (v - mx) / sxx) AS half FROM spots)
 SELECT feature, CAST(point AS INTEGER) AS point, round(v, 6) AS x, round(fit, 4) AS fit, round(fit - half, 4) AS lwr, round(fit + half, 4) AS upr FROM l""",
)
def r1l(d: Data):
    out = regression.fitted_line(d.li(), "feature", "x", "value", points=5)
    return rounded(rounded(out, "x"), "fit", "lwr", "upr", digits=4)
