"""Packed samples: principal components, distances and permutation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distance, pca, permanova, scale
from .registry import DIMS, EM, EML, EV, EVENT_TYPES, Data, query, rnd, rounded


def _axes_sql(source: str, dims: int, k: int = 2) -> str:
    """First ``k`` axes of the correlation matrix of ``source(sample, dim, value)``: a matrix
    squared 13 times keeps only its leading axis, which is then taken out of the matrix."""
    ctes = [
        f"""z AS (SELECT *, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM {source} WINDOW w AS (PARTITION BY dim))""",
        "r1 AS (SELECT a.dim AS i, b.dim AS j, avg(a.z * b.z) AS r FROM z a JOIN z b USING (sample) GROUP BY 1, 2)",
    ]
    for c in range(1, k + 1):
        last = f"r{c}"
        for step in range(13):
            name = f"p{c}_{step}"
            ctes.append(
                f"""{name} AS (SELECT i, j, r / sum(CASE WHEN i = j THEN r ELSE 0 END) OVER () AS r FROM
 (SELECT a.i, b.j, sum(a.r * b.r) AS r FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY 1, 2))"""
            )
            last = name
        ctes += [
            f"t{c} AS (SELECT i AS top, sqrt(r) AS size FROM {last} WHERE i = j ORDER BY r DESC LIMIT 1)",
            f"v{c} AS (SELECT i, r / size AS v FROM {last}, t{c} WHERE j = top)",
            f"e{c} AS (SELECT sum(x.v * r * y.v) AS e FROM r{c} JOIN v{c} x ON x.i = r{c}.i JOIN v{c} y ON y.i = r{c}.j)",
            f"r{c + 1} AS (SELECT r{c}.i, r{c}.j, r - e * x.v * y.v AS r FROM e{c}, r{c} JOIN v{c} x ON x.i = r{c}.i JOIN v{c} y ON y.i = r{c}.j)",
        ]
    ctes += [
        f"load AS ({' UNION ALL '.join(f'SELECT i, {c} AS axis, v FROM v{c}' for c in range(1, k + 1))})",
        f"eigen AS ({' UNION ALL '.join(f'SELECT {c} AS axis, e FROM e{c}' for c in range(1, k + 1))})",
        f"share AS (SELECT *, 100 * e / {dims} AS pct FROM eigen)",
    ]
    return ", ".join(ctes)


_AXES = f"{EML}, {_axes_sql('eml', 64)}"
_SCORES = f"""{_AXES}, scores AS (SELECT sample, any_value(grp) AS grp, sum(z * v) FILTER (axis = 1) AS pc1, sum(z * v) FILTER (axis = 2) AS pc2
 FROM z JOIN load ON i = dim GROUP BY 1)"""
_EIGEN = "SELECT axis AS dim, round(e, 6) AS eigenvalue, round(pct, 5) AS pct, round(sum(pct) OVER (ORDER BY axis), 5) AS cum_pct FROM share"


def _result(d: Data, k: int = 2) -> pca.PcaResult:
    return pca.pca(d.em(), ["sample", "grp"], "vector", k, DIMS)


def _eigen(result: pca.PcaResult):
    return rounded(rounded(result.eigen, "pct", "cum_pct", digits=5), "eigenvalue")


@query("x5_pca_eigenvalues", f"WITH {_AXES} {_EIGEN}")
def x5(d: Data):
    return _eigen(_result(d))


@query("x5_pca_six_axes", f"WITH {EML}, {_axes_sql('eml', 64, 6)} {_EIGEN}")
def x5a(d: Data):
    return _eigen(_result(d, 6))


@query("x5_pca_scores", f"WITH {_SCORES} SELECT sample, grp, round(pc1, 5) AS pc1, round(pc2, 5) AS pc2 FROM scores")
def x5s(d: Data):
    return rounded(_result(d).scores, "pc1", "pc2", digits=5)


@query(
    "x5_pca_scores_total",
    f"""WITH {EML} SELECT 64::BIGINT AS features, count(DISTINCT sample) AS samples FROM eml""",
)
def x5t(d: Data):
    """All components together hold the variance of all features, over all samples."""
    result = _result(d, 64)
    total = result.eigen.agg(F.round(F.sum("eigenvalue")).cast("long").alias("features"))
    rows = result.scores.agg(F.count("*").alias("samples"))
    return total.withColumn("_k", F.lit(1)).join(rows.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query(
    "x6_pca_contributions",
    f"""WITH {_AXES}, c AS (SELECT i, sum(e * 100 * v * v) / sum(e) AS contrib FROM load JOIN eigen USING (axis) GROUP BY 1)
 SELECT i::VARCHAR AS feature, round(contrib, 5) AS contrib FROM c ORDER BY c.contrib DESC LIMIT 10""",
)
def x6(d: Data):
    return rounded(pca.pca_contributions(_result(d), 10), "contrib", digits=5)


@query(
    "x7_group_ellipse",
    f"""WITH {_SCORES} SELECT grp, count(*) AS n, round(avg(pc1), 5) AS cx, round(avg(pc2), 5) AS cy, round(var_samp(pc1), 5) AS vxx,
 round(var_samp(pc2), 5) AS vyy, round(covar_samp(pc1, pc2), 5) AS vxy FROM scores GROUP BY 1""",
)
def x7(d: Data):
    found = pca.group_ellipse(_result(d).scores, "grp").select("grp", "n", "cx", "cy", "vxx", "vyy", "vxy")
    return rounded(found, "cx", "cy", "vxx", "vyy", "vxy", digits=5)


@query(
    "x7_ellipse_axes",
    f"""WITH {_SCORES}, v AS (SELECT grp, count(*) AS n, var_samp(pc1) AS a, var_samp(pc2) AS b, covar_samp(pc1, pc2) AS c FROM scores GROUP BY 1),
 r AS (SELECT *, sqrt((n - 1) * (pow(0.05, -2.0 / (n - 1)) - 1)) AS radius, sqrt((a - b) * (a - b) / 4 + c * c) AS swing FROM v)
 SELECT grp, round(radius, 6) AS radius, round(radius * sqrt((a + b) / 2 + swing), 4) AS major,
 round(radius * sqrt((a + b) / 2 - swing), 4) AS minor FROM r""",
)
def x7a(d: Data):
    found = pca.group_ellipse(_result(d).scores, "grp")
    return found.select("grp", rnd("radius").alias("radius"), rnd("major", 4).alias("major"), rnd("minor", 4).alias("minor"))


_SUBSET = f"""{EV}, cell AS (SELECT subject AS sample, feature AS dim, avg(value) AS raw, avg(zs) AS zs FROM (SELECT subject, feature, value,
 (value - avg(value) OVER w) / stddev_samp(value) OVER w AS zs FROM ev WHERE time = 'D35' WINDOW w AS (PARTITION BY feature)) GROUP BY 1, 2),
 eml AS (SELECT sample, dim, coalesce(zs, 0) AS value FROM (SELECT DISTINCT sample FROM cell) s CROSS JOIN (SELECT DISTINCT dim FROM cell) d
 LEFT JOIN cell USING (sample, dim)), {_axes_sql('eml', 5)}"""


@query("x8_pca_subset", f"WITH {_SUBSET} {_EIGEN}")
def x8(d: Data):
    scaled = scale.zscore(d.ev().where("time = 'D35'"), "feature", "value")
    packed = scale.pack_vectors(scaled, ["subject"], "feature", "scaled", EVENT_TYPES)
    return _eigen(pca.pca(packed, ["subject"], "vector", 2, EVENT_TYPES))


@query(
    "v1_euclidean_distance",
    f"""WITH {EM} SELECT x.sample AS i, y.sample AS j, round(list_distance(x.vector, y.vector), 6) AS d
 FROM em x JOIN em y ON x.sample < y.sample""",
)
def v1(d: Data):
    return rounded(distance.pairwise_distance(d.em(), "sample", "vector", "euclidean"), "d")


_SCALED = f"""{EML}, sc AS (SELECT sample, grp, dim, coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0) AS v
 FROM eml WINDOW w AS (PARTITION BY dim)),
 vec AS (SELECT sample, grp, list(v ORDER BY dim) AS v, sum(v) AS total FROM sc GROUP BY 1, 2)"""
_BRAY = f"""{_SCALED}, bray AS (SELECT x.sample AS i, y.sample AS j, x.grp AS gi, y.grp AS gj,
 list_sum([abs(p[1] - p[2]) FOR p IN list_zip(x.v, y.v)]) / (x.total + y.total) AS d FROM vec x JOIN vec y ON x.sample < y.sample)"""


def _range_scaled(d: Data):
    return scale.range_scale_vectors(d.em(), "vector")


@query("v2_bray_distance", f"WITH {_BRAY} SELECT i, j, round(d, 6) AS d FROM bray")
def v2(d: Data):
    return rounded(distance.pairwise_distance(_range_scaled(d), "sample", "scaled", "bray"), "d")


_TEST = """s AS (SELECT count(*) AS groups, sum(n) AS nn, sum(ssw) AS ssw FROM
 (SELECT g.n, coalesce(w.q, 0) / g.n AS ssw FROM grps g LEFT JOIN (SELECT gi, sum(d * d) AS q FROM dist WHERE gi = gj GROUP BY 1) w ON w.gi = g.grp)),
 t AS (SELECT sum(d * d) / (SELECT nn FROM s) AS sst FROM dist),
 r AS (SELECT sst, ssw, sst - ssw AS ssa, groups - 1 AS df1, nn - groups AS df2 FROM s, t)
 SELECT 'group' AS term, df1::BIGINT AS df, round(ssa, 6) AS ss, round((ssa / df1) / (ssw / df2), 6) AS f, round(ssa / sst, 6) AS r2 FROM r
 UNION ALL SELECT 'residual', df2::BIGINT, round(ssw, 6), NULL, round(ssw / sst, 6) FROM r
 UNION ALL SELECT 'total', (df1 + df2)::BIGINT, round(sst, 6), NULL, 1.0 FROM r"""


def _plain(df):
    return df.select("term", "df", rnd("ss").alias("ss"), rnd("f").alias("f"), rnd("r2").alias("r2"))


@query(
    "v3_permanova_bray",
    f"""WITH {_BRAY}, dist AS (SELECT gi, gj, d FROM bray), grps AS (SELECT grp, count(*) AS n FROM vec GROUP BY 1), {_TEST}""",
)
def v3(d: Data):
    return _plain(permanova.permanova(_range_scaled(d), "sample", "scaled", "grp", "bray", p=False))


@query("v3_permanova_bray_p")
def v3p(d: Data):
    return permanova.permanova(_range_scaled(d), "sample", "scaled", "grp", "bray", 999, seed=7)


@query(
    "v3_permanova_given_distances",
    f"""WITH {EM}, dist AS (SELECT x.grp AS gi, y.grp AS gj, list_distance(x.vector, y.vector) AS d FROM em x JOIN em y ON x.sample < y.sample),
 grps AS (SELECT grp, count(*) AS n FROM em GROUP BY 1), {_TEST}""",
)
def v3d(d: Data):
    em = d.em()
    dist = distance.pairwise_distance(em, "sample", "vector")  # read once, so not staged
    return _plain(permanova.permanova_from_distances(dist, em.select("sample", "grp"), "sample", "grp", p=False))


@query(
    "v4_permanova_pairwise",
    f"""WITH {_BRAY}, n AS (SELECT grp, count(*) AS n FROM vec GROUP BY 1),
 w AS (SELECT n.grp, n.n, coalesce(sum(d * d), 0) AS q FROM n LEFT JOIN bray ON gi = n.grp AND gj = n.grp GROUP BY 1, 2),
 x AS (SELECT least(gi, gj) AS a, greatest(gi, gj) AS b, sum(d * d) AS q FROM bray WHERE gi <> gj GROUP BY 1, 2),
 r AS (SELECT wa.grp || ' vs ' || wb.grp AS pair, wa.n + wb.n AS nn, (wa.q + wb.q + x.q) / (wa.n + wb.n) AS sst, wa.q / wa.n + wb.q / wb.n AS ssw
 FROM x JOIN w wa ON wa.grp = x.a JOIN w wb ON wb.grp = x.b)
 SELECT pair, (nn - 2)::BIGINT AS df_resid, round((sst - ssw) / (ssw / (nn - 2)), 6) AS f, round((sst - ssw) / sst, 6) AS r2 FROM r""",
)
def v4(d: Data):
    out = permanova.permanova_pairwise(_range_scaled(d), "sample", "scaled", "grp", "bray", p=False)
    group = out.where("term = 'group'").select("pair", rnd("f").alias("f"), rnd("r2").alias("r2"))
    rest = out.where("term = 'residual'").select("pair", F.col("df").alias("df_resid"))
    return group.join(rest, "pair").select("pair", "df_resid", "f", "r2")


@query("v4_permanova_pairwise_p")
def v4p(d: Data):
    return permanova.permanova_pairwise(_range_scaled(d), "sample", "scaled", "grp", "bray", 199, seed=7)


@query("v5_permanova_gated")
def v5(d: Data):
    whole, pairs = permanova.permanova_gated(d.em(), "sample", "vector", "grp", permutations=199, seed=7)
    whole = whole.select(F.lit("all").alias("pair"), *whole.columns)
    return whole if pairs is None else whole.unionByName(pairs, allowMissingColumns=True)


_CENTROID = f"""{EML}, c AS (SELECT dim, grp, count(*) AS n, var_pop(value) * count(*) AS q FROM eml GROUP BY 1, 2),
 tot AS (SELECT sum(q) AS sst FROM (SELECT var_pop(value) * count(*) AS q FROM eml GROUP BY dim)),
 s AS (SELECT count(DISTINCT grp) AS groups, sum(q) AS ssw FROM c), n AS (SELECT count(*) AS nn FROM em),
 r AS (SELECT sst, ssw, sst - ssw AS ssa, groups - 1 AS df1, nn - groups AS df2 FROM s, tot, n)
 SELECT 'group' AS term, df1::BIGINT AS df, round(ssa, 6) AS ss, round((ssa / df1) / (ssw / df2), 6) AS f, round(ssa / sst, 6) AS r2 FROM r
 UNION ALL SELECT 'residual', df2::BIGINT, round(ssw, 6), NULL, round(ssw / sst, 6) FROM r
 UNION ALL SELECT 'total', (df1 + df2)::BIGINT, round(sst, 6), NULL, 1.0 FROM r"""


@query("v6_permanova_euclidean", f"WITH {_CENTROID}")
def v6(d: Data):
    return _plain(permanova.permanova_euclidean(d.em(), "sample", "vector", "grp", p=False))


@query("v6_permanova_euclidean_p")
def v6p(d: Data):
    return permanova.permanova_euclidean(d.em(), "sample", "vector", "grp", 999, seed=7)


_ALL = f"""{EML}, c AS (SELECT dim, grp, count(*) AS n, var_pop(value) * count(*) AS q, avg(value) AS m FROM eml GROUP BY 1, 2),
 g AS (SELECT grp, any_value(n) AS n, sum(q) AS ssw FROM c GROUP BY 1),
 two AS (SELECT a.grp || ' vs ' || b.grp AS pair, a.n + b.n AS nn, a.ssw + b.ssw AS ssw, 1 AS df1,
 (SELECT sum((x.m - y.m) * (x.m - y.m)) * a.n * b.n / (a.n + b.n) FROM c x JOIN c y USING (dim) WHERE x.grp = a.grp AND y.grp = b.grp) AS ssa
 FROM g a JOIN g b ON a.grp < b.grp),
 one AS (SELECT 'all' AS pair, sum(n) AS nn, sum(ssw) AS ssw, count(*) - 1 AS df1,
 (SELECT sum(var_pop * k) FROM (SELECT var_pop(value) AS var_pop, count(*) AS k FROM eml GROUP BY dim)) - sum(ssw) AS ssa FROM g),
 r AS (SELECT pair, nn, ssw, df1, ssa FROM one UNION ALL SELECT pair, nn, ssw, df1, ssa FROM two)"""


@query(
    "v5_permanova_gated_tables",
    f"""WITH {_ALL}
 SELECT pair, 'group' AS term, df1::BIGINT AS df, round(ssa, 5) AS ss, round((ssa / df1) / (ssw / (nn - df1 - 1)), 5) AS f, round(ssa / (ssa + ssw), 5) AS r2 FROM r
 UNION ALL SELECT pair, 'residual', (nn - df1 - 1)::BIGINT, round(ssw, 5), NULL, round(ssw / (ssa + ssw), 5) FROM r
 UNION ALL SELECT pair, 'total', (nn - 1)::BIGINT, round(ssa + ssw, 5), NULL, 1.0 FROM r""",
)
def v5t(d: Data):
    """The gate left open, so that what both tables hold does not hang on a permutation p."""
    whole, pairs = permanova.permanova_gated(d.em(), "sample", "vector", "grp", permutations=9, seed=7, alpha=1.01)
    both = whole.select(F.lit("all").alias("pair"), *whole.columns).unionByName(pairs, allowMissingColumns=True)
    return both.select("pair", "term", "df", rnd("ss", 5).alias("ss"), rnd("f", 5).alias("f"), rnd("r2", 5).alias("r2"))
