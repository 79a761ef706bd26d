"""SQL for the normal and studentized-range distributions, by quadrature on a grid."""

from __future__ import annotations

_H = 0.005  # grid step; z covers [-24, 8], the range r covers [0, 16]

# Cumulative trapezoid with the first end correction: error about 1e-12 at this step.
NORMAL = f"""zs AS (SELECT i, i * {_H} AS z, exp(-0.5 * (i * {_H}) ^ 2) / sqrt(2 * pi()) AS pdf FROM range(-4800, 1601) r(i)),
 norm AS (SELECT i, z, pdf, (sum(pdf) OVER (ORDER BY i) - pdf / 2) * {_H} + {_H} * {_H} / 12 * z * pdf AS cdf FROM zs)"""


def tukey_p_sql(source: str, keys: str, ks: list[int]) -> str:
    """CTE ``tukey(keys, p)`` for ``source(keys, q, k, df)``: the range tail on a grid, read by
    four-point interpolation at the nodes of the scale integral."""
    families = ", ".join(f"({k})" for k in ks)
    lagrange = """CASE o WHEN -1 THEN -u * (u - 1) * (u - 2) / 6 WHEN 0 THEN (u + 1) * (u - 1) * (u - 2) / 2
 WHEN 1 THEN -(u + 1) * u * (u - 2) / 2 ELSE (u + 1) * u * (u - 1) / 6 END"""
    return f"""{NORMAL},
 gaps AS (SELECT j, a.pdf AS pdf, a.cdf - b.cdf AS gap FROM norm a, range(0, 3201) g(j), norm b
 WHERE a.i BETWEEN -1600 AND 1600 AND b.i = a.i - j),
 known AS (SELECT k, j, 1 - any_value(k) * {_H} * sum(pdf * pow(gap, k - 1)) AS miss FROM gaps, (VALUES {families}) f(k) GROUP BY k, j),
 tail AS (SELECT * FROM known UNION ALL SELECT k, -1, 1 - (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * (1 - miss) FROM known WHERE j = 1),
 nodes AS (SELECT {keys}, k, q, df, greatest(1e-9, 1 - 9 / sqrt(2 * df)) + (9 / sqrt(2 * df) + least(1 - 1e-9, 9 / sqrt(2 * df))) * t / 400 AS s,
 CASE WHEN t = 0 OR t = 400 THEN 1 WHEN t % 2 = 1 THEN 4 ELSE 2 END AS w FROM {source}, range(0, 401) n(t)),
 mass AS (SELECT {keys}, k, q * s / {_H} AS spot, w * exp(df / 2 * (2 * ln(s) + 1 - s * s) - ln(s)) AS m FROM nodes),
 spots AS (SELECT {keys}, k, m, o, floor(spot)::BIGINT + o AS j, spot - floor(spot) AS u FROM mass, (VALUES (-1), (0), (1), (2)) x(o)),
 tukey AS (SELECT {keys}, greatest(0.0, sum(m * coalesce(miss, 0) * ({lagrange})) / (sum(m) / 4)) AS p
 FROM spots LEFT JOIN tail USING (k, j) GROUP BY {keys})"""


def normal_quantiles_sql(points: int) -> str:
    """CTE ``normal(point, theoretical)``: the grid point nearest to each probability, then two
    Taylor terms."""
    return f"""{NORMAL}, goal AS (SELECT CAST(n AS INTEGER) AS point, (n - 0.5) / {points} AS p FROM range(1, {points} + 1) r(n)),
 close AS (SELECT point, arg_min(z, abs(cdf - p)) AS z, arg_min((p - cdf) / pdf, abs(cdf - p)) AS e FROM goal, norm WHERE abs(z) < 6 GROUP BY point),
 normal AS (SELECT point, z + e + z * e * e / 2 AS theoretical FROM close)"""
