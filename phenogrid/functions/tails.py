"""Upper tails and quantiles of the t, F and studentized-range distributions, for per-feature results.

Spark SQL has none of these functions. They run on aggregated rows only, in Arrow batches.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_TINY = 1e-300
_STEP = 0.01  # spacing of the normal grid behind the studentized range
_FALL = 45.0  # natural logarithms below its peak an integrand is left out


def _lgamma(x: np.ndarray) -> np.ndarray:
    values, back = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in values])[back].reshape(x.shape)


def _lentz(first: np.ndarray, step, limit: int) -> np.ndarray:
    """Continued fraction by the modified Lentz method; ``step(i)`` gives numerator, denominator."""
    c = np.where(np.abs(first) < _TINY, _TINY, first)
    d = np.zeros_like(c)
    out = c.copy()
    for i in range(1, limit):
        num, den = step(i)
        d = den + num * d
        d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = den + num / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        change = c * d
        out = out * change
        if np.all(np.abs(change - 1.0) < 1e-15):
            break
    return out


def _gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    out = np.ones_like(x)
    pos = x > 0
    a, x = a[pos], x[pos]
    scale = np.exp(a * np.log(x) - x - _lgamma(a))
    term = 1.0 / a
    total = term.copy()
    for i in range(1, 1000):
        term = term * x / (a + i)
        total = total + term
        if np.all(term < 1e-17 * total):
            break
    series = 1.0 - scale * total
    far = np.maximum(x, a + 1.0)
    frac = _lentz(far + 1.0 - a, lambda i: (-i * (i - a), far + 2 * i + 1.0 - a), 1000)
    out[pos] = np.where(x < a + 1.0, series, scale / frac)
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, two terms merged into one."""

    def step(i):
        m = i // 2
        if i % 2:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return num, 1.0

    limit = int(400 + 20 * math.sqrt(max(a.max(), b.max())))
    return _lentz(np.ones_like(x), step, limit)


def beta_lower(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b); ``y = 1 - x`` is passed to keep its digits."""
    a, b, x, y = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x, y))
    out = np.where(x >= 1.0, 1.0, 0.0)
    inside = (x > 0.0) & (y > 0.0)
    # For a huge first parameter the expansion in 1/a is exact to double precision.
    big = inside & (a > 2e5) & (b < 50)
    if big.any():
        ab, bb = a[big], b[big]
        out[big] = _gamma_upper(bb, -(ab + (bb - 1) / 2) * np.log1p(-y[big]))
    near = inside & ~big
    if near.any():
        a, b, x, y = a[near], b[near], x[near], y[near]
        flip = x > (a + 1) / (a + b + 2)
        p, q = np.where(flip, b, a), np.where(flip, a, b)
        u, v = np.where(flip, y, x), np.where(flip, x, y)
        log_front = p * np.log(u) + q * np.log(v) + _lgamma(p + q) - _lgamma(p) - _lgamma(q)
        part = np.exp(log_front) / (p * _beta_fraction(p, q, u))
        out[near] = np.where(flip, 1.0 - part, part)
    return out


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    if ok.any():
        sq, d = t[ok] ** 2, df[ok]
        out[ok] = beta_lower(d / 2, np.full(d.shape, 0.5), d / (d + sq), sq / (d + sq))
    return out


def f_upper(f, df1, df2) -> np.ndarray:
    f, df1, df2 = np.broadcast_arrays(
        np.asarray(f, float), np.asarray(df1, float), np.asarray(df2, float)
    )
    out = np.full(f.shape, np.nan)
    ok = np.isfinite(f) & (df1 > 0) & (df2 > 0)
    if ok.any():
        v, d1, d2 = np.maximum(f[ok], 0.0), df1[ok], df2[ok]
        whole = d2 + d1 * v
        out[ok] = beta_lower(d2 / 2, d1 / 2, d2 / whole, d1 * v / whole)
    return out


@lru_cache(maxsize=1)
def _normal_grid() -> tuple[np.ndarray, np.ndarray]:
    z = np.arange(-2400, 801) * _STEP  # covers z - r for z in [-8, 8] and r in [0, 16]
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi), cdf


@lru_cache(maxsize=128)
def _range_table(k: int) -> tuple[np.ndarray, np.ndarray]:
    """log P(range of k standard normals > r) and its slope on the grid r = 0, 0.01, ..., 16.

    Both are trapezoid sums, which converge geometrically for these integrands. All terms are
    positive, so the logarithm is right far out, too.
    """
    pdf, cdf = _normal_grid()
    at = np.arange(1600, 3201)
    miss = np.empty(1601)
    slope = np.empty(1601)
    for r in range(1601):
        # all others lie below the largest value z, but not all of them within r of it
        with np.errstate(divide="ignore"):
            lower = -np.expm1((k - 1) * np.log1p(-np.minimum(cdf[at - r] / cdf[at], 1.0)))
        miss[r] = k * _STEP * np.sum(pdf[at] * cdf[at] ** (k - 1) * lower)
        gap = np.maximum(cdf[at] - cdf[at - r], 0.0)
        slope[r] = -k * (k - 1) * _STEP * np.sum(pdf[at] * pdf[at - r] * gap ** (k - 2))
    miss = np.minimum(miss, 1.0)
    return np.log(miss), slope / miss


def _range_log_upper(k: int, r: np.ndarray) -> np.ndarray:
    """Cubic Hermite reading of the table; beyond r = 16 the tail is below 1e-26 for any k in use."""
    miss, slope = _range_table(k)
    pos = np.minimum(r / _STEP, 1599.999999)
    i = pos.astype(int)
    t = pos - i
    h00, h01 = (1 + 2 * t) * (1 - t) ** 2, t * t * (3 - 2 * t)
    h10, h11 = t * (1 - t) ** 2, t * t * (t - 1)
    out = h00 * miss[i] + h01 * miss[i + 1] + _STEP * (h10 * slope[i] + h11 * slope[i + 1])
    return np.where(r >= 16.0, -np.inf, np.minimum(out, 0.0))


def _log_scale_peak(df: np.ndarray) -> np.ndarray:
    """Log density, at 0, of the logarithm of the error's standard deviation."""
    a = df / 2
    big = np.maximum(a, 10.0)
    series = 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5) - 1 / (1680 * big**7)
    stirling = 0.5 * np.log(big / (2 * math.pi)) - series
    small = np.minimum(a, 10.0)
    exact = small * np.log(small) - small - _lgamma(small)
    # a log a - a - log gamma(a) by its series, or term by term where little cancels
    return math.log(2) + np.where(a >= 10.0, stirling, exact)


def _tukey_group(q: np.ndarray, k: int, df: np.ndarray) -> np.ndarray:
    """The tail of the range, averaged over the logarithm x of the scale.

    In x the integrand falls off on both sides at least exponentially, so a trapezoid sum converges
    geometrically. A coarse look finds where the integrand lives: around x = 0, or, far out in the tail,
    where q exp(x) is a moderate range. The sum is refined until halving its step changes nothing.
    """
    q, d = np.maximum(q, 1e-12)[:, None], df[:, None]
    peak = _log_scale_peak(d)

    def height(x: np.ndarray) -> np.ndarray:
        return peak + d * (x - np.expm1(2 * x) / 2) + _range_log_upper(k, q * np.exp(x))

    wide = 50.0 / d + 10.0 / np.sqrt(d)
    top = np.minimum(np.log1p(10.0 / np.sqrt(2 * d)), np.log(16.0 / q))
    low = np.minimum(-wide, np.log(0.5 / q) - 50.0 / d)
    steps = np.linspace(0.0, 1.0, 401)
    far = low + (top - low) * steps
    near = np.minimum(-wide + (top + wide) * steps, top)  # where the scale itself lives
    x = np.sort(np.concatenate([far, np.maximum(near, low)], axis=1), axis=1)
    h = height(x)
    lives = h > h.max(axis=1, keepdims=True) - _FALL
    first = np.maximum(lives.argmax(axis=1) - 1, 0)
    last = np.minimum(x.shape[1] - lives[:, ::-1].argmax(axis=1), x.shape[1] - 1)
    rows = np.arange(len(q))
    low, top = x[rows, first][:, None], x[rows, last][:, None]
    out = np.empty(len(q))
    todo, count = rows, 256
    while len(todo):
        fine = low[todo] + (top[todo] - low[todo]) * np.linspace(0.0, 1.0, 2 * count + 1)
        part_q, part_d, part_peak = q[todo], d[todo], peak[todo]
        with np.errstate(under="ignore"):
            f = np.exp(part_peak + part_d * (fine - np.expm1(2 * fine) / 2) + _range_log_upper(k, part_q * np.exp(fine)))
        step = (top[todo] - low[todo])[:, 0] / count
        ends = (f[:, 0] + f[:, -1]) / 2
        whole = step / 2 * (f[:, 1:-1].sum(axis=1) + ends)
        half = step * (f[:, 2:-1:2].sum(axis=1) + ends)
        out[todo] = whole
        if count >= 8192:
            break
        todo, count = todo[np.abs(whole - half) > 1e-10 * whole], 4 * count
    return out


def tukey_upper(q, k, df) -> np.ndarray:
    """Upper tail of the studentized range of ``k`` means with ``df`` error degrees of freedom."""
    q, k, df = np.broadcast_arrays(np.asarray(q, float), np.asarray(k, float), np.asarray(df, float))
    out = np.full(q.shape, np.nan)
    ok = np.isfinite(q) & (k >= 2) & (df >= 1)
    for size in np.unique(k[ok]):
        rows = np.flatnonzero(ok & (k == size))
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            out[part] = _tukey_group(np.abs(q[part]), int(size), df[part])
    return np.clip(out, 0.0, 1.0)


def tukey_quantile(conf, k, df) -> np.ndarray:
    """Critical value by bisection, once for each distinct (conf, k, df)."""
    conf, k, df = np.broadcast_arrays(
        np.asarray(conf, float), np.asarray(k, float), np.asarray(df, float)
    )
    out = np.full(k.shape, np.nan)
    ok = (k >= 2) & (df >= 1)
    if not ok.any():
        return out
    cases, back = np.unique(np.stack([conf[ok], k[ok], df[ok]]), axis=1, return_inverse=True)
    lo, hi = np.zeros(cases.shape[1]), np.full(cases.shape[1], 2.0)
    for _ in range(60):
        short = tukey_upper(hi, cases[1], cases[2]) > 1 - cases[0]
        if not short.any():
            break
        hi = np.where(short, hi * 2, hi)
    for _ in range(60):
        mid = (lo + hi) / 2
        above = tukey_upper(mid, cases[1], cases[2]) > 1 - cases[0]
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    out[ok] = ((lo + hi) / 2)[back.reshape(-1)]
    return out


def f_quantile(p, df1, df2) -> np.ndarray:
    """The f whose upper tail is ``p``: Newton steps on the logarithms of both, kept within a bracket.
    NaN outside 0 < p < 1."""
    p, df1, df2 = np.broadcast_arrays(np.asarray(p, float), np.asarray(df1, float), np.asarray(df2, float))
    out = np.full(p.shape, np.nan)
    ok = (p > 0) & (p < 1) & (df1 > 0) & (df2 > 0)
    if not ok.any():
        return out
    cases, back = np.unique(np.stack([p[ok], df1[ok], df2[ok]]), axis=1, return_inverse=True)
    goal, a, b = cases
    norm = _lgamma((a + b) / 2) - _lgamma(a / 2) - _lgamma(b / 2) + a / 2 * np.log(a / b)
    low, high = np.full(len(goal), -1.0), np.full(len(goal), 1.0)
    for _ in range(60):
        short = f_upper(np.exp(high), a, b) > goal
        long = f_upper(np.exp(low), a, b) < goal
        if not (short | long).any():
            break
        high, low = np.where(short, 2 * high, high), np.where(long, 2 * low, low)
        high, low = np.minimum(high, 700.0), np.maximum(low, -700.0)
    y = (low + high) / 2
    for _ in range(200):
        tail = f_upper(np.exp(y), a, b)
        low, high = np.where(tail > goal, y, low), np.where(tail > goal, high, y)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            # slope of the log tail in y
            slope = -np.exp(norm + a / 2 * y - (a + b) / 2 * np.log1p(a / b * np.exp(y))) / tail
            new = y - (np.log(tail) - np.log(goal)) / slope
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        moved = np.abs(new - y)
        y = new
        if (moved < 1e-14 * np.maximum(np.abs(y), 1.0)).all():
            break
    out[ok] = np.exp(y)[back.reshape(-1)]
    return out


def t_quantile(p, df) -> np.ndarray:
    """The t >= 0 whose two-sided tail is ``p``."""
    return np.sqrt(f_quantile(p, 1.0, df))


@pandas_udf(DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_quantile(p, df))


@pandas_udf(DoubleType())
def f_critical(p: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_quantile(p, df1, df2))


@pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df))


@pandas_udf(DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f, df1, df2))


@pandas_udf(DoubleType())
def tukey_tail(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(tukey_upper(q, k, df))


@pandas_udf(DoubleType())
def tukey_critical(conf: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(tukey_quantile(conf, k, df))
