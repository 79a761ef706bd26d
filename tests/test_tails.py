import math

import numpy as np
import pytest

from phenogrid.functions import tails


def simpson(f, lo, hi, n=4000):
    x = np.linspace(lo, hi, n + 1)
    w = np.where(np.arange(n + 1) % 2 == 1, 4.0, 2.0)
    w[[0, -1]] = 1
    return float(np.sum(w * f(x)) * (hi - lo) / n / 3)


@pytest.mark.parametrize("df", [1, 2, 3.7, 17, 250, 20000, 3e5, 1e6])
@pytest.mark.parametrize("t", [0.0, 0.3, 1.96, 4.5])
def test_t_tail_against_integration(t, df):
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    middle = 2 * scale * simpson(lambda a: np.cos(a) ** (df - 1), 0, math.atan(t / math.sqrt(df)))
    assert tails.t_two_sided([t], [df])[0] == pytest.approx(1 - middle, abs=5e-9)


@pytest.mark.parametrize("df2", [3, 21.5, 400, 5e5, 1e8])
def test_f_tail_closed_form(df2):
    f = np.array([0.0, 0.5, 3.0, 20.0])
    want = np.exp(-df2 / 2 * np.log1p(2 * f / df2))
    np.testing.assert_allclose(tails.f_upper(f, 2, df2), want, rtol=1e-8, atol=1e-15)


def test_f_of_one_is_t_squared():
    t = np.array([0.2, 1.0, 2.5, 6.0])
    np.testing.assert_allclose(tails.f_upper(t**2, 1, 9), tails.t_two_sided(t, 9), rtol=1e-12)


@pytest.mark.parametrize("df", [2, 17, 1000])
def test_range_of_two_is_t(df):
    q = np.array([0.1, 1.0, 3.0, 5.0])
    np.testing.assert_allclose(tails.tukey_upper(q, 2, df), tails.t_two_sided(q / math.sqrt(2), df), atol=1e-10)


def test_studentized_range_tables():
    # Table values at the 5 % level.
    got = tails.tukey_quantile(0.95, [3, 4, 10, 3, 5], [10, 17, 20, 60, 1e6])
    np.testing.assert_allclose(got, [3.877, 4.020, 5.008, 3.399, 3.858], atol=6e-4)


def test_range_against_simulation():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200_000, 5))
    s = np.sqrt(rng.chisquare(8, 200_000) / 8)
    q = (x.max(1) - x.min(1)) / s
    assert tails.tukey_upper([4.0], [5], [8])[0] == pytest.approx(np.mean(q > 4.0), abs=4e-3)


def test_undefined_stays_undefined():
    assert np.isnan(tails.t_two_sided([np.nan, 1.0], [5, 0])).all()
    assert np.isnan(tails.f_upper([np.nan, 1.0], [1, 0], [5, 5])).all()
    assert np.isnan(tails.tukey_upper([np.nan, 1.0], [3, 1], [5, 5])).all()


@pytest.mark.parametrize("df", [1, 2, 3.5, 17, 1000])
def test_range_of_two_far_out(df):
    q = np.array([0.0, 1e-3, 0.5, 3.0, 16.0, 40.0, 300.0, 3000.0])
    want = tails.t_two_sided(q / math.sqrt(2), df)
    seen = want > (1e-25 if df > 100 else 1e-200)  # ranges of normals are tabulated up to 16
    np.testing.assert_allclose(tails.tukey_upper(q, 2, df)[seen], want[seen], rtol=1e-8)


@pytest.mark.parametrize("k", [3, 8, 40])
def test_range_of_many_for_many_degrees_of_freedom(k):
    """With ever more degrees of freedom the tail becomes that of the range itself."""
    r = np.array([0.5, 2.0, 5.0, 9.0])
    z = np.linspace(-9, 22, 60001)
    pdf, cdf = np.exp(-z * z / 2) / math.sqrt(2 * math.pi), np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    for at in r:
        under = np.interp(z - at, z, cdf)
        want = 1 - k * np.trapezoid(pdf * (cdf - under) ** (k - 1), z)
        assert tails.tukey_upper([at], k, 1e8)[0] == pytest.approx(want, rel=1e-5, abs=1e-9)


def test_quantiles_bring_tails_back():
    rng = np.random.default_rng(2)
    p = np.concatenate([10.0 ** rng.uniform(-12, 0, 300), 1 - 10.0 ** rng.uniform(-6, 0, 100)])
    p = np.clip(p, 1e-12, 1 - 1e-6)
    a, b = 10.0 ** rng.uniform(0, 3, 400), 10.0 ** rng.uniform(0, 4, 400)
    np.testing.assert_allclose(tails.f_upper(tails.f_quantile(p, a, b), a, b), p, rtol=1e-9)
    np.testing.assert_allclose(tails.f_quantile(p, 2.0, b), b / 2 * np.expm1(-2 / b * np.log(p)), rtol=1e-9)
    np.testing.assert_allclose(tails.t_quantile(0.05, [1, 10, 60]), [12.7062047, 2.2281389, 2.0002978], rtol=1e-7)
    np.testing.assert_allclose(tails.t_two_sided(tails.t_quantile(p, b), b), p, rtol=1e-9)
    assert np.isnan(tails.f_quantile([0.0, 1.0, np.nan, 0.5], [1, 1, 1, 0], 5)).all()
