import math

import pytest

from rotapanel.functions.distributions import chi2_above, chi2_point, t_point, t_two_sided


def values(spark, rows, schema, *columns):
    out = spark.createDataFrame(rows, schema).select(*columns)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    return [tuple(r) for r in out.collect()]


def test_published_points(spark):
    found = values(spark, [(1,), (20,), (40,), (10**7,)], "df int", t_point("df"))
    assert [round(r[0], 3) for r in found] == [12.706, 2.086, 2.021, 1.96]
    found = values(spark, [(1,), (4,), (7,), (9,)], "df int", chi2_point("df"))
    assert [round(r[0], 4) for r in found] == [3.8415, 9.4877, 14.0671, 16.919]


def inside(t, df):
    """Probability between -t and t by the finite series of whole degrees of freedom."""
    angle = math.atan(t / math.sqrt(df))
    if df % 2:
        terms, term = 0.0, math.cos(angle)
        for k in range((df - 1) // 2):
            terms += term
            term *= math.cos(angle) ** 2 * (2 * k + 2) / (2 * k + 3)
        return 2 / math.pi * (angle + math.sin(angle) * terms)
    terms, term = 0.0, 1.0
    for k in range(df // 2):
        terms += term
        term *= math.cos(angle) ** 2 * (2 * k + 1) / (2 * k + 2)
    return math.sin(angle) * terms


def test_points_and_tails_meet_the_finite_series(spark):
    degrees = [1, 2, 3, 4, 9, 10, 57, 300, 10_001, 200_000]
    found = values(spark, [(d,) for d in degrees], "df int", t_point("df"))
    backs = values(spark, [(d, t) for d, (t,) in zip(degrees, found)], "df int, t double", t_two_sided("t", "df"))
    for df, (t,), (p,) in zip(degrees, found, backs):
        assert math.isclose(inside(t, df), 0.95, abs_tol=1e-10) and math.isclose(p, 0.05, abs_tol=1e-12)
    pairs = [(df, t) for df in degrees for t in (0.0, 0.01, 0.7, 1.3, 1.75, 2.5, 6.0, -2.5, 40.0)]
    found = values(spark, pairs, "df int, t double", t_two_sided("t", "df"))
    for (df, t), (p,) in zip(pairs, found):
        assert math.isclose(p, 1 - inside(abs(t), df), abs_tol=1e-10), (df, t)


def test_far_tails_and_rare_shares(spark):
    rows = values(
        spark, [(2.0, 1e4), (1.0, 1e6)], "df double, t double",
        t_two_sided("t", "df"), t_point("df", 1e-9),
    )
    assert math.isclose(rows[0][0], 1 / 1e8, rel_tol=1e-6) and math.isclose(rows[1][0], 2 / math.pi * 1e-6, rel_tol=1e-9)
    assert math.isclose(rows[1][1], 1 / math.tan(math.pi * 1e-9 / 2), rel_tol=1e-6)


@pytest.mark.parametrize("df", [0.3, 1.5, 2.7, 33.3, 1234.5])
def test_degrees_need_not_be_whole(spark, df):
    """Tails against sums of the densities in small steps."""
    size = 400_000
    t_mass = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi * df)
    h = 1.7 / size
    t_in = 2 * t_mass * sum((1 + ((k + 0.5) * h) ** 2 / df) ** (-(df + 1) / 2) for k in range(size)) * h
    x = 1.2 * df
    mass = math.exp(-math.lgamma(df / 2) - df / 2 * math.log(2)) if df < 100 else None
    t_out, c_out, c_point = values(
        spark, [(df, x)], "df double, x double", t_two_sided("1.7", "df"), chi2_above("x", "df"),
        chi2_point("df"),
    )[0]
    back = values(spark, [(df, c_point)], "df double, x double", chi2_above("x", "df"))[0][0]
    assert math.isclose(t_out, 1 - t_in, abs_tol=1e-8) and math.isclose(back, 0.05, abs_tol=1e-11) and c_point > 0
    if mass is None:
        return
    if df >= 2:
        h = x / size
        c_in = mass * sum(((k + 0.5) * h) ** (df / 2 - 1) * math.exp(-(k + 0.5) * h / 2) for k in range(size)) * h
    else:  # with u = x ** (df / 2) the density has no pole at zero
        h = x ** (df / 2) / size
        c_in = mass * 2 / df * sum(math.exp(-(((k + 0.5) * h) ** (2 / df)) / 2) for k in range(size)) * h
    assert math.isclose(c_out, 1 - c_in, abs_tol=1e-6)


@pytest.mark.parametrize("df", [2, 4, 8, 60, 1000])
def test_chi_squared_of_even_degrees_is_a_poisson_sum(spark, df):
    xs = [0.5, df * 0.6, df * 1.0, df * 1.1, df * 2.5]
    found = values(spark, [(x,) for x in xs], "x double", chi2_above("x", str(df)))
    for x, (p,) in zip(xs, found):
        want = sum(math.exp(-x / 2 + k * math.log(x / 2) - math.lgamma(k + 1)) for k in range(df // 2))
        assert math.isclose(p, want, rel_tol=1e-10, abs_tol=1e-14)
    assert values(spark, [(0.0,)], "x double", chi2_above("x", str(df))) == [(1.0,)]


def test_columns_take_nulls(spark):
    rows = values(
        spark, [(1, 12.706), (None, 2.0), (0, 2.0), (20, None), (20, float("nan")), (20, float("inf")), (-3, 1.0)], "df int, t double",
        t_point("df"), t_two_sided("t", "df"), chi2_point("df"), chi2_above("t", "df"),
    )
    assert round(rows[0][0], 3) == 12.706 and round(rows[0][1], 4) == 0.05
    assert rows[1] == rows[2] == rows[6] == (None, None, None, None)
    assert rows[3][1] is None and rows[3][3] is None and rows[4][1] is None and rows[4][3] is None
    assert rows[5][1] == 0.0 and rows[5][3] == 0.0
