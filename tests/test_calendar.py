import datetime as dt
import math

from panelspark.operators import calendar as cal, windows as win
from pyspark.sql import functions as F

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_last_non_null_per_column_and_gap_month(spark):
    df = spark.createDataFrame(
        [("a", D(2020, 1, 10), 1.0, 5.0), ("a", D(2020, 1, 20), None, 6.0), ("a", D(2020, 3, 2), 3.0, None)],
        "k string, d date, x double, y double")
    out = rows(cal.month_end_last(df, ["k"], "d", ["x", "y"]), "t")
    assert out == [("a", D(2020, 1, 31), 1.0, 6.0), ("a", D(2020, 2, 29), None, None), ("a", D(2020, 3, 31), 3.0, None)]


def test_gap_month_has_zero_return_and_null_drawdown(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 31), 2.0), ("a", D(2020, 3, 31), 3.0)], "k string, t date, p double")
    m = cal.fill_months(df, ["k"])
    m = cal.running_drawdown(cal.pct_change(m, ["k"], "t", "p", {"r1": 1, "r2": 2}), ["k"], "t", "p")
    r = m.orderBy("t").collect()
    assert [x.r1 for x in r] == [None, 0.0, 0.5]
    assert r[2].r2 == 0.5 and r[1].running_max is None and r[1].drawdown is None
    f = cal.forward_return(m, ["k"], "t", "r1").orderBy("t").collect()
    assert [x.fwd_ret for x in f] == [0.0, 0.5]


def test_fill_months_keeps_month_ends_over_february(spark):
    df = spark.createDataFrame([("a", D(2021, 1, 31), 1), ("a", D(2021, 5, 31), 2)], "k string, t date, v int")
    assert [r[1] for r in rows(cal.fill_months(df, ["k"]).select("k", "t"), "t")] == [
        D(2021, 1, 31), D(2021, 2, 28), D(2021, 3, 31), D(2021, 4, 30), D(2021, 5, 31)]


def test_risk_free_fills_both_ways(spark):
    df = spark.createDataFrame([(D(2020, 1, 31), None), (D(2020, 2, 29), 12.0), (D(2020, 3, 31), None)], "t date, r double")
    assert [x[2] for x in rows(cal.risk_free(df, "t", "r"), "t")] == [0.01] * 3
    none = df.withColumn("r", F.lit(None).cast("double"))
    assert [x[2] for x in rows(cal.risk_free(none, "t", "r"), "t")] == [0.0] * 3


def test_implied_dividends_ignore_noise(spark):
    df = spark.createDataFrame(
        [("a", D(2020, 1, 1), 100.0, 90.0), ("a", D(2020, 1, 2), 99.0, 90.0), ("a", D(2020, 1, 3), 99.0, 90.0001)],
        "k string, d date, close double, adj double")
    r = cal.implied_dividends(df, ["k"], "d", "close", "adj").orderBy("d").collect()
    assert r[0].div_amount is None and math.isclose(r[1].div_amount, 1.0) and r[2].div_amount == 0.0


def test_residual_volatility_matches_regression(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=80) / 50
    y = 0.5 * x + rng.normal(size=80) / 100
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(80)]
    df = spark.createDataFrame([("a", d, float(b), float(a)) for d, a, b in zip(days, x, y)], "k string, d date, r double, m double")
    got = win.residual_volatility(df, ["k"], "d", "r", "m").orderBy("t").collect()[-1].idio_vol
    xs, ys = x[-63:], y[-63:]
    b = np.cov(xs, ys, ddof=0)[0, 1] / np.var(xs)
    res = ys - (ys.mean() - b * xs.mean() + b * xs)
    assert math.isclose(got, res.std(ddof=1) * math.sqrt(252), rel_tol=1e-9)


def test_trailing_features_need_history_and_carry_on(spark):
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    df = spark.createDataFrame([("a", d, 0.01, 100.0) for d in days], "k string, d date, r double, v double")
    f = win.illiquidity(df, ["k"], "d", "r", "v")
    got = rows(f, "t")
    assert got[0] == ("a", D(2020, 1, 31), 0.01 / 100 * 1e9)
    months = spark.createDataFrame([(D(2020, 1, 31),), (D(2020, 2, 29),), (D(2020, 4, 30),)], "t date")
    assert len(rows(win.carry_to_months(f, months, ["k"], ["illiq"]), "t")) == 3
