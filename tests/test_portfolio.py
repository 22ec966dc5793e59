import datetime as dt
import math
import random

from pyspark.sql import functions as F

from panelspark.operators import evaluate as ev, portfolio as pf

MONTHS = [dt.date(2020, m, 28) for m in range(1, 7)]


def brute(held, ret, drift):
    """The sequential definition, period by period."""
    prev, out = {}, []
    for m in MONTHS:
        names = [k for k in held.get(m, [])]
        w = {k: 1 / len(names) for k in names}
        g = sum(w[k] * ret[m, k] for k in names)
        out.append((0.5 * sum(abs(w.get(k, 0) - prev.get(k, 0)) for k in {*w, *prev}), g))
        if drift:
            prev = {k: w[k] * (1 + ret[m, k]) / (1 + g) for k in names} if names and g > -1 else {}
        else:
            prev = w
    return out


def test_turnover_against_the_sequential_definition(spark):
    rng = random.Random(4)
    ret = {(m, k): rng.uniform(-0.5, 0.5) for m in MONTHS for k in range(6)}
    for k in range(6):
        ret[MONTHS[4], k] = -1.0  # everything is lost: nothing drifts on
    held = {m: rng.sample(range(6), 3) for m in MONTHS if m != MONTHS[2]}  # one empty period
    h = spark.createDataFrame([("s", m, k, ret[m, k]) for m, ks in held.items() for k in ks], "strategy string, t date, k int, r double")
    periods = spark.createDataFrame([(m,) for m in MONTHS], "t date")
    s = pf.period_series(h, periods, ["s"], "t", "r")
    for drift in (True, False):
        got = [(r.turnover, r.gross_return) for r in pf.turnover(h, s, "t", "k", "r", drift).orderBy("t").collect()]
        for (a, b), (c, d) in zip(got, brute(held, ret, drift)):
            assert math.isclose(a, c, abs_tol=1e-12) and math.isclose(b, d, abs_tol=1e-12)
    assert got[0][0] == 0.5 and got[2] == (0.5, 0.0)


def test_missing_return_counts_as_zero_and_value_series_compounds(spark):
    h = spark.createDataFrame([("s", MONTHS[0], 1, 0.2), ("s", MONTHS[0], 2, None)], "strategy string, t date, k int, r double")
    s = pf.period_series(h, spark.createDataFrame([(m,) for m in MONTHS[:2]], "t date"), ["s"], "t", "r")
    v = pf.value_series(s.withColumns({"turnover": F.lit(0.5), "monthly_rf": F.lit(0.01)}), "t", 0.1).orderBy("t").collect()
    assert [round(x.nav_gross, 9) for x in v] == [1.1, 1.1] and round(v[1].nav_net, 9) == round(1.05 * 0.95, 9)
    assert round(v[1].drawdown_net, 9) == -0.05
    p = pf.performance(spark.createDataFrame([r.asDict() for r in v])).first()
    assert p.n_periods == 2 and math.isclose(p.final_nav_gross, 1.1)


def test_flat_returns_have_no_sharpe(spark):
    rows = [("s", m, 1, 0.01, 0.0, 0.0) for m in MONTHS]
    s = spark.createDataFrame(rows, "strategy string, t date, n_holdings int, gross_return double, turnover double, monthly_rf double")
    p = pf.performance(pf.value_series(s, "t", 0.0)).first()
    assert p.ann_vol_gross < 1e-12 and (p.sharpe_gross is None or p.ann_vol_gross > 0)


def test_four_score_triples(spark):
    data = [(2, 1, 1), (2, -2, 0), (-2, -1, -1), (0, 0, 1)]
    r = spark.createDataFrame(data, "a int, b int, c int").select("a", "b", "c", *[v.alias(n) for n, v in ev.score_rule("a", "b", "c").items()]).collect()
    got = {(x.a, x.b, x.c): (x.signal, x.confidence, x.disagreement) for x in r}
    assert got == {(2, 1, 1): ("increase", "high", 1), (2, -2, 0): ("hold", "low", 4), (-2, -1, -1): ("reduce", "high", 1), (0, 0, 1): ("hold", "low", 1)}
