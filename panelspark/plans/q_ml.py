"""Regression and model queries (M*)."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ORDINAL, band_label, r6 as R, t_p_value_sql
from ..operators import calendar as cal, evaluate as ev, ml, portfolio as pf, sets
from ..sources import bind as b, sinks
from .q_core import BOUNDS, SPLIT_SQL
from .q_portfolio import STRATEGIES, holdings
from .registry import cte, query, r6

NUMERIC = ["ret_1m", "ret_3m", "vol_annualized", "drawdown", "s1_lag1", "s2_lag1"]


def panel(spark, sf):
    """Features, sector, label and split, computed once."""
    p = cal.forward_return(b.price_signals(spark, sf), ["k"], "t", "ret_1m")
    m = cal.publication_lag(b.macro_month(spark, sf), [], "t", ["s1", "s2"]).select("t", "s1_lag1", "s2_lag1", "monthly_rf")
    p = p.join(b.dim(spark, sf).select("k", "sector"), "k", "left").join(m, "t", "left")
    p = p.withColumn("label", band_label("fwd_ret", b.EVAL_BAND))
    return sinks.settle(sinks.time_split(p, "t", BOUNDS).select("k", "t", "sector", "label", "split", "fwd_ret", "monthly_rf", *NUMERIC))


def parts(p):
    return p.where("split = 'train'"), p.where("split = 'validation'"), p.where("split = 'test'")


@query("m1_feature_pipeline", f"""
 WITH p AS (SELECT r.k, r.t, {SPLIT_SQL} AS split, r.ret_1m, d.sector FROM v_ret r LEFT JOIN v_dim d ON r.k = d.k WHERE r.t BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'),
  f AS (SELECT quantile_cont(ret_1m, 0.5) AS m FROM p WHERE split = 'train'),
  g AS (SELECT avg(coalesce(ret_1m, m)) AS mu, stddev_pop(coalesce(ret_1m, m)) AS sd FROM p, f WHERE split = 'train'),
  c AS (SELECT DISTINCT sector FROM p WHERE split = 'train')
 SELECT k, t, split, CAST({len(NUMERIC)} + (SELECT count(sector) FROM c) AS INTEGER) AS n_features, {r6('(coalesce(ret_1m, m) - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS first,
  CASE WHEN split <> 'train' AND k % 7 = 0 OR sector NOT IN (SELECT sector FROM c) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS one_hot FROM p, f, g""")
def m1(spark, sf):
    from pyspark.ml.functions import vector_to_array

    p = panel(spark, sf)
    f = ml.Features(NUMERIC, "sector").fit(parts(p)[0])
    unseen = (F.col("split") != "train") & (F.col("k") % 7 == 0)
    x = f.transform(p.withColumn("sector", F.when(unseen, "elsewhere").otherwise(F.col("sector"))))
    v = vector_to_array("features")
    n = len(NUMERIC)
    return x.select("k", "t", "split", F.size(v).alias("n_features"), R(v[0]).alias("first"), F.aggregate(F.slice(v, n + 1, 100), F.lit(0.0), lambda a, z: a + z).alias("one_hot"))


@query("m2_logistic")
def m2(spark, sf):
    tr, va, te = parts(panel(spark, sf))
    out = ml.fit_predict(tr, va.unionByName(te), NUMERIC, "sector", lambda n: ml.logistic(n, 0.1, 0.5, 50))
    return ev.per_class(out, "label", "pred", ["split"]).withColumns({c: R(c) for c in ("recall", "precision", "f1")})


# the training years give four expanding folds of half a year; the month before each is purged
FOLDS = [
    {"fold": i, "train_start": "1995-01-01", "train_end": end, "val_start": lo, "val_end": hi}
    for i, (end, lo, hi) in enumerate((
        ("1996-11-30", "1997-01-01", "1997-06-30"), ("1997-05-31", "1997-07-01", "1997-12-31"),
        ("1997-11-30", "1998-01-01", "1998-06-30"), ("1998-05-31", "1998-07-01", "1998-12-31")), 1)
]
# 0 is the L2 and 1 the L1 penalty
CANDIDATES = [
    {"candidate": f"C{c}_l1{r}", "C": c, "l1_ratio": r} for c in (0.01, 0.1, 1.0, 10.0, 100.0) for r in (0.0, 1.0, 0.1, 0.3, 0.5)]


@query("m3_walk_forward")
def m3(spark, sf):
    tr, _, _ = parts(panel(spark, sf))
    s = sinks.settle(ml.search_table(ml.walk_forward(tr, "t", NUMERIC, "sector", FOLDS, CANDIDATES, 3000)))
    best = ml.best_candidate(s).select("candidate").scalar()
    return s.withColumn("selected", F.col("candidate") == best).withColumns({c: R(c) for c in s.columns if c.startswith(("mean", "sd"))})


@query("m4_row_count_folds", """
 SELECT k, t, position, CASE WHEN position >= n - 4 * (n // 5) THEN (position - (n - 4 * (n // 5))) // (n // 5) END AS test_fold
 FROM (SELECT k, t, row_number() OVER (ORDER BY t, k) - 1 AS position, count(*) OVER () AS n FROM v_ret)""")
def m4(spark, sf):
    return ml.row_count_folds(sinks.settle(b.returns(spark, sf).select("k", "t")), "t", "k", 4).select("k", "t", "position", "test_fold")


@query("m5_score_columns")
def m5(spark, sf):
    tr, va, te = parts(panel(spark, sf))
    out = ml.fit_predict(tr, te, NUMERIC, "sector", lambda n: ml.logistic(n, 0.1, 0.5, 30))
    return out.select("k", "t", "pred", *[R(c).alias(c) for c in ("p_increase", "p_hold", "p_reduce", "score")])


def families(trees=500, rounds=100):
    return {
        "logistic": lambda n: ml.logistic(n, 1.0, 0.0, 5000), "forest": lambda n: ml.forest(trees), "boosted": lambda n: ml.boosted(rounds, 3),
    }


@query("m6_model_families")
def m6(spark, sf):
    tr, va, _ = parts(panel(spark, sf))
    pred, _ = ml.compare_families(tr, va, NUMERIC, "sector", families())
    return ev.summary(pred, "label", "pred", ["model"]).withColumns({c: R(c) for c in ("accuracy", "macro_f1", "weighted_f1")})


XS = ["ret_1m", "ret_3m"]
_M = ", ".join(f"avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}, covar_pop({x}, fwd_ret) / stddev_pop({x}) AS c_{x}" for x in XS)
_RHO = "corr(ret_1m, ret_3m)"
_B = "(c_ret_1m - rho * c_ret_3m) / (1 - rho * rho) AS b1, (c_ret_3m - rho * c_ret_1m) / (1 - rho * rho) AS b2"
cte("v_xs", f"SELECT k, t, ret_1m, ret_3m, fwd_ret, {SPLIT_SQL} AS split FROM v_ret WHERE ret_1m IS NOT NULL AND ret_3m IS NOT NULL AND t <= DATE '2001-12-31'")
cte("v_fit", f"SELECT *, {_B} FROM (SELECT {_M}, {_RHO} AS rho, avg(fwd_ret) AS my FROM v_xs WHERE split = 'train')")


def xs_rows(spark, sf):
    return sinks.settle(sinks.time_split(b.returns(spark, sf), "t", BOUNDS).select("k", "t", "split", "fwd_ret", *XS))


@query("m7_pooled_ols", f"""
 SELECT split, count(*) AS n, {r6('1 - sum(e * e) / (var_pop(fwd_ret) * count(*))')} AS r2, {r6('sqrt(avg(e * e))')} AS rmse, {r6('avg(abs(e))')} AS mae FROM (
  SELECT split, fwd_ret, fwd_ret - (my + b1 * (ret_1m - m_ret_1m) / s_ret_1m + b2 * (ret_3m - m_ret_3m) / s_ret_3m) AS e FROM v_xs, v_fit) GROUP BY split""")
def m7(spark, sf):
    m, _ = ml.pooled_ols(xs_rows(spark, sf), XS, "fwd_ret", "split")
    return m.withColumns({c: R(c) for c in ("r2", "rmse", "mae")})


@query("m7_coefficient_ranking", f"""
 SELECT feature, {r6('coef')} AS coef, row_number() OVER (ORDER BY abs(coef) DESC, feature) AS rank FROM (SELECT 'ret_1m' AS feature, b1 AS coef FROM v_fit UNION ALL SELECT 'ret_3m', b2 FROM v_fit)""")
def m7c(spark, sf):
    from pyspark.sql import Window

    _, c = ml.pooled_ols(xs_rows(spark, sf), XS, "fwd_ret", "split")
    # one row per feature
    return c.select("feature", R("coef").alias("coef"), F.row_number().over(Window.orderBy(F.desc(F.abs("coef")), "feature")).alias("rank"))


@query("m7_full_panel_ols")
def m7f(spark, sf):
    m, _ = ml.pooled_ols(panel(spark, sf), NUMERIC, "fwd_ret", "split")
    return m.withColumns({c: R(c) for c in ("r2", "rmse", "mae")})


@query("m7_normal_equations", " UNION ALL ".join(f"SELECT '{x}' AS feature, TRUE AS orthogonal" for x in ("1", *NUMERIC)))
def m7n(spark, sf):
    """The full-panel fit against its definition: no feature is left in the residuals."""
    train = panel(spark, sf).where(F.col("split") == "train")
    fit = ml.ols(train.na.drop(subset=[*NUMERIC, "fwd_ret"]), [], NUMERIC, "fwd_ret")
    e = ml.normal_equations(train, NUMERIC, "fwd_ret", fit)
    return e.select("feature", (F.abs("value") < 1e-8).alias("orthogonal"))


cte("v_fm", f"SELECT t, n, {_B} FROM (SELECT t, count(*) AS n, {_M}, {_RHO} AS rho FROM v_xs GROUP BY t HAVING count(*) >= 10)")


@query("m8_period_p_values", " UNION ALL ".join(f"""
 SELECT feature, n_periods, {r6('t')} AS t, {r6(t_p_value_sql('t', '(n_periods - 1)'))} AS p_value FROM (
  SELECT '{x}' AS feature, count(*) AS n_periods, avg({v}) / (stddev_samp({v}) / sqrt(count(*))) AS t FROM v_fm)""" for x, v in zip(XS, ("b1", "b2"))))
def m8p(spark, sf):
    _, s = ml.fama_macbeth(xs_rows(spark, sf), "t", XS, "fwd_ret")
    return ml.with_p_value(s, "t", F.col("n_periods") - 1).select("feature", "n_periods", R("t").alias("t"), R("p_value").alias("p_value"))


@query("m8_fama_macbeth", " UNION ALL ".join(f"""
 SELECT '{x}' AS feature, count(*) AS n_periods, {r6(f'avg({v})')} AS mean_coef, {r6(f'stddev_samp({v})')} AS sd_coef, {r6(f'avg({v}) / (stddev_samp({v}) / sqrt(count(*)))')} AS t FROM v_fm""" for x, v in zip(XS, ("b1", "b2"))))
def m8(spark, sf):
    _, s = ml.fama_macbeth(xs_rows(spark, sf), "t", XS, "fwd_ret")
    return s.withColumns({c: R(c) for c in ("mean_coef", "sd_coef", "t")})


@query("m8_full_panel_p_values")
def m8f(spark, sf):
    # the period-constant columns have no slope inside a period: the minimum-norm solve gives 0, t is NULL
    _, s = ml.fama_macbeth(panel(spark, sf), "t", NUMERIC, "fwd_ret")
    return ml.with_p_value(s, "t", F.col("n_periods") - 1).withColumns({c: R(c) for c in ("mean_coef", "sd_coef", "t", "p_value")})


@query("m10_ordered_logit")
def m10(spark, sf):
    tr, va, _ = parts(panel(spark, sf))
    out = ml.ordered_logit(tr, va, NUMERIC, "sector", ORDINAL)
    return ev.per_class(out, "label", "pred").withColumns({c: R(c) for c in ("recall", "precision", "f1")})


@query("m11_market_adjusted_model")
def m11(spark, sf):
    from ..operators import stats

    p = stats.leave_one_out(panel(spark, sf), "t", "fwd_ret", 5).withColumn("label", band_label("excess", b.EVAL_BAND))
    tr, va, _ = parts(sinks.settle(p))
    out = ml.fit_predict(tr, va, NUMERIC, "sector", lambda n: ml.logistic(n, 0.1, 0.5, 30))
    return ev.per_class(out, "label", "pred").withColumns({c: R(c) for c in ("recall", "precision", "f1")})


cte("v_reg", f"""
 SELECT *, {SPLIT_SQL} AS split FROM (SELECT r.t, avg(r.fwd_ret) AS y, avg(r.ret_3m) AS x1, any_value(f.x2) AS x2, count_if(r.fwd_ret < -0.5) / count(*) AS er FROM v_ret r
  LEFT JOIN (SELECT t, lag(s1) OVER (ORDER BY t) AS x2 FROM v_mm) f ON f.t = r.t GROUP BY r.t) WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND t <= DATE '2001-12-31'""")
cte("v_regfit", """
 SELECT *, (c1 - rho * c2) / (1 - rho * rho) AS b1, (c2 - rho * c1) / (1 - rho * rho) AS b2 FROM (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, avg(y) AS my,
  covar_pop(x1, y) / stddev_pop(x1) AS c1, covar_pop(x2, y) / stddev_pop(x2) AS c2, corr(x1, x2) AS rho FROM v_reg WHERE split = 'train')""")


def regime_series(spark, sf):
    m = cal.publication_lag(b.macro_month(spark, sf), [], "t", ["s1"]).select("t", F.col("s1_lag1").alias("x2"))
    p = b.returns(spark, sf).join(m, "t", "left")
    s = cal.market_series(p, "t", {"y": "fwd_ret", "x1": "ret_3m"}, ["x2"])
    bad = cal.bad_periods(p, "t", F.col("fwd_ret") < -0.5, 1.2).select("t", F.col("bad").cast("int").alias("bad"))
    s = sinks.time_split(s.join(bad, "t"), "t", BOUNDS)
    return sinks.settle(s.na.drop(subset=["x1", "x2", "y"]).select("t", "y", "x1", "x2", "bad", "split"))


@query("m12_regime_regression", f"""
 SELECT CASE WHEN split = 'train' THEN 'in_sample' ELSE 'out_of_sample' END AS sample, count(*) AS n, {r6('1 - sum(e * e) / sum((y - my) * (y - my))')} AS r2 FROM (
  SELECT split, y, my, y - (my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2) AS e FROM v_reg, v_regfit) GROUP BY 1""")
def m12(spark, sf):
    s = regime_series(spark, sf)
    fit = ml.ols(s.where("split = 'train'"), [], ["x1", "x2"], "y").select("fit").scalar()
    d = ml.predict_ols(s, fit, ["x1", "x2"]).withColumn("_m", s.where("split = 'train'").agg(F.avg("y").alias("m")).scalar())
    e, z = F.col("y") - F.col("yhat"), F.col("y") - F.col("_m")
    return d.groupBy(F.when(F.col("split") == "train", "in_sample").otherwise("out_of_sample").alias("sample")).agg(
        F.count("*").alias("n"), R(1 - F.sum(e * e) / F.sum(z * z)).alias("r2"))


@query("m12_regime_auc")
def m12a(spark, sf):
    s = regime_series(spark, sf).withColumn("label", F.when(F.col("bad") == 1, "reduce").otherwise("increase"))
    tr = s.where("split = 'train'")
    out = sinks.settle(ml.fit_predict(tr, s, ["x1", "x2"], None, lambda n: ml.logistic(n, 1.0, 0.0, 50)).withColumn(
        "sample", F.when(F.col("split") == "train", "in_sample").otherwise("out_of_sample")))
    return ev.ranking_metrics(out, "p_reduce", F.col("bad") == 1, ["sample"]).withColumns({c: R(c) for c in ("roc_auc", "avg_precision")})


WINDOWS = [
    {"window": "main", "train": ("1995-01-01", "1998-12-31"), "val": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")},
    {"window": "early", "train": ("1995-01-01", "1997-12-31"), "val": ("1998-01-01", "1998-12-31"), "test": ("2000-01-01", "2001-12-31")},
    {"window": "earliest", "train": ("1995-01-01", "1996-12-31"), "val": ("1997-01-01", "1997-12-31"), "test": ("2000-01-01", "2001-12-31")},
]


def backtest(pred):
    p = sinks.settle(pred.select("k", "t", "sector", "label", "pred", "score", "monthly_rf", (F.col("fwd_ret") / 20).alias("r")))
    h = sinks.settle(holdings(p))
    s = pf.turnover(h, pf.period_series(h, p, STRATEGIES, "t", "r"), "t", "k", "r")
    rf = p.groupBy("t").agg(F.any_value("monthly_rf", True).alias("monthly_rf"))
    return pf.performance(pf.value_series(s.join(rf, "t", "left"), "t", 0.001))


ELIGIBLE = [s for s in STRATEGIES if s != "top5"]  # fixed values: five names are too few to be chosen


@query("m14_window_robustness")
def m14(spark, sf):
    p = panel(spark, sf)
    models = families()

    def compared(w):
        tr, va = (ml.between(p, "t", *w[x]) for x in ("train", "val"))
        return ml.compare_families(tr, va, NUMERIC, "sector", models)[0]

    def result(w, pred):
        tr, va, te = (ml.between(p, "t", *w[x]) for x in ("train", "val", "test"))
        pred = sinks.settle(pred)
        # the choice is a single row: model first, then rule, then the test result of that pair
        model = sets.best_row(ev.summary(pred, "label", "pred", ["model"]), [F.desc("macro_f1"), F.desc("weighted_f1"), F.desc("accuracy"), F.asc("model")]).first()["model"]
        rule = sets.best_row(backtest(pred.where(F.col("model") == model)).where(F.col("strategy").isin(*ELIGIBLE)), [F.desc_nulls_last("sharpe_net"), F.desc("ann_excess_net"), F.asc("strategy")]).first()["strategy"]
        final = ml.fit_predict(tr.unionByName(va), te, NUMERIC, "sector", models[model])
        return backtest(final).where(F.col("strategy") == rule).select(
            F.lit(w["window"]).alias("window"), F.lit(model).alias("model"), "strategy", "n_periods", R("sharpe_net").alias("sharpe_net"), R("final_nav_net").alias("final_nav_net"))

    return reduce(DataFrame.unionByName, ml.in_turn(compared, result, WINDOWS))


_CS = "SELECT sector, count(*) AS n, avg(p_r) AS p, max(pred) AS top FROM v_ev {} GROUP BY 1"


@query("m15_consistency", f"""
 WITH a AS ({_CS.format("WHERE sector <> 'ASIA'")}), z AS (SELECT sector, n + CASE WHEN sector = 'AFRICA' THEN 1 ELSE 0 END AS n, p, CASE WHEN sector = 'EUROPE' THEN 'other' ELSE top END AS top FROM ({_CS.format('')})),
  j AS (SELECT coalesce(a.sector, z.sector) AS sector, a.sector IS NOT NULL AND z.sector IS NOT NULL AS bo, a.n = z.n AS en, abs(a.p - z.p) <= 1e-10 AS ep, a.top = z.top AS et FROM a FULL JOIN z ON a.sector = z.sector)
 SELECT sector, 'n' AS item, bo AND coalesce(en, false) AS consistent FROM j UNION ALL SELECT sector, 'p', bo AND coalesce(ep, false) FROM j UNION ALL SELECT sector, 'top', bo AND coalesce(et, false) FROM j""")
def m15(spark, sf):
    e = b.evaluated(spark, sf, sector=True)
    t = sinks.settle(e.groupBy("sector").agg(F.count("*").alias("n"), F.avg("p_r").alias("p"), F.max("pred").alias("top")))
    other = t.withColumn("n", F.col("n") + F.when(F.col("sector") == "AFRICA", 1).otherwise(0)).withColumn("top", F.when(F.col("sector") == "EUROPE", "other").otherwise(F.col("top")))
    return ml.consistency(t.where(F.col("sector") != "ASIA"), other, ["sector"], ["n", "p"], ["top"]).select("sector", "item", "consistent")
