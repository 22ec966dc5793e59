"""Calendar, panel-construction and window queries (T*, W*) and the flagship."""

from pyspark.sql import functions as F

from ..functions.columns import CLASSES, band_label, r6 as R
from ..operators import calendar as cal, joins, ranking, windows as win
from ..sources import bind as b, sinks
from .registry import cte, label_sql, query, r6

RETS = ["ret_1m", "ret_3m", "ret_6m", "ret_12m"]


@query("flagship_label_distribution", f"""
 SELECT t, count(*) AS n_obs, {', '.join(f"count(*) FILTER (WHERE label = '{c}') AS n_{c}" for c in CLASSES)},
  {r6('avg(ret_3m)')} AS mean_ret_3m, {r6('avg(ret_12m)')} AS mean_ret_12m,
  {r6('avg(vol_annualized)')} AS mean_vol, {r6('avg(adj_close / running_max - 1)')} AS mean_drawdown
 FROM (SELECT s.*, v.vol_annualized, {label_sql('s.fwd_ret', '0.1::DOUBLE')} AS label FROM
   (SELECT *, lead(ret_1m) OVER (PARTITION BY k ORDER BY t) AS fwd_ret FROM v_sig) s
   LEFT JOIN v_vol v ON s.k = v.k AND s.t = v.t WHERE s.fwd_ret IS NOT NULL) GROUP BY t""")
def flagship(spark, sf):
    p = cal.forward_return(b.price_signals(spark, sf), ["k"], "t", "ret_1m").withColumn(
        "label", band_label("fwd_ret", b.EVAL_BAND)
    )
    return p.groupBy("t").agg(
        F.count("*").alias("n_obs"),
        *[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in CLASSES],
        R(F.avg("ret_3m")).alias("mean_ret_3m"), R(F.avg("ret_12m")).alias("mean_ret_12m"),
        R(F.avg("vol_annualized")).alias("mean_vol"), R(F.avg("drawdown")).alias("mean_drawdown"),
    )


def _gappy(spark, sf):
    px = b.px_daily(spark, sf)
    return px.withColumn("close", F.when(F.col("volume") % 5 != 0, F.col("close")))


@query("t1_month_end_last", f"""
 WITH g AS (SELECT k, d, CASE WHEN volume % 5 <> 0 THEN close END AS close, volume FROM v_px)
 SELECT s.k, s.t, {r6('p.close')} AS close, p.volume FROM (
   SELECT k, last_day(CAST(unnest(generate_series(min(date_trunc('month', d)), max(date_trunc('month', d)),
     INTERVAL 1 MONTH)) AS DATE)) AS t FROM g GROUP BY k) s
 LEFT JOIN (SELECT k, last_day(d) AS t, arg_max(close, d) FILTER (WHERE close IS NOT NULL) AS close,
    arg_max(volume, d) AS volume FROM g GROUP BY 1, 2) p ON s.k = p.k AND s.t = p.t""")
def t1(spark, sf):
    return cal.month_end_last(_gappy(spark, sf), ["k"], "d", ["close", "volume"]).select(
        "k", "t", R("close").alias("close"), "volume")


@query("t2_resample_ffill", f"SELECT t, {', '.join(f'{r6(s)} AS {s}' for s in b.SERIES)} FROM v_mm")
def t2(spark, sf):
    m = cal.resample_ffill(b.macro_daily(spark, sf), "d", list(b.SERIES))
    return m.select("t", *[R(s).alias(s) for s in b.SERIES])


@query("t3_monthly_volatility", f"SELECT k, t, {r6('vol_annualized')} AS vol_annualized FROM v_vol")
def t3(spark, sf):
    d = cal.pct_change(b.px_daily(spark, sf), ["k"], "d", "adj_close", {"ret_d": 1})
    return cal.monthly_volatility(d, ["k"], "d", "ret_d").select("k", "t", R("vol_annualized").alias("vol_annualized"))


@query("t4_reindex_ffill", f"""
 WITH days AS (SELECT DISTINCT d FROM v_px), s AS (SELECT d, s2 FROM v_macro WHERE s2 IS NOT NULL)
 SELECT days.d, {r6('s.s2')} AS s2 FROM days ASOF LEFT JOIN s ON days.d >= s.d""")
def t4(spark, sf):
    days = b.px_daily(spark, sf).select("d").distinct()
    series = b.macro_daily(spark, sf).where(F.col("s2").isNotNull()).select(F.col("d").alias("sd"), "s2")
    return joins.asof_join(days, series, [], "d", "sd", ["s2"], ["s2"]).select("d", R("s2").alias("s2"))


@query("t5_differences_spreads", f"""
 SELECT t, {r6('s1 - lag(s1, 1) OVER (ORDER BY t)')} AS s1_chg_1m, {r6('s1 - lag(s1, 3) OVER (ORDER BY t)')} AS s1_chg_3m,
  {r6('s2 - lag(s2, 1) OVER (ORDER BY t)')} AS s2_chg_1m, {r6('s2 - s3')} AS spread_2_3 FROM v_mm""")
def t5(spark, sf):
    m = cal.resample_ffill(b.macro_daily(spark, sf), "d", list(b.SERIES))
    m = cal.differences(m, [], "t", {"s1_chg_1m": ("s1", 1), "s1_chg_3m": ("s1", 3), "s2_chg_1m": ("s2", 1)})
    m = m.withColumn("spread_2_3", F.col("s2") - F.col("s3"))
    return m.select("t", *[R(c).alias(c) for c in ("s1_chg_1m", "s1_chg_3m", "s2_chg_1m", "spread_2_3")])


@query("t6_growth", f"""
 SELECT t, {r6('s4 / lag(s4, 1) OVER (ORDER BY t) - 1')} AS s4_mom, {r6('s4 / lag(s4, 12) OVER (ORDER BY t) - 1')} AS s4_yoy
 FROM v_mm""")
def t6(spark, sf):
    m = cal.resample_ffill(b.macro_daily(spark, sf), "d", ["s4"])
    return cal.pct_change(m, [], "t", "s4", {"s4_mom": 1, "s4_yoy": 12}).select(
        "t", R("s4_mom").alias("s4_mom"), R("s4_yoy").alias("s4_yoy"))


@query("t7_publication_lag", f"""
 SELECT t, {', '.join(f'{r6(f"lag({s}) OVER (ORDER BY t)")} AS {s}_lag1' for s in b.SERIES)} FROM v_mm""")
def t7(spark, sf):
    m = cal.resample_ffill(b.macro_daily(spark, sf), "d", list(b.SERIES))
    m = cal.publication_lag(m, [], "t", list(b.SERIES))
    return m.select("t", *[R(f"{s}_lag1").alias(f"{s}_lag1") for s in b.SERIES])


@query("t8_risk_free", f"""
 SELECT t, {r6('monthly_rf', 9)} AS monthly_rf FROM (SELECT t, coalesce(
   last_value(r IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   first_value(r IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS monthly_rf
  FROM (SELECT last_day(d) AS t, arg_max(s1, d) FILTER (WHERE day(d) > 20 AND month(d) > 1 AND s1 IS NOT NULL) / 1200.0 AS r
        FROM v_macro GROUP BY 1))""")
def t8(spark, sf):
    late = F.when((F.dayofmonth("d") > 20) & (F.month("d") > 1), F.col("s1"))
    m = cal.month_end_last(b.macro_daily(spark, sf).withColumn("late", late), [], "d", ["late"])
    return cal.risk_free(m, "t", "late").select("t", R("monthly_rf", 9).alias("monthly_rf"))


@query("t9_build_panel", f"""
 SELECT r.k, r.t, d.company, d.sector, {r6('r.adj_close')} AS adj_close, {r6('r.fwd_ret')} AS fwd_ret,
  {label_sql('r.fwd_ret', '0.02::DOUBLE')} AS label, {r6('f.monthly_rf', 9)} AS monthly_rf, {r6('f.s3')} AS s3
 FROM v_ret r LEFT JOIN v_dim d ON r.k = d.k LEFT JOIN v_rf f ON r.t = f.t""")
def t9(spark, sf):
    p = joins.build_panel(
        cal.pct_change(b.price_month(spark, sf), ["k"], "t", "adj_close", {"ret_1m": 1}),
        b.dim(spark, sf), b.macro_month(spark, sf).select("t", "s3", "monthly_rf"), 0.02)
    return p.select("k", "t", "company", "sector", R("adj_close").alias("adj_close"), R("fwd_ret").alias("fwd_ret"),
                    "label", R("monthly_rf", 9).alias("monthly_rf"), R("s3").alias("s3"))


cte("v_div", """
 SELECT k, d, close, CASE WHEN abs(gap) < 0.0001 THEN 0.0 ELSE gap END AS div_ret,
  CASE WHEN abs(gap) < 0.0001 THEN 0.0 ELSE prev * gap END AS div_amount
 FROM (SELECT *, lag(close) OVER w AS prev, (adj_close / lag(adj_close) OVER w - 1) - (close / lag(close) OVER w - 1) AS gap
       FROM v_px WINDOW w AS (PARTITION BY k ORDER BY d))""")
cte("v_yield", """
 SELECT k, t, div_month, close, sum(div_month) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
   AS div_trailing FROM (SELECT k, last_day(d) AS t, coalesce(sum(div_amount), 0.0) AS div_month, arg_max(close, d) AS close
   FROM v_div GROUP BY 1, 2)""")


@query("t10_enrich_panel", f"""
 SELECT r.k, r.t, {r6('r.fwd_ret')} AS fwd_ret, {r6('y.yl')} AS div_yield_lag1, {r6('f.s2')} AS s2 FROM v_ret r
 LEFT JOIN (SELECT k, t, lag(div_trailing / close) OVER (PARTITION BY k ORDER BY t) AS yl FROM v_yield) y ON r.k = y.k AND r.t = y.t
 LEFT JOIN v_rf f ON r.t = f.t""")
def t10(spark, sf):
    px = sinks.settle(b.px_daily(spark, sf).select("k", "d", "close", "adj_close", "volume"))
    base = b.returns(spark, sf, px).select("k", "t", "fwd_ret")
    y = cal.trailing_yield(cal.implied_dividends(px, ["k"], "d", "close", "adj_close"),
                           ["k"], "d", "div_amount", "close")
    y = cal.publication_lag(y, ["k"], "t", ["div_yield"]).select("k", "t", "div_yield_lag1")
    out = joins.enrich(base, [(y, ["k", "t"]), (b.macro_month(spark, sf).select("t", "s2"), ["t"])])
    return out.select("k", "t", R("fwd_ret").alias("fwd_ret"), R("div_yield_lag1").alias("div_yield_lag1"), R("s2").alias("s2"))


@query("t10_coverage_report", f"""
 SELECT 'div_yield' AS feature, count(*) AS n_rows, count(y.div_trailing / y.close) AS n_present,
  {r6('count(y.div_trailing / y.close) / count(*)')} AS coverage
 FROM v_ret r LEFT JOIN v_yield y ON r.k = y.k AND r.t = y.t
 UNION ALL SELECT 'ret_12m', count(*), count(ret_12m), {r6('count(ret_12m) / count(*)')} FROM v_ret""")
def t10c(spark, sf):
    px = sinks.settle(b.px_daily(spark, sf).select("k", "d", "close", "adj_close", "volume"))
    base = b.returns(spark, sf, px)
    y = cal.trailing_yield(cal.implied_dividends(px, ["k"], "d", "close", "adj_close"),
                           ["k"], "d", "div_amount", "close").select("k", "t", "div_yield")
    p = joins.enrich(base, [(y, ["k", "t"])])
    return joins.coverage(p, ["div_yield", "ret_12m"]).select(
        "feature", "n_rows", "n_present", R("coverage").alias("coverage"))


@query("t11_implied_dividends", f"SELECT k, d, {r6('div_ret')} AS div_ret, {r6('div_amount')} AS div_amount FROM v_div")
def t11(spark, sf):
    return cal.implied_dividends(b.px_daily(spark, sf), ["k"], "d", "close", "adj_close").select(
        "k", "d", R("div_ret").alias("div_ret"), R("div_amount").alias("div_amount"))


@query("t12_trailing_yield", f"""
 SELECT k, t, {r6('div_month')} AS div_month, {r6('div_trailing')} AS div_trailing, {r6('div_trailing / close')} AS div_yield
 FROM v_yield""")
def t12(spark, sf):
    y = cal.trailing_yield(cal.implied_dividends(b.px_daily(spark, sf), ["k"], "d", "close", "adj_close"),
                           ["k"], "d", "div_amount", "close")
    return y.select("k", "t", *[R(c).alias(c) for c in ("div_month", "div_trailing", "div_yield")])


@query("t13_market_series", f"""
 SELECT r.t, {r6('avg(fwd_ret)')} AS mkt_fwd, {r6('avg(ret_3m)')} AS mkt_ret_3m, {r6('any_value(f.s1)')} AS s1
 FROM v_ret r LEFT JOIN v_rf f ON r.t = f.t GROUP BY r.t""")
def t13(spark, sf):
    p = b.returns(spark, sf).join(b.macro_month(spark, sf).select("t", "s1"), "t", "left")
    return cal.market_series(p, "t", {"mkt_fwd": "fwd_ret", "mkt_ret_3m": "ret_3m"}, ["s1"]).select(
        "t", *[R(c).alias(c) for c in ("mkt_fwd", "mkt_ret_3m", "s1")])


@query("t14_bad_periods", f"""
 WITH p AS (SELECT t, count(*) AS n_obs, count(*) FILTER (WHERE label = 'reduce' AND fwd_ret < -0.5) AS e FROM v_truth GROUP BY t)
 SELECT t, n_obs, {r6('e / n_obs')} AS event_rate, e / n_obs > 2.0 * (SELECT sum(e) / sum(n_obs) FROM p) AS bad FROM p""")
def t14(spark, sf):
    out = cal.bad_periods(b.truth(spark, sf), "t", (F.col("label") == "reduce") & (F.col("fwd_ret") < -0.5))
    return out.select("t", "n_obs", R("event_rate").alias("event_rate"), "bad")


@query("w1_k_period_returns", f"SELECT k, t, {', '.join(f'{r6(c)} AS {c}' for c in RETS)} FROM v_sig")
def w1(spark, sf):
    m = cal.pct_change(b.price_month(spark, sf), ["k"], "t", "adj_close", dict(zip(RETS, (1, 3, 6, 12))))
    return m.select("k", "t", *[R(c).alias(c) for c in RETS])


@query("w2_forward_return", f"SELECT k, t, {r6('fwd_ret')} AS fwd_ret FROM v_ret")
def w2(spark, sf):
    return b.returns(spark, sf).select("k", "t", R("fwd_ret").alias("fwd_ret"))


@query("w3_running_drawdown", f"""
 SELECT k, t, {r6('running_max')} AS running_max, {r6('adj_close / running_max - 1')} AS drawdown FROM v_sig""")
def w3(spark, sf):
    m = cal.running_drawdown(b.price_month(spark, sf), ["k"], "t", "adj_close")
    return m.select("k", "t", R("running_max").alias("running_max"), R("drawdown").alias("drawdown"))


@query("w4_nav_drawdown", f"""
 SELECT k, t, {r6('nav')} AS nav, {r6('nav / max(nav) OVER (PARTITION BY k ORDER BY t) - 1')} AS drawdown
 FROM (SELECT k, t, product(1 + fwd_ret / 50) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nav
       FROM v_ret)""")
def w4(spark, sf):
    m = b.returns(spark, sf).withColumn("r", F.col("fwd_ret") / 50)
    return win.nav_and_drawdown(m, ["k"], "t", "r").select("k", "t", R("nav").alias("nav"), R("drawdown").alias("drawdown"))


@query("w5_trailing_rows", f"""
 SELECT k, t, {r6('sum(volume) OVER w')} AS volume_3, {r6('avg(close) OVER w')} AS close_avg_3 FROM v_pm
 WINDOW w AS (PARTITION BY k ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def w5(spark, sf):
    m = win.trailing(b.price_month(spark, sf), ["k"], "t",
                     {"volume_3": ("sum", "volume", 3), "close_avg_3": ("avg", "close", 3)})
    return m.select("k", "t", R("volume_3").alias("volume_3"), R("close_avg_3").alias("close_avg_3"))


@query("w6_illiquidity", f"""
 SELECT k, t, CASE WHEN n >= 30 THEN {r6('illiq', 3)} END AS illiq FROM (
  SELECT k, last_day(d) AS t, arg_max(illiq, d) AS illiq, arg_max(n, d) AS n FROM (
   SELECT k, d, avg(abs(ret_d) / day_value * 1e9) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS illiq,
    count(*) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM v_dret) GROUP BY 1, 2)""")
def w6(spark, sf):
    d = cal.pct_change(b.px_daily(spark, sf), ["k"], "d", "adj_close", {"ret_d": 1})
    return win.illiquidity(d, ["k"], "d", "ret_d", "day_value").select("k", "t", R("illiq", 3).alias("illiq"))


cte("v_mkt", "SELECT *, avg(ret_d) OVER (PARTITION BY d) AS mkt FROM v_dret")


@query("w7_residual_volatility", f"""
 SELECT k, t, CASE WHEN h >= 30 AND n >= 40 AND sxx > 0 THEN {r6('sqrt((syy - sxy * sxy / sxx) / (n - 1)) * sqrt(252.0)')} END AS idio_vol
 FROM (SELECT k, last_day(d) AS t, arg_max(h, d) AS h, arg_max(n, d) AS n, arg_max(sxx, d) AS sxx, arg_max(syy, d) AS syy, arg_max(sxy, d) AS sxy
  FROM (SELECT k, d, count(*) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h,
    regr_count(ret_d, mkt) OVER w AS n, regr_sxx(ret_d, mkt) OVER w AS sxx, regr_syy(ret_d, mkt) OVER w AS syy, regr_sxy(ret_d, mkt) OVER w AS sxy
   FROM v_mkt WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) GROUP BY 1, 2)""")
def w7(spark, sf):
    d = cal.pct_change(b.px_daily(spark, sf), ["k"], "d", "adj_close", {"ret_d": 1})
    d = win.market_mean(sinks.settle(d.select("k", "d", "ret_d")), "d", "ret_d", "mkt")
    return win.residual_volatility(d, ["k"], "d", "ret_d", "mkt").select("k", "t", R("idio_vol").alias("idio_vol"))


@query("w6_w7_carry_to_months", f"""
 WITH f AS (SELECT k, last_day(d) AS t, arg_max(CASE WHEN n >= 30 THEN illiq END, d) AS illiq FROM (
   SELECT k, d, avg(abs(ret_d) / day_value * 1e9) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS illiq,
    count(*) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM v_dret) GROUP BY 1, 2),
  m AS (SELECT DISTINCT t FROM v_pm), g AS (SELECT a.k, m.t FROM m JOIN (SELECT k, min(t) AS t0 FROM f GROUP BY k) a ON m.t >= a.t0)
 SELECT k, t, {r6('illiq', 3)} AS illiq FROM (SELECT g.k, g.t, last_value(f.illiq IGNORE NULLS) OVER (PARTITION BY g.k ORDER BY g.t
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS illiq FROM g LEFT JOIN f ON g.k = f.k AND g.t = f.t)""")
def w67(spark, sf):
    d = cal.pct_change(b.px_daily(spark, sf), ["k"], "d", "adj_close", {"ret_d": 1})
    f = sinks.settle(win.illiquidity(d, ["k"], "d", "ret_d", "day_value"))
    months = b.price_month(spark, sf).select("t").distinct()
    return win.carry_to_months(f, months, ["k"], ["illiq"]).select("k", "t", R("illiq", 3).alias("illiq"))


@query("w8_market_mean", f"SELECT k, d, {r6('ret_d')} AS ret_d, {r6('mkt')} AS mkt FROM v_mkt")
def w8(spark, sf):
    d = cal.pct_change(b.px_daily(spark, sf), ["k"], "d", "adj_close", {"ret_d": 1})
    return win.market_mean(sinks.settle(d.select("k", "d", "ret_d")), "d", "ret_d", "mkt").select("k", "d", R("ret_d").alias("ret_d"), R("mkt").alias("mkt"))


@query("w9_first_rank_cut", """
 SELECT k, t, rk <= bround AS fired, rk FROM (SELECT k, t, row_number() OVER (PARTITION BY t ORDER BY p_r DESC, k) AS rk,
   round_even(0.2 * count(*) OVER (PARTITION BY t), 0) AS bround FROM v_ev)""")
def w9(spark, sf):
    e = sinks.settle(b.evaluated(spark, sf).select("k", "t", "p_r"))
    return ranking.rank_in_group(e, ["t"], "p_r", "k", totals={"n": F.lit(1).cast("bigint")}).select(
        "k", "t", "rk", (F.col("rk") <= F.bround(0.2 * F.col("n"))).alias("fired"))


@query("w10_half_and_median_split", """
 WITH r AS (SELECT k, sum(fwd_ret) AS s, min(p_h) AS p FROM v_ev GROUP BY k)
 SELECT k, CASE WHEN row_number() OVER (ORDER BY p, k) <= (SELECT count(*) // 2 FROM r) THEN 'low' ELSE 'high' END AS half,
   CASE WHEN p > (SELECT quantile_cont(p, 0.5) FROM r) THEN 'high' ELSE 'low' END AS side FROM r""")
def w10(spark, sf):
    r = sinks.settle(b.evaluated(spark, sf).groupBy("k").agg(F.min("p_h").alias("p")))
    return win.median_split(win.half_split(r, "p", "k"), "p").select("k", "half", "side")


@query("w11_quantile_bucket_means", f"""
 WITH q AS (SELECT quantile_cont(p_r, 1.0/3) AS e1, quantile_cont(p_r, 2.0/3) AS e2 FROM v_ev)
 SELECT CASE WHEN p_r > e2 THEN 3 WHEN p_r > e1 THEN 2 ELSE 1 END AS bucket, count(*) AS n, {r6('avg(fwd_ret)')} AS mean_ret
 FROM v_ev, q GROUP BY 1""")
def w11(spark, sf):
    e = win.quantile_bucket(sinks.settle(b.evaluated(spark, sf).select("p_r", "fwd_ret")), "p_r", 3)
    return e.groupBy("bucket").agg(F.count("*").alias("n"), R(F.avg("fwd_ret")).alias("mean_ret"))
