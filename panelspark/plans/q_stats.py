"""Aggregate statistics (A*, M9)."""

from pyspark.sql import functions as F

from ..functions.columns import CLASSES, band_label, r6 as R
from ..operators import calendar as cal, ranking, stats
from ..sources import bind as b, sinks
from .q_core import agent_vectors
from .registry import cte, label_sql, query, r6


def ev(spark, sf, *cols):
    """The joined evaluation rows, computed once for plans that read them more than once."""
    return sinks.settle(b.evaluated(spark, sf).select("k", "t", *cols))


@query("a1_group_aggregates", f"""
 SELECT d.sector, count(*) AS n, count(DISTINCT p.k) AS n_k, {r6('sum(volume)')} AS vol, {r6('avg(close)')} AS mean_close, {r6('min(close)')} AS lo,
  {r6('max(close)')} AS hi, {r6('quantile_cont(close, 0.5)')} AS median_close, max(t) AS last_t
 FROM v_pm p JOIN v_dim d ON p.k = d.k GROUP BY 1""")
def a1(spark, sf):
    p = sinks.settle(b.price_month(spark, sf).join(b.dim(spark, sf).select("k", "sector"), "k"))
    g = p.groupBy("sector").agg(
        F.count("*").alias("n"), F.countDistinct("k").alias("n_k"), R(F.sum("volume")).alias("vol"), R(F.avg("close")).alias("mean_close"),
        R(F.min("close")).alias("lo"), R(F.max("close")).alias("hi"), F.max("t").alias("last_t"))
    med = ranking.exact_quantiles(p, ["sector"], "close", {"m": 0.5}).select("sector", R("m").alias("median_close"))
    return g.join(med, "sector")


@query("a2_conditional_rates", f"""
 SELECT sector, t, count(*) AS n_obs, count_if(pred = 'reduce') AS n_fire, {r6('count_if(pred = ' + "'reduce'" + ') / count(*)')} AS rate_fire,
  count_if(label = 'reduce') AS n_event, {r6('count_if(label = ' + "'reduce'" + ') / count(*)')} AS rate_event FROM v_ev GROUP BY 1, 2""")
def a2(spark, sf):
    out = stats.conditional_rates(b.evaluated(spark, sf, sector=True), ["sector", "t"], {"fire": F.col("pred") == "reduce", "event": F.col("label") == "reduce"})
    return out.withColumns({c: R(c) for c in ("rate_fire", "rate_event")})


@query("a3_class_distribution", f"""
 WITH x AS (SELECT unnest(['increase', 'hold', 'reduce']) AS label), s AS (SELECT DISTINCT sector FROM v_ev), n AS (SELECT sector, count(*) AS tot FROM v_ev GROUP BY 1)
 SELECT s.sector, x.label, coalesce(c.n, 0) AS n, {r6('coalesce(c.n, 0) / n.tot')} AS share FROM x CROSS JOIN s JOIN n ON s.sector = n.sector
  LEFT JOIN (SELECT sector, label, count(*) AS n FROM v_ev GROUP BY 1, 2) c ON c.sector = s.sector AND c.label = x.label""")
def a3(spark, sf):
    return stats.class_distribution(b.evaluated(spark, sf, sector=True), ["sector"], "label").withColumn("share", R("share"))


_D = ("ret_1m", "ret_3m", "ret_12m", "fwd_ret")


@query("a4_describe", " UNION ALL ".join(f"""
 SELECT '{x}' AS feature, count({x}) AS n, {r6(f'avg({x})')} AS mean, {r6(f'stddev_samp({x})')} AS sd, {r6(f'min({x})')} AS min, {r6(f'quantile_cont({x}, 0.5)')} AS median,
  {r6(f'max({x})')} AS max, (SELECT {r6('avg(s)')} FROM (SELECT stddev_pop({x}) AS s FROM v_ret GROUP BY t)) AS xs_sd FROM v_ret""" for x in _D))
def a4(spark, sf):
    out = stats.describe(sinks.settle(b.returns(spark, sf).select("t", *_D)), _D, "t")
    return out.select("feature", "n", *[R(c).alias(c) for c in ("mean", "sd", "min", "median", "max", "xs_sd")])


@query("a5_quantile_summary", f"""
 SELECT coalesce(label, 'all') AS "group", count(p_r) AS n, {r6('avg(p_r)')} AS mean, {r6('min(p_r)')} AS min, {r6('max(p_r)')} AS max,
  {r6('quantile_cont(p_r, 0.25)')} AS q25, {r6('quantile_cont(p_r, 0.5)')} AS median, {r6('quantile_cont(p_r, 0.75)')} AS q75
 FROM v_ev GROUP BY GROUPING SETS ((label), ())""")
def a5(spark, sf):
    out = stats.quantile_summary(ev(spark, sf, "label", "p_r"), ["label"], "p_r")
    return out.select("group", "n", *[R(c).alias(c) for c in ("mean", "min", "max", "q25", "median", "q75")])


cte("v_rank", """
 SELECT p_r, q_r, rank() OVER (ORDER BY p_r) + (count(*) OVER (PARTITION BY p_r) - 1) / 2.0 AS rp, rank() OVER (ORDER BY q_r) + (count(*) OVER (PARTITION BY q_r) - 1) / 2.0 AS rq FROM v_ev""")


@query("a6_correlations", f"SELECT count(*) AS n, {r6('corr(p_r, q_r)')} AS pearson, {r6('corr(rp, rq)')} AS spearman FROM v_rank")
def a6(spark, sf):
    e = ev(spark, sf, "p_r", "q_r")
    pear = e.agg(F.corr("p_r", "q_r").alias("p")).scalar()
    return stats.spearman(e, "p_r", "q_r").select("n", R(pear).alias("pearson"), R("rho").alias("spearman"))


@query("a7_regression_per_group", f"""
 WITH m AS (SELECT k, fwd_ret AS y, avg(fwd_ret) OVER (PARTITION BY t) AS x FROM v_ret)
 SELECT k, count(*) AS n, {r6('regr_slope(y, x)')} AS slope, {r6('regr_intercept(y, x)')} AS intercept, {r6('regr_r2(y, x)')} AS r2,
  {r6('sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 1))')} AS resid_sd FROM m GROUP BY k HAVING count(*) >= 24""")
def a7(spark, sf):
    from ..operators import windows as win

    r = win.market_mean(sinks.settle(b.returns(spark, sf).select("k", "t", "fwd_ret")), "t", "fwd_ret", "mkt")
    out = stats.simple_regression(r, ["k"], "fwd_ret", "mkt", 24)
    return out.select("k", "n", *[R(c).alias(c) for c in ("slope", "intercept", "r2", "resid_sd")])


@query("a8_leave_one_out", f"""
 WITH m AS (SELECT k, t, fwd_ret, (sum(fwd_ret) OVER w - fwd_ret) / (count(*) OVER w - 1) AS loo, count(*) OVER w AS n FROM v_ret WINDOW w AS (PARTITION BY t))
 SELECT k, t, {r6('loo')} AS loo_mean, {r6('fwd_ret - loo')} AS excess FROM m WHERE n >= 5""")
def a8(spark, sf):
    out = stats.leave_one_out(sinks.settle(b.returns(spark, sf).select("k", "t", "fwd_ret")), "t", "fwd_ret", 5)
    return out.select("k", "t", R("loo_mean").alias("loo_mean"), R("excess").alias("excess"))


_WF = ("ret_1m", "ret_3m", "ret_12m")
_EVT = "(fwd_ret < -0.1::DOUBLE)"


@query("a9_welch_t", " UNION ALL ".join(f"""
 SELECT '{x}' AS feature, n1 AS n_event, n0 AS n_other, {r6('m1')} AS mean_event, {r6('m0')} AS mean_other, {r6('(m1 - m0) / sqrt(v1 / n1 + v0 / n0)')} AS t
 FROM (SELECT count({x}) FILTER (WHERE {_EVT}) AS n1, count({x}) FILTER (WHERE NOT {_EVT}) AS n0, avg({x}) FILTER (WHERE {_EVT}) AS m1, avg({x}) FILTER (WHERE NOT {_EVT}) AS m0,
  var_samp({x}) FILTER (WHERE {_EVT}) AS v1, var_samp({x}) FILTER (WHERE NOT {_EVT}) AS v0 FROM v_ret)""" for x in _WF))
def a9(spark, sf):
    out = stats.welch_t(b.returns(spark, sf), _WF, F.col("fwd_ret") < -0.1)
    return out.select("feature", "n_event", "n_other", *[R(c).alias(c) for c in ("mean_event", "mean_other", "t")])


@query("a10_compound_return", f"SELECT k, year(t) AS y, count(*) AS n, {r6('ln(product(1 + ret_1m / 50))')} AS log_growth FROM v_ret WHERE ret_1m IS NOT NULL GROUP BY 1, 2")
def a10(spark, sf):
    r = b.returns(spark, sf).where(F.col("ret_1m").isNotNull()).select("k", F.year("t").alias("y"), (F.col("ret_1m") / 50).alias("r"))
    return stats.compound(r, ["k", "y"], "r").select("k", "y", "n", R(F.log1p("compound")).alias("log_growth"))


@query("a11_feature_variation", " UNION ALL ".join(f"""
 SELECT '{x}' AS feature, {r6('sum(c) / sum(n)')} AS coverage, {r6('avg(s)')} AS xs_sd, coalesce(avg(s) > 1e-9, false) AS has_signal
 FROM (SELECT t, count(*) AS n, count({x}) AS c, stddev_pop({x}) AS s FROM v_ret LEFT JOIN v_rf USING (t) GROUP BY t)""" for x in (*_WF, "s1", "s2")))
def a11(spark, sf):
    p = b.returns(spark, sf).join(b.macro_month(spark, sf).select("t", "s1", "s2"), "t", "left")
    out = stats.feature_variation(p, "t", (*_WF, "s1", "s2"))
    return out.select("feature", R("coverage").alias("coverage"), R("xs_sd").alias("xs_sd"), "has_signal")


@query("a12_missing_rates", " UNION ALL ".join(
    f"""SELECT '{x}' AS "column", {r6(f'count_if({x} IS NULL) / count(*)')} AS missing_rate FROM v_sig""" for x in ("k", "t", "adj_close", "ret_1m", "ret_12m")))
def a12(spark, sf):
    m = cal.pct_change(b.price_month(spark, sf), ["k"], "t", "adj_close", {"ret_1m": 1, "ret_12m": 12})
    return stats.missing_rates(m.select("k", "t", "adj_close", "ret_1m", "ret_12m")).withColumn("missing_rate", R("missing_rate"))


@query("a13_variance_split", f"""
 SELECT {r6('var_pop(m)')} AS between, {r6('avg(v)')} AS within, {r6('var_pop(m) / (var_pop(m) + avg(v))')} AS systematic_share
 FROM (SELECT t, avg(fwd_ret) AS m, var_pop(fwd_ret) AS v FROM v_ret GROUP BY t)""")
def a13(spark, sf):
    out = stats.variance_split(b.returns(spark, sf), "t", "fwd_ret")
    return out.select(*[R(c).alias(c) for c in ("between", "within", "systematic_share")])


def _disp(src: str, event: str) -> str:
    return f"""
 WITH p AS (SELECT t, count(*) AS n, count_if({event}) AS e FROM {src} GROUP BY t), g AS (SELECT sum(e) / sum(n) AS b FROM p)
 SELECT {r6('max(b)')} AS base_rate, {r6('stddev_pop(e / n)')} AS obs_sd, {r6('sqrt(max(b) * (1 - max(b)) / avg(n))')} AS null_sd,
  {r6('stddev_pop(e / n) / sqrt(max(b) * (1 - max(b)) / avg(n))')} AS dispersion_ratio, {r6('sum(CASE WHEN e / n > 2 * b THEN e ELSE 0 END) / sum(e)')} AS share_in_high,
  count_if(e / n > 2 * b) AS n_high, count(*) AS n_periods FROM p, g"""


_DC = ("base_rate", "obs_sd", "null_sd", "dispersion_ratio", "share_in_high")


@query("a14_event_dispersion", _disp("v_ret", "fwd_ret < -0.5"))
def a14(spark, sf):
    out = stats.event_dispersion(b.returns(spark, sf), "t", F.col("fwd_ret") < -0.5)
    return out.select(*[R(c).alias(c) for c in _DC], "n_high", "n_periods")


@query("a15_period_effect_r2", f"""
 SELECT count(*) AS n, {r6('sum((m - b) * (m - b)) / sum((y - b) * (y - b))')} AS r2
 FROM (SELECT y, avg(y) OVER (PARTITION BY t) AS m, avg(y) OVER () AS b FROM (SELECT t, CASE WHEN label = 'reduce' THEN 1.0 ELSE 0.0 END AS y FROM v_ev))""")
def a15(spark, sf):
    return stats.period_effect_r2(b.evaluated(spark, sf), "t", F.col("label") == "reduce").select("n", R("r2").alias("r2"))


PRICES = {"list": (0.27, 1.1), "reduced": (0.14, 0.28)}


@query("a16_ledger_rollup", " UNION ALL ".join(f"""
 SELECT '{n}' AS scenario, count(*) AS n_decisions, count(l.seq) AS n_entries, count_if(l.seq IS NULL) AS n_missing, count_if(l.pt <> d.pt OR l.ct <> d.ct) AS n_mismatch,
  CAST(sum(l.pt) AS BIGINT) AS prompt_tokens, CAST(sum(l.ct) AS BIGINT) AS completion_tokens, {r6(f'(sum(l.pt) * {p} + sum(l.ct) * {q}) / 1e6')} AS cost_usd
 FROM (SELECT k, t, CAST(k * 10 + max(seq) + (CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pt, CAST(max(seq) * 7 AS BIGINT) AS ct FROM v_log GROUP BY k, t) d
 LEFT JOIN (SELECT k, t, max(seq) AS seq, max(k * 10 + seq) AS pt, max(seq * 7) AS ct FROM v_log WHERE k % 20 <> 3 GROUP BY k, t) l ON d.k = l.k AND d.t = l.t""" for n, (p, q) in PRICES.items()))
def a16(spark, sf):
    log = b.log_rows(spark, sf).select("k", "t", "seq", (F.col("k") * 10 + F.col("seq")).alias("prompt_tokens"), (F.col("seq") * 7).cast("bigint").alias("completion_tokens"))
    dec = log.groupBy("k", "t").agg(F.max("seq").alias("s")).select(
        "k", "t", (F.col("k") * 10 + F.col("s") + F.when(F.col("k") % 9 == 0, 1).otherwise(0)).alias("prompt_tokens"), (F.col("s") * 7).alias("completion_tokens"))
    return stats.ledger_rollup(log.where(F.col("k") % 20 != 3), dec, ["k", "t"], "seq", PRICES).withColumn("cost_usd", R("cost_usd"))


_NW = """ WITH s AS (SELECT k, t, fwd_ret - avg(fwd_ret) OVER (PARTITION BY k) AS u, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM v_ret),
  g AS (SELECT k, count(*) AS n, avg(fwd_ret) AS mean, stddev_samp(fwd_ret) AS sd, CAST(floor(4 * pow(count(*) / 100.0, 2.0 / 9.0)) AS INTEGER) AS lags FROM v_ret GROUP BY k),
  c AS (SELECT a.k, sum(CASE WHEN z.i = a.i THEN 1.0 ELSE 2.0 * (1 - (z.i - a.i) / (g.lags + 1.0)) END * a.u * z.u) AS q
    FROM s a JOIN g ON a.k = g.k JOIN s z ON a.k = z.k AND z.i BETWEEN a.i AND a.i + g.lags GROUP BY a.k) """


@query("m9_newey_west", f"""{_NW} SELECT g.k, g.n, g.lags, {r6('g.mean')} AS mean, {r6('sqrt(c.q / g.n / (g.n - 1))')} AS nw_se,
  {r6('g.mean / sqrt(c.q / g.n / (g.n - 1))')} AS nw_t, {r6('g.mean / (g.sd / sqrt(g.n))')} AS plain_t FROM g JOIN c ON g.k = c.k""".strip())
def m9(spark, sf):
    out = stats.newey_west(sinks.settle(b.returns(spark, sf).select("k", "t", "fwd_ret")), ["k"], "t", "fwd_ret")
    return out.select("k", "n", "lags", *[R(c).alias(c) for c in ("mean", "nw_se", "nw_t", "plain_t")])


@query("m11_market_adjusted_labels", f"""
 WITH m AS (SELECT k, t, fwd_ret - (sum(fwd_ret) OVER w - fwd_ret) / (count(*) OVER w - 1) AS ex, count(*) OVER w AS n FROM v_ret WINDOW w AS (PARTITION BY t)),
  l AS (SELECT t, {label_sql('ex', '0.1::DOUBLE')} AS label FROM m WHERE n >= 5)
 SELECT t, count(*) AS n_obs, {', '.join(f"count_if(label = '{x}') AS n_{x}" for x in CLASSES)} FROM l GROUP BY t""")
def m11(spark, sf):
    x = stats.leave_one_out(b.returns(spark, sf).select("k", "t", "fwd_ret"), "t", "fwd_ret", 5).withColumn("label", band_label("excess", 0.1))
    return x.groupBy("t").agg(F.count("*").alias("n_obs"), *[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in CLASSES])


@query("m11_market_adjusted_dispersion", f"""
 WITH m AS (SELECT t, fwd_ret - (sum(fwd_ret) OVER w - fwd_ret) / (count(*) OVER w - 1) AS ex FROM v_ret WINDOW w AS (PARTITION BY t)), {_disp('m', 'ex < -0.5').strip()[5:]}""")
def m11d(spark, sf):
    x = stats.leave_one_out(sinks.settle(b.returns(spark, sf).select("k", "t", "fwd_ret")), "t", "fwd_ret")
    out = stats.event_dispersion(x, "t", F.col("excess") < -0.5)
    return out.select(*[R(c).alias(c) for c in _DC], "n_high", "n_periods")
