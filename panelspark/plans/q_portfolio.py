"""Portfolio queries (B*). Returns are scaled down, so that compounded values stay readable."""

import re

from pyspark.sql import functions as F

from ..functions.columns import band_label, r6 as R
from ..operators import joins, portfolio as pf, ranking, stats
from ..sources import bind as b, sinks
from .q_core import GRID
from .registry import CTE, cte, label_sql, query, r6

STRATEGIES = ("hard_increase", "not_reduce", "positive", "top5", "top10", "top30pct", "top30pct_wide")
COST = 0.001

cte("v_pf", "SELECT k, t, sector, label, pred, p_i - p_r AS score, q_r, fwd_ret / 20.0::DOUBLE AS r FROM v_ev")
cte("v_rk", "SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, k) AS rk, count(*) OVER (PARTITION BY t) AS n FROM v_pf")
_RULE_SQL = {
    "hard_increase": "pred = 'increase'", "not_reduce": "pred <> 'reduce'", "positive": "score > 0", "top5": "rk <= 5", "top10": "rk <= 10",
    "top30pct": "rk <= ceil(0.3::DOUBLE * n)", "top30pct_wide": "rk <= least(n, greatest(10, ceil(0.3::DOUBLE * n)))",
}
cte("v_sel", " UNION ALL ".join(f"SELECT '{s}' AS strategy, k, t, sector, r FROM v_rk WHERE {c}" for s, c in _RULE_SQL.items()))
cte("v_per", f"""
 SELECT g.strategy, g.t, coalesce(p.n, 0) AS n_holdings, coalesce(p.r, 0.0::DOUBLE) AS gross_return
 FROM (SELECT s.strategy, x.t FROM (SELECT DISTINCT t FROM v_pf) x, (SELECT unnest({list(STRATEGIES)}) AS strategy) s) g
 LEFT JOIN (SELECT strategy, t, count(*) AS n, avg(coalesce(r, 0.0)) AS r FROM v_sel GROUP BY 1, 2) p ON p.strategy = g.strategy AND p.t = g.t""")


def _turn(drift: bool) -> str:
    old = "h.w * (1 + h.r) / (1 + p.gross_return)" if drift else "h.w"
    alive = "AND p.gross_return > -1" if drift else ""
    return f"""
 SELECT s.strategy, s.t, s.n_holdings, s.gross_return, coalesce(x.turnover, 0.0) AS turnover FROM v_per s LEFT JOIN (
  SELECT coalesce(a.strategy, z.strategy) AS strategy, coalesce(a.t, z.t) AS t, 0.5 * sum(abs(coalesce(a.w, 0) - coalesce(z.w, 0))) AS turnover
  FROM (SELECT strategy, k, t, 1.0::DOUBLE / count(*) OVER (PARTITION BY strategy, t) AS w FROM v_sel) a FULL JOIN (
   SELECT h.strategy, h.k, nx.nt AS t, {old} AS w FROM (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY strategy, t) AS w FROM v_sel) h
   JOIN v_per p ON p.strategy = h.strategy AND p.t = h.t {alive}
   JOIN (SELECT t, lead(t) OVER (ORDER BY t) AS nt FROM (SELECT DISTINCT t FROM v_pf)) nx ON nx.t = h.t WHERE nx.nt IS NOT NULL) z
  ON a.strategy = z.strategy AND a.k = z.k AND a.t = z.t GROUP BY 1, 2) x ON x.strategy = s.strategy AND x.t = s.t"""


cte("v_turn", _turn(True))
cte("v_turn0", _turn(False))


def _values(src: str, where: str = "TRUE") -> str:
    return f"""
 SELECT *, nav_gross / max(nav_gross) OVER w - 1 AS drawdown_gross, nav_net / max(nav_net) OVER w - 1 AS drawdown_net FROM (
  SELECT *, product(1 + gross_return) OVER w AS nav_gross, product(1 + net_return) OVER w AS nav_net FROM (
   SELECT x.*, gross_return - {COST} * turnover AS net_return, gross_return - f.monthly_rf AS excess_gross,
     gross_return - {COST} * turnover - f.monthly_rf AS excess_net
   FROM {src} x LEFT JOIN v_rf f ON x.t = f.t WHERE {where})
  WINDOW w AS (PARTITION BY strategy ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 WINDOW w AS (PARTITION BY strategy ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


cte("v_val", _values("v_turn"))


def predictions(spark, sf):
    return sinks.settle(b.evaluated(spark, sf, sector=True).select(
        "k", "t", "sector", "label", "pred", "q_r", (F.col("p_i") - F.col("p_r")).alias("score"), (F.col("fwd_ret") / 20).alias("r")))


def holdings(pred):
    rk = ranking.rank_in_group(pred, ["t"], "score", "k", totals={"n": F.lit(1).cast("bigint")})
    cut = F.ceil(0.3 * F.col("n"))
    rules = {
        "hard_increase": F.col("pred") == "increase", "not_reduce": F.col("pred") != "reduce", "positive": F.col("score") > 0,
        "top5": F.col("rk") <= 5, "top10": F.col("rk") <= 10, "top30pct": F.col("rk") <= cut,
        "top30pct_wide": F.col("rk") <= F.least("n", F.greatest(F.lit(10), cut)),
    }
    return pf.select_holdings(rk, rules, ["k", "t", "sector", "r"])


def series(spark, sf, drift=True):
    pred = predictions(spark, sf)
    h = sinks.settle(holdings(pred))
    s = pf.period_series(h, pred, STRATEGIES, "t", "r")
    return h, pf.turnover(h, s, "t", "k", "r", drift).join(b.macro_month(spark, sf).select("t", "monthly_rf"), "t", "left")


@query("b1_strategy_weights", f"SELECT strategy, k, t, {r6('1.0::DOUBLE / count(*) OVER (PARTITION BY strategy, t)')} AS weight FROM v_sel")
def b1(spark, sf):
    h = sinks.settle(holdings(predictions(spark, sf)))
    n = h.groupBy("strategy", "t").agg(F.count("*").alias("n"))
    return h.join(n, ["strategy", "t"]).select("strategy", "k", "t", R(1.0 / F.col("n")).alias("weight"))


@query("b2_period_returns", f"SELECT strategy, t, n_holdings, {r6('gross_return')} AS gross_return FROM v_per")
def b2(spark, sf):
    pred = predictions(spark, sf)
    return pf.period_series(holdings(pred), pred, STRATEGIES, "t", "r").withColumn("gross_return", R("gross_return"))


@query("b3_drifted_turnover", f"SELECT strategy, t, {r6('turnover')} AS turnover FROM v_turn")
def b3(spark, sf):
    return series(spark, sf)[1].select("strategy", "t", R("turnover").alias("turnover"))


@query("b4_target_turnover", f"SELECT strategy, t, {r6('turnover')} AS turnover FROM v_turn0")
def b4(spark, sf):
    return series(spark, sf, False)[1].select("strategy", "t", R("turnover").alias("turnover"))


@query("b5_average_turnover", f"""
 SELECT strategy, {r6('avg(turnover)')} AS avg_turnover FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY t) AS i FROM v_turn0)
 WHERE i > 1 AND n_holdings > 0 GROUP BY 1""")
def b5(spark, sf):
    return pf.average_turnover(series(spark, sf, False)[1], "t").withColumn("avg_turnover", R("avg_turnover"))


_V = ("net_return", "excess_gross", "excess_net", "nav_gross", "nav_net", "drawdown_gross", "drawdown_net")


@query("b6_value_series", f"SELECT strategy, t, {', '.join(f'{r6(c)} AS {c}' for c in _V)} FROM v_val")
def b6(spark, sf):
    return pf.value_series(series(spark, sf)[1], "t", COST).select("strategy", "t", *[R(c).alias(c) for c in _V])


_PERF = f"""
 SELECT strategy, n_periods, {r6('ng')} AS final_nav_gross, {r6('nn')} AS final_nav_net, {r6('pow(ng, 12.0 / n_periods) - 1')} AS ann_return_gross,
  {r6('pow(nn, 12.0 / n_periods) - 1')} AS ann_return_net, {r6('eg')} AS ann_excess_gross, {r6('en')} AS ann_excess_net, {r6('vg')} AS ann_vol_gross, {r6('vn')} AS ann_vol_net,
  {r6('eg / vg')} AS sharpe_gross, {r6('en / vn')} AS sharpe_net, {r6('dg')} AS max_drawdown_gross, {r6('dn')} AS max_drawdown_net, {r6('ah')} AS avg_holdings, {r6('ato')} AS avg_turnover
 FROM (SELECT strategy, count(*) AS n_periods, product(1 + gross_return) AS ng, product(1 + net_return) AS nn, avg(excess_gross) * 12 AS eg, avg(excess_net) * 12 AS en,
  stddev_samp(gross_return) * sqrt(12) AS vg, stddev_samp(net_return) * sqrt(12) AS vn, min(drawdown_gross) AS dg, min(drawdown_net) AS dn, avg(n_holdings) AS ah, avg(turnover) AS ato
  FROM v_val GROUP BY strategy)"""
_PC = ("final_nav_gross", "final_nav_net", "ann_return_gross", "ann_return_net", "ann_excess_gross", "ann_excess_net", "ann_vol_gross", "ann_vol_net",
       "sharpe_gross", "sharpe_net", "max_drawdown_gross", "max_drawdown_net", "avg_holdings", "avg_turnover")


@query("b7_performance", _PERF)
def b7(spark, sf):
    return pf.performance(pf.value_series(series(spark, sf)[1], "t", COST)).select("strategy", "n_periods", *[R(c).alias(c) for c in _PC])


@query("b8_rebased_series", f"""
 SELECT strategy, t, {r6('nav_gross')} AS nav_gross, {r6('drawdown_net')} AS drawdown_net FROM (
 {_values('v_turn', "x.t BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")})""")
def b8(spark, sf):
    return pf.rebase(series(spark, sf)[1], "t", "1997-01-01", "1998-12-31", COST).select(
        "strategy", "t", R("nav_gross").alias("nav_gross"), R("drawdown_net").alias("drawdown_net"))


@query("b9_buy_and_hold", f"""
 SELECT 'hold ' || k AS strategy, t, {r6('g')} AS gross_return, 1 AS n_holdings, 0.0::DOUBLE AS turnover FROM (
  SELECT k, t, lead(adj_close) OVER (PARTITION BY k ORDER BY t) / adj_close - 1 AS g FROM v_pm WHERE adj_close IS NOT NULL) WHERE g IS NOT NULL""")
def b9(spark, sf):
    return pf.buy_and_hold(b.price_month(spark, sf), "k", "t", "adj_close").withColumn("gross_return", R("gross_return"))


@query("b10_perfect_label_portfolio", f"""
 WITH p AS (SELECT t, count_if(label = 'increase') AS n, coalesce(avg(r) FILTER (WHERE label = 'increase'), 0.0) AS r FROM v_pf GROUP BY t),
  v AS (SELECT *, product(1 + r) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nav FROM p),
  d AS (SELECT *, nav / max(nav) OVER (ORDER BY t) - 1 AS dd FROM v)
 SELECT 'perfect' AS strategy, count(*) AS n_periods, {r6('min(r)')} AS min_return, {r6('avg(r)')} AS mean_return, {r6('max(r)')} AS max_return,
  count_if(r < 0) AS n_negative, count_if(abs(r) <= 1e-8) AS n_zero, {r6('min(dd)')} AS max_drawdown, {r6('avg(n)')} AS avg_holdings FROM d""")
def b10(spark, sf):
    pred = predictions(spark, sf)
    h = pf.select_holdings(pred, {"perfect": F.col("label") == "increase"}, ["k", "t", "r"])
    s = pf.period_series(h, pred, ["perfect"], "t", "r").withColumns({"turnover": F.lit(0.0), "monthly_rf": F.lit(0.0)})
    out = pf.oracle_summary(pf.value_series(s, "t", 0.0))
    return out.withColumns({c: R(c) for c in ("min_return", "mean_return", "max_return", "max_drawdown", "avg_holdings")})


@query("b11_sector_composition", f"""
 WITH s AS (SELECT DISTINCT sector FROM v_dim), w AS (SELECT strategy, t, sector, count(*) / max(n) AS w FROM (SELECT *, count(*) OVER (PARTITION BY strategy, t) AS n FROM v_sel) GROUP BY 1, 2, 3)
 SELECT p.strategy, s.sector, {r6('avg(coalesce(w, 0))')} AS avg_weight, {r6('max(coalesce(w, 0))')} AS max_weight, {r6('min(coalesce(w, 0))')} AS min_weight
 FROM v_per p CROSS JOIN s LEFT JOIN w ON w.strategy = p.strategy AND w.t = p.t AND w.sector = s.sector GROUP BY 1, 2""")
def b11(spark, sf):
    pred = predictions(spark, sf)
    h = sinks.settle(holdings(pred))
    s = pf.period_series(h, pred, STRATEGIES, "t", "r")
    sp = joins.spine(pred, "t", b.dim(spark, sf), "sector", STRATEGIES)
    out = pf.sector_weights(h, s, sp, "t", "sector")
    return out.select("strategy", "sector", *[R(c).alias(c) for c in ("avg_weight", "max_weight", "min_weight")])


SCREENS = ("all", "avoid_flagged", "avoid_scored", "avoid_true")
cte("v_held", """
 SELECT x.strategy, k, t, r FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY q_r DESC, k) AS rq, count_if(pred = 'reduce') OVER (PARTITION BY t) AS b FROM v_pf) p,
  (SELECT unnest(['all', 'avoid_flagged', 'avoid_scored', 'avoid_true']) AS strategy) x
 WHERE x.strategy = 'all' OR (x.strategy = 'avoid_flagged' AND pred <> 'reduce') OR (x.strategy = 'avoid_scored' AND rq > b) OR (x.strategy = 'avoid_true' AND label <> 'reduce')""")
cte("v_hper", """
 SELECT h.strategy, h.t, h.n, h.g, h.g - f.monthly_rf AS e FROM (SELECT strategy, t, count(*) AS n, avg(r) AS g FROM v_held GROUP BY 1, 2) h LEFT JOIN v_rf f ON f.t = h.t""")
cte("v_hto", """
 SELECT strategy, avg(x) AS avg_turnover FROM (
  SELECT coalesce(a.strategy, z.strategy) AS strategy, coalesce(a.t, z.t) AS t, 0.5 * sum(abs(coalesce(a.w, 0) - coalesce(z.w, 0))) AS x, count(a.k) AS n, bool_or(z.k IS NOT NULL) AS later
  FROM (SELECT strategy, k, t, 1.0::DOUBLE / count(*) OVER (PARTITION BY strategy, t) AS w FROM v_held) a FULL JOIN (
   SELECT strategy, k, nt AS t, 1.0::DOUBLE / count(*) OVER (PARTITION BY strategy, h.t) AS w FROM v_held h
   JOIN (SELECT t, lead(t) OVER (ORDER BY t) AS nt FROM (SELECT DISTINCT t FROM v_pf)) nx ON nx.t = h.t WHERE nt IS NOT NULL) z
  ON a.strategy = z.strategy AND a.k = z.k AND a.t = z.t GROUP BY 1, 2) WHERE n > 0 AND t > (SELECT min(t) FROM v_pf) GROUP BY 1""")


def screens(spark, sf):
    pred = predictions(spark, sf)
    rk = ranking.rank_in_group(pred, ["t"], "q_r", "k", totals={"b": (F.col("pred") == "reduce").cast("bigint")})
    return pred, sinks.settle(pf.select_holdings(rk, {
        "all": F.lit(True), "avoid_flagged": F.col("pred") != "reduce", "avoid_scored": F.col("rk") > F.col("b"), "avoid_true": F.col("label") != "reduce",
    }, ["k", "t", "r"]))


def screen_series(spark, sf):
    pred, h = screens(spark, sf)
    s = pf.turnover(h, pf.period_series(h, pred, SCREENS, "t", "r"), "t", "k", "r", drift=False)
    return s.join(b.macro_month(spark, sf).select("t", "monthly_rf"), "t", "left")


_SV = ("ann_return", "ann_excess", "ann_vol", "max_drawdown", "avg_turnover", "sharpe", "sharpe_se", "sharpe_net", "cer")


@query("b12_screen_value", f"""
 WITH v AS (SELECT *, nav / max(nav) OVER (PARTITION BY strategy ORDER BY t) - 1 AS dd FROM (SELECT *, product(1 + g) OVER (PARTITION BY strategy ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nav FROM v_hper)),
  a AS (SELECT strategy, count(*) AS n, avg(g) * 12 AS ar, avg(e) * 12 AS ae, stddev_samp(e) * sqrt(12) AS av, min(dd) AS dd FROM v GROUP BY 1)
 SELECT a.strategy, n AS n_periods, {r6('ar')} AS ann_return, {r6('ae')} AS ann_excess, {r6('av')} AS ann_vol, {r6('dd')} AS max_drawdown, {r6('o.avg_turnover')} AS avg_turnover,
  {r6('ae / av')} AS sharpe, {r6('sqrt((1 + (ae / av) * (ae / av) / 2) / n)')} AS sharpe_se, {r6('(ae - 2 * o.avg_turnover * 25 / 1e4 * 12) / av')} AS sharpe_net, {r6('ae - 1.5 * av * av')} AS cer
 FROM a JOIN v_hto o ON a.strategy = o.strategy""")
def b12(spark, sf):
    s = sinks.settle(screen_series(spark, sf))
    out = pf.screen_value(pf.value_series(s.where(F.col("n_holdings") > 0), "t", 0.0), pf.average_turnover(s, "t"), 25.0, 3.0)
    return out.select("strategy", "n_periods", *[R(c).alias(c) for c in _SV])


@query("b13_hurdles", f"""
 WITH p AS ({_PERF}), h AS (SELECT max(sharpe_net) FILTER (WHERE strategy = 'top5') AS h5, max(sharpe_net) FILTER (WHERE strategy = 'top10') AS h10 FROM p)
 SELECT strategy, sharpe_net, h5 AS hurdle_top5, h10 AS hurdle_top10, sharpe_net > h5 AS beats_top5, sharpe_net > h10 AS beats_top10, sharpe_net > h5 AND sharpe_net > h10 AS beats_all FROM p, h""")
def b13(spark, sf):
    p = pf.performance(pf.value_series(series(spark, sf)[1], "t", COST)).withColumn("sharpe_net", R("sharpe_net"))
    return pf.hurdles(p, "sharpe_net", ["top5", "top10"], ["top5", "top10"])


cte("v_liq", """
 SELECT *, tv >= 90000 AS liquid FROM (SELECT k, t, av, n, avg(av) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS tv
  FROM (SELECT k, last_day(d) AS t, avg(close * volume) AS av, count(*) AS n FROM v_px GROUP BY 1, 2))""")


@query("b14_liquidity_by_entity", f"""
 SELECT k, count(DISTINCT t) AS months, {r6('avg(CAST(liquid AS INTEGER))')} AS share_liquid, {r6('quantile_cont(tv, 0.5)', 3)} AS median_trailing, avg(CAST(liquid AS INTEGER)) >= 1 AS passes
 FROM v_liq GROUP BY k""")
def b14(spark, sf):
    m = pf.liquidity(b.px_daily(spark, sf), "k", "d", "close", "volume", 90000.0)
    # one row per month of an entity: the built-in median is bounded here
    return m.groupBy("k").agg(
        F.countDistinct("t").alias("months"), R(F.avg(F.col("is_liquid").cast("double"))).alias("share_liquid"),
        R(F.percentile("trailing_value", 0.5), 3).alias("median_trailing"), (F.avg(F.col("is_liquid").cast("double")) >= 1).alias("passes"))


@query("b14_liquidity_by_month", f"SELECT t, count(DISTINCT k) AS n_k, count_if(liquid) AS n_liquid, {r6('count_if(liquid) / count(DISTINCT k)')} AS share FROM v_liq GROUP BY t")
def b14m(spark, sf):
    m = pf.liquidity(b.px_daily(spark, sf), "k", "d", "close", "volume", 90000.0)
    return m.groupBy("t").agg(F.countDistinct("k").alias("n_k"), F.count_if("is_liquid").alias("n_liquid")).withColumn(
        "share", R(F.col("n_liquid") / F.col("n_k")))


@query("b14_liquidity_summary", f"""
 SELECT count(*) AS n_k, count_if(s >= 1) AS n_pass, {r6('quantile_cont(s, 0.5)')} AS median_share, {r6('min(s)')} AS min_share
 FROM (SELECT k, avg(CAST(liquid AS INTEGER)) AS s FROM v_liq GROUP BY k)""")
def b14s(spark, sf):
    m = pf.liquidity(b.px_daily(spark, sf), "k", "d", "close", "volume", 90000.0)
    g = sinks.settle(m.groupBy("k").agg(F.avg(F.col("is_liquid").cast("double")).alias("s")))
    med = ranking.exact_quantiles(g, [], "s", {"m": 0.5}).scalar()
    one = g.agg(F.count("*").alias("n_k"), F.count_if(F.col("s") >= 1).alias("n_pass"), R(F.min("s")).alias("min_share"))
    return one.withColumn("median_share", R(med))


# ---------------------------------------------------------------- perfect-label portfolios of the label grid
def _banded(text: str) -> str:
    """The SQL of the portfolios with the band portfolios' own views."""
    for name in ("v_pf", "v_sel", "v_per", "v_turn", "v_val"):
        text = re.sub(rf"\b{name}0?\b", name.replace("v_", "v_band_"), text)
    return text


def _band(g: float) -> str:
    return f"band {g}"


cte("v_band_pf", "SELECT k, t, fwd_ret, fwd_ret / 20.0::DOUBLE AS r FROM v_ret WHERE fwd_ret IS NOT NULL")
cte("v_band_sel", " UNION ALL ".join(
    f"SELECT '{_band(g)}' AS strategy, k, t, r FROM v_band_pf WHERE {label_sql('fwd_ret', f'{g}::DOUBLE')} = 'increase'" for g in GRID))
cte("v_band_per", _banded(CTE["v_per"]).replace(str(list(STRATEGIES)), str([_band(g) for g in GRID])))
cte("v_band_turn", _banded(_turn(False)))
cte("v_band_val", _values("v_band_turn"))


@query("p8_band_portfolios", f"SELECT * EXCLUDE (final_nav_gross, final_nav_net) FROM ({_banded(_PERF)})")
def p8_portfolios(spark, sf):
    """What a portfolio of all rises would earn under each band of the label: an upper bound for any model of it."""
    r = sinks.settle(b.returns(spark, sf).where(F.col("fwd_ret").isNotNull()).select("k", "t", "fwd_ret", (F.col("fwd_ret") / 20).alias("r")))
    h = sinks.settle(pf.select_holdings(r, {_band(g): band_label("fwd_ret", g) == "increase" for g in GRID}, ["k", "t", "r"]))
    s = pf.turnover(h, pf.period_series(h, r, [_band(g) for g in GRID], "t", "r"), "t", "k", "r", drift=False)
    rf = b.macro_month(spark, sf).select("t", "monthly_rf")
    return pf.performance(pf.value_series(s.join(rf, "t", "left"), "t", COST)).select("strategy", "n_periods", *[R(c).alias(c) for c in _PC[2:]])


# ---------------------------------------------------------------- strategies and held benchmarks over the periods they share
HELD = (1, 2)
cte("v_mix", f"""
 SELECT strategy, t, n_holdings, gross_return, turnover FROM v_turn
 UNION ALL SELECT 'hold ' || k, t, 1, g / 20.0::DOUBLE, 0.0::DOUBLE FROM (
  SELECT k, t, lead(adj_close) OVER (PARTITION BY k ORDER BY t) / adj_close - 1 AS g FROM v_pm WHERE adj_close IS NOT NULL AND k IN {HELD}) WHERE g IS NOT NULL""")
cte("v_mix_common", "SELECT * FROM v_mix WHERE t IN (SELECT t FROM v_mix GROUP BY t HAVING count(DISTINCT strategy) = (SELECT count(DISTINCT strategy) FROM v_mix))")
cte("v_mix_val", _values("v_mix_common"))
_BARS = ", ".join(f"max(sharpe_net) FILTER (WHERE strategy = 'hold {k}') AS hurdle_{k}" for k in HELD)
_BEATS = [f"coalesce(sharpe_net > hurdle_{k}, FALSE)" for k in HELD]


@query("b7_common_period_table", f"""
 WITH p AS ({re.sub("v_val", "v_mix_val", _PERF)}), h AS (SELECT {_BARS} FROM p)
 SELECT p.* EXCLUDE (final_nav_gross, final_nav_net), {', '.join(f'hurdle_{k}' for k in HELD)}, {', '.join(f'{c} AS beats_{k}' for k, c in zip(HELD, _BEATS))}, {' AND '.join(_BEATS)} AS beats_all FROM p, h""")
def b7_common(spark, sf):
    """All strategies and the benchmarks that are bought and held, restarted at 1 on the periods that every one of them has."""
    _, own = series(spark, sf)
    held = pf.buy_and_hold(b.price_month(spark, sf).where(F.col("k").isin(*HELD)), "k", "t", "adj_close")
    held = held.withColumn("gross_return", F.col("gross_return") / 20).join(b.macro_month(spark, sf).select("t", "monthly_rf"), "t", "left")
    both = sinks.settle(own.unionByName(held.select(own.columns)))
    n = both.agg(F.countDistinct("strategy").alias("n")).scalar()
    table = pf.performance(pf.value_series(joins.common_periods(both, "t", "strategy", n), "t", COST)).select(
        "strategy", "n_periods", *[R(c).alias(c) for c in _PC[2:]])
    names = [f"hold {k}" for k in HELD]
    bars = pf.hurdles(table, "sharpe_net", names, names).drop("sharpe_net").withColumnsRenamed(
        {f"{x}_hold {k}": f"{x}_{k}" for x in ("hurdle", "beats") for k in HELD})
    return table.join(bars, "strategy")
