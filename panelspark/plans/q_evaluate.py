"""Classifier evaluation and resampled inference queries (C*, R*)."""

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.columns import CLASSES, r6 as R, t_p_value, t_p_value_sql
from ..operators import evaluate as ev, ranking, resample as rs, stats, windows as win
from ..sources import bind as b, sinks
from .q_portfolio import screen_series
from .q_stats import ev as rows
from .registry import argmax_sql, cte, query, r6


def is_event():
    return F.col("label") == "reduce"


def is_fired():
    return F.col("pred") == "reduce"


Y, P = "(label = 'reduce')", "(pred = 'reduce')"
cte("v_uid", "SELECT *, k * 100000 + date_diff('day', DATE '1990-01-01', t) AS uid FROM v_ev")


def uid(df):
    return df.withColumn("uid", F.col("k") * 100000 + F.datediff("t", F.lit("1990-01-01")))


@query("c1_confusion_matrix", """
 SELECT a.x AS truth, p.x AS pred, count(e.k) AS n FROM (SELECT unnest(['increase', 'hold', 'reduce']) AS x) a CROSS JOIN (SELECT unnest(['increase', 'hold', 'reduce']) AS x) p
 LEFT JOIN v_ev e ON e.label = a.x AND e.pred = p.x GROUP BY 1, 2""")
def c1(spark, sf):
    return ev.confusion_matrix(b.evaluated(spark, sf), "label", "pred")


def _pc(x: str, pred: str = "pred") -> str:
    return f"""count_if(label = '{x}' AND {pred} = '{x}') AS tp, count_if({pred} = '{x}') AS pp, count_if(label = '{x}') AS ap"""


@query("c2_per_class", " UNION ALL ".join(f"""
 SELECT '{x}' AS class, {r6('coalesce(tp / nullif(ap, 0), 0)')} AS recall, {r6('coalesce(tp / nullif(pp, 0), 0)')} AS precision, {r6('coalesce(2 * tp / nullif(ap + pp, 0), 0)')} AS f1, ap AS support
 FROM (SELECT {_pc(x)} FROM v_ev)""" for x in CLASSES))
def c2(spark, sf):
    return ev.per_class(b.evaluated(spark, sf), "label", "pred").withColumns({x: R(x) for x in ("recall", "precision", "f1")})


@query("c2_summary", f"""
 WITH f AS ({' UNION ALL '.join(f"SELECT coalesce(2 * tp / nullif(ap + pp, 0), 0) AS f1, ap FROM (SELECT {_pc(x)} FROM v_ev)" for x in CLASSES)})
 SELECT CAST(sum(ap) AS BIGINT) AS n, (SELECT {r6('avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END)')} FROM v_ev) AS accuracy, {r6('avg(f1)')} AS macro_f1, {r6('sum(f1 * ap) / sum(ap)')} AS weighted_f1 FROM f""")
def c2s(spark, sf):
    return ev.summary(b.evaluated(spark, sf), "label", "pred").withColumns({x: R(x) for x in ("accuracy", "macro_f1", "weighted_f1")})


_FLOOR = f"SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count_if({Y}) AS DOUBLE) AS m, CAST(count_if({P}) AS DOUBLE) AS k FROM v_ev"


@query("c3_random_floor", f"""
 SELECT CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CAST(k AS BIGINT) AS k, {r6('k / n')} AS recall, {r6('m / n')} AS precision,
  {r6('sqrt(k * (m / n) * (1 - m / n) * (n - k) / (n - 1)) / m')} AS recall_sd FROM ({_FLOOR})""")
def c3(spark, sf):
    return ev.random_floor(b.evaluated(spark, sf), is_event(), is_fired()).withColumns({x: R(x) for x in ("recall", "precision", "recall_sd")})


@query("c4_threshold_at_budget", f"""
 SELECT count(*) AS n, max(kk) AS k, count_if(y AND rk <= kk) AS hits, {r6('count_if(y AND rk <= kk) / count_if(y)')} AS recall, {r6('count_if(y AND rk <= kk) / max(kk)')} AS precision
 FROM (SELECT {Y} AS y, row_number() OVER (ORDER BY q_r DESC, uid) AS rk, count_if({P}) OVER () AS kk FROM v_uid)""")
def c4(spark, sf):
    e = uid(rows(spark, sf, "q_r", "label", "pred"))
    return ev.threshold_at_budget(e, "q_r", "uid", is_event(), is_fired()).withColumns({x: R(x) for x in ("recall", "precision")})


@query("c5_headline", f"""
 {' UNION ALL '.join(f"SELECT '{n}' AS method, {r6('coalesce(tp / nullif(ap, 0), 0)')} AS recall, {r6('coalesce(tp / nullif(pp, 0), 0)')} AS precision, {r6('ok / n')} AS accuracy, {r6('pp / n')} AS fire_rate FROM (SELECT {_pc('reduce', p)}, count(*) AS n, count_if(label = {p}) AS ok FROM v_ev)" for n, p in (('logged', 'pred'), ('baseline', 'base_pred')))}
 UNION ALL SELECT 'random', {r6('k / n')}, {r6('m / n')}, NULL, {r6('k / n')} FROM ({_FLOOR})
 UNION ALL SELECT 'threshold', {r6('count_if(y AND rk <= kk) / count_if(y)')}, {r6('count_if(y AND rk <= kk) / max(kk)')}, NULL, {r6('max(kk) / count(*)')}
  FROM (SELECT {Y} AS y, row_number() OVER (ORDER BY q_r DESC, uid) AS rk, count_if({P}) OVER () AS kk FROM v_uid)""")
def c5(spark, sf):
    e = uid(rows(spark, sf, "q_r", "label", "pred", "base_pred"))
    return ev.headline(e, "label", {"logged": "pred", "baseline": "base_pred"}, "reduce", "q_r", "uid", "pred").withColumns(
        {x: R(x) for x in ("recall", "precision", "accuracy", "fire_rate")})


@query("c6_c7_ranking_metrics", " UNION ALL ".join(f"""
 SELECT '{n}' AS model, CAST(sum(cn) AS BIGINT) AS n, CAST(sum(cp) AS BIGINT) AS n_event, {r6('sum(cp * (below + (cn - cp) / 2.0)) / (sum(cp) * sum(cn - cp))')} AS roc_auc, {r6('sum(cp * ap / an) / sum(cp)')} AS avg_precision
 FROM (SELECT cn, cp, CAST(sum(cn) OVER w AS DOUBLE) AS an, CAST(sum(cp) OVER w AS DOUBLE) AS ap, CAST(sum(cn - cp) OVER () - sum(cn - cp) OVER w AS DOUBLE) AS below
  FROM (SELECT {s}, CAST(count(*) AS DOUBLE) AS cn, CAST(count_if({Y}) AS DOUBLE) AS cp FROM v_ev GROUP BY 1) WINDOW w AS (ORDER BY {s} DESC))""" for n, s in (("logged", "p_r"), ("baseline", "q_r"))))
def c67(spark, sf):
    e = rows(spark, sf, "p_r", "q_r", "label")
    long = e.select("label", F.explode(F.array(F.struct(F.lit("logged").alias("model"), F.col("p_r").alias("s")), F.struct(F.lit("baseline").alias("model"), F.col("q_r").alias("s")))).alias("m")).select("label", "m.*")
    return ev.ranking_metrics(long, "s", is_event(), ["model"]).withColumns({x: R(x) for x in ("roc_auc", "avg_precision")})


_BIN = " + ".join(f"CAST(p_r >= {i} * 1e-1 AS INTEGER)" for i in range(1, 10))
cte("v_bin", f"SELECT {_BIN} AS bin, p_r, CASE WHEN label = 'reduce' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM v_ev")


@query("c8_murphy", f"""
 WITH g AS (SELECT bin, count(*) AS n, avg(p_r) AS pk, avg(y) AS yk FROM v_bin GROUP BY 1), t AS (SELECT avg(y) AS b, avg((p_r - y) * (p_r - y)) AS br FROM v_bin),
  s AS (SELECT CAST(sum(n) AS BIGINT) AS n, max(br) AS br, sum(n * (pk - yk) * (pk - yk)) / sum(n) AS rel, sum(n * (yk - b) * (yk - b)) / sum(n) AS res, max(b * (1 - b)) AS unc, sum(n * abs(pk - yk)) / sum(n) AS ece FROM g, t)
 SELECT n, {r6('br')} AS brier, {r6('rel')} AS reliability, {r6('res')} AS resolution, {r6('unc')} AS uncertainty, {r6('ece')} AS ece, {r6('br - (rel - res + unc)')} AS residual FROM s""")
def c8(spark, sf):
    return ev.murphy(rows(spark, sf, "p_r", "label"), "p_r", is_event()).withColumns(
        {x: R(x) for x in ("brier", "reliability", "resolution", "uncertainty", "ece", "residual")})


@query("c9_reliability_curve", f"""
 SELECT CAST(x.bin AS INTEGER) AS bin, {r6('x.bin * 1e-1')} AS lo, {r6('(x.bin + 1) * 1e-1')} AS hi, count(v.y) AS n, {r6('avg(p_r)')} AS mean_forecast, {r6('avg(y)')} AS observed
 FROM (SELECT unnest(range(10)) AS bin) x LEFT JOIN v_bin v ON v.bin = x.bin GROUP BY x.bin""")
def c9(spark, sf):
    return ev.reliability_curve(b.evaluated(spark, sf), "p_r", is_event()).withColumns({x: R(x) for x in ("lo", "hi", "mean_forecast", "observed")})


@query("c10_grid_share", f"""
 SELECT count(*) AS n, count(DISTINCT p_r) AS n_distinct, {r6('avg(CASE WHEN abs(round_even(p_r / 0.05::DOUBLE, 0) * 0.05::DOUBLE - p_r) <= 1e-9 + 1e-5 * p_r THEN 1.0 ELSE 0.0 END)')} AS on_grid FROM v_ev""")
def c10(spark, sf):
    return ev.grid_share(b.evaluated(spark, sf), "p_r", 0.05).withColumn("on_grid", R("on_grid"))


@query("c11_tie_census", f"""
 WITH e AS (SELECT {Y} AS y, {P} AS f, p_r, greatest(p_i, p_h, p_r) AS top, p_i, p_h FROM v_ev),
  t AS (SELECT y, f, (CAST(p_i = top AS INTEGER) + CAST(p_h = top AS INTEGER) + CAST(p_r = top AS INTEGER)) >= 2 AS tied, p_r = top AS rt FROM e)
 SELECT count(*) AS n, count_if(tied) AS n_tied, count_if(tied AND rt) AS n_tied_event, count_if(y) AS n_event, count_if(f) AS fired, count_if(f OR (tied AND rt)) AS fired_upper,
  {r6('count_if(f AND y) / count_if(y)')} AS recall, {r6('count_if((f OR (tied AND rt)) AND y) / count_if(y)')} AS recall_upper FROM t""")
def c11(spark, sf):
    return ev.tie_census(b.evaluated(spark, sf), "p_i", "p_h", "p_r", is_event()).withColumns({x: R(x) for x in ("recall", "recall_upper")})


cte("v_loss", f"""
 SELECT t, avg((p_r - y) * (p_r - y)) AS a, avg((q_r - y) * (q_r - y)) AS z, avg((b - y) * (b - y)) AS o FROM (
  SELECT t, p_r, q_r, CASE WHEN {Y} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, avg(CASE WHEN {Y} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER () AS b FROM v_ev) GROUP BY t""")


def _dm(spark, sf):
    return ev.diebold_mariano(rows(spark, sf, "p_r", "q_r", "label"), "t", is_event(), {"logged": "p_r", "baseline": "q_r"})


@query("c12_diebold_mariano", " UNION ALL ".join(f"""
 SELECT '{n}' AS pair, {r6(f'avg({d})')} AS mean_diff, {r6(f'avg({d}) / (stddev_samp({d}) / sqrt(count(*))) * sqrt((count(*) - 1) / count(*))')} AS t, count(*) AS n_periods FROM v_loss"""
    for n, d in (("logged_vs_baseline", "(a - z)"), ("logged_vs_base", "(a - o)"), ("baseline_vs_base", "(z - o)"))))
def c12(spark, sf):
    return _dm(spark, sf).withColumns({x: R(x) for x in ("mean_diff", "t")})


_T = " UNION ALL ".join(f"""
 SELECT '{n}' AS pair, avg({d}) / (stddev_samp({d}) / sqrt(count(*))) * sqrt((count(*) - 1) / count(*)) AS t, count(*) AS n_periods FROM v_loss"""
    for n, d in (("logged_vs_baseline", "(a - z)"), ("logged_vs_base", "(a - o)"), ("baseline_vs_base", "(z - o)")))


@query("c12_dm_p_values", f"SELECT pair, n_periods, {r6('t')} AS t, {r6(t_p_value_sql('t', '(n_periods - 1)'))} AS p_value FROM ({_T})")
def c12p(spark, sf):
    d = _dm(spark, sf)
    return d.select("pair", "n_periods", R("t").alias("t"), R(t_p_value("t", F.col("n_periods") - 1)).alias("p_value"))


_SEC = f"SELECT sector, count(*) AS n, count_if({P}) AS k, count_if({Y}) AS m, count_if({P} AND {Y}) AS tp FROM v_ev GROUP BY 1"


@query("c13_sector_table", f"SELECT *, {r6('k / n')} AS fire_rate, {r6('m / n')} AS event_rate, {r6('tp / nullif(m, 0)')} AS recall, {r6('tp / nullif(k, 0)')} AS precision FROM ({_SEC})")
def c13(spark, sf):
    return ev.sector_table(b.evaluated(spark, sf, sector=True), "sector", is_event(), is_fired()).withColumns({x: R(x) for x in ("fire_rate", "event_rate", "recall", "precision")})


@query("c13_allocation_selection", f"""
 SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, CAST(sum(m) AS BIGINT) AS m, CAST(sum(tp) AS BIGINT) AS tp, {r6('sum(tp) / sum(m)')} AS recall, {r6('sum(k) / sum(n)')} AS recall_random,
  {r6('sum(k * m / n) / sum(m)')} AS recall_allocation, {r6('sum(k * m / n) / sum(m) - sum(k) / sum(n)')} AS allocation_effect, {r6('sum(tp) / sum(m) - sum(k * m / n) / sum(m)')} AS selection_effect FROM ({_SEC})""")
def c13a(spark, sf):
    return ev.allocation_selection(b.evaluated(spark, sf, sector=True), "sector", is_event(), is_fired()).withColumns(
        {x: R(x) for x in ("recall", "recall_random", "recall_allocation", "allocation_effect", "selection_effect")})


@query("c14_subgroup_metrics", f"""
 SELECT CASE WHEN GROUPING(a) = 1 THEN 'all' WHEN a THEN 'affected' ELSE 'unaffected' END AS "group", count(*) AS n, count_if({Y}) AS n_event, count_if({P}) AS n_fired,
  {r6(f'count_if({Y} AND {P}) / count_if({Y})')} AS recall, {r6(f'count_if({Y} AND {P}) / count_if({P})')} AS precision FROM (SELECT *, p_h > 0.3::DOUBLE AS a FROM v_ev) GROUP BY GROUPING SETS ((a), ())""")
def c14(spark, sf):
    return ev.subgroup_metrics(b.evaluated(spark, sf), F.col("p_h") > 0.3, is_event(), is_fired()).withColumns({x: R(x) for x in ("recall", "precision")})


A = b.AGENTS
# every choice of agents, named by its members
SUBSETS = {"_".join(s): list(s) for n in range(1, len(A) + 1) for s in combinations(A, n)}


def _mean_sql(sub, x):
    return "(0.0::DOUBLE + " + " + ".join(f"{a}_{x}" for a in sub) + f") / {len(sub)}"


_RULES = {"logged": ("p_i", "p_h", "p_r"), **{n: tuple(_mean_sql(s, x) for x in "ihr") for n, s in SUBSETS.items()}}


def agents(spark, sf):
    return sinks.settle(b.evaluated(spark, sf, agents=True))


def vectors():
    return {a: c.prob_vector(f"{a}_i", f"{a}_h", f"{a}_r") for a in A}


LOGGED = ("p_i", "p_h", "p_r")


@query("c15_channel_ablation", " UNION ALL ".join(f"""
 SELECT '{n}' AS rule, {r6('coalesce(tp / nullif(ap, 0), 0)')} AS recall, {r6('coalesce(tp / nullif(pp, 0), 0)')} AS precision, {r6('pp / n')} AS fire_rate, {r6('ok / n')} AS accuracy
 FROM (SELECT {_pc('reduce', 'x')}, count(*) AS n, count_if(label = x) AS ok FROM (SELECT label, {argmax_sql(*v)} AS x FROM v_ev))""" for n, v in _RULES.items()))
def c15(spark, sf):
    out = ev.channel_ablation(b.evaluated(spark, sf, agents=True), vectors(), SUBSETS, c.prob_vector(*LOGGED), "label", "reduce")
    return out.withColumns({x: R(x) for x in ("recall", "precision", "fire_rate", "accuracy")})


_CF = {a: f"greatest({a}_i, {a}_h, {a}_r)" for a in A}
_CW = "(0.0::DOUBLE + " + " + ".join(_CF[a] for a in A) + ")"
_RULES2 = {
    "logged": LOGGED, "mean": tuple(_mean_sql(A, x) for x in "ihr"), "single": tuple(f"disclosure_{x}" for x in "ihr"),
    "confidence": tuple("(0.0::DOUBLE + " + " + ".join(f"{a}_{x} * {_CF[a]}" for a in A) + f") / {_CW}" for x in "ihr"),
}


@query("c16_aggregation_agreement", " UNION ALL ".join(f"""
 SELECT '{n}' AS rule, n, {r6('coalesce(tp / nullif(ap, 0), 0)')} AS recall, {r6('coalesce(tp / nullif(pp, 0), 0)')} AS precision, pp AS n_fired, {r6('ok / n')} AS accuracy, ag AS n_agree, {r6('ag / n')} AS agreement
 FROM (SELECT {_pc('reduce', 'x')}, count(*) AS n, count_if(label = x) AS ok, count_if(x = pred) AS ag FROM (SELECT label, pred, {argmax_sql(*v)} AS x FROM v_ev))""" for n, v in _RULES2.items()))
def c16(spark, sf):
    out = ev.aggregation_agreement(agents(spark, sf), vectors(), "disclosure", c.prob_vector(*LOGGED), "label", "reduce")
    return out.withColumns({x: R(x) for x in ("recall", "precision", "accuracy", "agreement")})


cte("v_rate", f"SELECT t, count_if({P}) / count(*) AS f, count_if({Y}) / count(*) AS y FROM v_ev GROUP BY t")


@query("c17_timing", f"""
 SELECT count(*) AS n_periods, {r6('corr(f, y)')} AS pearson, {r6('corr(rf, ry)')} AS spearman, {r6('avg(f)')} AS mean_fire_rate, {r6('avg(y)')} AS mean_event_rate
 FROM (SELECT f, y, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 AS rf, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM v_rate)""")
def c17(spark, sf):
    m = stats.conditional_rates(b.evaluated(spark, sf), ["t"], {"fire": is_fired(), "event": is_event()})
    m = sinks.settle(m.select("t", (F.col("n_fire") / F.col("n_obs")).alias("f"), (F.col("n_event") / F.col("n_obs")).alias("y")))
    g = m.agg(F.corr("f", "y").alias("pearson"), F.avg("f").alias("mf"), F.avg("y").alias("my"))
    rho = stats.spearman(m, "f", "y").select("rho").scalar()
    n = m.agg(F.count("*").alias("n")).scalar()
    return g.select(n.alias("n_periods"), R("pearson").alias("pearson"), R(rho).alias("spearman"), R("mf").alias("mean_fire_rate"), R("my").alias("mean_event_rate"))


def _tv(a, z):
    return "((0.0::DOUBLE + " + " + ".join(f"abs({a}_{x} - {z}_{x})" for x in "ihr") + ") / 2)"


_PAIRS = [(A[i], A[j]) for i in range(4) for j in range(i + 1, 4)]
_DIS = "((" + " + ".join(_tv(x, y) for x, y in _PAIRS) + ") / 6)"
cte("v_agree", f"SELECT k, t, uid, CASE WHEN pred = label THEN 1 ELSE 0 END AS ok, floor((1 - {_tv('macro', 'price')}) * 20 + 0.4999) / 20 AS agree, floor({_DIS} * 1e6 + 0.4999) / 1e6 AS dis FROM v_uid")


def agreement(spark, sf):
    v = vectors()
    score = F.floor((1 - c.total_variation(v["macro"], v["price"])) * 20 + 0.4999) / 20
    e = uid(b.evaluated(spark, sf, agents=True))
    return sinks.settle(e.select("k", "t", "uid", (F.col("pred") == F.col("label")).cast("int").alias("ok"), score.alias("agree"),
                                 R(ev.pairwise_disagreement(list(v.values()))).alias("dis")))


@query("c18_agreement", f"""
 WITH r AS (SELECT *, row_number() OVER (ORDER BY agree, uid) AS rn, count(*) OVER () AS n, quantile_cont(agree, 0.5) OVER () AS med,
   rank() OVER (ORDER BY agree) + (count(*) OVER (PARTITION BY agree) - 1) / 2.0 AS ra, rank() OVER (ORDER BY dis) + (count(*) OVER (PARTITION BY dis) - 1) / 2.0 AS rd,
   rank() OVER (ORDER BY ok) + (count(*) OVER (PARTITION BY ok) - 1) / 2.0 AS ro FROM v_agree)
 SELECT count(*) AS n, {r6('corr(agree, ok)')} AS pearson, {r6('corr(ra, ro)')} AS spearman, {r6('avg(ok)')} AS accuracy, {r6('avg(ok) FILTER (WHERE rn <= n // 2)')} AS low_half, {r6('avg(ok) FILTER (WHERE rn > n - n // 2)')} AS high_half,
  {r6('max(med)')} AS median_score, {r6('avg(ok) FILTER (WHERE agree <= med)')} AS le_median, {r6('avg(ok) FILTER (WHERE agree > med)')} AS gt_median, {r6('corr(ra, rd)')} AS rho_disagreement, {r6('avg(dis)')} AS mean_disagreement FROM r""")
def c18(spark, sf):
    a = agreement(spark, sf)
    med = ranking.exact_quantiles(a, [], "agree", {"m": 0.5}).scalar()
    n = a.agg(F.count("*").alias("n")).scalar()
    r = ranking.rank_in_group(a, [], "agree", "uid", descending=False).withColumns({"_m": med, "_n": n})
    half = F.floor(F.col("_n") / 2)
    ok = F.col("ok").cast("double")
    g = r.agg(
        F.count("*").alias("n"), R(F.corr("agree", "ok")).alias("pearson"), R(F.avg(ok)).alias("accuracy"),
        R(F.avg(F.when(F.col("rk") <= half, ok))).alias("low_half"), R(F.avg(F.when(F.col("rk") > F.col("_n") - half, ok))).alias("high_half"),
        R(F.max("_m")).alias("median_score"), R(F.avg(F.when(F.col("agree") <= F.col("_m"), ok))).alias("le_median"),
        R(F.avg(F.when(F.col("agree") > F.col("_m"), ok))).alias("gt_median"), R(F.avg("dis")).alias("mean_disagreement"))
    return g.withColumn("spearman", R(stats.spearman(a, "agree", "ok").select("rho").scalar())).withColumn(
        "rho_disagreement", R(stats.spearman(a, "agree", "dis").select("rho").scalar()))


_S = {x: f"(CAST(l_linenumber * {m} + l_orderkey % 7 AS BIGINT) % 5 - 2)" for x, m in (("a", 1), ("b", 3), ("c", 4))}


@query("c19_score_rule", f"""
 SELECT l_orderkey, l_linenumber, a + b + c AS total_score, {r6('(a + b + c) / 3.0')} AS decision_score, greatest(a, b, c) - least(a, b, c) AS disagreement,
  CASE WHEN greatest(a, b, c) - least(a, b, c) >= 3 AND abs(a + b + c) < 3 THEN 'hold' WHEN a + b + c >= 2 THEN 'increase' WHEN a + b + c <= -2 THEN 'reduce' ELSE 'hold' END AS signal,
  CASE WHEN abs(a + b + c) >= 4 AND greatest(a, b, c) - least(a, b, c) <= 2 THEN 'high' WHEN abs(a + b + c) >= 2 AND greatest(a, b, c) - least(a, b, c) <= 3 THEN 'medium' ELSE 'low' END AS confidence
 FROM (SELECT l_orderkey, l_linenumber, {', '.join(f'{v} AS {x}' for x, v in _S.items())} FROM lineitem)""")
def c19(spark, sf):
    li = b.table(spark, sf, "lineitem")
    s = li.select("l_orderkey", "l_linenumber", *[
        ((F.col("l_linenumber") * m + F.col("l_orderkey") % 7) % 5 - 2).alias(x) for x, m in (("a", 1), ("b", 3), ("c", 4))])
    rule = ev.score_rule("a", "b", "c")
    return s.select("l_orderkey", "l_linenumber", *[(R(v) if n == "decision_score" else v).alias(n) for n, v in rule.items()])


# ---------------------------------------------------------------- resampled inference
REPS, SEED = 2000, 42


def _mix(x: str, out: str) -> str:
    """The SQL twin of resample._mix."""
    step = "(xor({0}, {0} >> 16) * 73244475) & 4294967295"
    return f"{x} AS {out}0, {step.format(out + '0')} AS {out}1, {step.format(out + '1')} AS {out}2, xor({out}2, {out}2 >> 16) AS {out}"


def _draw(blocks: str, reps: int, seed: int) -> str:
    """Draws of at most resample.RANGE blocks, which make one range."""
    return f"""SELECT rep, b.* FROM (SELECT rep, {_mix('xor(u, v)', 'w')}, w % n AS idx
   FROM (SELECT rep, {_mix(f'CAST({seed} * 1000003 + rep AS BIGINT)', 'u')} FROM (SELECT unnest(range({reps})) AS rep)),
    (SELECT n, {_mix('slot', 'v')} FROM (SELECT unnest(range(n)) AS slot, n FROM (SELECT count(*) AS n FROM {blocks})))) d
   JOIN (SELECT *, row_number() OVER (ORDER BY block) - 1 AS bi FROM {blocks}) b ON b.bi = d.idx"""


_BLK = f"SELECT {{}} AS block, count(*) AS n, count_if({Y}) AS m, count_if({Y} AND {P}) AS hit_logged, count_if({Y} AND base_pred = 'reduce') AS hit_baseline FROM v_ev GROUP BY 1"
cte("v_blk_k", _BLK.format("k"))
cte("v_blk_t", _BLK.format("date_diff('day', DATE '1970-01-01', t)"))


def _reps_sql(blk: str) -> str:
    return f"""SELECT rep, sum(hit_logged) / sum(m) AS logged, sum(hit_baseline) / sum(m) AS baseline, round_even((SELECT count_if({P}) / count(*) FROM v_ev) * sum(n), 0) / sum(n) AS random,
   sum(hit_logged) / sum(m) - round_even((SELECT count_if({P}) / count(*) FROM v_ev) * sum(n), 0) / sum(n) AS difference FROM ({_draw(blk, REPS, SEED)}) GROUP BY rep HAVING sum(m) > 0"""


cte("v_rep_k", _reps_sql("v_blk_k"))
cte("v_rep_t", _reps_sql("v_blk_t"))
_Q4 = ("logged", "baseline", "random", "difference")


def replicates(spark, sf, block):
    e = rows(spark, sf, "label", "pred", "base_pred")
    methods = {"logged": is_fired(), "baseline": F.col("base_pred") == "reduce"}
    blocks = sinks.settle(rs.recall_sums(e, block, is_event(), methods))
    rate = e.agg((F.count_if(is_fired()) / F.count("*")).alias("f")).scalar()
    return rs.recall_replicates(blocks, rate, list(methods), "logged", REPS, SEED)


def _iv(src: str, qs, extra: str = "") -> str:
    return " UNION ALL ".join(f"""
 SELECT '{q}' AS quantity, count(*) AS n_reps, {r6(f'avg({q})')} AS mean, {r6(f'stddev_samp({q})')} AS se, {r6(f'quantile_cont({q}, 0.025)')} AS lo, {r6(f'quantile_cont({q}, 0.975)')} AS hi{extra.format(q=q)} FROM {src} WHERE {q} IS NOT NULL""" for q in qs)


_IV = ("mean", "se", "lo", "hi")


@query("r1_block_bootstrap_entity", _iv("v_rep_k", _Q4))
def r1(spark, sf):
    r = replicates(spark, sf, F.col("k"))
    return rs.interval(r, {q: F.col(q) for q in _Q4}).withColumns({x: R(x) for x in _IV})


@query("r1_block_bootstrap_period", _iv("v_rep_t", _Q4))
def r1t(spark, sf):
    r = replicates(spark, sf, F.unix_date("t"))
    return rs.interval(r, {q: F.col(q) for q in _Q4}).withColumns({x: R(x) for x in _IV})


@query("r2_minimum_detectable", "\n".join(["SELECT 'entity' AS scheme, * FROM (" + _iv("v_rep_k", ("difference",), f", {r6('(1.959963984540054 + 0.8416212335729143) * stddev_samp(difference)')} AS mde") + ")",
    "UNION ALL SELECT 'period', * FROM (" + _iv("v_rep_t", ("difference",), f", {r6('(1.959963984540054 + 0.8416212335729143) * stddev_samp(difference)')} AS mde") + ")"]))
def r2(spark, sf):
    out = None
    for name, block in (("entity", F.col("k")), ("period", F.unix_date("t"))):
        iv = rs.interval(replicates(spark, sf, block), {"difference": F.col("difference")})
        part = rs.minimum_detectable(iv).withColumn("scheme", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumns({x: R(x) for x in (*_IV, "mde")})


BAND = (0.1, 0.2, 0.3)
cte("v_w", f"SELECT rep, block, count(*) AS w FROM ({_draw('v_blk_t', REPS, 7)}) GROUP BY 1, 2")


def _wcell(score: str) -> str:
    return f"""SELECT w.rep, c.s, sum(c.n * w.w) AS n, sum(c.p * w.w) AS p FROM (SELECT date_diff('day', DATE '1970-01-01', t) AS block, {score} AS s, count(*) AS n, count_if({Y}) AS p FROM v_ev GROUP BY 1, 2) c
  JOIN v_w w ON w.block = c.block GROUP BY 1, 2"""


def scored(spark, sf):
    """Raw scores of both methods with the period as the block."""
    return sinks.settle(rows(spark, sf, "p_r", "q_r", "label").select(F.unix_date("t").cast("bigint").alias("block"), "p_r", "q_r", "label"))


@query("r3_budget_band", f"""
 WITH r AS ({' UNION ALL '.join(f"SELECT '{m}' AS m, rep, budget, sum(p * least(greatest(round_even(budget * nn, 0) - (cn - n), 0), n) / n) / max(pp) AS recall FROM (SELECT *, sum(n) OVER (PARTITION BY rep ORDER BY s DESC) AS cn, sum(n) OVER (PARTITION BY rep) AS nn, sum(p) OVER (PARTITION BY rep) AS pp FROM ({_wcell(s)})), (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS budget) GROUP BY 1, 2, 3" for m, s in (('a', 'p_r'), ('z', 'q_r')))}),
  d AS (SELECT a.budget, a.recall - z.recall AS x FROM r a JOIN r z ON a.rep = z.rep AND a.budget = z.budget AND a.m = 'a' AND z.m = 'z')
 SELECT budget, count(*) AS n_reps, {r6('avg(x)')} AS mean, {r6('quantile_cont(x, 0.025)')} AS lo, {r6('quantile_cont(x, 0.975)')} AS hi FROM d GROUP BY 1""")
def r3(spark, sf):
    e = scored(spark, sf)
    a, z = (rs.budget_replicates(e, "block", x, is_event(), BAND, REPS, 7) for x in ("p_r", "q_r"))
    d = a.join(z.withColumnRenamed("recall", "other"), ["rep", "budget"]).withColumn("x", F.col("recall") - F.col("other"))
    return d.groupBy("budget").agg(F.count("*").alias("n_reps"), R(F.avg("x")).alias("mean"), R(F.percentile("x", 0.025)).alias("lo"), R(F.percentile("x", 0.975)).alias("hi"))


def _auc_sql(score: str) -> str:
    return f"""SELECT rep, sum(p * (nn - pp - (cn - cp) + (n - p) / 2.0)) / (max(pp) * (max(nn) - max(pp))) AS auc, sum(p * cp / cn) / max(pp) AS ap FROM (
  SELECT rep, CAST(n AS DOUBLE) AS n, CAST(p AS DOUBLE) AS p, CAST(sum(n) OVER w AS DOUBLE) AS cn, CAST(sum(p) OVER w AS DOUBLE) AS cp, CAST(sum(n) OVER (PARTITION BY rep) AS DOUBLE) AS nn, CAST(sum(p) OVER (PARTITION BY rep) AS DOUBLE) AS pp
  FROM ({_wcell(score)}) WINDOW w AS (PARTITION BY rep ORDER BY s DESC)) GROUP BY rep HAVING max(pp) > 0 AND max(nn) > max(pp)"""


cte("v_auc", f"SELECT a.auc AS logged, z.auc AS baseline, a.auc - z.auc AS difference, a.ap AS logged_pr, z.ap AS baseline_pr FROM ({_auc_sql('p_r')}) a JOIN ({_auc_sql('q_r')}) z ON a.rep = z.rep")
_AUC = ("logged", "baseline", "difference", "logged_pr", "baseline_pr")


def auc_by_replicate(e):
    a, z = (rs.auc_replicates(e, "block", x, is_event(), REPS, 7) for x in ("p_r", "q_r"))
    z = z.select("rep", F.col("roc_auc").alias("baseline"), F.col("avg_precision").alias("baseline_pr"))
    return a.select("rep", F.col("roc_auc").alias("logged"), F.col("avg_precision").alias("logged_pr")).join(z, "rep").withColumn(
        "difference", F.col("logged") - F.col("baseline"))


@query("r4_auc_bootstrap", _iv("v_auc", _AUC))
def r4(spark, sf):
    return rs.interval(auc_by_replicate(scored(spark, sf)), {q: F.col(q) for q in _AUC}).withColumns({x: R(x) for x in _IV})


def _point(score: str) -> str:
    return f"""SELECT sum(p * (nn - pp - (cn - cp) + (n - p) / 2.0)) / (max(pp) * (max(nn) - max(pp))) AS auc, sum(p * cp / cn) / max(pp) AS ap FROM (
  SELECT CAST(n AS DOUBLE) AS n, CAST(p AS DOUBLE) AS p, CAST(sum(n) OVER w AS DOUBLE) AS cn, CAST(sum(p) OVER w AS DOUBLE) AS cp, CAST(sum(n) OVER () AS DOUBLE) AS nn, CAST(sum(p) OVER () AS DOUBLE) AS pp
  FROM (SELECT {score} AS s, count(*) AS n, count_if({Y}) AS p FROM v_ev GROUP BY 1) WINDOW w AS (ORDER BY s DESC))"""


def _bounds(q: str | None, name: str) -> str:
    return ", ".join(f"{r6(f'quantile_cont({q}, {p})') if q else 'CAST(NULL AS DOUBLE)'} AS {name}_{s}" for s, p in (("lo", 0.025), ("hi", 0.975)))


@query("r4_auc_table", f"""
 WITH a AS ({_point('p_r')}), z AS ({_point('q_r')})
 SELECT 'logged' AS model, {r6('(SELECT auc FROM a)')} AS roc_auc, {r6('(SELECT ap FROM a)')} AS pr_auc, {_bounds('logged', 'roc')}, {_bounds('logged_pr', 'pr')} FROM v_auc
 UNION ALL SELECT 'baseline', {r6('(SELECT auc FROM z)')}, {r6('(SELECT ap FROM z)')}, {_bounds('baseline', 'roc')}, {_bounds('baseline_pr', 'pr')} FROM v_auc
 UNION ALL SELECT 'logged_minus_baseline', {r6('(SELECT a.auc - z.auc FROM a, z)')}, {r6('(SELECT a.ap - z.ap FROM a, z)')}, {_bounds('difference', 'roc')}, {_bounds(None, 'pr')} FROM v_auc
 UNION ALL SELECT 'base_rate', 0.5, (SELECT {r6(f'count_if({Y}) / count(*)')} FROM v_ev), NULL, NULL, NULL, NULL""")
def r4_table(spark, sf):
    """Areas of each method on all rows with the interval of the replicates, their difference, and the base rate."""
    e = scored(spark, sf)
    none = F.lit(None).cast("double")
    points = [ev.ranking_metrics(e, s, is_event()).select(F.lit(m).alias("model"), "roc_auc", F.col("avg_precision").alias("pr_auc"))
              for m, s in (("logged", "p_r"), ("baseline", "q_r"))]
    two = points[0].unionByName(points[1])
    sign = F.when(F.col("model") == "logged", 1).otherwise(-1)
    gap = two.agg(F.sum(sign * F.col("roc_auc")).alias("roc_auc"), F.sum(sign * F.col("pr_auc")).alias("pr_auc")).select(
        F.lit("logged_minus_baseline").alias("model"), "roc_auc", "pr_auc")
    base = e.agg((F.count_if(is_event()) / F.count("*")).alias("pr_auc")).select(F.lit("base_rate").alias("model"), F.lit(0.5).alias("roc_auc"), "pr_auc")
    iv = rs.interval(auc_by_replicate(e), {q: F.col(q) for q in _AUC}).select("quantity", "lo", "hi")
    of = F.regexp_replace(F.regexp_replace("quantity", "_pr$", ""), "^difference$", "logged_minus_baseline")
    arms = iv.withColumns({"model": of, "pr": F.col("quantity").endswith("_pr")}).groupBy("model").agg(*[
        F.max(F.when(F.col("pr") == F.lit(arm == "pr"), F.col(x))).alias(f"{arm}_{x}") for arm in ("roc", "pr") for x in ("lo", "hi")])
    out = two.unionByName(gap).unionByName(base).join(arms, "model", "left")
    return out.select("model", *[R(F.coalesce(x, none)).alias(x) for x in ("roc_auc", "pr_auc", "roc_lo", "roc_hi", "pr_lo", "pr_hi")])


@query("r5_paired_returns", f"""
 WITH s AS (SELECT date_diff('day', DATE '1970-01-01', t) AS block, max(e) FILTER (WHERE strategy = 'avoid_flagged') AS a, max(e) FILTER (WHERE strategy = 'all') AS z FROM v_hper GROUP BY t HAVING count(e) = count(*)),
  r AS (SELECT rep, (avg(a) - avg(z)) * 12 AS d_mean, (avg(a) / stddev_samp(a) - avg(z) / stddev_samp(z)) * sqrt(12) AS d_sharpe FROM ({_draw('s', REPS, 9)}) GROUP BY rep) {_iv('r', ('d_mean', 'd_sharpe'))}""")
def r5(spark, sf):
    s = screen_series(spark, sf).withColumn("e", F.col("gross_return") - F.col("monthly_rf"))
    w = s.groupBy(F.unix_date("t").alias("block")).agg(
        F.max(F.when(F.col("strategy") == "avoid_flagged", F.col("e"))).alias("a"), F.max(F.when(F.col("strategy") == "all", F.col("e"))).alias("z"), F.count("e").alias("n"), F.count("*").alias("m"))
    w = sinks.settle(w.where(F.col("n") == F.col("m")).select("block", "a", "z"))
    return rs.interval(rs.paired_returns(w, "block", "a", "z", REPS, 9), {q: F.col(q) for q in ("d_mean", "d_sharpe")}).withColumns({x: R(x) for x in _IV})


@query("r6_equivalence", f"""
 SELECT {r6('quantile_cont(difference, 0.025)')} AS lo, {r6('quantile_cont(difference, 0.975)')} AS hi, {r6('1 - least(avg(CAST(difference < 0.05 AS INTEGER)), avg(CAST(difference > -0.05 AS INTEGER)))')} AS tost_p,
  quantile_cont(difference, 0.025) > -0.05 AND quantile_cont(difference, 0.975) < 0.05 AS equivalent FROM v_rep_t""")
def r6_(spark, sf):
    return rs.equivalence(replicates(spark, sf, F.unix_date("t")), "difference", 0.05).withColumns({x: R(x) for x in ("lo", "hi", "tost_p")})
