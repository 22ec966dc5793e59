"""Decision-log audits and data quality (L*, V*)."""

from pyspark.sql import functions as F

from ..functions.columns import CLASSES, r6 as R
from ..operators import calendar as cal, declog as dl, joins, quality as ql
from ..sources import bind as b, readers, sinks
from .q_core import BOUNDS, SPLIT_SQL, _KEY, _fact_months, cited, log_lines
from .q_evaluate import agreement
from .registry import argmax_sql, cte, query, r6


@query("l1_flat_predictions", f"""
 WITH g AS (SELECT k, t, max(seq) AS seq, arg_max(p_i, seq) AS p_i, arg_max(p_h, seq) AS p_h, arg_max(p_r, seq) AS p_r FROM v_log WHERE {_KEY} % 13 <> 0 AND {_KEY} % 17 <> 0 GROUP BY 1, 2)
 SELECT g.t AS decision_date, CAST(g.k AS VARCHAR) AS ticker, {r6('p_i')} AS prob_increase, {r6('p_h')} AS prob_hold, {r6('p_r')} AS prob_reduce, seq, 'm1' AS model_run_id, {argmax_sql('p_i', 'p_h', 'p_r')} AS predicted_label,
  coalesce(tr.label, 'unknown') AS true_label FROM g LEFT JOIN v_truth tr ON tr.k = g.k AND tr.t = g.t""")
def l1(spark, sf):
    good, _ = readers.parse_log(log_lines(spark, sf))
    tr = b.truth(spark, sf).select(F.col("t").alias("decision_date"), F.col("k").cast("string").alias("ticker"), F.col("label").alias("true_label"))
    return dl.flat_predictions(good, tr).withColumns({c: R(c) for c in ("prob_increase", "prob_hold", "prob_reduce")})


@query("l2_future_citations", """
 SELECT kind, count(*) AS n, CAST(sum(2) AS BIGINT) AS n_cited, count_if(id % 11 = 0) + count_if(id % 5 = 0) AS n_future, count_if(id % 11 = 0 OR id % 5 = 0) AS n_flagged FROM v_cited GROUP BY kind""")
def l2(spark, sf):
    late = F.date_add("d", F.when(F.col("id") % 11 == 0, 40).otherwise(-3))
    late2 = F.date_add("d", F.when(F.col("id") % 5 == 0, 9).otherwise(0))
    facts = F.array(F.concat(F.lit("annual report filed "), F.date_format(late, "yyyy-MM-dd")), F.concat(F.lit("see 8-K (item 2) on "), F.date_format(late2, "MMMM d, yyyy"), F.lit("; note due 2099-01-01")))
    d = dl.future_citations(cited(spark, sf).withColumn("facts", facts), "facts", "d")
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_cited").alias("n_cited"), F.sum("n_future").alias("n_future"), F.count_if(F.col("n_future") > 0).alias("n_flagged"))


@query("l3_grounding", f"""
 WITH g AS (SELECT kind, id % 4 AS e, 1 AS n_facts, id % 2 = 0 AS money, id % 3 = 0 AS risk FROM v_cited)
 SELECT CASE WHEN GROUPING(kind) = 1 THEN 'all' ELSE kind END AS "group", count(*) AS n, {r6('avg(CASE WHEN money OR risk THEN 1.0 ELSE 0.0 END)')} AS grounded, {r6('avg(CASE WHEN e = 0 THEN CASE WHEN money OR risk THEN 1.0 ELSE 0.0 END END)')} AS grounded_event,
  {r6('avg(CASE WHEN risk THEN 1 ELSE 0 END)')} AS mean_risk, {r6('avg(CASE WHEN money THEN 1 ELSE 0 END)')} AS money_share FROM g GROUP BY GROUPING SETS ((kind), ())""")
def l3(spark, sf):
    d = cited(spark, sf)
    fact = F.when(F.col("id") % 2 == 0, F.lit("paid $ 300 for 5% of it")).otherwise(F.lit("paid nothing"))
    why = F.when(F.col("id") % 3 == 0, "Covenant breach likely").otherwise(F.lit(None))
    g = dl.grounding(F.array(fact), why)
    d = d.select(F.explode(F.array("kind", F.lit("all"))).alias("group"), "id", *[v.alias(n) for n, v in g.items()])
    ok = F.col("grounded").cast("double")
    return d.groupBy("group").agg(F.count("*").alias("n"), R(F.avg(ok)).alias("grounded"), R(F.avg(F.when(F.col("id") % 4 == 0, ok))).alias("grounded_event"),
                                  R(F.avg("n_risk")).alias("mean_risk"), R(F.avg(F.col("has_money").cast("double"))).alias("money_share"))


@query("l4_structured_factuality", f"""
 SELECT kind, count(*) AS n, count_if(id % 7 <> 0) AS n_ok, {r6('count_if(id % 7 <> 0) / count(*)')} AS share FROM v_cited GROUP BY kind""")
def l4(spark, sf):
    d = cited(spark, sf)
    t = d.select("id", F.lit("leverage").alias("name"), (F.col("v") * 100).alias("true_value"))
    facts = F.array("fact", F.lit("other text"), F.lit("unknown_name: 4"))
    out = dl.structured_factuality(d.withColumn("facts", facts), "facts", ["id"], t).join(d.select("id", "kind"), "id")
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), R(F.count_if("ok") / F.count("*")).alias("share"))


@query("l5_text_factuality", """
 SELECT kind, count(*) AS n, count_if(ok) AS n_ok FROM (SELECT kind, unnest([
   contains(src, substr(CAST(o_custkey AS VARCHAR) || '000', 1, 5)), contains(src, y),
   -- an amount that reads as a year is one more token
   CASE WHEN o_custkey BETWEEN 1900 AND 2099 AND CAST(o_custkey AS VARCHAR) <> y THEN contains(src, CAST(o_custkey AS VARCHAR)) END]) AS ok FROM (
    SELECT o_orderpriority AS kind, o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'about' || CAST(o_custkey AS VARCHAR) || '000in' ELSE 'noamount' END
     || CAST(year(o_orderdate) - o_orderkey % 2 AS VARCHAR) AS src FROM orders)) WHERE ok IS NOT NULL GROUP BY kind""")
def l5(spark, sf):
    d = cited(spark, sf).withColumn("cust", F.regexp_extract("fact", r"\$(\d+),", 1))
    src = F.concat(F.when(F.col("id") % 3 == 0, F.concat(F.lit("about $"), "cust", F.lit(",000 in "))).otherwise("no amount "), (F.year("d") - F.col("id") % 2).cast("string"))
    out = dl.text_factuality(d.withColumn("facts", F.array("fact")).withColumn("src", src), "facts", "src", ["id", "kind"])
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


cte("v_used", """
 WITH f AS (SELECT k, concept, filed, max(pos) AS pos, arg_max(val, pos) AS val, arg_max(end_d, pos) AS end_d FROM v_facts GROUP BY 1, 2, 3),
  p AS (SELECT m.k, m.t, c.concept FROM v_months m JOIN (SELECT DISTINCT k, concept FROM v_facts) c ON c.k = m.k),
  u AS (SELECT p.k, p.t, p.concept, f.filed, f.val, f.end_d FROM p ASOF JOIN f ON p.k = f.k AND p.concept = f.concept AND p.t >= f.filed),
  s AS (SELECT *, row_number() OVER (PARTITION BY k, concept, end_d ORDER BY filed, pos) AS rn FROM v_facts)
 SELECT u.*, s.filed AS first_filed, s.val AS first_val, u.filed <> s.filed AND u.val <> s.val AS restated,
  CASE WHEN u.filed <> s.filed AND u.val <> s.val THEN abs(u.val - s.val) / abs(s.val) END AS rel_diff FROM u JOIN s ON s.rn = 1 AND s.k = u.k AND s.concept = u.concept AND s.end_d = u.end_d""")


def used(spark, sf):
    return dl.restatements(_fact_months(spark, sf), b.facts(spark, sf), ["k"], "t")


@query("l6_restatements", f"SELECT k, concept, t, end_d, filed, val, first_filed, first_val, restated, {r6('rel_diff')} AS rel_diff FROM v_used")
def l6(spark, sf):
    return used(spark, sf).withColumn("rel_diff", R("rel_diff"))


@query("l6_restatement_summary", f"""
 SELECT count(*) AS n_uses, count_if(restated) AS n_restated, {r6('count_if(restated) / count(*)')} AS share, {r6('quantile_cont(rel_diff, 0.5)')} AS median_diff, {r6('quantile_cont(rel_diff, 0.9)')} AS p90_diff,
  {r6('max(rel_diff)')} AS max_diff, {r6('count_if(rel_diff > 0.05) / count(rel_diff)')} AS share_gt_5pct FROM v_used""")
def l6s(spark, sf):
    return dl.restatement_summary(sinks.settle(used(spark, sf))).withColumns({c: R(c) for c in ("share", "median_diff", "p90_diff", "max_diff", "share_gt_5pct")})


@query("l6_raw_prevalence", "SELECT count(*) AS n_cells, count_if(m) AS n_restated FROM (SELECT count(DISTINCT val) > 1 AS m FROM v_facts GROUP BY k, concept, end_d)")
def l6r(spark, sf):
    return dl.raw_restatements(b.facts(spark, sf), ["k"])


@query("l7_fallback_census", " UNION ALL ".join(f"""
 SELECT '{a}' AS channel, count(*) AS n, count_if({a}_i = 0.34 AND {a}_h = 0.33 AND {a}_r = 0.33) AS n_fallback, {r6(f'count_if({a}_i = 0.34 AND {a}_h = 0.33 AND {a}_r = 0.33) / count(*)')} AS share FROM v_dec""" for a in b.AGENTS))
def l7(spark, sf):
    out = dl.fallback_census(b.decisions(spark, sf), {a: (f"{a}_i", f"{a}_h", f"{a}_r") for a in b.AGENTS}, b.UNIFORM)
    return out.withColumn("share", R("share"))


RATERS, PAIRS = ("h", "j", "r2"), (("h", "j"), ("r2", "j"), ("h", "r2"))
_SCORES = {("entailment", "h"): "quality + toxic", ("entailment", "r2"): "least(2, quality + doc_id % 2)", ("entailment", "j"): "least(2, toxic + doc_id % 3)",
           ("relevance", "h"): "quality * 2", ("relevance", "r2"): "greatest(0, quality * 2 - doc_id % 2)", ("relevance", "j"): "(quality + doc_id) % 3"}
cte("v_rate_long", " UNION ALL ".join(f"SELECT doc_id AS item, '{d}' AS dim, '{r}' AS rater, CAST({e} AS BIGINT) AS score FROM labels" for (d, r), e in _SCORES.items()))
cte("v_rate_pair", " UNION ALL ".join(f"SELECT x.item, x.dim, '{p}-{q}' AS pair, x.score AS a, z.score AS z FROM v_rate_long x JOIN v_rate_long z ON x.item = z.item AND x.dim = z.dim AND x.rater = '{p}' AND z.rater = '{q}'" for p, q in PAIRS))


def ratings(spark, sf):
    cells = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(r).alias("rater"), F.expr(e).cast("bigint").alias("score")) for (d, r), e in _SCORES.items()])
    return b.table(spark, sf, "labels").select(F.col("doc_id").alias("item"), F.inline(cells))


def rating_pairs(spark, sf):
    return dl.rater_pairs(dl.wide_ratings(ratings(spark, sf), RATERS), PAIRS)


@query("l8_rater_agreement", f"""
 SELECT dim, pair, count(*) AS n, {r6('avg(a)')} AS mean_a, {r6('avg(z)')} AS mean_b, {r6('count_if(a = z) / count(*)')} AS exact, {r6('count_if(abs(a - z) <= 1) / count(*)')} AS within_1 FROM v_rate_pair GROUP BY 1, 2""")
def l8(spark, sf):
    return dl.agreement(rating_pairs(spark, sf)).withColumns({c: R(c) for c in ("mean_a", "mean_b", "exact", "within_1")})


@query("l9_quadratic_kappa", f"""
 WITH c AS (SELECT dim, pair, a, z, count(*) AS o FROM v_rate_pair GROUP BY 1, 2, 3, 4), n AS (SELECT dim, pair, sum(o) AS n FROM c GROUP BY 1, 2),
  pa AS (SELECT dim, pair, a, sum(o) AS o FROM c GROUP BY 1, 2, 3), pz AS (SELECT dim, pair, z, sum(o) AS o FROM c GROUP BY 1, 2, 3),
  w AS (SELECT dim, pair, sum((a - z) * (a - z) / 4.0 * o) AS x FROM c GROUP BY 1, 2), e AS (SELECT pa.dim, pa.pair, sum((a - z) * (a - z) / 4.0 * pa.o * pz.o) AS x FROM pa JOIN pz ON pa.dim = pz.dim AND pa.pair = pz.pair GROUP BY 1, 2)
 SELECT n.dim, n.pair, CAST(n.n AS BIGINT) AS n, {r6('1 - (w.x / n.n) / (e.x / n.n / n.n)')} AS kappa FROM n JOIN w ON w.dim = n.dim AND w.pair = n.pair JOIN e ON e.dim = n.dim AND e.pair = n.pair""")
def l9(spark, sf):
    return dl.quadratic_kappa(rating_pairs(spark, sf)).withColumn("kappa", R("kappa"))


@query("l10_krippendorff_alpha", f"""
 WITH f AS (SELECT dim, score, count(*) AS c FROM v_rate_long GROUP BY 1, 2), de AS (SELECT a.dim, sum(a.c * z.c * (a.score - z.score) * (a.score - z.score)) AS x FROM f a JOIN f z ON a.dim = z.dim GROUP BY 1),
  tot AS (SELECT dim, CAST(sum(c) AS DOUBLE) AS n FROM f GROUP BY 1), d AS (SELECT x.dim, sum((x.score - z.score) * (x.score - z.score)) AS x, count(DISTINCT x.item) AS items FROM v_rate_long x JOIN v_rate_long z ON x.item = z.item AND x.dim = z.dim AND x.rater < z.rater GROUP BY 1)
 SELECT d.dim, d.items AS n_items, {r6('1 - (d.x / (d.items * 3)) / (de.x / (tot.n * (tot.n - 1)))')} AS alpha FROM d JOIN de ON d.dim = de.dim JOIN tot ON tot.dim = d.dim""")
def l10(spark, sf):
    return dl.krippendorff_alpha(ratings(spark, sf), 3).withColumn("alpha", R("alpha"))


@query("l11_judge_summary", f"""
 SELECT CASE WHEN GROUPING(form) = 1 THEN 'all' ELSE form END AS "group", dim, count(*) AS n, {r6('avg(score)')} AS mean, {r6('count_if(score >= 1) / count(*)')} AS share_ge_1, {r6('count_if(score = 2) / count(*)')} AS share_eq_2
 FROM v_rate_long JOIN v_docs d ON d.doc_id = item WHERE rater = 'j' GROUP BY GROUPING SETS ((form, dim), (dim))""")
def l11(spark, sf):
    j = ratings(spark, sf).where(F.col("rater") == "j").groupBy("item").agg(*[F.max(F.when(F.col("dim") == d, F.col("score"))).alias(d) for d in ("entailment", "relevance")])
    w = j.join(b.docs(spark, sf, text=False).select(F.col("doc_id").alias("item"), "form"), "item")
    return dl.judge_summary(w, ["entailment", "relevance"], "form").withColumns({c: R(c) for c in ("mean", "share_ge_1", "share_eq_2")})


@query("l12_match_texts", """
 WITH a AS (SELECT sha256(text) AS h, form, count(*) AS s FROM v_docs WHERE doc_id % 2 = 0 GROUP BY 1, 2), z AS (SELECT sha256(text) AS h, k, count(*) AS e FROM v_docs WHERE doc_id % 3 <> 0 GROUP BY 1, 2)
 SELECT form, k, CAST(sum(s * e) AS BIGINT) AS n_matches, CAST(sum(s) AS BIGINT) AS n_slots, CAST(sum(e) AS BIGINT) AS n_entries FROM a JOIN z USING (h) GROUP BY 1, 2""")
def l12(spark, sf):
    d = b.docs(spark, sf)
    return dl.match_texts(d.where(F.col("doc_id") % 2 == 0), d.where(F.col("doc_id") % 3 != 0), "text", "form", "k")


@query("l13_pick_cases", """
 SELECT * FROM (SELECT 'grounded_hit' AS "case", a.k, a.t FROM v_agree a JOIN v_ev e ON a.k = e.k AND a.t = e.t WHERE e.label = 'reduce' AND e.pred = 'reduce' ORDER BY a.dis DESC, a.k, a.t LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'least_agreement', k, t FROM v_agree ORDER BY agree, k, t LIMIT 1)""")
def l13(spark, sf):
    e = b.evaluated(spark, sf).select("k", "t", "pred", "label")
    a = agreement(spark, sf).join(e, ["k", "t"])
    return dl.pick_cases(a, ["k", "t"], (F.col("label") == "reduce") & (F.col("pred") == "reduce"), "dis", "agree")


# ---------------------------------------------------------------- quality
@query("v1_quality_report", f"""
 WITH p AS (SELECT k, t, ret_1m, ret_12m, fwd_ret, label FROM (SELECT r.*, t2.label FROM v_ret r JOIN v_truth t2 ON r.k = t2.k AND r.t = t2.t))
 SELECT 'rows' AS "check", CAST(count(*) AS DOUBLE) AS value, NULL AS note FROM p UNION ALL SELECT 'entities', count(DISTINCT k), NULL FROM p
 UNION ALL SELECT 'start', NULL, strftime(min(t), '%Y-%m-%d') FROM p UNION ALL SELECT 'end', NULL, strftime(max(t), '%Y-%m-%d') FROM p
 {' '.join(f"UNION ALL SELECT 'label_count_{x}', count_if(label = '{x}'), NULL FROM p" for x in CLASSES)}
 UNION ALL SELECT 'column_present_ret_1m', 1, NULL UNION ALL SELECT 'column_present_monthly_rf', 0, NULL
 {' '.join(f"UNION ALL SELECT 'missing_rate_{x}', {r6(f'count_if({x} IS NULL) / count(*)')}, NULL FROM p" for x in ('k', 't', 'ret_1m', 'ret_12m', 'fwd_ret', 'label'))}""")
def v1(spark, sf):
    from ..functions.columns import band_label

    p = b.returns(spark, sf).select("k", "t", "ret_1m", "ret_12m", "fwd_ret", band_label("fwd_ret", b.EVAL_BAND).alias("label"))
    return ql.quality_report(sinks.settle(p), "k", "t", "label", ["ret_1m", "monthly_rf"]).withColumn("value", R("value"))


def yields(spark, sf):
    return cal.trailing_yield(cal.implied_dividends(b.px_daily(spark, sf), ["k"], "d", "close", "adj_close"), ["k"], "d", "div_amount", "close")


@query("v2_range_outliers", """
 SELECT k, count(y) AS n, count_if(y < 0) AS n_low, count_if(y > 0.15) AS n_high FROM (SELECT k, div_trailing / close AS y FROM v_yield) GROUP BY k""")
def v2(spark, sf):
    return ql.range_outliers(yields(spark, sf), "k", "div_yield", 0.0, 0.15)


@query("v2_payments_per_year", """
 SELECT n AS payments, count(*) AS n_entity_years FROM (SELECT k, year(t), count(*) AS n FROM v_yield WHERE div_month > 0 GROUP BY 1, 2) GROUP BY 1""")
def v2p(spark, sf):
    return ql.payments_per_year(yields(spark, sf), "k", "t", "div_month")


@query("v3_validate_records", f"""
 WITH r AS (SELECT k, t, seq, CASE WHEN k % 7 = 0 THEN p_i + 0.5 ELSE p_i END AS p_i, CASE WHEN k % 11 = 0 THEN NULL ELSE p_h END AS p_h, p_r, CASE WHEN k % 5 = 0 THEN ' ' ELSE CAST(k AS VARCHAR) END AS name,
   CASE WHEN seq = 6 THEN 'buy' ELSE {argmax_sql('p_i', 'p_h', 'p_r')} END AS signal FROM v_log)
 SELECT errors, errors = '' AS valid, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN trim(name) = '' THEN 'name must be a non-empty string' END,
   CASE WHEN p_i > 1 THEN 'p_i must be between 0 and 1' END, CASE WHEN p_h IS NULL THEN 'p_h must be numeric' END,
   CASE WHEN abs(p_i + p_h + p_r - 1) > 0.02 THEN 'probability sum must be within 0.02 of 1' END,
   CASE WHEN signal NOT IN ('increase', 'hold', 'reduce') THEN 'signal must be one of [''increase'', ''hold'', ''reduce'']' END], lambda x: x IS NOT NULL), '; ') AS errors FROM r) GROUP BY 1, 2""")
def v3(spark, sf):
    from ..functions.columns import argmax_label

    r = b.log_rows(spark, sf).select(
        "k", "t", "seq", F.when(F.col("k") % 7 == 0, F.col("p_i") + 0.5).otherwise(F.col("p_i")).alias("p_i"), F.when(F.col("k") % 11 != 0, F.col("p_h")).alias("p_h"), "p_r",
        F.when(F.col("k") % 5 == 0, " ").otherwise(F.col("k").cast("string")).alias("name"), F.when(F.col("seq") == 6, "buy").otherwise(argmax_label("p_i", "p_h", "p_r")).alias("signal"))
    out = ql.validate_records(r, ["name"], ["p_i", "p_h", "p_r"], {"signal": CLASSES})
    return out.groupBy("errors", "valid").agg(F.count("*").alias("n"))


@query("v4_truncated_series", """
 SELECT s AS series, min(d) AS first, min(d) - DATE '1995-01-01' > 95 AS truncated FROM (
  SELECT o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '' ELSE '+' END AS s, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus <> 'O' OR o_orderdate > TIMESTAMP '1995-06-01') GROUP BY 1""")
def v4(spark, sf):
    o = b.table(spark, sf, "orders").where((F.col("o_orderstatus") != "O") | (F.col("o_orderdate") > F.lit("1995-06-01").cast("timestamp")))
    s = o.select(F.concat("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "").otherwise("+")).alias("series"), F.to_date("o_orderdate").alias("d"))
    return ql.truncated_series(s, "series", "d", "1995-01-01")


@query("v5_duplicate_keys", "SELECT k, t, count(*) AS n FROM v_log GROUP BY 1, 2 HAVING count(*) > 1")
def v5(spark, sf):
    return joins.duplicate_keys(b.log_rows(spark, sf), ["k", "t"])


@query("v6_input_presence", """
 SELECT 'lineitem' AS source, true AS present, count(*) > 0 AS non_empty FROM lineitem UNION ALL SELECT 'labels', true, count(*) > 0 FROM labels UNION ALL SELECT 'absent', false, false""")
def v6(spark, sf):
    return ql.input_presence(spark, {n: f"{sf}/{n}.parquet" for n in ("lineitem", "labels", "absent")})


@query("v7_drift_summary", f"""
 SELECT split, count(*) AS n, {r6('avg(ret_1m)')} AS mean_ret_1m, {r6('avg(s1)')} AS mean_s1, {r6("avg(CASE WHEN label = 'reduce' THEN 1.0 ELSE 0.0 END)")} AS event_share
 FROM (SELECT {SPLIT_SQL} AS split, * FROM (SELECT r.t, r.ret_1m, x.label, f.s1 FROM v_ret r JOIN v_truth x ON x.k = r.k AND x.t = r.t LEFT JOIN v_rf f ON f.t = r.t)) WHERE t <= DATE '2001-12-31' GROUP BY 1""")
def v7(spark, sf):
    from ..functions.columns import band_label

    p = b.returns(spark, sf).join(b.macro_month(spark, sf).select("t", "s1"), "t", "left").withColumn("label", band_label("fwd_ret", b.EVAL_BAND))
    out = ql.drift_summary(sinks.time_split(p, "t", BOUNDS), "split", ["ret_1m", "s1"], F.col("label") == "reduce")
    return out.withColumns({c: R(c) for c in ("mean_ret_1m", "mean_s1", "event_share")})
