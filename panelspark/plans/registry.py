"""Query registry: a Spark build function and, where SQL can say the same, the SQL to check it against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BUILD: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTE: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTE[name] = body.strip()


def sql(body: str) -> str:
    """Prefix a SELECT with the named views it uses, directly or through other views."""
    need: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\b[a-z_][a-z_0-9]*\b", todo.pop()))
        for n in words & CTE.keys() - need:
            need.add(n)
            todo.append(CTE[n])
    ctes = [f"{n} AS ({b})" for n, b in CTE.items() if n in need]
    body = body.strip()
    if not ctes:
        return body
    head = f"WITH {', '.join(ctes)}"
    return f"{head}, {body[5:]}" if body.startswith("WITH ") else f"{head} {body}"


def query(name: str, check: str | None = None):
    def wrap(fn):
        BUILD[name] = fn
        if check is not None:
            SQL[name] = sql(check)
        return fn

    return wrap


def r6(expr: str, digits: int = 6) -> str:
    """The SQL twin of functions.columns.r6."""
    return f"(floor(CAST({expr} AS DOUBLE) * 1e{digits}::DOUBLE + 0.4999::DOUBLE) / 1e{digits}::DOUBLE)"


cte("v_px", """
 SELECT k, d, CAST(c AS DOUBLE) / (100.0::DOUBLE * volume) AS close,
        CAST(a AS DOUBLE) / (10000.0::DOUBLE * volume) AS adj_close, volume,
        CAST(c AS DOUBLE) / 100.0::DOUBLE AS day_value
 FROM (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d,
        sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c,
        sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS a,
        sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)""")
cte("v_dim", """
 SELECT s_suppkey AS k, s_name AS company, r_name AS sector FROM supplier
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
cte("v_macro", "SELECT CAST(o_orderdate AS DATE) AS d, " + ", ".join(
    f"CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderpriority = '{p}') AS DOUBLE) / "
    f"nullif(CAST(count(*) FILTER (WHERE o_orderpriority = '{p}') AS DOUBLE), 0) / 1e7::DOUBLE AS {s}"
    for s, p in (("s1", "1-URGENT"), ("s2", "2-HIGH"), ("s3", "3-MEDIUM"), ("s4", "4-NOT SPECIFIED"), ("s5", "5-LOW"))
) + " FROM orders GROUP BY 1")
cte("v_facts", """
 SELECT k, concept, end_d, CAST(end_d + CAST(pos % 400 AS INTEGER) AS DATE) AS filed, val, pos FROM (
 SELECT c_nationkey AS k, o_orderpriority AS concept, make_date(year(o_orderdate), 12, 31) AS end_d,
        o_totalprice AS val, o_orderkey AS pos FROM orders JOIN customer ON o_custkey = c_custkey)""")
cte("v_docs", """
 SELECT source AS k, lang AS form, CAST(DATE '2024-01-01' + CAST(doc_id % 720 AS INTEGER) AS DATE) AS filed, doc_id, text
 FROM documents""")
cte("v_pm", """
 SELECT s.k, s.t, p.close, p.adj_close, p.volume FROM (
   SELECT k, last_day(CAST(unnest(generate_series(min(date_trunc('month', d)), max(date_trunc('month', d)),
          INTERVAL 1 MONTH)) AS DATE)) AS t FROM v_px GROUP BY k) s
 LEFT JOIN (SELECT k, last_day(d) AS t, arg_max(close, d) AS close, arg_max(adj_close, d) AS adj_close,
          arg_max(volume, d) AS volume FROM v_px GROUP BY 1, 2) p ON s.k = p.k AND s.t = p.t""")
cte("v_sig", """
 SELECT *, CASE WHEN adj_close IS NOT NULL THEN max(adj_close) OVER (PARTITION BY k ORDER BY t) END AS running_max,
  pad / lag(pad, 1) OVER w - 1 AS ret_1m, pad / lag(pad, 3) OVER w - 1 AS ret_3m,
  pad / lag(pad, 6) OVER w - 1 AS ret_6m, pad / lag(pad, 12) OVER w - 1 AS ret_12m
 FROM (SELECT *, last_value(adj_close IGNORE NULLS) OVER (PARTITION BY k ORDER BY t
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pad FROM v_pm)
 WINDOW w AS (PARTITION BY k ORDER BY t)""")
cte("v_dret", """
 SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY k ORDER BY d) - 1 AS ret_d FROM v_px""")
cte("v_vol", """
 SELECT k, last_day(d) AS t, stddev_samp(ret_d) * sqrt(252.0::DOUBLE) AS vol_annualized FROM v_dret GROUP BY 1, 2""")
cte("v_ret", """
 SELECT * FROM (SELECT k, t, adj_close, close, volume, ret_1m, ret_3m, ret_12m,
   lead(ret_1m) OVER (PARTITION BY k ORDER BY t) AS fwd_ret FROM v_sig)
 WHERE fwd_ret IS NOT NULL""")


def label_sql(ret: str, band: str) -> str:
    return f"CASE WHEN {ret} > {band} THEN 'increase' WHEN {ret} < -({band}) THEN 'reduce' ELSE 'hold' END"


def argmax_sql(i: str, h: str, r: str) -> str:
    return f"CASE WHEN {i} >= {h} AND {i} >= {r} THEN 'increase' WHEN {h} >= {r} THEN 'hold' ELSE 'reduce' END"


cte("v_truth", f"SELECT k, t, fwd_ret, {label_sql('fwd_ret', '0.1::DOUBLE')} AS label FROM v_ret")
cte("v_mm", """
 SELECT t, """ + ", ".join(
    f"last_value({s} IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {s}"
    for s in ("s1", "s2", "s3", "s4", "s5")) + """
 FROM (SELECT sp.t, s1, s2, s3, s4, s5 FROM (
   SELECT last_day(CAST(unnest(generate_series(min(date_trunc('month', d)), max(date_trunc('month', d)),
          INTERVAL 1 MONTH)) AS DATE)) AS t FROM v_macro) sp
 LEFT JOIN (SELECT last_day(d) AS t, """ + ", ".join(
    f"arg_max({s}, d) FILTER (WHERE {s} IS NOT NULL) AS {s}" for s in ("s1", "s2", "s3", "s4", "s5")) + """
   FROM v_macro GROUP BY 1) m ON sp.t = m.t)""")
cte("v_rf", """
 SELECT t, s1, s2, s3, s4, s5, coalesce(last_value(r IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   first_value(r IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0::DOUBLE) AS monthly_rf
 FROM (SELECT *, s1 / 100.0::DOUBLE / 12.0::DOUBLE AS r FROM v_mm)""")

_SLICE = {"disclosure": 0, "macro": 1, "price": 2, "fundamentals": 3}
_UNI = {"i": "0.34::DOUBLE", "h": "0.33::DOUBLE", "r": "0.33::DOUBLE"}
_FLAG = {"i": "A", "h": "N", "r": "R"}
cte("v_dec", "SELECT l_suppkey AS k, last_day(CAST(l_shipdate AS DATE)) AS t, " + ", ".join(
    f"coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 0.0::DOUBLE) / sum(l_quantity) AS p_{n}"
    for n, f in _FLAG.items()) + ", " + ", ".join(
    f"coalesce(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = '{f}' AND l_linenumber % 4 = {s}), 0.0::DOUBLE) "
    f"/ sum(l_quantity) FILTER (WHERE l_linenumber % 4 = {s}), {_UNI[n]}) AS {a}_{n}"
    for a, s in _SLICE.items() for n, f in _FLAG.items()) + " FROM lineitem GROUP BY 1, 2")
cte("v_log", "SELECT l_suppkey AS k, last_day(CAST(l_shipdate AS DATE)) AS t, l_linenumber AS seq, " + ", ".join(
    f"coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 0.0::DOUBLE) / sum(l_quantity) AS p_{n}"
    for n, f in _FLAG.items()) + " FROM lineitem GROUP BY 1, 2, 3")
cte("v_ev", f"""
 SELECT d.*, d.price_r AS q_r, {argmax_sql('p_i', 'p_h', 'p_r')} AS pred,
   {argmax_sql('price_i', 'price_h', 'price_r')} AS base_pred, tr.fwd_ret, tr.label, dm.sector
 FROM v_dec d JOIN v_truth tr ON d.k = tr.k AND d.t = tr.t LEFT JOIN v_dim dm ON d.k = dm.k""")
