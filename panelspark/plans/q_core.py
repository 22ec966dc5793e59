"""Sources, sinks, projections, joins, sets and scalar functions (S*, P*, J*, K*, U*, X*)."""

from pyspark.sql import functions as F

from ..functions import columns as c, text as tx
from ..functions.columns import CLASSES, band_label, r6 as R
from ..operators import calendar as cal, documents, joins, prep, ranking, sets, stats
from ..sources import bind as b, readers, sinks
from .registry import argmax_sql, cte, label_sql, query, r6

LINEITEM = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


# ---------------------------------------------------------------- sources and sinks
@query("s1_read_table", """
 SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS close FROM lineitem""")
def s1(spark, sf):
    t = readers.read_table(spark, f"{sf}/lineitem.parquet", LINEITEM,
                           {"close": ["adj_close", "Close", "l_extendedprice"], "ts": ["Date", "date", "l_shipdate"]})
    return t.select(F.col("l_suppkey").alias("k"), F.to_date("ts").alias("d"), "close")


@query("s2_pruned_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def s2(spark, sf):
    return b.table(spark, sf, "lineitem").select("l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def log_lines(spark, sf, spoil: bool = True):
    """The log as JSON lines; with `spoil`, some are cut short and some are blank."""
    rec = F.to_json(F.struct(
        F.date_format("t", "yyyy-MM-dd").alias("decision_date_t"), F.col("k").cast("string").alias("ticker"),
        F.lit("m1").alias("model_main"),
        F.struct(F.col("p_i").alias("increase"), F.col("p_h").alias("hold"), F.col("p_r").alias("reduce")).alias("final_probabilities"),
        F.struct((F.col("k") * 10 + F.col("seq")).alias("prompt"), (F.col("seq") * 7).cast("bigint").alias("completion"),
                 (F.col("seq") / 1000.0).alias("cost_usd")).alias("tokens"),
        F.col("seq").cast("bigint").alias("seq"),
    ))
    key = F.col("k") + F.col("seq") + F.dayofyear("t")
    line = rec
    if spoil:
        line = F.when(key % 13 == 0, F.substring(rec, 1, 40)).when(key % 17 == 0, F.lit("  ")).otherwise(rec)
    return b.log_rows(spark, sf).select(line.alias("value"))


_KEY = "(k + seq + dayofyear(t))"


@query("s3_read_decision_log", f"""
 SELECT k, 'good' AS kind, count(*) AS n, CAST(sum(k * 10 + seq) AS BIGINT) AS prompt_tokens, CAST(count_if(p_r = 0) AS BIGINT) AS n_zero
 FROM v_log WHERE {_KEY} % 13 <> 0 AND {_KEY} % 17 <> 0 GROUP BY k
 UNION ALL SELECT -1, 'corrupt', count(*), NULL, NULL FROM v_log WHERE {_KEY} % 13 = 0""")
def s3(spark, sf):
    path = sinks.new_path(spark, "log")
    log_lines(spark, sf).write.text(path)
    good, corrupt = readers.read_decision_log(spark, path)
    g = good.groupBy(F.col("ticker").cast("bigint").alias("k")).agg(
        F.count("*").alias("n"), F.sum("tokens.prompt").alias("prompt_tokens"),
        F.count_if(F.col("final_probabilities.reduce") == 0).alias("n_zero")).withColumn("kind", F.lit("good"))
    bad = corrupt.agg(F.count("*").alias("n")).select(F.lit(-1).cast("bigint").alias("k"), "n", F.lit("corrupt").alias("kind"))
    return g.unionByName(bad, allowMissingColumns=True)


@query("s4_document_names", """
 SELECT doc_id, upper(k) AS entity, form, filed, CAST(doc_id AS VARCHAR) AS accession FROM v_docs""")
def s4(spark, sf):
    d = b.docs(spark, sf, text=False)
    name = F.concat_ws("_", "k", "form", F.date_format("filed", "yyyy-MM-dd"), F.col("doc_id").cast("string"))
    return d.withColumn("name", F.concat(name, F.lit(".txt"))).select("doc_id", *[
        v.alias(n) for n, v in readers.file_name_parts(F.col("name")).items()])


@query("s4_folder_scan", """
 SELECT doc_id, upper(k) AS entity, form, filed, octet_length(encode(coalesce(text, ''))) AS n_bytes, md5(coalesce(text, '')) AS h FROM v_docs""")
def s4_folder(spark, sf):
    """The documents as files, scanned back."""
    d = b.docs(spark, sf)
    path = sinks.new_path(spark, "documents")
    name = F.concat(F.concat_ws("_", "k", "form", F.date_format("filed", "yyyy-MM-dd"), F.col("doc_id").cast("string")), F.lit(".txt"))
    readers.write_documents(d.withColumn("name", name), path, "name", "text")
    text = F.regexp_replace("text", r"\n\z", "")
    return readers.read_documents(spark, path).select(
        F.col("accession").cast("bigint").alias("doc_id"), "entity", "form", "filed", (F.col("n_bytes") - 1).alias("n_bytes"), F.md5(text).alias("h"))


@query("s5_flatten_index", """
 SELECT o_orderkey AS pos, f.form, f.filed, f.accession FROM orders, LATERAL (VALUES
   (o_orderpriority, CAST(o_orderdate AS DATE), 'A' || o_orderkey),
   (o_orderstatus, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE), 'B' || o_orderkey)) f(form, filed, accession)
 WHERE f.form IN ('1-URGENT', 'F', 'O') AND f.filed BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def s5(spark, sf):
    o = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pos"), F.array("o_orderpriority", "o_orderstatus").alias("forms"),
        F.array(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 30)).alias("dates"),
        F.array(F.concat(F.lit("A"), "o_orderkey"), F.concat(F.lit("B"), "o_orderkey")).alias("acc"))
    return readers.flatten_index(o, {"form": "forms", "filed": "dates", "accession": "acc"}, ["pos"],
                                 ["1-URGENT", "F", "O"], "1996-01-01", "1999-12-31")


@query("s6_flatten_facts", """
 SELECT v.pos AS id, v.concept, f.unit, f.pos, f.filed, f.val FROM v_facts v, LATERAL (VALUES
   ('USD', 0, v.filed, v.val, '10-K', 'FY'), ('USD', 1, CAST(v.filed + 90 AS DATE), v.val * 2, '10-Q', 'Q1'),
   ('shares', 0, v.filed, v.val / 4, CASE WHEN v.pos % 2 = 0 THEN '10-K/A' ELSE '8-K' END, NULL)) f(unit, pos, filed, val, form, fp)
 WHERE v.concept IN ('1-URGENT', '2-HIGH') AND (f.form LIKE '10-K%' OR f.fp = 'FY')""")
def s6(spark, sf):
    def fact(filed, val, form, fp):
        return F.struct(filed.alias("filed"), val.alias("val"), form.alias("form"), fp.cast("string").alias("fp"))

    amended = F.when(F.col("pos") % 2 == 0, "10-K/A").otherwise("8-K")
    nested = b.facts(spark, sf).select(F.col("pos").alias("id"), F.create_map(
        "concept", F.create_map(
            F.lit("USD"), F.array(fact(F.col("filed"), F.col("val"), F.lit("10-K"), F.lit("FY")),
                                  fact(F.date_add("filed", 90), F.col("val") * 2, F.lit("10-Q"), F.lit("Q1"))),
            F.lit("shares"), F.array(fact(F.col("filed"), F.col("val") / 4, amended, F.lit(None))))).alias("facts"))
    return readers.flatten_facts(nested, "facts", ["id"], ["1-URGENT", "2-HIGH"]).select(
        "id", "concept", "unit", "pos", "filed", "val")


@query("s7_union_sources", """
 SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source FROM customer
 UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier""")
def s7(spark, sf):
    return readers.union_sources({
        "customer": b.table(spark, sf, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        "supplier": b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))})


@query("s8_overwrite_table", "SELECT k, count(*) AS n FROM v_px GROUP BY k")
def s8(spark, sf):
    path = sinks.new_path(spark, "table")
    out = b.px_daily(spark, sf).groupBy("k").agg(F.count("*").alias("n"))
    sinks.write_table(out.withColumn("n", F.lit(0)), path)
    sinks.write_table(out, path)
    return spark.read.schema("k bigint, n bigint").parquet(path)


BOUNDS = {"train": ("1995-01-01", "1998-12-31"), "validation": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}
SPLIT_SQL = "CASE WHEN t <= DATE '1998-12-31' THEN 'train' WHEN t <= DATE '1999-12-31' THEN 'validation' ELSE 'test' END"


@query("s9_time_split", f"SELECT {SPLIT_SQL} AS split, k, t, {r6('fwd_ret')} AS fwd_ret FROM v_ret WHERE t BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'")
def s9(spark, sf):
    path = sinks.new_path(spark, "splits")
    s = sinks.time_split(b.returns(spark, sf).select("k", "t", "fwd_ret"), "t", BOUNDS)
    sinks.write_table(s, path, ["split"])
    return spark.read.schema("k bigint, t date, fwd_ret double, split string").parquet(path).select(
        "split", "k", "t", R("fwd_ret").alias("fwd_ret"))


@query("s10_append_log", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def s10(spark, sf):
    path = sinks.new_path(spark, "append")
    e = b.table(spark, sf, "events").select("event_id", "event_type")
    sinks.append_log(e, path)
    sinks.append_log(e, path)
    return spark.read.schema("event_id bigint, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- projections and filters
@query("p1_normalise_keys", """
 SELECT s_suppkey, upper(trim(s_name)) AS name, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS id10 FROM supplier""")
def p1(spark, sf):
    return b.table(spark, sf, "supplier").select("s_suppkey", c.upper_trim("s_name").alias("name"), c.zero_pad("s_suppkey", 10).alias("id10"))


@query("p2_membership", """
 SELECT k, d, close FROM v_px WHERE k IN (SELECT k FROM v_dim WHERE sector <> 'ASIA') AND k NOT IN
  (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def p2(spark, sf):
    universe = b.dim(spark, sf).where(F.col("sector") != "ASIA").select("k")
    marks = b.table(spark, sf, "supplier").where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("k"))
    px = b.px_daily(spark, sf).select("k", "d", "close")
    return px.join(universe, "k", "left_semi").join(marks, "k", "left_anti")


@query("p3_drop_incomplete", "SELECT k, t, volume FROM v_sig WHERE ret_12m IS NOT NULL AND adj_close IS NOT NULL AND volume IS NOT NULL")
def p3(spark, sf):
    m = cal.pct_change(b.price_month(spark, sf), ["k"], "t", "adj_close", {"ret_12m": 12})
    m = m.withColumn("ret_12m", c.clean("ret_12m"))
    return m.na.drop(subset=["ret_12m", "adj_close", "volume"]).select("k", "t", "volume")


@query("p4_date_slice", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'")
def p4(spark, sf):
    # the bounds have the column's own type, so that the filter reaches the scan
    kind = b.table(spark, sf, "lineitem").schema["l_shipdate"].dataType
    li = b.table(spark, sf, "lineitem").where(F.col("l_shipdate").between(
        F.lit("1997-03-01").cast(kind), F.lit("1997-03-31 23:59:59.999999").cast(kind)))
    return li.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"))


@query("p5_lossy_numbers", """
 SELECT p_type AS kind, count(*) AS n, count(TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)) AS n_num, sum(TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)) AS total,
  count(TRY_CAST(event_type AS DOUBLE)) AS n_text FROM (SELECT event_type AS p_type, * FROM events) GROUP BY 1""")
def p5(spark, sf):
    e = b.table(spark, sf, "events")
    num = c.to_number(F.regexp_extract("props", "([0-9]+)", 1))
    return e.groupBy(F.col("event_type").alias("kind")).agg(
        F.count("*").alias("n"), F.count(num).alias("n_num"), F.sum(num).alias("total"),
        F.count(c.to_number("event_type")).alias("n_text"))


@query("p6_coalesce_from", """
 SELECT s_suppkey AS k, coalesce(CASE WHEN s_acctbal > 5000 THEN n_name END, r_name) AS place, r_name AS region
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def p6(spark, sf):
    s = b.table(spark, sf, "supplier").join(b.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    left = s.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") > 5000, F.col("n_name")).alias("place"))
    d = b.dim(spark, sf).select("k", F.col("sector").alias("place"), F.col("sector").alias("region"))
    return prep.coalesce_from(left, d, ["k"], ["place", "region"])


@query("p7_band_label", f"""
 SELECT {label_sql('fwd_ret', '0.02::DOUBLE')} AS label, count(*) AS n, {r6('min(fwd_ret)')} AS lo, {r6('max(fwd_ret)')} AS hi FROM v_ret GROUP BY 1""")
def p7(spark, sf):
    r = b.returns(spark, sf).withColumn("label", band_label("fwd_ret", 0.02))
    return r.groupBy("label").agg(F.count("*").alias("n"), R(F.min("fwd_ret")).alias("lo"), R(F.max("fwd_ret")).alias("hi"))


GRID = (0.01, 0.02, 0.05, 0.1, 0.2)


@query("p8_label_grid", " UNION ALL ".join(f"""
 SELECT {g}::DOUBLE AS band, '{x}' AS label, count(*) FILTER (WHERE {label_sql('fwd_ret', f'{g}::DOUBLE')} = '{x}') AS n,
  {r6(f"count(*) FILTER (WHERE {label_sql('fwd_ret', f'{g}::DOUBLE')} = '{x}') / count(*)")} AS share FROM v_ret"""
    for g in GRID for x in CLASSES))
def p8(spark, sf):
    return prep.label_grid(b.returns(spark, sf), "fwd_ret", GRID).select("band", "label", "n", R("share").alias("share"))


_W = ("ret_1m", "ret_3m", "fwd_ret")


@query("p9_winsorize", f"""
 WITH q AS (SELECT {', '.join(f'quantile_cont({x}, {p}) AS {x}_{n}' for x in _W for n, p in (('lo', 0.01), ('hi', 0.99)))}
   FROM v_ret WHERE t <= DATE '1998-12-31')
 SELECT k, t, {', '.join(f'CASE WHEN {x} IS NOT NULL THEN {r6(f"least(greatest({x}, {x}_lo), {x}_hi)")} END AS {x}' for x in _W)} FROM v_ret, q""")
def p9(spark, sf):
    r = sinks.settle(b.returns(spark, sf).select("k", "t", *_W))
    w = prep.winsorize(r, _W, F.col("t") <= F.lit("1998-12-31").cast("date"))
    return w.select("k", "t", *[R(x).alias(x) for x in _W])


@query("p10_impute_median", f"""
 WITH q AS (SELECT quantile_cont(ret_12m, 0.5) AS m12, quantile_cont(ret_3m, 0.5) AS m3 FROM v_ret WHERE t <= DATE '1998-12-31')
 SELECT k, t, {r6('coalesce(ret_12m, m12)')} AS ret_12m, {r6('coalesce(ret_3m, m3)')} AS ret_3m FROM v_ret, q""")
def p10(spark, sf):
    r = sinks.settle(b.returns(spark, sf).select("k", "t", "ret_12m", "ret_3m"))
    w = prep.impute_median(r, ["ret_12m", "ret_3m"], F.col("t") <= F.lit("1998-12-31").cast("date"))
    return w.select("k", "t", R("ret_12m").alias("ret_12m"), R("ret_3m").alias("ret_3m"))


ROLES = {"ret_1m": "input", "ret_12m": "input", "fwd_ret": "target", "s1": "input"}


@query("p11_feature_inventory", f"""
 WITH p AS (SELECT r.t, r.ret_1m, r.ret_12m, r.fwd_ret, f.s1 FROM v_ret r LEFT JOIN v_rf f ON r.t = f.t),
  l AS ({' UNION ALL '.join(f"SELECT t, '{x}' AS feature, {x} AS value FROM p" for x in ROLES)}),
  x AS (SELECT feature, avg(s) AS xs FROM (SELECT feature, t, stddev_pop(value) AS s FROM l GROUP BY 1, 2) GROUP BY 1),
  cv AS (SELECT feature, count(value) / count(*) AS cov FROM l GROUP BY 1)
 SELECT feature, CASE WHEN feature = 'fwd_ret' THEN 'target' ELSE 'input' END AS role, {r6('cov')} AS coverage, {r6('xs')} AS xs_sd,
  coalesce(xs > 1e-9, false) AS has_signal, feature <> 'fwd_ret' AND coalesce(xs > 1e-9, false) AS keep,
  CASE WHEN feature = 'fwd_ret' THEN 'role: target' WHEN cov = 0 THEN 'no data' WHEN NOT coalesce(xs > 1e-9, false) THEN 'constant within periods' ELSE 'varies across entities' END AS reason
 FROM x JOIN cv USING (feature)""")
def p11(spark, sf):
    p = b.returns(spark, sf).join(b.macro_month(spark, sf).select("t", "s1"), "t", "left")
    v = stats.feature_variation(p, "t", c.present(p, list(ROLES)))
    return prep.feature_inventory(v, ROLES).select(
        "feature", "role", R("coverage").alias("coverage"), R("xs_sd").alias("xs_sd"), "has_signal", "keep", "reason")


@query("p12_optional_features", "SELECT t, count(ret_3m) AS n_ret_3m, count(ret_12m) AS n_ret_12m FROM v_ret GROUP BY t")
def p12(spark, sf):
    r = b.returns(spark, sf)
    cols = c.present(r, ["ret_3m", "not_there", "ret_12m"])
    return c.require_columns(r, ["t"]).groupBy("t").agg(*[F.count(x).alias(f"n_{x}") for x in cols])


# ---------------------------------------------------------------- joins
@query("j1_equi_joins", f"""
 SELECT d.k, d.t, {r6('d.p_r')} AS p_r, {r6('r.fwd_ret')} AS fwd_ret FROM v_dec d LEFT JOIN v_ret r ON d.k = r.k AND d.t = r.t""")
def j1(spark, sf):
    d = b.decisions(spark, sf).select("k", "t", "p_r")
    return d.join(b.returns(spark, sf).select("k", "t", "fwd_ret"), ["k", "t"], "left").select(
        "k", "t", R("p_r").alias("p_r"), R("fwd_ret").alias("fwd_ret"))


@query("j2_outer_align", f"SELECT d, {', '.join(f'{r6(s)} AS {s}' for s in b.SERIES)} FROM v_macro")
def j2(spark, sf):
    m = b.macro_daily(spark, sf)
    parts = {s: m.where(F.col(s).isNotNull()).select("d", F.col(s).alias("v")) for s in b.SERIES}
    return joins.outer_align(parts, "d", "v").select("d", *[R(s).alias(s) for s in b.SERIES])


cte("v_months", "SELECT DISTINCT c_nationkey AS k, last_day(CAST(o_orderdate AS DATE)) AS t FROM orders JOIN customer ON o_custkey = c_custkey")


@query("j3_asof_join", """
 WITH f AS (SELECT k, concept, filed, arg_max(val, pos) AS val, max(pos) AS pos FROM v_facts GROUP BY 1, 2, 3),
  g AS (SELECT m.k, m.t, c.concept FROM v_months m, (SELECT DISTINCT concept FROM v_facts) c)
 SELECT g.k, g.t, g.concept, f.filed, f.val, f.pos FROM g ASOF LEFT JOIN f ON g.k = f.k AND g.concept = f.concept AND g.t >= f.filed""")
def j3(spark, sf):
    each = _fact_months(spark, sf).withColumn("concept", F.explode(F.array(*map(F.lit, NAMES))))
    return joins.asof_join(each, b.facts(spark, sf), ["k", "concept"], "t", "filed", ["val", "pos"], ["pos"])


def _fact_months(spark, sf):
    o = b.table(spark, sf, "orders").join(
        b.table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").alias("k"), F.last_day(F.to_date("o_orderdate")).alias("t")).distinct()


NAMES = {"1-URGENT": "assets", "2-HIGH": "liabilities", "3-MEDIUM": "debt", "4-NOT SPECIFIED": "interest", "5-LOW": "equity"}
cte("v_wide", "WITH f AS (SELECT k, concept, filed, arg_max(val, pos) AS val FROM v_facts GROUP BY 1, 2, 3), "
    "p AS (SELECT m.k, m.t, cc.concept FROM v_months m, (SELECT DISTINCT concept FROM v_facts) cc) SELECT k, t, "
    + ", ".join(f"max(val) FILTER (WHERE concept = '{x}') AS {n}" for x, n in NAMES.items())
    + " FROM (SELECT p.k, p.t, p.concept, f.val FROM p ASOF LEFT JOIN f ON p.k = f.k AND p.concept = f.concept AND p.t >= f.filed) GROUP BY 1, 2")


def facts_wide(spark, sf):
    return joins.asof_wide(_fact_months(spark, sf), b.facts(spark, sf), ["k"], "t", "filed", "concept", "val", NAMES, ["pos"])


@query("j4_asof_facts_wide", f"SELECT k, t, {', '.join(NAMES.values())} FROM v_wide")
def j4(spark, sf):
    return facts_wide(spark, sf).select("k", "t", *NAMES.values())


cte("v_docdates", "SELECT DISTINCT k, last_day(filed) AS t FROM v_docs")


def doc_dates(spark, sf):
    return b.docs(spark, sf, text=False).select("k", F.last_day("filed").alias("t")).distinct()


@query("j5_trailing_interval_join", """
 SELECT p.k, p.t, d.form, d.filed, d.doc_id FROM v_docdates p JOIN v_docs d ON p.k = d.k AND d.filed BETWEEN CAST(p.t - INTERVAL 6 MONTH AS DATE) AND p.t""")
def j5(spark, sf):
    return joins.interval_join(doc_dates(spark, sf), b.docs(spark, sf, text=False), ["k"], "t", "filed", months_back=6)


@query("j6_forward_interval_join", f"""
 SELECT k, t, count(*) AS n_out, {r6('ln(product(1 + ret_1m))')} AS log_growth_12m FROM (
  SELECT a.k, a.t, x.ret_1m FROM v_ret a JOIN v_ret x ON a.k = x.k AND x.t > a.t AND x.t <= CAST(a.t + INTERVAL 12 MONTH AS DATE))
 GROUP BY 1, 2""")
def j6(spark, sf):
    r = b.returns(spark, sf)
    after = r.select("k", F.col("t").alias("ts"), F.log(1 + F.col("ret_1m")).alias("growth"))
    tot = documents.forward_totals(r.select("k", "t"), after, ["k"], "t", "ts", {"n_out": F.lit(1).cast("bigint"), "growth": F.col("growth")}, 12)
    return tot.where(F.col("n_out") > 0).select("k", "t", "n_out", R("growth").alias("log_growth_12m"))


@query("j7_join_1to1", f"SELECT k, t, {r6('p_r')} AS p_r, label FROM v_ev")
def j7(spark, sf):
    tr = sinks.settle(b.truth(spark, sf).select("k", "t", "label"))
    dec = sinks.settle(b.decisions(spark, sf).select("k", "t", "p_r"))
    return joins.join_1to1(dec, tr, ["k", "t"], keep_all=False).select("k", "t", R("p_r").alias("p_r"), "label")


@query("j8_previous_record", """
 SELECT doc_id, lag(doc_id) OVER w AS prev_doc_id, lag(filed) OVER w AS prev_filed FROM v_docs
 WINDOW w AS (PARTITION BY k, form ORDER BY filed, doc_id)""")
def j8(spark, sf):
    return joins.previous_record(b.docs(spark, sf, text=False), ["k", "form"], "filed", "doc_id", ["filed"]).select(
        "doc_id", "prev_doc_id", "prev_filed")


@query("j9_spine_zero_fill", """
 WITH s AS (SELECT DISTINCT sector FROM v_dim), d AS (SELECT DISTINCT t FROM v_ev), x AS (SELECT unnest(['increase', 'hold', 'reduce']) AS strategy)
 SELECT x.strategy, d.t, s.sector, coalesce(n, 0) AS n FROM x, d, s LEFT JOIN
  (SELECT pred, t, sector, count(*) AS n FROM v_ev GROUP BY 1, 2, 3) e ON e.pred = x.strategy AND e.t = d.t AND e.sector = s.sector""")
def j9(spark, sf):
    e = _ev(spark, sf, "pred", "sector")
    cells = e.groupBy(F.col("pred").alias("strategy"), "t", "sector").agg(F.count("*").alias("n"))
    sp = joins.spine(e, "t", b.dim(spark, sf), "sector", CLASSES)
    return sp.join(cells, ["strategy", "t", "sector"], "left").select("strategy", "t", "sector", F.coalesce("n", F.lit(0)).alias("n"))


@query("j10_common_periods", """
 WITH e AS (SELECT DISTINCT sector, last_day(d) AS t, k FROM v_px JOIN v_dim USING (k) WHERE k % 7 <> month(d) % 7)
 SELECT sector, t, count(*) AS n FROM e WHERE t IN (SELECT t FROM e GROUP BY t HAVING count(DISTINCT sector) = (SELECT count(DISTINCT sector) FROM v_dim)) GROUP BY 1, 2""")
def j10(spark, sf):
    px = b.px_daily(spark, sf).where(F.col("k") % 7 != F.month("d") % 7).select("k", F.last_day("d").alias("t")).distinct()
    e = px.join(b.dim(spark, sf).select("k", "sector"), "k")
    n = b.dim(spark, sf).agg(F.countDistinct("sector").alias("n")).scalar()
    return joins.common_periods(e, "t", "sector", n).groupBy("sector", "t").agg(F.count("*").alias("n"))


@query("j11_compare_logs", """
 WITH a AS (SELECT k, t, pred FROM v_ev WHERE k % 10 <> 0), b AS (SELECT k, t, base_pred FROM v_ev WHERE k % 10 <> 1),
  j AS (SELECT pred, base_pred FROM a FULL JOIN b ON a.k = b.k AND a.t = b.t)
 SELECT count_if(pred IS NOT NULL AND base_pred IS NOT NULL) AS n_both, count_if(base_pred IS NULL) AS only_a, count_if(pred IS NULL) AS only_b,
  count_if(pred = base_pred) AS n_agree, count_if(pred <> 'reduce' AND base_pred = 'reduce') AS flags_added, count_if(pred = 'reduce' AND base_pred <> 'reduce') AS flags_removed FROM j""")
def j11(spark, sf):
    e = _ev(spark, sf, "pred", "base_pred")
    left = e.where(F.col("k") % 10 != 0).select("k", "t", "pred")
    right = e.where(F.col("k") % 10 != 1).select("k", "t", F.col("base_pred").alias("pred"))
    return joins.compare_logs(left, right, ["k", "t"], "pred", "reduce")


# ---------------------------------------------------------------- top-k
def _ev(spark, sf, *cols):
    named = [x for x in cols if isinstance(x, str)]
    return sinks.settle(b.evaluated(spark, sf, sector="sector" in named).select("k", "t", *cols))


@query("k1_top_n", "SELECT k, t, rk FROM (SELECT k, t, row_number() OVER (PARTITION BY t ORDER BY p_i - p_r DESC, k) AS rk FROM v_ev) WHERE rk <= 5")
def k1(spark, sf):
    e = b.evaluated(spark, sf).select("k", "t", (F.col("p_i") - F.col("p_r")).alias("score"))
    return ranking.top_n(e, ["t"], "score", "k", 5).select("k", "t", "rk")


@query("k2_top_share", """
 SELECT k, t, rk FROM (SELECT k, t, row_number() OVER (PARTITION BY t ORDER BY p_i - p_r DESC, k) AS rk, count(*) OVER (PARTITION BY t) AS n FROM v_ev)
 WHERE rk <= least(greatest(ceil(0.3::DOUBLE * n), 10), n)""")
def k2(spark, sf):
    e = _ev(spark, sf, (F.col("p_i") - F.col("p_r")).alias("score"))
    return ranking.top_share(e, ["t"], "score", "k", 0.3, 10).select("k", "t", "rk")


@query("k3_matched_budget", """
 SELECT k, t, rk FROM (SELECT k, t, row_number() OVER (PARTITION BY t ORDER BY q_r DESC, k) AS rk, count_if(pred = 'reduce') OVER (PARTITION BY t) AS b FROM v_ev)
 WHERE rk <= b""")
def k3(spark, sf):
    e = _ev(spark, sf, "q_r", "pred")
    return ranking.top_by_budget(e, ["t"], "q_r", "k", F.col("pred") == "reduce").select("k", "t", "rk")


BUDGETS = (0.05, 0.1, 0.15, 0.2, 0.287, 0.3, 0.4, 0.5)


@query("k4_budget_curve", " UNION ALL ".join(f"""
 SELECT {x}::DOUBLE AS budget, CAST(max(k0) AS BIGINT) AS k, count(*) AS n, count_if(rk <= k0 AND y) AS hits, {r6('count_if(rk <= k0 AND y) / count_if(y)')} AS recall,
  {r6('count_if(rk <= k0 AND y) / max(k0)')} AS precision, {r6('max(k0) / count(*)')} AS random_recall
 FROM (SELECT row_number() OVER (ORDER BY p_r DESC, uid) AS rk, label = 'reduce' AS y, round_even({x} * count(*) OVER (), 0) AS k0
   FROM (SELECT *, k * 100000 + date_diff('day', DATE '1990-01-01', t) AS uid FROM v_ev))""" for x in BUDGETS))
def k4(spark, sf):
    e = _ev(spark, sf, "p_r", "label").withColumn("uid", F.col("k") * 100000 + F.datediff("t", F.lit("1990-01-01")))
    out = ranking.budget_curve(e, "p_r", "uid", F.col("label") == "reduce", BUDGETS)
    return out.select("budget", "k", "n", "hits", *[R(x).alias(x) for x in ("recall", "precision", "random_recall")])


@query("k5_newest_in_window", """
 SELECT k, t, doc_id, filed, row_number() OVER (PARTITION BY k, t ORDER BY filed, doc_id) AS pos FROM (
  SELECT p.k, p.t, d.doc_id, d.filed, row_number() OVER (PARTITION BY p.k, p.t ORDER BY d.filed DESC, d.doc_id DESC) AS rn
  FROM v_docdates p JOIN v_docs d ON p.k = d.k AND d.filed BETWEEN CAST(p.t - INTERVAL 6 MONTH AS DATE) AND p.t) WHERE rn <= 5""")
def k5(spark, sf):
    hits = joins.interval_join(doc_dates(spark, sf), b.docs(spark, sf, text=False), ["k"], "t", "filed", months_back=6)
    return documents.newest(hits, ["k", "t"], "filed", "doc_id", 5).select("k", "t", "doc_id", "filed", "pos")


@query("k6_best_candidate", """
 SELECT k, n_obs, acc FROM (SELECT k, count(*) AS n_obs, CAST(count_if(pred = label) AS BIGINT) AS acc, count_if(pred = 'reduce') AS fired FROM v_ev GROUP BY k)
 ORDER BY acc DESC, n_obs ASC, fired DESC, k LIMIT 1""")
def k6(spark, sf):
    g = b.evaluated(spark, sf).groupBy("k").agg(
        F.count("*").alias("n_obs"), F.count_if(F.col("pred") == F.col("label")).alias("acc"), F.count_if(F.col("pred") == "reduce").alias("fired"))
    return sets.best_row(g, [F.desc("acc"), F.asc("n_obs"), F.desc("fired"), F.asc("k")]).select("k", "n_obs", "acc")


@query("k7_stratified_sample", """
 SELECT k, t, label FROM (SELECT k, t, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || k || '|' || strftime(t, '%Y-%m-%d')), k, t) AS rn FROM v_ev) WHERE rn <= 15""")
def k7(spark, sf):
    e = b.evaluated(spark, sf).select("k", "t", "label")
    return sets.stratified_sample(e, "label", ["k", "t"], 15, 42)


@query("g1_prefix_sums", f"""
 SELECT p_r, n, hits, CAST(sum(n) OVER (ORDER BY p_r DESC) AS BIGINT) AS cum_n, CAST(sum(hits) OVER (ORDER BY p_r DESC) AS BIGINT) AS cum_hits
 FROM (SELECT {r6('p_r')} AS p_r, count(*) AS n, count_if(label = 'reduce') AS hits FROM v_ev GROUP BY 1)""")
def g1(spark, sf):
    e = _ev(spark, sf, "p_r", "label").select(R("p_r").alias("p_r"), "label")
    out = ranking.ranked_totals(e, [], "p_r", {"n": F.lit(1).cast("bigint"), "hits": (F.col("label") == "reduce").cast("bigint")}, True)
    return out.select("p_r", "n", "hits", "cum_n", "cum_hits")


# ---------------------------------------------------------------- sets
@query("u1_union_tagged", f"""
 SELECT 'main' AS model, pred, count(*) AS n, {r6('avg(p_r)')} AS mean_p FROM v_ev GROUP BY 2
 UNION ALL SELECT 'base', base_pred, count(*), NULL FROM v_ev GROUP BY 2""")
def u1(spark, sf):
    e = _ev(spark, sf, "pred", "base_pred", "p_r")
    a = e.groupBy("pred").agg(F.count("*").alias("n"), R(F.avg("p_r")).alias("mean_p"))
    z = e.groupBy(F.col("base_pred").alias("pred")).agg(F.count("*").alias("n"))
    return readers.union_sources({"main": a, "base": z}, "model")


@query("u2_last_wins", f"SELECT k, t, max(seq) AS seq, {r6('arg_max(p_r, seq)')} AS p_r FROM v_log GROUP BY 1, 2")
def u2(spark, sf):
    return sets.last_wins(b.log_rows(spark, sf), ["k", "t"], "seq").select("k", "t", "seq", R("p_r").alias("p_r"))


@query("u3_first_wins", f"SELECT k, t, min(seq) AS seq, {r6('arg_min(p_r, seq)')} AS p_r FROM v_log GROUP BY 1, 2")
def u3(spark, sf):
    return sets.first_wins(b.log_rows(spark, sf), ["k", "t"], "seq").select("k", "t", "seq", R("p_r").alias("p_r"))


@query("u4_period_intersection", "SELECT t FROM v_ret INTERSECT SELECT t FROM v_mm WHERE s1 > 2.2 INTERSECT SELECT t FROM v_dec")
def u4(spark, sf):
    return sets.period_intersection(
        [b.returns(spark, sf), b.macro_month(spark, sf).where(F.col("s1") > 2.2), b.decisions(spark, sf)], "t")


# ---------------------------------------------------------------- scalar functions
@query("x1_normalise_text", r"""
 SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS letters,
  CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || ' [truncated]' ELSE text END AS short FROM documents""")
def x1(spark, sf):
    d = b.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(tx.collapse_space(F.lower("text"))).alias("h"),
                    F.length(tx.letters_only("text")).alias("letters"), tx.truncate("text", 500, " [truncated]").alias("short"))


TERMS = ("the", "ation", "risk", "en de", "ou", "zzz")


@query("x2_term_presence", f"""
 SELECT doc_id, {' + '.join(f"CAST(contains(lower(text), '{x}') AS INTEGER)" for x in TERMS)} AS n_terms FROM documents""")
def x2(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", tx.term_count("text", TERMS).alias("n_terms"))


MONEY, PERCENT, YEAR = r"\$\s?\d[\d,]*(?:\.\d+)?", r"\d+(?:\.\d+)?\s?%", r"\b(?:19|20)\d{2}\b"
cte("v_cited", """
 SELECT o_orderkey AS id, o_orderpriority AS kind, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v,
  concat('leverage: ', CAST(CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 1.05 ELSE o_totalprice END * 100 AS BIGINT) AS VARCHAR),
   ' paid $', CAST(o_custkey AS VARCHAR), ',000 or ', CAST(o_orderkey % 90 AS VARCHAR), '% in ', CAST(year(o_orderdate) AS VARCHAR),
   CASE WHEN o_orderkey % 3 = 0 THEN ' risk rising' ELSE '' END) AS fact FROM orders""")


def cited(spark, sf):
    o = b.table(spark, sf, "orders")
    v = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") * 1.05).otherwise(F.col("o_totalprice"))
    fact = F.concat(
        F.lit("leverage: "), F.bround(v * 100).cast("bigint").cast("string"), F.lit(" paid $"), F.col("o_custkey").cast("string"),
        F.lit(",000 or "), (F.col("o_orderkey") % 90).cast("string"), F.lit("% in "), F.year("o_orderdate").cast("string"),
        F.when(F.col("o_orderkey") % 3 == 0, " risk rising").otherwise(""))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.to_date("o_orderdate").alias("d"),
                    F.col("o_totalprice").alias("v"), fact.alias("fact"))


@query("x3_money_percent_year", r"""
 SELECT id, len(regexp_extract_all(fact, '\$\s?\d[\d,]*(?:\.\d+)?')) AS n_money, regexp_extract(fact, '\d+(?:\.\d+)?\s?%') AS pct,
  array_to_string(list_sort(list_distinct(regexp_extract_all(fact, '\b(?:19|20)\d{2}\b'))), ' ') AS years FROM v_cited""")
def x3(spark, sf):
    d = cited(spark, sf)
    return d.select("id", F.size(tx.tokens("fact", MONEY)).cast("bigint").alias("n_money"), F.coalesce(F.get(tx.tokens("fact", PERCENT), 0), F.lit("")).alias("pct"),
                    F.array_join(F.array_sort(F.array_distinct(tx.tokens("fact", YEAR))), " ").alias("years"))


@query("x4_key_value_number", r"""
 SELECT id, regexp_extract(fact, '^\s*([A-Za-z_]+)\s*:', 1) AS name, TRY_CAST(regexp_extract(fact, ':\s*(-?[0-9.]+)', 1) AS DOUBLE) AS value FROM v_cited""")
def x4(spark, sf):
    return cited(spark, sf).select("id", *[v.alias(n) for n, v in tx.key_value("fact").items()])


@query("x5_cited_dates", """
 SELECT id, d AS iso, d AS long, array_to_string(list_sort([strftime(d, '%Y-%m-%d'), strftime(CAST(d + 10 AS DATE), '%Y-%m-%d')]), ' ') AS all_dates FROM v_cited""")
def x5(spark, sf):
    say = F.concat(F.lit("filed "), F.date_format("d", "yyyy-MM-dd"), F.lit(" and on "), F.date_format(F.date_add("d", 10), "MMMM d, yyyy"), F.lit(" again"))
    one = F.concat(F.lit("see "), F.date_format("d", "MMMM d, yyyy"))
    d = cited(spark, sf).withColumn("say", say).withColumn("one", one)
    return d.select("id", F.get(tx.cited_dates(F.date_format("d", "yyyy-MM-dd")), 0).alias("iso"), F.get(tx.cited_dates("one"), 0).alias("long"),
                    F.array_join(F.transform(F.array_sort(tx.cited_dates("say")), lambda x: F.date_format(x, "yyyy-MM-dd")), " ").alias("all_dates"))


@query("x6_calendar_parts", """
 SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS plus1,
  CAST(last_day(CAST(o_orderdate AS DATE)) - INTERVAL 6 MONTH AS DATE) AS minus6, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS m0 FROM orders""")
def x6(spark, sf):
    d = F.to_date("o_orderdate")
    return b.table(spark, sf, "orders").select(
        "o_orderkey", c.month_end(d).alias("month_end"), F.add_months(d, 1).alias("plus1"), F.add_months(F.last_day(d), -6).alias("minus6"),
        F.year(d).alias("y"), F.month(d).alias("m"), F.trunc(d, "month").alias("m0"))


@query("x7_math", f"""
 SELECT c_custkey, {r6('sqrt(abs(c_acctbal))')} AS rt, {r6('ln(abs(c_acctbal) + 1)')} AS lg, least(greatest(c_acctbal, 0), 5000) AS clipped,
  round_even(c_custkey / 4.0, 0) AS half_even, abs(c_acctbal - c_acctbal * (1 + 1e-12)) <= 1e-10 + 1e-10 * abs(c_acctbal) AS same FROM customer""")
def x7(spark, sf):
    a = F.col("c_acctbal")
    return b.table(spark, sf, "customer").select(
        "c_custkey", R(F.sqrt(F.abs(a))).alias("rt"), R(F.log(F.abs(a) + 1)).alias("lg"), c.clip(a, 0, 5000).alias("clipped"),
        F.bround(F.col("c_custkey") / 4.0).alias("half_even"), c.is_close(a * (1 + 1e-12), a).alias("same"))


@query("x8_argmax_label", f"SELECT k, t, {argmax_sql('p_i', 'p_h', 'p_r')} AS label FROM v_dec")
def x8(spark, sf):
    return b.decisions(spark, sf).select("k", "t", c.argmax_label("p_i", "p_h", "p_r").alias("label"))


def agent_vectors():
    return F.array(*[c.prob_vector(f"{a}_i", f"{a}_h", f"{a}_r") for a in b.AGENTS])


_A = b.AGENTS
_CONF = [f"greatest({a}_i, {a}_h, {a}_r)" for a in _A]


@query("x9_vector_ops", f"""
 SELECT k, t, {r6('(' + ' + '.join(f'{a}_r' for a in _A) + ') / 4')} AS mean_r,
  {r6('(' + ' + '.join(f'{a}_r * {q}' for a, q in zip(_A, _CONF)) + ') / (' + ' + '.join(_CONF) + ')')} AS conf_r,
  {r6('(abs(disclosure_i - macro_i) + abs(disclosure_h - macro_h) + abs(disclosure_r - macro_r)) / 2')} AS tv FROM v_dec""")
def x9(spark, sf):
    d = b.decisions(spark, sf).withColumn("v", agent_vectors())
    tv = c.total_variation(c.prob_vector("disclosure_i", "disclosure_h", "disclosure_r"), c.prob_vector("macro_i", "macro_h", "macro_r"))
    return d.select("k", "t", R(c.vector_mean(F.col("v"))[2]).alias("mean_r"), R(c.vector_weighted_mean(F.col("v"))[2]).alias("conf_r"), R(tv).alias("tv"))


@query("x10_fenced_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value AS v FROM events")
def x10(spark, sf):
    e = b.table(spark, sf, "events").select("event_id", "value", F.concat(
        F.lit("Sure, here it is:\n```json\n{\"a\": "), F.col("props"), F.lit(", \"v\": "), F.col("value").cast("string"), F.lit("}\n```\nDone.")).alias("raw"))
    rec = F.from_json(tx.first_json_object("raw"), "a struct<k bigint>, v double")
    return e.select("event_id", rec["a"]["k"].alias("k"), rec["v"].alias("v"))


@query("x11_canonical_hash", """
 SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS h FROM orders""")
def x11(spark, sf):
    o = b.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("custkey"))
    return o.select("o_orderkey", tx.canonical_hash(["orderkey", "status", "custkey"]).alias("h"))


_Z = "nullif({}, 0)"


@query("x12_safe_ratios", f"""
 SELECT k, t, {r6('debt / nullif(assets, 0)')} AS leverage, {r6('liabilities / nullif(equity, 0)')} AS debt_to_equity,
  {r6('(equity + interest + coalesce(debt, 0)) / nullif(interest, 0)')} AS interest_cover, {r6('equity / nullif(2 * assets, 0)')} AS book_to_market,
  {r6('ln(2 * assets)')} AS ln_mktcap, {r6('(liabilities + coalesce(debt, 0)) / nullif(2 * assets, 0)')} AS ffo_yield FROM v_wide""")
def x12(spark, sf):
    w = facts_wide(spark, sf).withColumn("shares", F.lit(2.0))
    out = stats.safe_ratios(w, assets="assets", debt="debt", liabilities="liabilities", equity="equity", interest="interest",
                            income_cover="equity", income="liabilities", depreciation="debt", shares="shares", price="assets")
    names = ["leverage", "debt_to_equity", "interest_cover", "book_to_market", "ln_mktcap", "ffo_yield"]
    return out.select("k", "t", *[R(n).alias(n) for n in names])


@query("x13_nav_premium_grid", f"""
 SELECT k, t, cap, {r6('2 * assets / nullif(equity + interest, 0)')} AS book_premium,
  CASE WHEN liabilities / cap - coalesce(debt, 0) > 0 THEN {r6('2 * assets / (liabilities / cap - coalesce(debt, 0))')} END AS cap_premium
 FROM v_wide, (SELECT unnest([0.05::DOUBLE, 0.06::DOUBLE, 0.07::DOUBLE]) AS cap)""")
def x13(spark, sf):
    w = facts_wide(spark, sf).withColumn("mcap", F.col("assets") * 2)
    out = stats.nav_premium(w, "mcap", "equity", "interest", "liabilities", "debt", [0.05, 0.06, 0.07])
    return out.select("k", "t", "cap", R("book_premium").alias("book_premium"), R("cap_premium").alias("cap_premium"))


@query("x14_stars", f"""
 SELECT k, {r6('ts', 4)} AS tstat, CASE WHEN abs(ts) >= 2.576 THEN '***' WHEN abs(ts) >= 1.96 THEN '**' WHEN abs(ts) >= 1.645 THEN '*' ELSE '' END AS stars
 FROM (SELECT k, avg(ret_1m) / (stddev_samp(ret_1m) / sqrt(count(ret_1m))) AS ts FROM v_ret GROUP BY k)""")
def x14(spark, sf):
    g = b.returns(spark, sf).groupBy("k").agg((F.avg("ret_1m") / (F.stddev_samp("ret_1m") / F.sqrt(F.count("ret_1m")))).alias("ts"))
    return g.select("k", R("ts", 4).alias("tstat"), c.stars("ts").alias("stars"))
