"""Document and text jobs (N*)."""

from html.entities import name2codepoint

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.columns import r6 as R
from ..operators import documents as dc, evaluate as ev, ml, stats, windows as win
from ..sources import bind as b, sinks
from .q_core import doc_dates
from .registry import cte, query, r6


def _cut(tag: str, inner: str) -> str:
    return rf"regexp_replace({inner}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"


_HTML = _cut("table", _cut("style", _cut("script", "html")))
_HTML = rf"regexp_replace(regexp_replace({_HTML}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _n in [n for n in sorted(name2codepoint) if n != "amp"] + ["#39", "amp"]:  # the ampersand last
    _HTML = f"replace({_HTML}, '&{_n};', chr({name2codepoint.get(_n, 39)}))"


@query("n1_clean_html", rf"SELECT page_id, md5(x) AS h, length(x) AS n_chars FROM (SELECT page_id, trim(regexp_replace({_HTML}, '\s+', ' ', 'g')) AS x FROM pages)")
def n1(spark, sf):
    x = tx.let(tx.strip_html("html"), lambda x: F.struct(F.md5(x).alias("h"), F.length(x).alias("n_chars")))
    return b.table(spark, sf, "pages").select("page_id", x.alias("x")).select("page_id", "x.*")


STARTS, ENDS = ("tion the", " en de ", "er de"), ("ing the", "ent en", "re and")
_LEAST = lambda xs: "least(" + ", ".join(xs) + ")"


@query("n2_rough_section", f"""
 WITH a AS (SELECT doc_id, text, lower(text) AS low, {_LEAST([f"nullif(strpos(lower(text), '{s}'), 0)" for s in STARTS])} AS st FROM documents),
  e AS (SELECT *, {_LEAST([f"nullif(strpos(substr(low, st + 20), '{s}'), 0)" for s in ENDS])} AS en FROM a)
 SELECT doc_id, CASE WHEN st IS NULL THEN 0 ELSE length(x) END AS n_chars, md5(CASE WHEN st IS NULL THEN '' ELSE x END) AS h
 FROM (SELECT *, trim(substr(text, st, coalesce(en + 19, length(text))), ' ') AS x FROM e)""")
def n2(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", tx.slice_between("text", STARTS, ENDS).alias("x"))
    return d.select("doc_id", F.length("x").alias("n_chars"), F.md5("x").alias("h"))


SECTION = dict(header="(?i)of .{0,12}the", end="(?i)ing the", loose="(?i)de la", phrase="(?i)und ", min_chars=400)


def _starts(p: str) -> str:
    cut, hit = f"string_split_regex(text, '{p}')", f"regexp_extract_all(text, '{p}')"
    return f"""list_transform(range(1, len({hit}) + 1), lambda i: CAST(coalesce(list_sum(list_transform(list_slice({cut}, 1, i), lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(list_slice({hit}, 1, i - 1), lambda x: length(x))), 0) AS BIGINT))"""


cte("v_span0", f"SELECT k, form, filed, doc_id, text, length(text) AS n, {_starts(SECTION['header'])} AS h, {_starts(SECTION['end'])} AS e, {_starts(SECTION['loose'])} AS l, {_starts(SECTION['phrase'])} AS p FROM v_docs")
_NEXT = "list_min(list_filter(e, lambda v: v > {0}))"
cte("v_span1", f"""SELECT *, list_filter(h, lambda x: x < list_max(e)) AS cands, list_filter(h, lambda x: x < list_max(e) AND {_NEXT.format('x')} - x >= {SECTION['min_chars']}) AS longs FROM v_span0""")
cte("v_span", f"""
 SELECT *, CASE WHEN bounded THEN coalesce({_NEXT.format('start')}, n) ELSE n END AS stop FROM (SELECT k, form, filed, doc_id, text, n, e, l,
  coalesce(list_max(longs), list_max(cands), l[1], p[1], 0) AS start, (len(cands) > 0 OR len(l) > 0) AS bounded,
  CASE WHEN len(longs) > 0 THEN 'long' WHEN len(cands) > 0 THEN 'short' WHEN len(l) > 0 THEN 'loose' WHEN len(p) > 0 THEN 'phrase' ELSE 'whole' END AS path FROM v_span1)""")


def spans(spark, sf):
    return b.docs(spark, sf).withColumn("s", tx.section_span("text", **SECTION))


@query("n3_section_span", "SELECT doc_id, start, stop, path FROM v_span")
def n3(spark, sf):
    return spans(spark, sf).select("doc_id", "s.start", "s.stop", "s.path")


WINDOW = 3000


@query("n4_span_audit", f"""
 WITH a AS (SELECT form, doc_id, path IN ('long', 'short') AS found, start, coalesce(l[1], 0) AS old FROM v_span),
  x AS (SELECT *, found AND start >= old AND start < old + {WINDOW} AS inside FROM a)
 SELECT coalesce(form, 'all') AS form, count(*) AS n, count_if(found) AS n_found, count_if(inside) AS n_inside, {r6('count_if(inside) / nullif(count_if(found), 0)')} AS inside_share
 FROM x GROUP BY GROUPING SETS ((form), ())""")
def n4(spark, sf):
    d = spans(spark, sf).withColumn("old", F.coalesce(tx.first_match("text", SECTION["loose"]), F.lit(0)))
    found = F.col("s.path").isin("long", "short")
    inside = found & (F.col("s.start") >= F.col("old")) & (F.col("s.start") < F.col("old") + WINDOW)
    x = d.select(F.explode(F.array("form", F.lit("all"))).alias("form"), found.alias("found"), inside.alias("inside"))
    g = x.groupBy("form").agg(F.count("*").alias("n"), F.count_if("found").alias("n_found"), F.count_if("inside").alias("n_inside"))
    return g.withColumn("inside_share", R(F.col("n_inside") / F.nullif(F.col("n_found"), F.lit(0))))


@query("n5_attach_documents", """
 WITH pt AS (SELECT DISTINCT k, t FROM v_docdates), an AS (SELECT k, filed, max(doc_id) AS id FROM v_docs WHERE form = 'fr' GROUP BY 1, 2), qu AS (SELECT k, filed, max(doc_id) AS id FROM v_docs WHERE form = 'de' GROUP BY 1, 2),
  base AS (SELECT z.k, z.t, z.annual_id, qu.id AS quarterly_id FROM (SELECT pt.k, pt.t, an.id AS annual_id FROM pt ASOF LEFT JOIN an ON pt.k = an.k AND pt.t >= an.filed) z ASOF LEFT JOIN qu ON z.k = qu.k AND z.t >= qu.filed),
  ev AS (SELECT k, t, doc_id, row_number() OVER (PARTITION BY k, t ORDER BY filed, doc_id) AS slot FROM (SELECT pt.k, pt.t, d.doc_id, d.filed, row_number() OVER (PARTITION BY pt.k, pt.t ORDER BY d.filed DESC, d.doc_id DESC) AS rn
    FROM pt JOIN v_docs d ON d.k = pt.k AND d.form = 'en' AND d.filed BETWEEN CAST(pt.t - INTERVAL 6 MONTH AS DATE) AND pt.t) WHERE rn <= 5),
  w AS (SELECT k, t, annual_id AS doc_id, -1 AS slot FROM base WHERE annual_id IS NOT NULL UNION ALL SELECT k, t, quarterly_id, 0 FROM base WHERE quarterly_id IS NOT NULL UNION ALL SELECT k, t, doc_id, slot FROM ev),
  g AS (SELECT w.k, w.t, count_if(slot > 0) AS n_events, string_agg(CASE WHEN slot <= 0 THEN substr(text, start + 1, stop - start) ELSE text END, chr(10) ORDER BY slot) AS txt FROM w JOIN v_span s ON s.doc_id = w.doc_id GROUP BY 1, 2)
 SELECT base.k, base.t, annual_id, quarterly_id, coalesce(n_events, 0) AS n_events, md5(txt) AS h FROM base LEFT JOIN g ON base.k = g.k AND base.t = g.t""")
def n5(spark, sf):
    s = tx.section_span("text", **SECTION)
    section = F.substr(F.col("text"), s["start"] + 1, s["stop"] - s["start"])
    out = dc.attach_documents(doc_dates(spark, sf), b.docs(spark, sf), "k", "t", "fr", "de", "en", section)
    return out.select("k", "t", "annual_id", "quarterly_id", "n_events", F.md5("text").alias("h"))


@query("n6_recency_audit", """
 WITH hits AS (SELECT p.k, p.t, d.filed, row_number() OVER (PARTITION BY p.k, p.t ORDER BY d.filed, d.doc_id) AS rn FROM v_docdates p JOIN v_docs d ON p.k = d.k AND d.filed BETWEEN CAST(p.t - INTERVAL 6 MONTH AS DATE) AND p.t),
  g AS (SELECT k, t, count(*) AS n, string_agg(DISTINCT CASE WHEN rn > 5 THEN strftime(filed, '%Y-%m-%d') END, ';' ORDER BY CASE WHEN rn > 5 THEN strftime(filed, '%Y-%m-%d') END) AS dd FROM hits GROUP BY 1, 2)
 SELECT p.k, p.t, coalesce(n, 0) AS n_window, least(coalesce(n, 0), 5) AS n_kept, greatest(coalesce(n, 0) - 5, 0) AS n_dropped, coalesce(dd, '') AS dropped_dates, coalesce(n, 0) > 5 AS affected FROM v_docdates p LEFT JOIN g ON p.k = g.k AND p.t = g.t""")
def n6(spark, sf):
    return dc.recency_audit(doc_dates(spark, sf), b.docs(spark, sf, text=False), "k", "t", "filed", 6, 5)


NEG, UNC = [*tx.NEGATIVE_WORDS, "the", "en", "und"], [*tx.UNCERTAIN_WORDS, "of", "le", "die"]
_IN = lambda ws: ", ".join(f"'{w}'" for w in ws)


@query("n7_lexicon_fractions", f"""
 WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'))), ' +'), lambda x: x <> '') AS ws FROM documents)
 SELECT doc_id, {r6(f"len(list_filter(ws, lambda x: x IN ({_IN(NEG)}))) / greatest(len(ws), 1)")} AS negative, {r6(f"len(list_filter(ws, lambda x: x IN ({_IN(UNC)}))) / greatest(len(ws), 1)")} AS uncertain, len(ws) AS n_words FROM w""")
def n7(spark, sf):
    f = tx.word_fractions("text", {"negative": NEG, "uncertain": UNC})
    return b.table(spark, sf, "documents").select("doc_id", R(f["negative"]).alias("negative"), R(f["uncertain"]).alias("uncertain"), f["n_words"].alias("n_words"))


@query("n8_text_baseline")
def n8(spark, sf):
    d = b.docs(spark, sf).join(b.table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", F.when(F.col("toxic") == 1, "reduce").when(F.col("quality") == 1, "increase").otherwise("hold").alias("label"), (F.col("filed") <= F.lit("2025-02-28").cast("date")).alias("fit"))
    d = sinks.settle(d)
    out = None
    for name, pred in (("tfidf", ml.tfidf_baseline(d, "text", "label", F.col("fit"))), ("lexicon", ml.lexicon_baseline(d, "text", "label", F.col("fit")))):
        part = ev.per_class(pred.where(~F.col("fit")), "label", "pred").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumns({c: R(c) for c in ("recall", "precision", "f1")})


cte("v_pair", """SELECT doc_id, prev_id FROM (SELECT doc_id, length(text) AS n, lag(doc_id) OVER w AS prev_id, lag(length(text)) OVER w AS pn FROM v_docs WINDOW w AS (PARTITION BY k, form ORDER BY filed, doc_id)) WHERE prev_id IS NOT NULL""")
cte("v_tf", r"SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY 1, 2")
cte("v_change", """
 WITH c AS (SELECT p.doc_id AS pair, term, n AS a, 0.0::DOUBLE AS z FROM v_pair p JOIN v_tf USING (doc_id) UNION ALL SELECT p.doc_id, term, 0.0, n FROM v_pair p JOIN v_tf f ON f.doc_id = p.prev_id),
  g AS (SELECT pair, term, sum(a) AS a, sum(z) AS z, CASE WHEN sum(a) > 0 AND sum(z) > 0 THEN 1.0::DOUBLE ELSE ln(1.5) + 1 END AS idf FROM c GROUP BY 1, 2)
 SELECT pair AS doc_id, sum(a * idf * z * idf) / nullif(sqrt(sum(a * idf * a * idf) * sum(z * idf * z * idf)), 0) AS sim FROM g GROUP BY 1""")


@query("n9_text_change", f"SELECT p.doc_id, p.prev_id AS prev_doc_id, {r6('sim')} AS similarity, {r6('1 - sim')} AS changed FROM v_pair p LEFT JOIN v_change c ON p.doc_id = c.doc_id")
def n9(spark, sf):
    return dc.text_change(b.docs(spark, sf), ["k", "form"], "filed", "doc_id", "text").withColumns({c: R(c) for c in ("similarity", "changed")})


cte("v_fwd", """
 SELECT d.doc_id, count(x.doc_id) AS n, sum(x.y) AS y FROM v_docs d LEFT JOIN (SELECT k, filed, doc_id, CAST(toxic AS INTEGER) AS y FROM v_docs JOIN labels USING (doc_id)) x
  ON x.k = d.k AND x.filed > d.filed AND x.filed <= CAST(d.filed + INTERVAL 12 MONTH AS DATE) GROUP BY 1""")


def change_outcomes(spark, sf):
    docs = b.docs(spark, sf)
    ch = dc.text_change(docs, ["k", "form"], "filed", "doc_id", "text")
    lab = b.docs(spark, sf, text=False).join(b.table(spark, sf, "labels"), "doc_id")
    fwd = dc.forward_totals(b.docs(spark, sf, text=False), lab, ["k"], "filed", "filed", {"n": F.lit(1).cast("bigint"), "y": F.col("toxic").cast("bigint")}, 12)
    j = ch.select("doc_id", R("changed").alias("changed")).join(fwd.select("doc_id", "n", "y"), "doc_id")
    return sinks.settle(j.where((F.col("n") > 0) & F.col("changed").isNotNull()).select("doc_id", "changed", (F.col("y") / F.col("n")).alias("rate")))


cte("v_chout", f"SELECT c.doc_id, {r6('1 - sim')} AS changed, y / n AS rate FROM v_change c JOIN v_fwd f ON f.doc_id = c.doc_id WHERE n > 0 AND sim IS NOT NULL")


@query("n10_change_correlation", f"""
 SELECT count(*) AS n, {r6('corr(changed, rate)')} AS pearson, {r6('corr(rc, rr)')} AS spearman FROM (SELECT changed, rate,
  rank() OVER (ORDER BY changed) + (count(*) OVER (PARTITION BY changed) - 1) / 2.0 AS rc, rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0 AS rr FROM v_chout)""")
def n10(spark, sf):
    j = change_outcomes(spark, sf)
    p = j.agg(F.corr("changed", "rate").alias("p")).scalar()
    return stats.spearman(j, "changed", "rate").select("n", R(p).alias("pearson"), R("rho").alias("spearman"))


@query("n10_change_terciles", f"""
 WITH q AS (SELECT quantile_cont(changed, 1.0/3) AS e1, quantile_cont(changed, 2.0/3) AS e2 FROM v_chout)
 SELECT CASE WHEN changed > e2 THEN 3 WHEN changed > e1 THEN 2 ELSE 1 END AS bucket, count(*) AS n, {r6('avg(rate)')} AS mean_rate FROM v_chout, q GROUP BY 1""")
def n10t(spark, sf):
    q = win.quantile_bucket(change_outcomes(spark, sf), "changed", 3)
    return q.groupBy("bucket").agg(F.count("*").alias("n"), R(F.avg("rate")).alias("mean_rate"))


cte("v_alias", "SELECT k, regexp_extract(text, '[A-Za-z]{5,}') AS alias FROM (SELECT k, arg_min(text, doc_id) AS text FROM v_docs WHERE regexp_matches(text, '[A-Za-z]{5,}') GROUP BY k, form)")
cte("v_pat", "SELECT k, '(^|[^A-Za-z0-9])(?:' || string_agg(DISTINCT alias, '|' ORDER BY alias) || ')($|[^A-Za-z0-9])' AS pat FROM v_alias GROUP BY k")
_N_HITS = "len(regexp_extract_all(regexp_replace({0}, '([^A-Za-z0-9])', '\\1\\1', 'g'), '(?i)' || pat))"


def patterns(spark, sf):
    d = b.docs(spark, sf).where(F.regexp_like("text", F.lit("[A-Za-z]{5,}")))
    first = d.groupBy("k", "form").agg(F.min_by(F.regexp_extract("text", "[A-Za-z]{5,}", 0), "doc_id").alias("alias"))
    return dc.alias_patterns(first, "k", "alias")


_ONCE = "regexp_replace({0}, '(?i)' || pat, '\\1[ENTITY]\\2', 'g')"
_IDS = r"regexp_replace(regexp_replace({0}, '\b\d{{10}}-\d{{2}}-\d{{6}}\b', '[ID]', 'g'), '\b\d{{10}}\b', '[ID]', 'g')"


@query("n11_scrub_identity", f"""
 SELECT doc_id, md5({_IDS.format(_ONCE.format(_ONCE.format('text')))}) AS h FROM v_docs d JOIN v_pat p ON d.k = p.k""")
def n11(spark, sf):
    s = dc.scrub_identity(b.docs(spark, sf), patterns(spark, sf), "k", "text")
    return s.select("doc_id", F.md5("scrubbed").alias("h"))


@query("n12_leak_scan", rf"""
 SELECT doc_id, {_N_HITS.format('text')} + len(regexp_extract_all(text, '\b\d{{10}}\b')) + len(regexp_extract_all(text, '\b\d{{10}}-\d{{2}}-\d{{6}}\b')) AS hits_before, 0 AS hits_after FROM v_docs d JOIN v_pat p ON d.k = p.k""")
def n12(spark, sf):
    s = dc.scrub_identity(b.docs(spark, sf), patterns(spark, sf), "k", "text")
    s = dc.leak_hits(dc.leak_hits(s, "text", "hits_before"), "scrubbed", "hits_after", fail=True)
    return s.select("doc_id", "hits_before", "hits_after")


SYMBOLS, COMMON, GENERIC = ("ARE", "QZX", "ALL", "KIM", "V-X"), ("ARE", "ALL"), ("holdings", "trust")
PLANTED = (  # forms of an entity, and near misses; %s is its symbol
    "see www.%s.com today", "tag %s:DebtMember", "series %sprL and %sPRM", "the %s fund", "in%sword and %sx", "%s.common or %s: not",
    "North Realm Holdings", "north-realm, holdingsX", "Realms and trust", "NORTH  REALM")


_PLANT = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(PLANTED)) + " END"
_CASED = "CASE WHEN doc_id % 3 = 0 THEN lower(sym) WHEN doc_id % 3 = 1 THEN sym ELSE upper(substr(sym, 1, 1)) || lower(substr(sym, 2)) END"
cte("v_named", f"""SELECT doc_id, sym, text || ' ' || replace({_PLANT}, '%s', {_CASED}) || '.' AS text FROM (
 SELECT doc_id, coalesce(text, '') AS text, CASE length(k) % 5 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SYMBOLS))} END AS sym FROM v_docs)""")
_AT, _TO, _FIRST = "(^|[^A-Za-z0-9])", "($|[^A-Za-z0-9])", "'\\1[ENTITY]'"
_SYM = "replace(sym, '-', '\\-')"
_BOTH = "'\\1[ENTITY]\\2'"
_USES = r"(\.(?:com|net|org)\b|:[A-Za-z]|pr[A-Za-z])"


def _masked(c: str) -> str:
    """The forms one after the other, each twice, with the letters around them put back."""
    name = r"(?i)" + _AT + r"north[\s\-–,\.]{0,3}realm[\s\-–,\.]{0,3}holdings"
    for pattern, to in (
            (f"'{name}'", _FIRST), (f"'(?i){_AT}(?:north|realm){_TO}'", _BOTH),
            (f"CASE WHEN sym IN ('ARE', 'ALL') THEN '' ELSE '(?i)' END || '{_AT}(?:' || {_SYM} || '){_TO}'", _BOTH),
            (f"'(?i){_AT}(?:' || {_SYM} || '){_USES}'", _BOTH)):
        for _ in range(2):
            c = f"regexp_replace({c}, {pattern}, {to}, 'g')"
    return c


@query("n11_identity_forms", f"""
 SELECT doc_id, md5({_IDS.format('s')}) AS h, CAST((length(s) - length(replace(s, '[ENTITY]', ''))) / 8 AS BIGINT) AS n_masked, s <> {_masked('s')} AS leak
 FROM (SELECT doc_id, sym, {_masked('text')} AS s FROM v_named)""")
def n11_forms(spark, sf):
    """Documents with planted forms and near misses, scrubbed of their entity's identity."""
    d = b.docs(spark, sf)
    sym = F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.length("k") % 5 + 1).cast("int"))
    cased = F.when(F.col("doc_id") % 3 == 0, F.lower("sym")).when(F.col("doc_id") % 3 == 1, F.col("sym")).otherwise(
        F.concat(F.upper(F.substring("sym", 1, 1)), F.lower(F.expr("substr(sym, 2)"))))
    plant = F.element_at(F.array(*map(F.lit, PLANTED)), (F.col("doc_id") % 10 + 1).cast("int"))
    named = d.withColumn("sym", sym).withColumn("text", F.concat(
        F.coalesce("text", F.lit("")), F.lit(" "), F.replace(plant, F.lit("%s"), cased), F.lit(".")))
    entities = named.select("sym").distinct().withColumn("names", F.array(F.lit("North Realm Holdings")))
    patterns = dc.identity_patterns(entities, "sym", "sym", "names", GENERIC, COMMON)
    s = dc.leak_hits(dc.scrub_identity(named, patterns, "sym", "text"), "scrubbed")
    n = F.regexp_count("scrubbed", F.lit(r"\[ENTITY\]")).cast("bigint")
    return s.select("doc_id", F.md5("scrubbed").alias("h"), n.alias("n_masked"), (F.col("hits") > 0).alias("leak"))


@query("n13_parse_worksheet", """
 SELECT doc_id AS sheet, f.name, f.day, f.dim, f.score FROM labels, LATERAL (VALUES
  ('AAA', DATE '2024-01-31', 'entailment', quality + toxic), ('AAA', DATE '2024-01-31', 'relevance', quality), ('AAA', DATE '2024-01-31', 'actionability', toxic),
  ('BB', DATE '2024-02-29', 'entailment', CAST(doc_id % 3 AS INTEGER)), ('BB', DATE '2024-02-29', 'relevance', 2), ('BB', DATE '2024-02-29', 'actionability', NULL)) f(name, day, dim, score)""")
def n13(spark, sf):
    line = lambda d, v: F.concat(F.lit(f"- {d} (0-2) = "), v.cast("string"), F.lit("\n"))
    sheet = F.concat(
        F.lit("# scores\n\n## 1. AAA — 2024-01-31\ntext\n"), line("entailment", F.col("quality") + F.col("toxic")), line("relevance", F.col("quality")), line("actionability", F.col("toxic")),
        F.lit("\n## 2. BB - 2024-02-29\n"), line("entailment", F.col("doc_id") % 3), line("relevance", F.lit(2)), F.lit("- actionability (0-2) = ___\n"))
    return dc.parse_worksheet(b.table(spark, sf, "labels").select(F.col("doc_id").alias("sheet"), sheet.alias("text")), "text", ["sheet"], ["entailment", "relevance", "actionability"])
