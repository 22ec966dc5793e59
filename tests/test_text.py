import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from panelspark.functions import text as tx
from panelspark.operators import documents as dc
from panelspark.sources.sinks import settle

HEADER, END = r"(?is)item\s*1\s*a\b.{0,40}?r\s*i\s*s\s*k\s*f\s*a\s*c\s*t\s*o\s*r\s*s", r"(?i)item\s*1\s*b"
LOOSE, PHRASE = r"(?i)item\s*1a", r"(?i)risk factors"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first().y


def span(spark, text):
    return tuple(one(spark, text, tx.section_span("x", HEADER, END, LOOSE, PHRASE, 5000)))


def test_section_prefers_the_last_long_header(spark):
    toc = "Item 1A. Risk Factors 5 Item 1B. Unresolved 9 "
    cross = "as set forth in Item 1A Risk Factors below. "
    body = "Item 1A. Ris k Factors " + "word " * 1500
    text = toc + cross + "x" * 6000 + body + "see Item 1A risk factors. Item 1B. Staff comments"
    start, stop, path = span(spark, text)
    assert path == "long" and start == text.index(body) and stop == text.rindex("Item 1B")


def test_section_fallbacks(spark):
    short = "Item 1A risk factors small Item 1B end"
    assert span(spark, short) == (0, short.index("Item 1B"), "short")
    loose = "intro item 1a only text"
    assert span(spark, loose) == (6, len(loose), "loose")
    phrase = "about Risk Factors here"
    assert span(spark, phrase) == (6, len(phrase), "phrase")
    assert span(spark, "nothing") == (0, 7, "whole")


def _span_by_hand(text, header, end, loose, phrase, least):
    h, e, l, p = ([m.start() for m in re.finditer(x, text)] for x in (header, end, loose, phrase))
    after = lambda x: min((v for v in e if v > x), default=None)
    counting = [x for x in h if after(x) is not None]
    long = [x for x in counting if after(x) - x >= least]
    if counting:
        x = (long or counting)[-1]
        return x, after(x), "long" if long else "short"
    if l:
        return l[0], after(l[0]) or len(text), "loose"
    return (p[0], len(text), "phrase") if p else (0, len(text), "whole")


def test_section_span_against_a_hand_search(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["HEAD", "END", "H", "E", "loose", "phrase", "xx", "é", "\x01"]) for _ in range(rnd.randrange(1, 25))) for _ in range(400)]
    args = ("HEAD|HE", "END", "loose|HEA", "phrase", 12)
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", tx.section_span("x", *args).alias("s")).collect()
    assert [tuple(r.s) for r in got] == [_span_by_hand(r.x, *args) for r in got]
    assert len({r.s.path for r in got}) == 5
    assert spark.createDataFrame([(None,)], "x string").select(tx.section_span("x", *args).alias("s")).first().s is None


def test_section_span_of_a_text_with_many_markers(spark):
    text = ("HEAD " + "word " * 9 + "END " + "w" * 46) * 100_000  # 10 MB and 200,000 markers
    began = time.monotonic()
    got = one(spark, text, tx.section_span("x", "HEAD", "END", "loose", "phrase", 40))
    assert tuple(got) == (100 * 99_999, 100 * 99_999 + 50, "long") and time.monotonic() - began < 30


def test_match_starts(spark):
    assert one(spark, "aXbbXXc", tx.match_starts("x", "X")) == [1, 4, 5]
    assert one(spark, "XaX", tx.match_starts("x", "X")) == [0, 2]
    assert one(spark, "none", tx.match_starts("x", "X")) == []


def test_rough_slice(spark):
    s = lambda t: one(spark, t, tx.slice_between("x", ["start one", "begin"], ["stop"], 20, 30))
    assert s("no section") == ""
    assert s("aa BEGIN stop then some more text stop tail") == "BEGIN stop then some more text"
    assert s("aa start one " + "z" * 50) == ("start one " + "z" * 50)[:30]


def test_html_tables_scripts_and_entities(spark):
    html = '<p>A&amp;B</p><SCRIPT x="1">var t="</p>";</SCRIPT><table><tr><td>no</td></tr></table><!-- gone --><b>C</b>&nbsp;D'
    assert one(spark, html, tx.strip_html("x")) == "A&B C D"


def _without_tables(html):
    """Pieces that no matched pair of marks encloses."""
    parts, pairs, opened = re.split(r"(<table[^>]*>|</table>)", html), [], []
    for i, p in enumerate(parts):
        if p.startswith("<table"):
            opened.append(i)
        elif p.startswith("</table") and opened:
            pairs.append((opened.pop(), i))
    return " ".join(p for i, p in enumerate(parts) if i % 2 == 0 and not any(a < i < b for a, b in pairs))


def test_blocks_at_any_depth(spark):
    deep = "a " + "<table><tr><td>x " * 50 + "y" + " z</table>" * 50 + " b"
    assert one(spark, deep, tx.strip_html("x")) == "a b"
    assert one(spark, "a <table> b <table> c </table> d", tx.strip_html("x")) == "a b d"  # the outer one is not closed
    assert one(spark, 'a <table title="x > </table> y"> gone </table> b <!-- <table> --> c', tx.strip_html("x")) == "a b c"
    assert one(spark, "a </table> b <TABLE\nx='1'> gone </Table > c <tablet>d</tablet>", tx.strip_html("x")) == "a b c d"
    rnd = random.Random(5)
    pages = ["".join(rnd.choice(["<table>", "</table>", "<table a='1'>", "p", "q ", "r"]) for _ in range(rnd.randrange(60))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in pages], "x string").select("x", tx.drop_blocks("x", "table").alias("y")).collect()
    assert [r.y.split() for r in got] == [_without_tables(r.x).split() for r in got]


def test_blocks_of_a_page_with_many_marks(spark):
    page = "keep <table> t <table> u </table> v </table> " * 30_000
    began = time.monotonic()
    assert one(spark, page, tx.strip_html("x")) == ("keep " * 30_000).strip()
    assert time.monotonic() - began < 30


def test_scan_over_chunks(spark):
    n = 2 * tx.CHUNKS[-1] + 3
    got = spark.range(1).select(tx.scan(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, x: a + x).alias("y")).first().y
    assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]
    assert spark.range(1).select(tx.scan(F.array().cast("array<int>"), F.lit(0), lambda a, x: a + x).alias("y")).first().y == []


def test_unicode_space_and_truncation(spark):
    assert one(spark, " a \n b ", tx.collapse_space("x")) == "a b"
    assert one(spark, "abcdef", tx.truncate("x", 3, "~")) == "abc~" and one(spark, "abc", tx.truncate("x", 3, "~")) == "abc"


def test_cited_dates(spark):
    t = "8-K filed on Jan. 5, 2024 and filed 2024-02-30, (8-K) March 3 2024; notes due 2029-01-01"
    assert one(spark, t, tx.cited_dates("x", tx.FILED_DATE)) == [dt.date(2024, 1, 5), dt.date(2024, 3, 3)]


def test_first_json_object(spark):
    assert one(spark, 'Hi ```json\n{"a": {"b": 1}}\n``` bye', tx.first_json_object("x")) == '{"a": {"b": 1}}'
    assert one(spark, "none", tx.first_json_object("x")) == ""


def _exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]


def test_terms_of_a_pair_are_counted_where_its_texts_meet(spark, monkeypatch):
    """Terms moved by document, then by pair, to a fixed number of tasks."""
    rows = [("a", dt.date(2024, 1, 1 + i), i, f"alpha beta{i % 3} gamma{i} é_{i % 2} alpha") for i in range(20)]
    docs = spark.createDataFrame(rows, "k string, d date, id bigint, text string")
    few = {tuple(r) for r in dc.text_change(docs, ["k"], "d", "id", "text").collect()}
    monkeypatch.setattr(dc, "CHARS", 100, raising=False)
    cut = dc.text_change(docs, ["k"], "d", "id", "text")
    chars = sum(len(a[3]) + len(b[3]) for a, b in zip(rows, rows[1:]))
    assert not any("_term" in x for x in _exchanges(cut)) and any("hashpartitioning(_pair#" in x and f", {-(-chars // 100)})" in x for x in _exchanges(cut))
    got = {tuple(r) for r in cut.collect()}
    assert {r[:2] for r in got} == {r[:2] for r in few} == {(i, i - 1) for i in range(1, 20)}
    assert sorted(r[2] for r in got) == pytest.approx(sorted(r[2] for r in few))


def test_texts_are_not_moved_to_few_entities(spark):
    rows = [(i, i % 2, f"{'AB'[i % 2]}corp said {i} " + " ".join(str((i * j) % 7919) for j in range(60))) for i in range(2000)]
    docs = settle(spark.createDataFrame(rows, "id bigint, k int, text string"))
    patterns = docs.groupBy("k").agg(F.concat(F.lit("(?i)"), F.min(F.split("text", " ")[0])).alias("pattern"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 50_000)
    try:
        out = dc.scrub_identity(docs, patterns, "k", "text")
        assert all("Broadcast" in x for x in _exchanges(out))
        assert {r.scrubbed.split(" ")[0] for r in out.collect()} == {"[ENTITY]"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_text_change_matches_hand_computation(spark):
    import math

    docs = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1, "red red blue " * 1), ("a", dt.date(2021, 1, 1), 2, "red green"), ("a", dt.date(2022, 1, 1), 3, "x")],
                                 "k string, d date, id bigint, text string")
    r = dc.text_change(docs, ["k"], "d", "id", "text", min_chars=5).collect()
    u = math.log(1.5) + 1
    want = 2 / math.sqrt((4 + u * u) * (1 + u * u))
    assert len(r) == 1 and (r[0].id, r[0].prev_id) == (2, 1) and math.isclose(r[0].similarity, want)


def test_scrub_and_leak_scan(spark):
    docs = spark.createDataFrame([("qzt", "QZT's plan: Alder Prop. (x) 0000123456, qztress, 1234567890-12-123456"), ("mno", "clean")], "k string, text string")
    al = spark.createDataFrame([("qzt", "QZT"), ("qzt", "Alder Prop.")], "k string, alias string")
    s = dc.scrub_identity(docs, dc.alias_patterns(al, "k", "alias"), "k", "text")
    got = {r.k: r for r in dc.leak_hits(dc.leak_hits(s, "text", "before"), "scrubbed", "after").collect()}
    assert got["qzt"].scrubbed == "[ENTITY]'s plan: [ENTITY] (x) [ID], qztress, [ID]"
    assert got["qzt"].after == 0 and got["qzt"].before >= 4 and got["mno"].before == 0
    with pytest.raises(Exception, match="identity left"):
        dc.leak_hits(s, "text", fail=True).collect()


def test_worksheet(spark):
    t = "intro\n## 1. ABC — 2024-01-31\nentailment (0-2) = 2\nrelevance = 1\n\n## 2. DE - 2024-02-29\nentailment = ___\nrelevance = 0\n"
    df = spark.createDataFrame([(1, t)], "s int, x string")
    got = sorted((r.name, r.dim, r.score) for r in dc.parse_worksheet(df, "x", ["s"], ["entailment", "relevance"]).collect())
    assert got == [("ABC", "entailment", 2), ("ABC", "relevance", 1), ("DE", "entailment", None), ("DE", "relevance", 0)]


def test_lexicon_shares(spark):
    f = tx.word_fractions("x", {"neg": ["risk", "loss"]})
    r = spark.createDataFrame([("Risk, no LOSS risk!\n",), ("",)], "x string").select(f["neg"].alias("neg"), f["n_words"].alias("n")).collect()
    assert (r[0].neg, r[0].n) == (0.75, 4) and (r[1].neg, r[1].n) == (0.0, 0)


def test_html_entities_nested_tables_and_unclosed_blocks(spark):
    html = ("caf&eacute; &#8217;x&#160;y &mdash; &#x41;&bogus; <table><tr><td><table>in</table></td></tr>out</table> z "
            "&amp;lt; <script>bad")
    assert one(spark, html, tx.strip_html("x")) == "café ’x y — A&bogus; z &lt;"


def test_first_json_object_ends_at_its_own_brace(spark):
    assert one(spark, 'a {"b": {"c": "}"}} and {"d": 1}', tx.first_json_object("x")) == '{"b": {"c": "}"}}'
    assert one(spark, "{ never closed {}", tx.first_json_object("x")) == ""


def _object_by_hand(text):
    at = text.find("{")
    depth, quoted, i = 0, False, at
    while 0 <= i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        else:
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return text[at:i + 1]
        i += 1
    return ""


def test_first_json_object_against_a_hand_scan(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice('{}"\\a\n ') for _ in range(rnd.randrange(40))) for _ in range(800)]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", tx.first_json_object("x").alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(t, _object_by_hand(t)) for t in texts]


def test_first_json_object_of_very_long_texts(spark):
    long = "x" * 10_000_000
    for text in ('{"a": "%s"}' % long, "{%s}" % long, "{" * 100_000 + "}" * 100_000, '{"a": "' + '\\"' * 500_000 + '"} {'):
        assert one(spark, "so: " + text + " done", tx.first_json_object("x")) == text.removesuffix(" {")
    assert one(spark, '{"' + '\\"' * 500_000 + "}", tx.first_json_object("x")) == ""


def test_section_without_end_runs_to_the_end(spark):
    text = "start here " + "x" * 150_000
    assert one(spark, text, tx.slice_between("x", ["start"], ["finish"])) == text


def test_key_value_names_are_small_letters(spark):
    assert one(spark, "Leverage: 3", tx.key_value("x")["name"]) == ""


def test_identity_forms_and_near_misses(spark):
    ents = spark.createDataFrame([("a", "ARE", ["North Realm Trust", "ARE"]), ("b", "BXP", None), ("c", None, []), ("d", "", ["V & Co"])],
                                 "k string, sym string, names array<string>")
    p = dc.identity_patterns(ents, "k", "sym", "names", ["trust"], ["ARE"])
    assert {r.k for r in p.collect()} == {"a", "b", "d"}
    docs = [
        ("a", "They are here; ARE fell. www.are.com, are:DebtMember, AREprL, Areprior", "They are here; [ENTITY] fell. www.[ENTITY].com, [ENTITY]:DebtMember, [ENTITY]prL, [ENTITY]prior"),
        ("a", "north–realm, Trust and NorthRealmTrustMember; Realm's, realms, Northern trust", "[ENTITY] and [ENTITY]Member; [ENTITY]'s, realms, Northern trust"),
        ("a", "careful share.com xAREprL are.common are: no", "careful share.com xAREprL are.common are: no"),
        ("b", "bxp's BXPx xbxp bxp.org BXP-7 0000012345", "[ENTITY]'s BXPx xbxp [ENTITY].org [ENTITY]-7 [ID]"),
        ("c", "nothing known", "nothing known"), ("d", "V & Co, v.co, vco, V Co-op, avco", "V & Co, [ENTITY], [ENTITY], [ENTITY]-op, avco"), ("a", None, None)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(docs)], "i int, k string, x string")
    got = {r.i: r.scrubbed for r in dc.scrub_identity(df, p, "k", "x").collect()}
    assert [got[i] for i in range(len(docs))] == [w for *_, w in docs]
