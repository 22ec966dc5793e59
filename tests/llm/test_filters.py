"""Filters, languages, shards and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, host_quality, language, queries, sharding, url_filter
from tests.llm.util import SCHEMA, documents, fixture, folded, prose, words

RULES = queries.URL_RULES


def test_url_rules_hosts_and_paths(spark):
    urls = ["https://A.Example.NET/en/1?x=/de/#y", "http://example.net", "http://example.net/fr/2", "http://notexample.com/de/",
            "http://m.example.com/de/9", "ftp://b.org/fr/", "http://org/fr/x", "nothing", None, "x://h?q=a://b", "http://a.net#t/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    model = url_filter.UrlModel(None, {}, 0.0)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, model, RULES).collect()}
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("example.net", "", None, "allow"),
        2: ("example.net", "/fr/2", "net/", "block"), 3: ("notexample.com", "/de/", None, "allow"),
        4: ("m.example.com", "/de/9", "example.com/de/", "block"), 5: ("b.org", "/fr/", "org/fr/", "allow"),
        6: ("org", "/fr/x", "org/fr/", "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("h", "", None, "allow"), 10: ("a.net", "", None, "allow")}


def test_url_trees_learn_lexical_signs(spark):
    rnd = random.Random(2)
    good = [f"https://{rnd.choice('abcdef')}site.org/read/page{i}" for i in range(150)]
    bad = [f"http://x{rnd.randrange(10**6)}-win-{i}.biz/?id={i}&ref={i}&go=1" for i in range(150)]
    rows = [(u, y) for y, part in ((0, good), (1, bad)) for u in part]
    df = spark.createDataFrame(rows, "url string, blocked int")
    model = url_filter.train(df.where("hash(url) % 2 = 0"), trees=3, depth=3)
    out = url_filter.judge(df.where("hash(url) % 2 <> 0"), model).collect()
    assert sum((r.verdict == "block") == r.blocked for r in out) / len(out) > 0.95
    assert url_filter.train(df.limit(0)).base == 0.0 and url_filter.train(df.where("blocked = 1")).base == 1.0
    assert url_filter.judge(df.limit(0), model).count() == 0


def test_host_quality_counts(spark):
    rows = fixture() + [(5, "x y\nx y\n\n  \n" + "# $ <" * 3)]
    got = {r.doc_id: r for r in host_quality.judge(documents(spark, rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = words(t)
        grams = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if grams[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and (not r.kept or not r.base_failed)


def test_host_verdicts_shrink_small_hosts(spark):
    rows = [("bad", True)] * 90 + [("bad", False)] * 10 + [("small", True)] + [("good", False)] * 400 + [(None, False)] * 50
    df = spark.createDataFrame(rows, "host string, failed boolean")
    got = {r.host: r for r in host_quality.host_verdicts(df).collect()}
    assert not got["bad"].host_ok and got["good"].host_ok and got[None].host_ok
    assert 0.2 < got["small"].shrunk_rate < 1.0
    assert host_quality.host_verdicts(df.limit(0)).count() == 0
    assert host_quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_communication_matrix():
    counts, sizes = [5, 0, 40, 7, 300], [88, 88, 88, 88]
    m = sharding.communication_matrix(counts, sizes, 3)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes
    rng = np.random.default_rng(0)
    draws = [sharding._draw(rng, 600_000_000, 900_000_000, 1000) for _ in range(300)]
    assert abs(np.mean(draws) - 400) < 4 and 10 < np.std(draws) < 22


@pytest.mark.parametrize("n, shards", [(0, 3), (2, 5), (500, 8)])
def test_shards_are_exact(spark, n, shards):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"))
    got = sharding.shuffle_into_shards(df, ["doc_id"], shards, group_rows=40).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shuffle_into_shards(df.repartition(5), ["doc_id"], shards, group_rows=40).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    if n == 500:
        place = [r.slot for r in sorted(got, key=lambda r: r.doc_id)]
        assert abs(np.corrcoef(place, range(n))[0, 1]) < 0.2


def test_shards_with_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None)], "doc_id long, _g string")
    got = sharding.shuffle_into_shards(df, ["doc_id"], 2).collect()
    assert len(got) == 4 and Counter(r.shard for r in got) == {0: 2, 1: 2}


def test_languages(spark):
    rnd = random.Random(4)
    sound = {"aa": ["la", "lo", "mi", "né"], "bb": ["str", "ung", "ich", "ß"], "cc": ["ko", "shi", "ta", "wu"]}
    rows = [(i, " ".join("".join(rnd.choice(sound[x]) for _ in range(3)) for _ in range(30)), x)
            for i, x in enumerate(rnd.choice(list(sound)) for _ in range(200))]
    rows += [(900, None, "aa"), (901, "123 !", "bb"), (902, "lalo", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    model = language.train(df.where(language.learns()))
    assert sorted(model) == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[:200]) and got[902].lang_pred == "aa"
    assert (got[900].lang_pred, got[901].lang_pred, got[901].score) == ("und", "und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(df, language.train(df.limit(0))).first().lang_pred == "und"


def test_profiles_are_the_most_frequent_ngrams(spark):
    rows = [(1, "ab ab, B", "x"), (2, "ab\n", "x")]
    got = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=4)["x"]
    grams = Counter()
    for t in ("_ab_ab_b_", "_ab_"):
        grams.update(g for n in (1, 2, 3) for k in range(len(t) - n + 1) for g in [t[k:k + n]]
                     if g != "_" and g[1:-1] != "_")
    top = sorted(grams.values(), reverse=True)[:4]

    def count(key):
        pad = {0: "_"}
        a, b, c = (int(key) >> 42) & 0x1FFFFF, (int(key) >> 21) & 0x1FFFFF, int(key) & 0x1FFFFF
        letter = lambda x: pad.get(x) or chr(x)
        if int(key) >> 62 == 3:
            return grams[letter(c)]
        return grams[letter(b) + letter(c)] if int(key) >> 63 else grams[letter(a) + letter(b) + letter(c)]

    assert [count(k) for k in got] == top


def brute_hits(text, items, window):
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    w, hit, found = re.findall(pattern, folded(text)), set(), set()
    for item, t in items:
        p = re.findall(pattern, folded(t))
        m = min(window, len(p))
        for k in range(len(p) - m + 1 if m else 0):
            for s in range(len(w) - m + 1):
                if w[s:s + m] == p[k:k + m]:
                    hit.update(range(s, s + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_words", [2_000_000, 40])
def test_decontamination(spark, max_words):
    rnd = random.Random(6)
    rows = fixture()
    items = [(i, prose(rnd, rnd.choice([1, 3, 12, 13, 14, 40]))) for i in range(12)]
    items += [(77, " ".join(words(rows[0][1] or rows[1][1])[3:25])), (78, None), (79, "?"), (80, "w1 w1 w1"), (80, "W1-w1, w1")]
    rows += [(2, "start " + items[4][1].upper() + ". end"), (3, items[77 - 65][1] + " tail" * 700)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows).withColumnRenamed("lang", "hits")
    got = decontaminate.contamination(decontaminate.find_windows(docs, bench, max_words=max_words)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = brute_hits(r.text or "", items, 13)
        assert (r.n_words, r.n_hit, r.item_ids, r.n_items) == (n, hit, found, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in got if not r.contaminated}
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
