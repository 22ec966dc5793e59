"""Removal of repeats against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import line_dedup, ngram_join, substring_dedup
from panelspark.llm.components import components
from panelspark.llm.rarity import count_keys
from tests.llm.util import (
    SCHEMA, deduped_lines, documents, fixture, folded, least_reachable, set_links, shingle_set, words)


def removed_words(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if k in seen:
                gone[s:s + window] = [True] * window
            seen.add(k)
        out[i] = [x for x, g in zip(w, gone) if not g], len(w)
    return out


@pytest.mark.parametrize("window", [5, 20])
def test_substrings(spark, window):
    rows = [(i, t) for i, t in fixture()]
    got = substring_dedup.remove_repeats(documents(spark, rows), window=window).collect()
    want = removed_words([(i, t or "") for i, t in rows], window)
    assert {r.doc_id: (r.kept_text, r.n_words, r.n_removed) for r in got} == {
        i: (" ".join(k), n, n - len(k)) for i, (k, n) in want.items()}
    assert any(r.n_removed for r in got)


def test_substring_digest_nulls_and_clashing_columns(spark):
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame(
        [(1, text, "a", 5), (None, text, "b", 6), (1, text, "c", 7), (3, None, None, None)],
        "doc_id long, text string, key string, n_words long")
    got = substring_dedup.remove_repeats(df, digest=True).collect()
    whole, none = hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b"").hexdigest()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, str(r.key)) for r in got) == sorted([
        ("None", 30, 0, whole, "b"), ("1", 30, 30, none, "a"), ("1", 30, 30, none, "c"), ("3", 0, 0, none, "None")])


def test_parse_names_equal_stretches_alike():
    rng = np.random.default_rng(1)
    core = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    core[20:29] = core[20]
    first = np.concatenate((rng.integers(1, 99, 17).astype(np.uint64), core, core[:7]))
    second = np.concatenate((core[:1], core, rng.integers(1, 99, 5).astype(np.uint64)))
    found = []
    for text, at in ((first, 17), (second, 1)):
        levels = substring_dedup.parse(text, np.array([0, len(text)]))
        starts = np.arange(at, at + 41)
        found.append(substring_dedup.anchors(levels, starts, 20)[0])
    assert (found[0] == found[1]).all()


def test_lines(spark):
    rows = fixture()
    got = line_dedup.dedup_lines(documents(spark, rows)).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == deduped_lines(rows)
    assert sum(r.n_removed for r in got) > 20


def test_lines_second_round_takes_all_candidates(spark, monkeypatch):
    """With one candidate at once, the second round must find what is left."""
    rows = fixture(8)
    monkeypatch.setattr(line_dedup, "BEST", 1)
    got = line_dedup.dedup_lines(documents(spark, rows)).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == deduped_lines(rows)


def test_long_lines_of_common_words_are_no_candidates(spark):
    """Sets of 160 tokens with a Jaccard of about 0.5 share prefix tokens; maps of 64 bits let most of these pairs through."""
    rng = np.random.default_rng(3)
    common = " ".join(f"c{i}" for i in range(90))
    rows = [(i, common + " " + " ".join(f"w{j}" for j in rng.permutation(300)[:70])) for i in range(40)]
    rows.append((40, rows[7][1].replace("c1 ", "d1 ")))
    docs = documents(spark, rows).select(
        F.col("doc_id").alias("doc"), line_dedup._tag("text").alias("tag"), "text", F.lit(None).cast("array<int>").alias("probe"))
    counters = count_keys(docs.select("text"), line_dedup._piece_words)
    met = line_dedup._met(docs, counters, 80, None).where("a is not null")
    assert {(r.doc, r.line) for r in met.collect()} == {(40, 0)}
    got = line_dedup.dedup_lines(documents(spark, rows)).where("n_removed > 0")
    assert [(r.doc_id, r.n_removed) for r in got.collect()] == [(40, 1)]


@pytest.mark.parametrize("first, best", [(1, 2), (1, 1)])
def test_lines_by_other_candidates_where_the_nearest_fail(spark, monkeypatch, first, best):
    rows = fixture(8)
    monkeypatch.setattr(line_dedup, "FIRST", first)
    monkeypatch.setattr(line_dedup, "BEST", best)
    got = line_dedup.dedup_lines(documents(spark, rows)).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == deduped_lines(rows)


def test_lines_are_ordered_by_all_bits_of_their_tokens():
    of = np.array([1, 0, 1, 0, 1], dtype=np.int64)
    keys = np.array([5, 9, 4, 8, 5], dtype=np.uint64)  # equal in the upper bits that one sort compares
    assert (line_dedup._within(of, keys, 200) == np.lexsort((keys, of))).all()


def test_lines_ties_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(2, "a b c d\nx", 1, "p"), (None, "A B C D", 2, "q"), (2, "a b c d\nx", 3, "r"), (5, None, 4, "s"),
         (6, "a b c d e\n", 5, "t")], "doc_id long, text string, tag long, doc string")
    got = {(r.doc_id, r.tag): (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {(2, 1): ("x", 2, 1), (2, 3): ("x", 2, 1), (None, 2): ("A B C D", 1, 0), (5, 4): (None, 0, 0),
                   (6, 5): ("", 2, 1)}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 60)])
def test_near_duplicates(spark, n, percent):
    rows = fixture()
    sets = {i: shingle_set(t, n) for i, t in rows}
    got = ngram_join.near_duplicates(documents(spark, rows), n=n, percent=percent).collect()
    want = least_reachable(sets, set_links(sets, percent))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}


@pytest.mark.parametrize("block_sets", [1024, 3])
@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 60)])
def test_near_duplicates_count_all_links(spark, monkeypatch, n, percent, block_sets):
    """Links inside a component count too, also where it is split into blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block_sets)
    rows = fixture()
    sets = {i: shingle_set(t, n) for i, t in rows}
    want = Counter(x for pair in set_links(sets, percent) for x in pair)
    got = ngram_join.near_duplicates(documents(spark, rows), n=n, percent=percent).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: want[i] for i in sets}
    assert max(want.values()) > 2


@pytest.mark.parametrize("limits", [{}, {"LIST_SETS": 2, "GROUP_ENTRIES": 5}])
def test_list_pairs_are_those_that_share_enough_keys(spark, monkeypatch, limits):
    """Against all pairs of each list; lists cut into blocks give the same pairs."""
    for k, v in limits.items():
        monkeypatch.setattr(ngram_join, k, v)
    rng = np.random.default_rng(4)
    sets = {i: (int(rng.integers(20, 26)), int(rng.integers(1, 3)), int(rng.integers(0, 4))) for i in range(40)}
    entries = [(int(k), i, s, int(rng.integers(1, 9)), m, p) for i, (s, m, p) in sets.items() for k in rng.choice(9, 4, replace=False)]
    bits = {i: [int(x) for x in rng.integers(0, 2, 32) * rng.integers(0, 1 << 6, 32)] for i in sets}
    got = ngram_join._list_pairs(
        spark.createDataFrame(entries, "key long, id long, size long, rank int, match int, part long"),
        spark.createDataFrame([(i, s[0], bits[i]) for i, s in sets.items()], "set_id long, size long, sketch array<long>"), 60).collect()
    shared = Counter()
    for x in entries:
        for y in entries:
            least = (60 * (x[2] + y[2]) + 159) // 160
            m = max(x[4], y[4])
            if x[0] == y[0] and x[1] < y[1] and x[5] != y[5] and x[3] <= x[2] - least + m and y[3] <= y[2] - least + m:
                shared[x[1], y[1]] += 1

    def apart(a, b):
        x = [p ^ q for p, q in zip(bits[a], bits[b])]
        return sum((x[j] ^ x[j + 4] ^ x[j + 8] ^ x[j + 12] ^ x[j + 16] ^ x[j + 20] ^ x[j + 24] ^ x[j + 28]).bit_count() for j in range(4))

    want = {(a, b) for (a, b), n in shared.items() if n >= max(sets[a][1], sets[b][1]) and
            apart(a, b) <= (t := sets[a][0] + sets[b][0]) - 2 * ((60 * t + 159) // 160)}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 5


def test_near_duplicates_nulls_and_repeated_ids(spark):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame(
        [(None, text + " z", "a"), (4, text, "b"), (4, text, "c"), (7, "other words here now then", "d"), (8, None, "e"),
         (9, "", "f")], "doc_id long, text string, component string")
    got = sorted((str(r.doc_id), str(r.component_id), r.n_shingles) for r in ngram_join.near_duplicates(df).collect())
    assert got == sorted([("None", "None", 37), ("4", "None", 36), ("4", "None", 36), ("7", "7", 1), ("8", "8", 0), ("9", "9", 0)])
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.component for r in kept.collect()) == ["a", "d", "e", "f"]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (50, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.remove_repeats(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0
    assert ngram_join.keep_one(none).count() == 0


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    rows = fixture(11)
    docs = documents(spark, rows)
    cut = corpus_pipeline.remove_lines(spark, docs, "")
    assert cut.columns == docs.columns
    want = {i: t for i, (t, _, gone) in deduped_lines(rows).items() if not gone or words(t)}
    got = cut.collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    sets = {i: shingle_set(t, 5) for i, t in want.items()}
    root = least_reachable(sets, set_links(sets, 80))
    left = corpus_pipeline.remove_near_duplicates(spark, cut, "").collect()
    assert {r.doc_id for r in left} == {i for i in want if root[i] == i}
    assert folded("AbÉ") == "abÉ"
