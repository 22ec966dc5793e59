"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelspark.llm import suffix_dedup
from tests.llm.util import documents, fixture


def cut(texts, window):
    """(kept bytes, bytes removed, stretches removed) of each text."""
    raw = [(t or "").encode() for t in texts]
    times = Counter(t[s:s + window] for t in raw for s in range(len(t) - window + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - window + 1):
            if times[t[s:s + window]] > 1:
                gone[s:s + window] = b"\1" * window
        out.append((bytes(b for b, g in zip(t, gone) if not g), sum(gone), len([p for p in bytes(gone).split(b"\0") if p])))
    return out


def check(spark, rows, window):
    got = suffix_dedup.remove_repeats(documents(spark, rows).repartition(5), window=window).collect()
    want = Counter((i, len((t or "").encode()), *x[1:], x[0]) for (i, t), x in zip(rows, cut([t for _, t in rows], window)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got) == want
    return want


@pytest.mark.parametrize("window", [7, 40, 200])
def test_fixture(spark, window):
    assert any(r[2] for r in check(spark, fixture(), window))


def edited(seed, n):
    """Near copies with an edit each, letters of two and three bytes, periods and long repeats inside one text."""
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abcdeé → ") for _ in range(900))
    texts = [base[:i] + "#" + base[i + rnd.randrange(9):] for i in (rnd.randrange(900) for _ in range(n))]
    texts += ["a" * 700, "ab" * 300 + base[100:350], base[100:300] + "x" + base[100:300], base[:199], base[:200], None, ""]
    return list(enumerate(texts))


@pytest.mark.parametrize("parts", [{}, {"BUCKET_BYTES": 400}, {"BUCKET_BYTES": 60, "SPLITTERS": 5}])
def test_edits_over_many_buckets(spark, monkeypatch, parts):
    """Small buckets, so that kinds of suffixes lie on both sides of a cut."""
    for k, v in parts.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    check(spark, edited(3, 25), 200)


def test_hot_string_lies_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    rnd = random.Random(1)
    shared = "".join(rnd.choice("abcdef ") for _ in range(260))
    tail = lambda: "".join(rnd.choice("ghijk ") for _ in range(rnd.randrange(300)))
    check(spark, [(i, tail() + shared + tail() if i % 3 else shared) for i in range(150)], 200)


def test_long_text(spark):
    rnd = random.Random(2)
    body = "".join(rnd.choice("abcdefgh ") for _ in range(1_400_000))
    rows = [(1, body + body[:500_000]), (2, body[700_000:700_300])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert got == {1: (1_900_000, 1_000_300, 3), 2: (300, 300, 1)}


def test_same_ids_nulls_empty_tables_and_clashing_columns(spark):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(100))
    df = spark.createDataFrame(
        [(1, text, "a", 5), (1, text, "b", 6), (None, text[1:], "c", 7), (3, None, None, None), (None, "z", "d", 1)],
        "doc_id long, text string, key string, n_bytes long")
    got = suffix_dedup.remove_repeats(df, digest=True).collect()
    none, n = hashlib.sha256(b"").hexdigest(), len(text)
    left = hashlib.sha256(b"z").hexdigest()
    assert sorted((str(r.doc_id), str(r.key), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted([
        ("1", "a", n, n, 1, none), ("1", "b", n, n, 1, none), ("None", "c", n - 1, n - 1, 1, none), ("3", "None", 0, 0, 0, none),
        ("None", "d", 1, 0, 0, left)])
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def test_multikey_order():
    rng = np.random.default_rng(1)
    tokens = [rng.integers(0, m, 5000).astype(np.uint64) for m in (30, 5, 1 << 62)]
    order = suffix_dedup.multikey_order(tokens)
    assert sorted(order) == list(range(5000))
    rows = list(zip(*(t[order].tolist() for t in tokens)))
    assert rows == sorted(rows)
