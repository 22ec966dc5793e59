"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from panelspark.llm import spelling
from tests.llm.util import documents, folded


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(words):
    out = []
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        out.append([w, best if best and words[best] >= 2 * n else None, n, len(close)])
    form = {w: f for w, f, *_ in out}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, f or "", root(w), n, k, words[f] if f else 0) for w, f, n, k in out)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def counted(rows, misspell=97):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", folded(t)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            out[run[:at] + run[at + 1:] if h % misspell == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def vocabulary(seed, n, letters="abcé"):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(n)}
    words |= {"a" * k for k in range(2, 12)} | {"ab" * k for k in range(1, 6)}
    return {w: min(int(rnd.paretovariate(0.5)), 10 ** 9) for w in words}


def test_all_near_pairs_once(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BUCKET_WORDS", 50)
    words = vocabulary(1, 700)
    got = [(r.a, r.b) for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()]
    want = {frozenset((a, b)) for a in words for b in words if near(a, b)}
    assert Counter(map(frozenset, got)) == Counter(want)


def test_forms_and_roots(spark):
    words = vocabulary(2, 400)
    got = found(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words)
    assert any(r[1] and r[1] != r[2] for r in got)  # a form that has a form


def test_ties_take_the_smallest_form(spark):
    words = {"colour": 2, "colours": 9, "colouré": 9, "colourz": 9, "single": 1}
    got = found(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words) and got[0][:2] == ("colour", "colours")


def test_words_of_texts(spark):
    rnd = random.Random(4)
    vocab = list(vocabulary(3, 60, "abÀÿZ"))
    rows = [(i, " ".join(rnd.choice(vocab) + rnd.choice([" ", "1", ".", "\n"]) for _ in range(rnd.randrange(300)))) for i in range(40)]
    rows += [(None, "Colour colour COLOUR"), (7, None), (7, ""), (8, "ČolourĀ colour÷x")]
    docs = documents(spark, rows).withColumnsRenamed({"lang": "word", "source": "run"}).repartition(3)
    words = spelling.word_counts(docs, misspell=97)
    assert {r.word: r.n for r in words.collect()} == counted(rows)
    assert found(spelling.group_variants(words)) == grouped(counted(rows))
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == counted(rows, 10 ** 12)


def test_very_long_words_and_no_words(spark):
    long = "xy" * 40_000
    words = [(long, 1), (long + "z", 5), ("q" * 60_000, 1), ("q" * 60_001, 2), ("q" * 60_002, 1)]
    got = {r.word: (r.form and len(r.form), len(r.root), r.n_near) for r in spelling.group_variants(
        spark.createDataFrame(words, "word string, n long")).collect()}
    assert [got[w] for w, _ in words] == [(80_001, 80_001, 1), (None, 80_001, 1), (60_001, 60_001, 1), (None, 60_001, 2), (60_001, 60_001, 1)]
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []
