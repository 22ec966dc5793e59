"""Grouping of spelling variants: the vocabulary's acceptor composed with a one-edit transducer and the acceptor again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.sources.sinks import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
BUCKET_WORDS = 2000  # entries of the words in a bucket, on average
_PAIRS = "a string, n_a long, b string, n_b long"


class Acceptor:
    """Minimal acyclic acceptors of several word lists, which share their states."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[tuple[tuple[str, int], ...]] = []
        self.shortest: list[int] = []  # lengths of what a state accepts
        self.longest: list[int] = []

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in self.number:
            self.number[key] = len(self.final)
            self.final.append(final)
            self.arcs.append(key[1])
            self.shortest.append(0 if final else 1 + min(self.shortest[q] for _, q in arcs))
            self.longest.append(1 + max(self.longest[q] for _, q in arcs) if arcs else 0)
        return self.number[key]

    def add(self, words: list[str]) -> int:
        """The state that accepts these words (ascending, distinct, at least one)."""
        path, last = [[False, []]], ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(final, arcs)))

        for w in words:
            k, most = 0, min(len(w), len(last))
            while k < most and w[k] == last[k]:
                k += 1
            close(k)
            path.extend([False, []] for _ in w[k:])
            path[-1][0], last = True, w
        close(0)
        return self._state(*path[0])

    def common(self, p: int, q: int, length: int, unless: str = "") -> list[str]:
        """What both states accept, of this length, but for what begins with the letter `unless`."""
        found, stack, back = [], [(p, q, length, -1)], []
        while stack:
            p, q, n, at = stack.pop()
            if not (self.shortest[p] <= n <= self.longest[p] and self.shortest[q] <= n <= self.longest[q]):
                continue
            if n == 0:
                found.append(_spell(back, at))
                continue
            to = dict(self.arcs[q])
            for c, r in self.arcs[p]:
                if c in to and (at >= 0 or c != unless):
                    back.append((at, c))
                    stack.append((r, to[c], n - 1, len(back) - 1))
        return found

    def one_edit(self, root: int, length: int) -> Iterator[tuple[str, str]]:
        """Pairs that acceptor, one-edit transducer and acceptor take from `root`: equal letters, one edit, equal letters.

        Either both words have `length` letters and one is replaced, or the first has a letter more. Of a run of equal
        letters the last one is the one left out. The edits at a state don't depend on how it was reached, so each state
        is worked out once.
        """
        known: dict[tuple[int, int], list[tuple[str, str]]] = {}
        stack, back = [(root, length, -1)], []
        while stack:
            q, n, at = stack.pop()
            if (q, n) not in known:
                arcs = self.arcs[q]
                known[q, n] = edits = []
                for i, (a, p) in enumerate(arcs):
                    for b, r in arcs[:i]:
                        edits += [(a + x, b + x) for x in self.common(p, r, n - 1)]
                    edits += [(a + x, x) for x in self.common(p, q, n, a)]
            if known[q, n]:
                head = _spell(back, at)
                for a, b in known[q, n]:
                    yield head + a, head + b
            for c, p in self.arcs[q]:
                back.append((at, c))
                stack.append((p, n - 1, len(back) - 1))


def _spell(back: list[tuple[int, str]], at: int) -> str:
    letters = []
    while at >= 0:
        at, c = back[at]
        letters.append(c)
    return "".join(reversed(letters))


def word_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", misspell: int | None = None,
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
) -> DataFrame:
    """word, n: runs of letters of all texts, A-Z lower-cased, of at least min_length letters and min_count occurrences.

    With `misspell`, a run loses its letter number h % length if misspell divides h, the crc32 of '<doc_id>:<run>'; a null
    doc_id is empty there. Occurrences are added up in each task before the exchange.
    """
    run = F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0)))
    word: Column = F.col("run")
    if misspell is None:
        runs = docs.select(run.alias("run"))
    else:
        seen = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), run.alias("run"))
        runs = seen.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % misspell == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(word)
    return runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= min_count)


def near_words(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words (word, n) that differ by one inserted, deleted or replaced letter, once.

    A pair whose shorter word has m letters shares the first (m - 1) / 2 letters or the last ones. So the acceptor's
    initial state has an arc for each m and such beginning (of the words, and of the words read backwards), and buckets
    of these arcs are worked on apart. A word has four arcs. Words have two letters at least.
    """
    m = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("forward"), F.col("word").alias("read")), F.struct(
        F.lit(False).alias("forward"), F.reverse("word").alias("read")))).alias("side")
    entries = words.select("word", "n", m).where("m > 0").select("m", "n", sides).select("m", "n", "side.*")
    half = F.floor((F.col("m") - 1) / 2).cast("int")
    entries = entries.withColumn("start", F.substr("read", F.lit(1), half))
    n_buckets = 1 + words.count() * 4 // BUCKET_WORDS
    dealt = entries.withColumn("bucket", F.pmod(F.xxhash64("m", "forward", "start"), F.lit(n_buckets)))
    return dealt.groupBy("bucket").applyInArrow(_pairs, _PAIRS)


def _pairs(group: pa.Table) -> pa.Table:
    counts: dict[str, int] = {}
    starts: dict[tuple[int, bool, str], list[str]] = {}
    for r in group.select(["m", "forward", "start", "read", "n"]).to_pylist():
        word = r["read"] if r["forward"] else r["read"][::-1]
        counts[word] = r["n"]
        starts.setdefault((r["m"], r["forward"], r["start"]), []).append(r["read"][len(r["start"]):])
    acceptor, out = Acceptor(), []
    for (m, forward, start), rests in starts.items():
        if len(rests) < 2:
            continue
        k = len(start)
        for a, b in acceptor.one_edit(acceptor.add(sorted(rests)), m - k):
            a, b = start + a, start + b
            if not forward:
                a, b = a[::-1], b[::-1]
                if a[:k] == b[:k]:  # found in the words read forwards
                    continue
            out.append((a, counts[a], b, counts[b]))
    a, n_a, b, n_b = zip(*out) if out else ((), (), (), ())
    return pa.table({"a": pa.array(a, pa.string()), "n_a": pa.array(n_a, pa.int64()), "b": pa.array(b, pa.string()),
                     "n_b": pa.array(n_b, pa.int64())})


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last one. A form is at least twice as frequent as its word, so a
    path has at most log2 of the largest count steps; each round doubles the steps taken."""
    steps = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = settle(steps.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not steps.agg(F.max("moved")).first()[0]:
            return steps.select("word", "root")


def group_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the distinct words (word, n).

    form: the most frequent word that is one edit away (of equally frequent ones the smallest in code-point order), if
    it is at least twice as frequent, else null; root: the last of the forms from the word on, the word itself if it has
    none; n_near: the number of words that are one edit away; form_n: the form's n. No words: no rows.
    """
    words = settle(words.select("word", "n"))
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.struct((-F.col("n_b")).alias("k"), F.col("b").alias("w")).alias("near")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.struct((-F.col("n_a")).alias("k"), F.col("a").alias("w")).alias("near"))
    )).alias("x")).select("x.*")
    best = settle(both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n_own"), F.min("near").alias("near")))
    forms = best.where(-F.col("near.k") >= 2 * F.col("n_own")).select("word", F.col("near.w").alias("form"), (-F.col("near.k")).alias("form_n"))
    roots = _roots(forms)
    out = words.join(best.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
