"""Benchmark decontamination: Wu-Manber search of many word sequences in whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.words import ALNUM, Words, extended, mix, pieces

WINDOW = 13
MAX_WORDS = 2_000_000  # benchmark words of one pattern table; more are searched table by table
LANE = 512  # word positions that one lane of the search walks over
_BITS = 17
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _block(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of `size` (1 or 2) words that ends at each position."""
    last = words[at] * _A
    return mix(last if size == 1 else last + words[at - 1] * _B)


class PatternTable:
    """Patterns of one length m: block shifts, and buckets of patterns by the hash of their last block."""

    def __init__(self, patterns: np.ndarray, owners: np.ndarray):
        self.m = m = patterns.shape[1]
        self.size = size = min(2, m)
        self.mask = np.uint64((1 << _BITS) - 1)
        flat, rows = patterns.ravel(), np.arange(len(patterns)) * m
        self.shift = np.full(1 << _BITS, m - size + 1, dtype=np.int64)
        for end in range(size - 1, m):  # ascending: the block nearest to the pattern's end has the last word
            self.shift[(_block(flat, rows + end, size) & self.mask).astype(np.int64)] = m - 1 - end
        key = _block(flat, rows + m - 1, size)
        order = np.argsort(key, kind="stable")
        self.keys, self.patterns, self.owners = key[order], patterns[order], owners[order]

    def find(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions in `words` of all occurrences and the owner of the pattern found; texts begin at `first`."""
        m, pos, end = self.m, [], []
        for lo, hi in zip(first[:-1], first[1:]):
            if hi - lo >= m:
                begins = np.arange(lo + m - 1, hi, LANE)
                pos.append(begins)
                end.append(np.minimum(begins + LANE, hi))
        if not pos:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pos, end, found = np.concatenate(pos), np.concatenate(end), []
        while len(pos):
            step = self.shift[(_block(words, pos, self.size) & self.mask).astype(np.int64)]
            found.append(pos[step == 0])
            pos = pos + np.maximum(step, 1)
            live = pos < end
            pos, end = pos[live], end[live]
        return self._compare(words, np.concatenate(found))

    def _compare(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = _block(words, ends, self.size)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        starts, owners, todo = [], [], np.flatnonzero(hi > lo)
        while len(todo):  # one pattern of each bucket at a time
            at = ends[todo, None] + np.arange(1 - self.m, 1)
            same = (words[at] == self.patterns[lo[todo]]).all(axis=1)
            starts.append(ends[todo[same]] - self.m + 1)
            owners.append(self.owners[lo[todo[same]]])
            lo[todo] += 1
            todo = todo[lo[todo] < hi[todo]]
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(starts), np.concatenate(owners)


def pattern_tables(ids: list[str], texts: pa.Array, window: int) -> list[PatternTable]:
    """A table for each pattern length: all windows of `window` words, or the whole item where it has fewer."""
    w = Words(texts, ALNUM, fold=True)
    by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
    for i in range(len(ids)):
        own = w.hashes[w.first[i]:w.first[i + 1]]
        if len(own):
            m = min(window, len(own))
            rows = np.unique(np.lib.stride_tricks.sliding_window_view(own, m), axis=0)
            by_length.setdefault(m, []).append((rows, i))
    return [
        PatternTable(np.concatenate([r for r, _ in got]), np.concatenate([np.full(len(r), i) for r, i in got]))
        for _, got in sorted(by_length.items())]


def _search(words: Words, tables: list[PatternTable]) -> tuple[np.ndarray, np.ndarray]:
    """Which words are hit, and the distinct (text, owner) pairs."""
    edge, pairs = np.zeros(len(words.hashes) + 1, dtype=np.int64), []
    for t in tables:
        starts, owners = t.find(words.hashes, words.first)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + t.m, -1)
        doc = np.searchsorted(words.first, starts, side="right") - 1
        pairs.append(np.stack([doc, owners], axis=1))
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
    return np.cumsum(edge[:-1]) > 0, pairs


def find_windows(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
    window: int = WINDOW, max_words: int = MAX_WORDS,
) -> DataFrame:
    """docs with n_words, n_hit, hits (a bit for each word, first word in the lowest bit of the first byte) and item_ids.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A word is hit when it lies in an
    occurrence of a window of an item; item_ids are the sorted distinct ids (as strings) of items with an occurring
    window. Every whole text is searched for every window. A pattern table holds at most about `max_words` benchmark
    words (or one item), so that its size is known; a larger benchmark is searched table by table and the hits of
    each document are merged. Null texts and items have no words; an empty benchmark hits nothing; a null item id
    counts as an empty string. Columns of docs named n_words, n_hit, hits or item_ids are replaced.
    """
    docs = docs.drop(*[c for c in ("n_words", "n_hit", "hits", "item_ids") if c != text])
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"),
                             F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_tables = max(1, -(-total // (2 * max_words)))  # a word and its separator are two bytes at least
    one = _find_in_one if n_tables == 1 else _find_in_many
    return one(docs, items, n_tables, text, window)


def _tables(items: DataFrame, window: int) -> tuple[list[str], list[PatternTable]]:
    rows = items.toArrow()
    ids = rows["i"].to_pylist()
    return ids, pattern_tables(ids, rows["t"].combine_chunks(), window)


def _find_in_one(docs: DataFrame, items: DataFrame, _: int, text: str, window: int) -> DataFrame:
    ids, tables = _tables(items, window)
    shared = docs.sparkSession.sparkContext.broadcast((ids, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tables = shared.value
        for b in pieces(batches, text):
            words = Words(b.column(text), ALNUM, fold=True)
            hit, pairs = _search(words, tables)
            owners: list[list[str]] = [[] for _ in range(b.num_rows)]
            for doc, owner in pairs.tolist():
                owners[doc].append(ids[owner])
            first = words.first
            total = np.concatenate(([0], np.cumsum(hit)))
            bits = [np.packbits(hit[x:y], bitorder="little").tobytes() for x, y in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.diff(first), pa.int64()),
                 pa.array(np.diff(total[first]), pa.int64()), pa.array(bits, pa.binary()),
                 pa.array([sorted(set(x)) for x in owners], pa.list_(pa.string()))],
                names=[*b.schema.names, "n_words", "n_hit", "hits", "item_ids"])

    return docs.mapInArrow(run, extended(docs, "n_words long, n_hit long, hits binary, item_ids array<string>"))


def _find_in_many(docs: DataFrame, items: DataFrame, n_tables: int, text: str, window: int) -> DataFrame:
    """One scan for each table; only documents with hits are exchanged, keyed by their text's digest."""
    dealt = items.withColumn("__t", F.pmod(F.xxhash64("i", "t"), F.lit(n_tables)))
    keyed = docs.withColumn("__key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    found = None
    for k in range(n_tables):
        part = _find_in_one(keyed.select("__key", text), dealt.where(F.col("__t") == k), 1, text, window)
        part = part.where(F.size("item_ids") > 0).select("__key", F.col("hits").alias("h"), F.col("item_ids").alias("o"))
        found = part if found is None else found.unionAll(part)
    distinct = found.groupBy("__key", "h").agg(F.array_distinct(F.flatten(F.collect_set("o"))).alias("o"))
    merged = distinct.groupBy("__key").applyInArrow(_merge, "__key string, n_hit long, hits binary, item_ids array<string>")
    none: list[str] = []
    base = _find_in_one(keyed, items.limit(0), 1, text, window).drop("item_ids", "n_hit").withColumnRenamed("hits", "__none")
    out = base.join(merged, "__key", "left")
    return out.select(
        *docs.columns, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("hits", "__none").alias("hits"),
        F.coalesce("item_ids", F.array(*none).cast("array<string>")).alias("item_ids"))


def _merge(group: pa.Table) -> pa.Table:
    hits = None
    for h in group["h"].to_pylist():
        own = np.frombuffer(h, np.uint8)
        hits = own if hits is None else hits | own
    ids = sorted({i for o in group["o"].to_pylist() for i in o})
    return pa.table({"__key": group["__key"].slice(0, 1), "n_hit": pa.array([int(np.unpackbits(hits).sum())]),
                     "hits": pa.array([hits.tobytes()], pa.binary()),
                     "item_ids": pa.array([ids], pa.list_(pa.string()))})


def contamination(found: DataFrame, min_percent: int = 5) -> DataFrame:
    """What find_windows returned with n_items, items_sha256 and contaminated.

    contaminated: at least one word is hit and the hit words are at least `min_percent` per cent of all.
    """
    return found.withColumns({
        "n_items": F.size("item_ids").cast("long"),
        "items_sha256": F.sha2(F.array_join("item_ids", ","), 256),
        "contaminated": (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words")),
    })


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    keep = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.col(text).alias("__text"))
    judged = contamination(find_windows(keep, benchmark, "__text", **options))
    return judged.where(~F.col("contaminated")).select("__row.*")

