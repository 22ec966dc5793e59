"""Removal of repeated word sequences, found by recompression: global names for runs and pairs of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.membership import split
from panelspark.llm.rarity import bucket_of, packed, unpacked
from panelspark.llm.words import PIECE, Words, extended, int64s, mix, pieces, sequence_hash
from panelspark.sources.sinks import settle

WINDOW = 20
ROUNDS = 2  # of one run step and PAIRINGS pair steps
PAIRINGS = 2
BUCKET_BYTES = 12 << 20  # of what one task compares
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_EXCHANGED = "bucket int, names binary, docs binary, keys binary, lows binary, counts binary, windows binary, " \
             "own_docs binary, own_keys binary, own_spans binary"


class Symbols:
    """One level of the parse of some texts: names, and the words [lo, hi) that decide each symbol.

    Equal stretches of words have equal names for all symbols whose [lo, hi) lies inside the stretch. Both bounds
    ascend. Next to an end of its text, a symbol's bound lies outside the text.
    """

    def __init__(self, name, lo, hi, doc, edge):
        self.name, self.lo, self.hi, self.doc, self.edge = name, lo, hi, doc, edge

    def _before(self, at: np.ndarray) -> np.ndarray:
        """lo of the symbol before each, or a place before the text."""
        same = (at > 0) & (self.doc[at - 1] == self.doc[at])
        return np.where(same, self.lo[at - 1], self.edge[self.doc[at]] - 1)

    def _after(self, at: np.ndarray) -> np.ndarray:
        follows = np.minimum(at + 1, len(self.doc) - 1)
        same = (at + 1 < len(self.doc)) & (self.doc[follows] == self.doc[at])
        return np.where(same, self.hi[follows], self.edge[self.doc[at] + 1] + 1)

    def runs(self) -> Symbols:
        """Each run of equal symbols becomes one, named by the symbol and the run's length."""
        new = np.ones(len(self.name), dtype=bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(new)) - 1
        n = (tail - head + 1).astype(np.uint64)
        name = np.where(n > 1, mix(self.name[head] * _C + n), self.name[head])
        return Symbols(name, self._before(head), self._after(tail), self.doc[head], self.edge)

    def pairs(self, salt: int) -> Symbols:
        """A coin thrown by name makes each symbol left or right; each left one followed by a right one is joined."""
        left = mix(self.name ^ np.uint64(salt)) & np.uint64(1) == 1
        joins = np.zeros(len(left), dtype=bool)
        joins[:-1] = left[:-1] & ~left[1:] & (self.doc[1:] == self.doc[:-1])
        keep = np.ones(len(left), dtype=bool)
        keep[1:] = ~joins[:-1]
        at = np.flatnonzero(keep)
        pair, is_left = joins[at], left[at]
        second = np.minimum(at + 1, len(left) - 1)
        name = np.where(pair, mix(self.name[at] * _A + self.name[second] * _B), self.name[at])
        lo = np.where(pair | is_left, self.lo[at], self._before(at))
        hi = np.where(pair | is_left, self._after(at), self.hi[at])
        return Symbols(name, lo, hi, self.doc[at], self.edge)


def parse(words: np.ndarray, first: np.ndarray) -> list[Symbols]:
    """All levels of the parse, the words themselves first."""
    at = np.arange(len(words))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    levels = [Symbols(words, at, at + 1, doc, first)]
    for r in range(ROUNDS):
        levels.append(levels[-1].runs())
        for p in range(PAIRINGS):
            levels.append(levels[-1].pairs(0x51ED + 7919 * (r * PAIRINGS + p)))
    return levels


def anchors(levels: list[Symbols], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words the symbol that stands for it: its name, and a number for its occurrence.

    It is the least name of the highest level with a symbol decided inside the window, so that equal windows have
    equal names. Level 0 has the words themselves, so every window has one.
    """
    name, place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    left = np.arange(len(starts))
    for k in reversed(range(len(levels))):
        s = levels[k]
        lo = np.searchsorted(s.lo, starts[left], "left")
        hi = np.searchsorted(s.hi, starts[left] + window, "right")
        has = hi > lo
        at, lo, hi = left[has], lo[has], hi[has]
        left = left[~has]
        if len(at):
            best, where = s.name[lo], lo.copy()
            for j in range(1, int((hi - lo).max())):
                more = np.minimum(lo + j, hi - 1)
                better = s.name[more] < best
                best, where = np.where(better, s.name[more], best), np.where(better, more, where)
            name[at], place[at] = best, where * len(levels) + k
        if not len(left):
            break
    return name, place


def _later(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which windows have an equal key that starts earlier: in a smaller doc, or in the same one before."""
    if not len(key):
        return np.zeros(0, dtype=bool)
    rank = np.unique(doc, return_inverse=True)[1].astype(np.int64)
    at = (rank << 32) | pos
    order = np.argsort(at, kind="stable")
    order = order[np.argsort(key[order], kind="stable")]
    k, a = key[order], at[order]
    head = np.ones(len(k), dtype=bool)
    head[1:] = k[1:] != k[:-1]
    first = a[np.flatnonzero(head)][np.cumsum(head) - 1]
    out = np.zeros(len(k), dtype=bool)
    out[order] = a > first
    return out


def _spans(group: np.ndarray, pos: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (sorted by group, then start) joined to covered stretches: group, begin, end."""
    if not len(pos):
        return group, pos, pos
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (pos[1:] > pos[:-1] + window)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(pos)) - 1
    return group[head], pos[head], pos[tail] + window


def _bytes(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()


def _exchange_rows(b: pa.RecordBatch, n_buckets: int, window: int) -> Iterator[dict]:
    """What a piece of the corpus sends to each bucket of anchor names.

    Windows that start earlier in the piece itself are settled here; only the first of each goes out.
    """
    words = Words(b.column("text"))
    docs, keys, first = int64s(b.column("doc")), int64s(b.column("key")), words.first
    sizes = np.maximum(np.diff(first) - window + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[:-1], sizes)
    if not len(starts):
        return
    name, place = anchors(parse(words.hashes, first), starts, window)
    code, low = sequence_hash(words.hashes, window)[starts], starts - first[doc]
    later = _later(code ^ mix(name), docs[doc], low)
    own_doc, own_from, own_to = _spans(doc[later], low[later], window)
    keep = ~later
    name, place, code, low, doc = name[keep], place[keep], code[keep], low[keep], doc[keep]
    head = np.ones(len(low), dtype=bool)
    head[1:] = (place[1:] != place[:-1]) | (low[1:] != low[:-1] + 1) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, len(low)))
    bucket = ((name[at] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    count, at, bucket = count[order], at[order], bucket[order]
    ends = np.cumsum(count)
    flat = code[np.arange(len(low)) - np.repeat(ends - count, count) + np.repeat(at, count)]
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for i, j in zip(edges[:-1], edges[1:]):
        own = slice(0, len(own_doc)) if i == 0 else slice(0, 0)
        runs = at[i:j]
        yield {
            "bucket": int(bucket[i]), "names": _bytes(name[runs], "<u8"), "docs": _bytes(docs[doc[runs]], "<i8"),
            "keys": _bytes(keys[doc[runs]], "<i8"), "lows": _bytes(low[runs], "<i4"),
            "counts": _bytes(count[i:j], "<i4"), "windows": _bytes(flat[ends[i] - count[i]:ends[j - 1]], "<u8"),
            "own_docs": _bytes(docs[own_doc[own]], "<i8"), "own_keys": _bytes(keys[own_doc[own]], "<i8"),
            "own_spans": _bytes(np.stack([own_from[own], own_to[own]], axis=1), "<i4")}


def _compare_bucket(rows: pa.Table, window: int, n_texts: int) -> pa.Table:
    """The stretches that start earlier elsewhere, among all occurrences of a bucket's names; packed by text."""
    def column(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows[name].to_pylist()), kind)

    names, docs, keys = column("names", "<u8"), column("docs", "<i8"), column("keys", "<i8")
    lows, counts, codes = column("lows", "<i4").astype(np.int64), column("counts", "<i4"), column("windows", "<u8")
    _, group, times = np.unique(names, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[group] > 1)  # a name that occurs once reveals nothing
    n = counts[shared].astype(np.int64)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begins = np.cumsum(counts.astype(np.int64)) - counts
    run = np.repeat(shared, n)
    code, pos = codes[begins[run] + within] ^ mix(names[run]), lows[run] + within
    later = _later(code, docs[run], pos)
    run, pos = run[later], pos[later]
    own = column("own_spans", "<i4").reshape(-1, 2).astype(np.int64)
    docs = np.concatenate((docs[run], column("own_docs", "<i8")))
    keys = np.concatenate((keys[run], column("own_keys", "<i8")))
    begin, end = np.concatenate((pos, own[:, 0])), np.concatenate((pos + window, own[:, 1]))
    docs, keys, begin, end = _joined(docs, keys, begin, end)
    text = bucket_of(mix(docs.view(np.uint64) ^ mix(keys.view(np.uint64))), n_texts)
    return pa.Table.from_pylist(list(packed(text, {
        "docs": docs, "keys": keys, "begins": begin.astype("<i4"), "ends": end.astype("<i4")})), schema=_FOUND)


def _joined(docs: np.ndarray, keys: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Stretches of each text, in order, with those that touch made one."""
    order = np.lexsort((begin, keys, docs))
    docs, keys, begin, end = docs[order], keys[order], begin[order], end[order]
    if not len(docs):
        return docs, keys, begin, end
    other = np.ones(len(docs), dtype=bool)
    other[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    shift = (np.cumsum(other) - 1) << 33  # texts apart, so that one running maximum serves all
    reach = np.maximum.accumulate(end + shift) - shift
    new = other.copy()
    new[1:] |= begin[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return docs[head], keys[head], begin[head], reach[np.append(head[1:], len(docs)) - 1]


def _texts(group: pa.Table) -> pa.Table:
    """doc, key, spans of the texts of one bucket."""
    e = unpacked(group, {"docs": "<i8", "keys": "<i8", "begins": "<i4", "ends": "<i4"})
    docs, keys, begin, end = _joined(
        e["docs"], e["keys"], e["begins"].astype(np.int64), e["ends"].astype(np.int64))
    other = np.ones(len(docs), dtype=bool)
    other[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    head = np.flatnonzero(other)
    flat = np.stack([begin, end], axis=1).ravel()
    return pa.table({
        "doc": docs[head], "key": keys[head],
        "spans": pa.ListArray.from_arrays(pa.array(np.append(2 * head, len(flat)), pa.int32()), pa.array(flat, pa.int32()))})


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, key, spans (begin and end of the covered stretches of words, in a row), one row for each text.

    docs has doc (long), key (a hash of the text) and text. All texts are parsed by recompression: runs and pairs
    are named by 64-bit hashes of what they replace, so that names agree over the whole corpus without an exchange
    for each round. Every window of `window` words stands under one symbol decided inside it; occurrences of that
    symbol's name meet in a bucket, and there the windows of shared names are compared by a hash of all their words.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-2 * total // BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE // 2):  # all levels of a parse are held at once
            rows = list(_exchange_rows(b, n_buckets, window))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SENT)

    n_texts = max(1, n_buckets // 8)
    found = docs.mapInArrow(send, _EXCHANGED).groupBy("bucket").applyInArrow(
        lambda group: _compare_bucket(group, window, n_texts),
        "bucket int, docs binary, keys binary, begins binary, ends binary")
    return found.groupBy("bucket").applyInArrow(_texts, "doc long, key long, spans array<int>")


_FOUND = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("docs", "keys", "begins", "ends"))])
_SENT = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.binary()) for c in _EXCHANGED.split(", ")])


def _removed(n: int, spans: list[int] | None) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    if spans:
        at = np.array(spans, dtype=np.int64)
        np.add.at(edge, at[0::2], 1)
        np.add.at(edge, at[1::2], -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False,
) -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words left, joined by one space.

    A word goes when a window of `window` words that covers it also starts earlier in the input: in a document of
    smaller doc_id, or before in the same one. Null text has no words. A null doc_id comes before all others. Rows
    with the same doc_id are one document: an equal start in another of them is not earlier. Texts shorter than the
    window are left whole. Columns with the names of results are replaced. With `digest`, kept_sha256 instead.
    """
    made = ["n_words", "n_removed", "kept_sha256" if digest else "kept_text"]
    docs = docs.drop(*[c for c in made if c not in (text, doc_id)])
    keyed = docs.withColumns({
        "__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))),
        "__key": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    spans = repeated_spans(keyed.select(F.col("__doc").alias("doc"), F.col("__key").alias("key"), F.col(text).alias("text")),
                           window)
    merged = settle(spans.select(
        F.col("doc").alias("__of"), F.col("key").alias("__of_key"), F.col("spans").alias("__spans")))
    some, whole = split(keyed, merged.select(F.col("__of").alias("__doc")), "__doc")
    joined = some.join(merged, (F.col("__doc") == F.col("__of")) & (F.col("__key") == F.col("__of_key")), "left").select(
        *docs.columns, "__spans")
    out = joined.unionByName(whole.select(*docs.columns, F.lit(None).cast("array<int>").alias("__spans")))
    names = [*docs.columns, *made]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            n_words, n_removed, kept = [], [], []
            for t, s in zip(b.column(text).to_pylist(), b.column("__spans").to_pylist()):
                words = (t or "").encode().split()
                n_words.append(len(words))
                gone = _removed(len(words), s)
                n_removed.append(int(gone.sum()))
                left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if n_removed[-1] else words)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=names)

    return out.mapInArrow(finish, extended(docs, f"n_words long, n_removed long, {made[2]} string"))
