"""Removal of byte strings that occur twice, by a suffix array over range-partitioned buckets.

A suffix is a row of tokens, each a 64-bit name of a stretch of its bytes. Splitters sampled from the corpus cut the order
of all suffixes into buckets by their leading tokens; every bucket is sorted by multikey quicksort and neighbours are
compared, also those on both sides of a cut. Suffixes go twice through this:

- sparse ones, which begin at the least k-gram of every `width` consecutive starts and stand for all windows with that
  least k-gram. Their first token names the bytes that all these windows share, the second all bytes of the windows;
- those of every byte, where a sparse suffix shares its first token but not its second. Their tokens name the two
  halves of the window that begins there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.membership import split
from panelspark.llm.rarity import bucket_of, packed, unpacked
from panelspark.llm.words import extended, int64s, mix, pieces, powers, text_bytes
from panelspark.sources.sinks import settle

WINDOW = 200
SEGMENT = (1 << 20) - 4096  # bytes of text worked on at once, longer texts in overlapping parts
BUCKET_BYTES = 16 << 20  # of the suffixes in a bucket
SPLITTERS = 1 << 16  # at most so many come from the driver; beyond, each range is cut evenly
SAMPLES = 16  # suffixes drawn for each splitter
DRAWN_BYTES = 32 << 20  # of the texts, picked by hash, from which they are drawn
COVERED, ASKED = 1, 2
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_SUFFIX = {"a": "<u8", "b": "<u8", "docs": "<i8", "keys": "<i4", "lows": "<i4", "counts": "<u2", "many": "<i1"}
_FOUND = {"docs": "<i8", "keys": "<i4", "lows": "<i4", "counts": "<i4", "states": "<i1"}
_PENDING = {k: v for k, v in _SUFFIX.items() if k != "a"}


def _schema(fields: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields.items()))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


_SENT = _schema({"bucket": pa.int32()} | {c: pa.binary() for c in _SUFFIX} | {f"own_{c}": pa.binary() for c in _FOUND})
_MET = _schema({"bucket": pa.int32()} | {c: pa.binary() for c in _FOUND} | {f"at_{c}": pa.binary() for c in _PENDING} | {
    "head": pa.int64(), "first": pa.int64(), "n_first": pa.int64(), "last": pa.int64(), "n_last": pa.int64()})
_TEXT = _schema({"bucket": pa.int32()} | {c: pa.binary() for c in _FOUND})


class Names:
    """64-bit names of stretches of some bytes: equal stretches have equal names."""

    def __init__(self, data: np.ndarray):
        self.sums = np.empty(len(data) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(_LETTERS[data] * powers(_BASE, len(data)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(data) + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def _least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """For each start the least of `width` consecutive keys."""
    least, d = keys.copy(), 1
    while 2 * d <= width:
        np.minimum(least[:-d], least[d:], out=least[:-d])
        d *= 2
    if width > d:
        np.minimum(least[:d - width], least[width - d:], out=least[:d - width])
    return least


def sparse_suffixes(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """text, low, count, first and second token of the suffixes that stand for windows low .. low + count - 1.

    The least k-gram of a window's first `width` starts is a matter of the window alone, so equal windows stand under
    suffixes with the same first token, at the same distance.
    """
    width = max(1, window * 8 // 25)
    k = min(16, window - width + 1)
    sizes = np.maximum(np.diff(offsets) - window + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[:-1], sizes)
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    name, at = Names(data), np.arange(len(data) - k + 1)
    grams = (name(at, at + k) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    place = (_least_of(grams, width)[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(place)))
    low, place, text = start[head], place[head], text[head]
    first = name(place, place + window - width + 1)
    shape = ((place - low) * (width + 1) + count).astype(np.uint64)
    second = mix(name(low, low + count - 1 + window) ^ mix(shape))
    return text, low - offsets[text], count, first, second


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of suffixes by their tokens: ternary quicksort token by token, all unsorted segments in one step.

    A step splits each segment by a pivot of its current token into less, equal and greater; the equal part goes on
    with the next token. Segments of one suffix, and those without a further token, are done.
    """
    n = len(tokens[0])
    order, begin, depth = np.arange(n), np.array([0]), np.array([0])
    size = np.array([n])
    values = np.stack(tokens)
    while True:
        open_ = (size > 1) & (depth < len(tokens))
        begin, size, depth = begin[open_], size[open_], depth[open_]
        if not len(begin):
            return order
        offset = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(seg)) - offset[seg] + begin[seg]
        own = order[at]
        value = values[depth[seg], own]
        three = [value[offset + x] for x in (size * 0, size // 2, size - 1)]
        pivot = np.maximum(np.minimum(three[0], three[1]), np.minimum(np.maximum(three[0], three[1]), three[2]))[seg]
        sides = [value < pivot, value == pivot, value > pivot]
        begins, sizes = [], []
        to = begin
        for side in sides:
            before = np.concatenate(([0], np.cumsum(side)))
            count = before[offset + size] - before[offset]
            place = (to - before[offset])[seg[side]] + before[:-1][side]
            order[place] = own[side]
            begins.append(to)
            sizes.append(count)
            to = to + count
        begin, size = np.concatenate(begins), np.concatenate(sizes)
        depth = np.concatenate((depth, depth + 1, depth))


def _places(docs: np.ndarray, keys: np.ndarray, lows: np.ndarray) -> np.ndarray:
    return mix(docs.astype(np.int64).view(np.uint64) ^ mix((keys.astype(np.int64) << 32 | lows).view(np.uint64)))


class Splitters:
    """Cuts of the order of (first token, second token, place); buckets ascend with the order."""

    def __init__(self, drawn: list[np.ndarray], n_buckets: int):
        n = min(n_buckets, SPLITTERS)
        self.even = -(-n_buckets // n)
        order = np.lexsort(drawn[::-1])
        cut = np.unique((np.arange(1, n) * len(order)) // n) if len(order) else np.zeros(0, np.int64)
        self.cuts = [d[order[cut]] for d in drawn]

    def buckets(self, tokens: list[np.ndarray]) -> np.ndarray:
        n = len(self.cuts[0])
        order = np.lexsort([np.concatenate(x) for x in zip(self.cuts[::-1], tokens[::-1])])
        passed = np.cumsum(order < n)
        out = np.empty(len(tokens[0]), dtype=np.int64)
        own = order >= n
        out[order[own] - n] = passed[own]
        if self.even > 1:  # within a range first tokens lie evenly, as they are hashes
            edges = np.concatenate(([0.0], self.cuts[0].astype(np.float64), [2.0 ** 64]))
            lo, hi = edges[out], edges[out + 1]
            part = (tokens[0].astype(np.float64) - lo) / np.maximum(hi - lo, 1.0) * self.even
            out = out * self.even + np.clip(part.astype(np.int64), 0, self.even - 1)
        return out


def _joined(docs, keys, begin, end):
    """Stretches of each text in order, with those that touch made one."""
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


def _sent(a, b, docs, keys, lows, counts, window: int, splitters: Splitters) -> list[dict]:
    """What a piece of the corpus sends to each bucket: every suffix once, with `many` where it occurs again here.

    The windows of suffixes that occur twice in the piece are covered; they go along as merged stretches.
    """
    order = np.lexsort((b, a))
    a, b, docs, keys, lows, counts = (x[order] for x in (a, b, docs, keys, lows, counts))
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(a)))
    twice = np.repeat(times > 1, times)
    own = _joined(docs[twice], keys[twice], lows[twice], lows[twice] + counts[twice] - 1 + window)
    a, b, docs, keys, lows, counts = (x[head] for x in (a, b, docs, keys, lows, counts))
    rows = list(packed(splitters.buckets([a, b, _places(docs, keys, lows)]), {
        "a": a, "b": b, "docs": docs.astype("<i8"), "keys": keys.astype("<i4"), "lows": lows.astype("<i4"),
        "counts": counts.astype("<u2"), "many": (times > 1).astype("<i1")}))
    covered = dict(zip(_FOUND, (own[0], own[1], own[2], own[3] - own[2] - window + 1, np.ones(len(own[0])))))
    for i, row in enumerate(rows):
        row |= {f"own_{c}": covered[c].astype(kind).tobytes() if i == 0 else b"" for c, kind in _FOUND.items()}
    return rows


def _states(pair: np.ndarray, n: np.ndarray, mixed: np.ndarray, many: np.ndarray) -> np.ndarray:
    """COVERED: the suffix occurs again. ASKED: its windows have to be compared one by one, for which one of each kind
    of suffix with the same first token is needed.

    pair: number of each suffix' kind, ascending; n: occurrences of each kind; mixed: the first token has other kinds.
    """
    first = np.ones(len(pair), dtype=bool)
    first[1:] = pair[1:] != pair[:-1]
    again = n[pair] > 1
    return np.where(again & (many == 0), COVERED, 0) | np.where(mixed & first, ASKED, 0)


def _by_text(e: dict, states: np.ndarray, n_texts: int) -> list[dict]:
    keep = states > 0
    e = {c: e[c][keep] for c in ("docs", "keys", "lows", "counts")}
    text = bucket_of(mix(e["docs"].view(np.uint64) ^ mix(e["keys"].astype(np.int64).view(np.uint64))), n_texts)
    return list(packed(text, {"docs": e["docs"].astype("<i8"), "keys": e["keys"].astype("<i4"), "lows": e["lows"].astype("<i4"),
                              "counts": e["counts"].astype("<i4"), "states": states[keep].astype("<i1")}))


def _runs(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return np.cumsum(new) - 1


def _compare(rows: pa.Table, n_texts: int, ask: bool) -> pa.Table:
    """Sorts a bucket and compares neighbours. Suffixes with its first or its last first token are pending: what they
    are compared with may lie in another bucket."""
    own = unpacked(rows.select([f"own_{c}" for c in _FOUND]), {f"own_{c}": k for c, k in _FOUND.items()})
    own = {c: own[f"own_{c}"] for c in _FOUND}
    e = unpacked(rows, _SUFFIX)
    order = multikey_order([e["a"], e["b"]])
    e = {c: x[order] for c, x in e.items()}
    head = _runs(e["a"])
    pair = _runs(e["b"])
    pair = _runs(pair + head)  # both ascend, so the sum changes where either does
    n = np.bincount(pair, weights=1 + e["many"]).astype(np.int64)
    kinds = np.bincount(head[np.flatnonzero(np.diff(pair, prepend=-1))])
    edge = (head == 0) | (head == head[-1])
    out = _by_text(own, own["states"], n_texts)
    inner = {c: x[~edge] for c, x in e.items()}
    if len(inner["a"]):
        at = pair[~edge]
        out += _by_text(inner, _states(at - at[0], n[at[0]:], ask & (kinds[head[~edge]] > 1), inner["many"]), n_texts)
    for h in {0, int(head[-1])}:
        i, j = np.searchsorted(head, [h, h + 1])
        p = pair[i:j]
        out.append({"bucket": -1, "head": int(e["a"][i].view(np.int64)), "first": int(e["b"][i].view(np.int64)),
                    "n_first": int(n[p[0]]), "last": int(e["b"][j - 1].view(np.int64)), "n_last": int(n[p[-1]])} | {
                        f"at_{c}": e[c][i:j].tobytes() for c in _PENDING})
    return pa.Table.from_pylist(out, schema=_MET)


def _settle_edges(met: DataFrame, n_texts: int, ask: bool) -> DataFrame:
    """The pending suffixes, compared across the cuts: what a bucket's edge needs to know of the others is how often its
    outermost kinds occur, and whether its first token has other kinds."""
    pending = met.where("bucket < 0").select(
        "head", "first", "n_first", "last", "n_last", *[F.col(f"at_{c}").alias(c) for c in _PENDING])
    heads = pending.groupBy("head").agg((F.min(F.least("first", "last")) != F.max(F.greatest("first", "last"))).alias("mixed"))
    ends = F.when(F.col("first") == F.col("last"), F.array(F.struct("first", "n_first"))).otherwise(
        F.array(F.struct("first", "n_first"), F.struct(F.col("last").alias("first"), F.col("n_last").alias("n_first"))))
    kinds = pending.select("head", F.explode(ends).alias("e")).groupBy("head", F.col("e.first").alias("kind")).agg(
        F.sum("e.n_first").alias("n"))
    known = pending.join(heads, "head").join(
        kinds.select("head", F.col("kind").alias("first"), F.col("n").alias("all_first")), ["head", "first"]).join(
        kinds.select("head", F.col("kind").alias("last"), F.col("n").alias("all_last")), ["head", "last"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                e = {c: np.frombuffer(r[c], kind) for c, kind in _PENDING.items()}
                pair = _runs(e["b"])
                n = np.bincount(pair, weights=1 + e["many"]).astype(np.int64)
                n[0], n[-1] = r["all_first"], r["all_last"]
                out += _by_text(e, _states(pair, n, np.full(len(pair), ask and r["mixed"]), e["many"]), n_texts)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_TEXT)

    return known.mapInArrow(resolve, _ddl(_TEXT))


def _texts(group: pa.Table, window: int) -> pa.Table:
    """doc, key, spans and asked windows of the texts of one bucket."""
    e = unpacked(group, _FOUND)
    order = np.lexsort((e["lows"], e["keys"], e["docs"]))
    e = {c: x[order].astype(np.int64) for c, x in e.items()}
    cov, ask = e["states"] & COVERED > 0, e["states"] & ASKED > 0
    new = np.ones(len(order), dtype=bool)
    new[1:] = (e["docs"][1:] != e["docs"][:-1]) | (e["keys"][1:] != e["keys"][:-1])
    head, text = np.flatnonzero(new), np.cumsum(new) - 1
    of, _, begin, end = _joined(text[cov], text[cov], e["lows"][cov], e["lows"][cov] + e["counts"][cov] - 1 + window)

    def lists(of: np.ndarray, *columns: np.ndarray) -> pa.Array:
        flat = np.stack(columns, axis=1).ravel()
        edges = 2 * np.searchsorted(of, np.arange(len(head) + 1))
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int32()))

    return pa.table({"doc": e["docs"][head], "key": pa.array(e["keys"][head], pa.int32()), "spans": lists(of, begin, end),
                     "asked": lists(text[ask], e["lows"][ask], e["counts"][ask])})


def _array(sent: DataFrame, n_texts: int, window: int, ask: bool) -> DataFrame:
    """doc, key, spans, asked: the buckets of `sent` compared, packed by text."""
    met = settle(sent.groupBy("bucket").applyInArrow(lambda g: _compare(g, n_texts, ask), _ddl(_MET)))
    found = met.where("bucket >= 0").select([f.name for f in _TEXT]).unionByName(_settle_edges(met, n_texts, ask))
    return settle(found.groupBy("bucket").applyInArrow(
        lambda g: _texts(g, window), "doc long, key int, spans array<int>, asked array<int>"))


def _sparse(b: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """a, b, doc, key, low, count of the sparse suffixes of a piece, or of each part of a long text."""
    data, offsets = text_bytes(b.column("text"))
    docs, keys = int64s(b.column("doc")), int64s(b.column("key"))
    for at in range(0, max(1, len(data) if b.num_rows == 1 else 1), SEGMENT):
        part, edges = (data[at:at + SEGMENT + window - 1], None) if b.num_rows == 1 else (data, offsets)
        text, low, count, first, second = sparse_suffixes(part, np.array([0, len(part)]) if edges is None else edges, window)
        yield first, second, docs[text], keys[text], low + at, count


def _dense(b: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for every byte at which an asked window begins."""
    data, offsets = text_bytes(b.column("text"))
    docs, keys, asked = int64s(b.column("doc")), int64s(b.column("key")), b.column("asked")
    lows, counts = asked.flatten().to_numpy().astype(np.int64).reshape(-1, 2).T
    text = np.repeat(np.arange(b.num_rows), np.diff(asked.offsets.to_numpy()) // 2)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lows, counts)
    text = np.repeat(text, counts)
    start = start + offsets[text]
    order = np.argsort(start, kind="stable")
    start, text = start[order], text[order]
    for at in range(0, len(data), SEGMENT):
        i, j = np.searchsorted(start, [at, at + SEGMENT])
        if i == j:
            continue
        name, s, t = Names(data[at:at + SEGMENT + window - 1]), start[i:j] - at, text[i:j]
        half = window // 2
        yield name(s, s + half), name(s + half, s + window), docs[t], keys[t], start[i:j] - offsets[t], np.ones(len(s), np.int64)


def _splitters(texts: DataFrame, of, window: int, n_buckets: int, n_suffixes: int) -> Splitters:
    """Drawn by hash from all suffixes of the texts: about SAMPLES for each splitter, whatever the input."""
    limit = np.uint64(min(SAMPLES * min(n_buckets, SPLITTERS) / max(1, n_suffixes), 1.0) * (2.0 ** 64 - 2048))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", SEGMENT):
            for a, second, docs, keys, lows, _ in of(b, window):
                place = _places(docs, keys, lows)
                keep = mix(place) <= limit
                yield pa.RecordBatch.from_pydict({"tokens": pa.array(
                    [np.stack([a[keep], second[keep], place[keep]]).tobytes()], pa.binary())})

    drawn = [np.zeros((3, 0), np.uint64)]
    if n_buckets > 1:
        drawn += [np.frombuffer(r[0], "<u8").reshape(3, -1) for r in texts.mapInArrow(draw, "tokens binary").collect()]
    return Splitters(list(np.concatenate(drawn, axis=1)), n_buckets)


def _suffixes(texts: DataFrame, of, window: int, splitters: Splitters) -> DataFrame:
    """All suffixes of the texts in packed rows by bucket."""
    shared = texts.sparkSession.sparkContext.broadcast(splitters)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", SEGMENT):
            for part in of(b, window):
                if len(part[0]):
                    yield pa.RecordBatch.from_pylist(_sent(*part, window, shared.value), schema=_SENT)

    return texts.mapInArrow(send, _ddl(_SENT))


def repeated_spans(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, key, spans (begin and end of the covered stretches of bytes, in a row), one or two rows for each text.

    texts has doc (long), key (int, a hash of the text) and text.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = 1 + total // BUCKET_BYTES
    n_texts = 1 + n_buckets // 8
    thin = max(1, total // DRAWN_BYTES)
    few = texts.where(F.pmod(F.xxhash64("doc", "key"), F.lit(thin)) == 0)
    splitters = _splitters(few, _sparse, window, n_buckets, total // thin // 32)
    sparse = _array(_suffixes(texts, _sparse, window, splitters), n_texts, window, True)
    asked = sparse.where(F.size("asked") > 0).select(F.col("doc").alias("of"), F.col("key").alias("of_key"), "asked")
    counts = F.filter("asked", lambda _, i: i % 2 == 1)
    n_windows = asked.agg(F.sum(F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    some, _ = split(texts, asked.select(F.col("of").alias("doc")), "doc")
    joined = some.join(asked, (F.col("doc") == F.col("of")) & (F.col("key") == F.col("of_key"))).select(
        "doc", "key", "text", "asked")
    all_windows = few.withColumn("asked", F.array(F.lit(0), F.greatest(F.octet_length("text") - (window - 1), F.lit(0))))
    splitters = _splitters(all_windows.where("text is not null"), _dense, window, 1 + n_windows * 32 // BUCKET_BYTES, total // thin)
    dense = _array(_suffixes(joined, _dense, window, splitters), n_texts, window, False)
    return sparse.where(F.size("spans") > 0).select("doc", "key", "spans").unionByName(dense.select("doc", "key", "spans"))


def _cut(text: bytes, spans: list[int] | None) -> tuple[list[bytes], int]:
    """What is left of a text, and the number of stretches that went."""
    kept, at, n = [], 0, 0
    for begin, end in sorted(zip(spans[0::2], spans[1::2])) if spans else ():
        if begin > at or not n:
            n += 1
            kept.append(text[at:begin])
        at = max(at, end)
    kept.append(text[at:])
    return kept, n


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False,
) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_bytes: the text's UTF-8 bytes without all repeated ones.

    A byte goes when a string of `window` bytes that covers it also starts anywhere else, in any row or at another place
    of the same text; overlaps count, and so do the first occurrence and rows that are repeated as a whole. n_spans is
    the number of maximal removed stretches. Null text has no bytes. A null doc_id is as any other. Texts shorter than the
    window are left whole. No rows: no rows. Columns with the names of results are replaced. With `digest`, kept_sha256
    (lowercase hex) instead of kept_bytes. Names have 64 bits and two of them decide: at 10^13 suffixes, some 10^-13 of
    them would meet a false partner.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept_bytes"]
    docs = docs.drop(*[c for c in made if c not in (text, doc_id)])
    keyed = docs.withColumns({
        "__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))),
        "__key": F.hash(F.coalesce(F.col(text), F.lit("")))})
    spans = repeated_spans(keyed.select(F.col("__doc").alias("doc"), F.col("__key").alias("key"), F.col(text).alias("text")), window)
    merged = settle(spans.groupBy(F.col("doc").alias("__of"), F.col("key").alias("__of_key")).agg(
        F.flatten(F.collect_list("spans")).alias("__spans")))
    some, whole = split(keyed, merged.select(F.col("__of").alias("__doc")), "__doc")
    joined = some.join(merged, (F.col("__doc") == F.col("__of")) & (F.col("__key") == F.col("__of_key")), "left").select(
        *docs.columns, "__spans")
    out = joined.unionByName(whole.select(*docs.columns, F.lit(None).cast("array<int>").alias("__spans")))
    names = [*docs.columns, *made]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for t, s in zip(b.column(text).cast(pa.large_binary()).to_pylist(), b.column("__spans").to_pylist()):
                t = t or b""
                parts, n = _cut(t, s)
                n_bytes.append(len(t))
                n_removed.append(len(t) - sum(map(len, parts)))
                n_spans.append(n)
                left = b"".join(parts)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)),
                 pa.array(kept, pa.string() if digest else pa.binary())], names=names)

    return out.mapInArrow(
        finish, extended(docs, f"n_bytes long, n_removed long, n_spans long, {made[3]} {'string' if digest else 'binary'}"))
