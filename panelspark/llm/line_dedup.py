"""Removal of lines that are near copies of an earlier line: an exact set-similarity join with prefix filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelspark.functions.text import let
from panelspark.llm.membership import bit_set, may_hold, split
from panelspark.llm.rarity import bucket_of, count_keys, rare_first, unpacked
from panelspark.llm.words import SPACED, Words, int64s, mix, pieces, spans
from panelspark.sources.sinks import settle

PERCENT = 80
BUCKET_BYTES = 16 << 20
SENT_BYTES = 2 << 20  # of text whose sets are held at once
BEST = 16  # candidates kept for each line and key; a second round takes all where these don't settle it
FIRST = 4  # of a line's candidates over all keys, how many are verified first; the others where these don't settle it
_PAIRS = 1 << 20  # pairs compared at once
_WIDE_PAIRS = 1 << 17  # the same by all words of their bit maps
WIDE = 8  # words of the bit map of the largest sets; a larger set needs more bits for as sharp a bound
_ENTRY = {"keys": "<u4", "sets": "<u8", "tags": "<u2", "probes": "<i1"}
_NARROW = ("docs", "lines", "sizes", "ranks")  # in the fewest bytes that hold the row's values; docs from `base`
_OWN = {"own_docs": "<i8", "own_tags": "<u2", "own_lines": "<i4"}
_SENT = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), *((c, pa.binary()) for c in (*_ENTRY, *_NARROW, "bits", *_OWN))])


class Lines:
    """Token sets of all lines with a word of some texts, each set's tokens from rare to frequent.

    only: says of text numbers and lines which ones are taken. having: lines with none of these tokens are left out.
    """

    def __init__(self, texts: pa.Array, counters: np.ndarray, only: Callable | None = None, having: np.ndarray | None = None):
        w = Words(texts, SPACED, fold=True)
        breaks = np.flatnonzero(w.data == 10)
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        line = np.searchsorted(breaks, w.starts) - np.searchsorted(breaks, w.offsets)[doc]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
        self.doc, self.line = doc[new], line[new]
        of, hashes = np.cumsum(new) - 1, w.hashes
        take = np.ones(len(self.doc), dtype=bool)
        if only is not None:
            take = only(self.doc, self.line)
        if having is not None:
            some = np.zeros(len(take), dtype=bool)
            some[of[may_hold(having, rare_first(hashes, counters).view(np.int64))]] = True
            take &= some
        if not take.all():
            self.doc, self.line = self.doc[take], self.line[take]
            hashes, of = hashes[take[of]], (np.cumsum(take) - 1)[of[take[of]]]
        keys = rare_first(hashes, counters)
        order = _within(of, keys, len(self.doc))
        keys, of = keys[order], of[order]
        once = np.ones(len(keys), dtype=bool)
        once[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        self.keys, self.of = keys[once], of[once]
        self.begin = np.searchsorted(self.of, np.arange(len(self.doc)))
        self.size = np.diff(np.append(self.begin, len(self.of)))
        if len(self.doc):
            self.set = mix(np.add.reduceat(mix(self.keys), self.begin) + self.size.astype(np.uint64))
            self.bits = np.bitwise_xor.reduceat(np.uint64(1) << (self.keys & np.uint64(63)), self.begin)
        else:
            self.set = self.bits = np.empty(0, dtype=np.uint64)

    def words(self, some: np.ndarray) -> np.ndarray:
        """The bit maps of these lines one after the other, each of width() words that give `bits` when added without carry."""
        out, i = [], 0
        while i < len(some):
            own = some[i:i + 4096]
            size = self.size[own]
            row = np.repeat(np.arange(len(own)), size)
            odd = np.bincount(row * 64 * WIDE + (self.keys[spans(self.begin[own], size)] & np.uint64(64 * WIDE - 1)).astype(np.int64),
                              minlength=len(own) * 64 * WIDE).astype(np.uint8) & 1
            maps, w = np.packbits(odd, bitorder="little").view("<u8").reshape(-1, WIDE), width(size)
            full = np.zeros((len(own), WIDE), dtype=np.uint64)
            for n in np.unique(w):
                full[w == n, :n] = np.bitwise_xor.reduce(maps[w == n].reshape(-1, WIDE // n, n), axis=1)
            out.append(full[np.arange(WIDE) < w[:, None]])
            i += 4096
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def width(size: np.ndarray) -> np.ndarray:
    """Words of the bit map of a set: 1, 2, 4 or 8."""
    return 1 + (size > 64) + 2 * (size > 128) + 4 * (size > 256)


def _within(of: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Order by (of, key), of in 0 .. n-1: one sort by the key's upper bits where these tell all keys apart."""
    shift = np.uint64(max(n - 1, 1).bit_length())
    both = (of.astype(np.uint64) << (np.uint64(64) - shift)) | (keys >> shift)
    order = np.argsort(both)
    same = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    if (keys[order[same]] != keys[order[same + 1]]).any():
        return np.lexsort((keys, of))
    return order


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One number for a document's line."""
    return mix(mix(doc.astype(np.int64).view(np.uint64)) + line.astype(np.uint64)).view(np.int64)


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    return (percent * size + 99) // 100


def _overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least number of common tokens of similar sets with these sizes."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _asks(x: Lines, probe: pa.Array) -> np.ndarray:
    """Which lines ask for candidates: those that the text's list names, or all where there is no list."""
    flat, rows = probe.flatten().to_numpy().astype(np.int64), np.arange(len(probe))
    sizes = pc.fill_null(pc.list_value_length(probe), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    named = np.isin((x.doc.astype(np.int64) << 32) | x.line, (np.repeat(rows, sizes) << 32) | flat)
    return named | probe.is_null().to_numpy(zero_copy_only=False)[x.doc]


def _prefixes(x: Lines, percent: int) -> np.ndarray:
    """Of all tokens of all lines (x.of, x.keys), which belong to a prefix."""
    rank = np.arange(len(x.of)) - x.begin[x.of] + 1
    size = x.size[x.of]
    return rank <= size - needed(size, percent) + 1


def _send(
    b: pa.RecordBatch, counters: np.ndarray, wanted: np.ndarray | None, n_buckets: int, percent: int,
) -> Iterator[dict]:
    """Prefix entries of a piece's distinct sets for each bucket of tokens, and its lines that repeat an earlier one.

    wanted: tokens that any line in question has in its prefix; entries of others can meet none.
    """
    x = Lines(b.column("text"), counters, having=wanted)
    docs, tags = int64s(b.column("doc")), b.column("tag").to_numpy().astype("<u2")
    if not len(x.doc):
        return
    d = docs[x.doc]
    order = np.lexsort((x.line, d, x.set))
    s, dd, ll = x.set[order], d[order], x.line[order]
    head = np.ones(len(s), dtype=bool)
    head[1:] = s[1:] != s[:-1]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    again = (dd != dd[lead]) | (ll != ll[lead])
    keep = np.zeros(len(s), dtype=bool)
    keep[order[head]] = True
    take = keep[x.of]
    of, keys = x.of[take], x.keys[take]
    rank = (np.arange(len(x.of)) - x.begin[x.of])[take] + 1
    size = x.size[of]
    prefix = rank <= size - needed(size, percent) + 1
    of, keys, rank, size = of[prefix], keys[prefix], rank[prefix], size[prefix]
    if wanted is not None:
        hits = may_hold(wanted, keys.view(np.int64))
        of, keys, rank, size = of[hits], keys[hits], rank[hits], size[hits]
    asks = _asks(x, b.column("probe"))
    own = order[again]
    local = {"own_docs": d[own].astype("<i8").tobytes(), "own_tags": tags[x.doc[own]].tobytes(),
             "own_lines": x.line[own].astype("<i4").tobytes()}
    none = dict.fromkeys(_OWN, b"")
    if not len(of):
        if own.size:
            yield {"bucket": 0, "base": 0} | dict.fromkeys((*_ENTRY, *_NARROW, "bits"), b"") | local
        return
    h, base = mix(keys), int(d[of].min())
    bucket = bucket_of(h, n_buckets)
    order = np.argsort(bucket.astype(np.uint16) if n_buckets < 1 << 16 else bucket, kind="stable")
    bucket, of, rank, size = bucket[order], of[order], rank[order], size[order]
    sent = np.unique(of)  # lines with an entry
    at = np.searchsorted(sent, of)
    wide = width(x.size[sent])
    first = np.cumsum(wide) - wide
    maps = x.words(sent)[spans(first[at], wide[at])]
    ends = np.cumsum(wide[at])
    columns = {"keys": (h[order] >> np.uint64(32)).astype("<u4"), "sets": x.set[of], "tags": tags[x.doc[of]],
               "docs": _narrow((d[of] - base).view(np.uint64)), "lines": _narrow(x.line[of]), "sizes": _narrow(size),
               "ranks": _narrow(rank)}
    if not asks.all():
        columns["probes"] = asks[of].astype("<i1")
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for n, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
        yield {"bucket": int(bucket[i]), "base": base, "probes": b"", "bits": maps[ends[i] - wide[at[i]]:ends[j - 1]].tobytes()} | {
            k: v[i:j].tobytes() for k, v in columns.items()} | (none if n else local)


def _entries(group: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The entries of a bucket, and the words of their bit maps; `at` says where an entry's begin."""
    e = unpacked(group, {k: v for k, v in _ENTRY.items() if k != "probes"})
    n = np.array([len(x) // 4 for x in group["keys"].to_pylist()], dtype=np.int64)
    for c in _NARROW:
        parts = [np.frombuffer(x, f"<u{len(x) // k}").astype(np.int64) for x, k in zip(group[c].to_pylist(), n) if k]
        e[c] = np.concatenate(parts) if parts else np.empty(0, np.int64)
    e["docs"] = e["docs"] + np.repeat(int64s(group["base"]), n)
    e["probes"] = np.frombuffer(b"".join([x or b"\x01" * k for x, k in zip(group["probes"].to_pylist(), n)]), "<i1")
    wide = width(e["sizes"])
    e["at"] = np.cumsum(wide) - wide
    return e, np.frombuffer(b"".join(group["bits"].to_pylist()), "<u8")


def _far(maps: np.ndarray, at: np.ndarray, wide: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the maps of pairs differ, the wider one brought to the other's width."""
    least, out = np.minimum(wide[a], wide[b]), np.empty(len(a), dtype=np.int64)
    for n in np.unique(least):
        pairs = np.flatnonzero(least == n)
        for i in range(0, len(pairs), _WIDE_PAIRS):
            some, word = pairs[i:i + _WIDE_PAIRS], np.arange(n)
            x = np.zeros((len(some), n), dtype=np.uint64)
            for side in (a[some], b[some]):
                own = maps[at[side][:, None] + word]
                for k in range(n, int(wide[side].max()), n):
                    more = wide[side] > k
                    own[more] ^= maps[at[side[more]][:, None] + k + word]
                x ^= own
            out[some] = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the fewest bytes that hold them all."""
    return values.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if int(values.max()) < 1 << 8 * w))


def _best(later: np.ndarray, other: np.ndarray, far: np.ndarray, more: np.ndarray, limit: int | None):
    """For each later entry the `limit` nearest others; `more` where some were left out."""
    if limit is None or not len(later):
        return later, other, far, more
    order = np.lexsort((far, later))
    later, other, far, more = later[order], other[order], far[order], more[order]
    head = np.flatnonzero(np.diff(later, prepend=-1))
    count = np.diff(np.append(head, len(later)))
    place = np.arange(len(later)) - np.repeat(head, count)
    more = np.repeat(np.logical_or.reduceat(more, head) | (count > limit), count)
    keep = place < limit
    return later[keep], other[keep], far[keep], more[keep]


def _meet(group: pa.Table, percent: int, limit: int | None) -> pa.Table:
    """Within a bucket of tokens: lines whose set occurs earlier, and candidate pairs of sets.

    Pairs share a prefix token, have sizes that can reach the similarity, pass the positional filter for the first
    common token, and differ in few enough bits of their bit maps (parities, in which common tokens cancel; wider for larger
    sets). The later line of a pair names its nearest candidates.
    """
    e, maps = _entries(group)
    own = unpacked(group, _OWN)
    _, key, times = np.unique(e["keys"], return_inverse=True, return_counts=True)
    live = np.flatnonzero(times[key] > 1)
    e, key = {k: v[live] for k, v in e.items()}, key[live]
    order = np.lexsort((e["lines"], e["docs"], e["sets"], key))
    e, key = {k: v[order] for k, v in e.items()}, key[order]
    head = np.ones(len(key), dtype=bool)
    head[1:] = (key[1:] != key[:-1]) | (e["sets"][1:] != e["sets"][:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(key) else np.empty(0, np.int64)
    again = ((e["docs"] != e["docs"][lead]) | (e["lines"] != e["lines"][lead])) & (e["ranks"] == 1)
    gone = {k: e[k][again] for k in ("docs", "tags", "lines")}
    e, key = {k: v[head] for k, v in e.items()}, key[head]
    size = e["sizes"].astype(np.int64)
    order = np.lexsort((size, key))
    e, key, size = {k: v[order] for k, v in e.items()}, key[order], size[order]
    rank, docs, lines, wide = e["ranks"], e["docs"], e["lines"], width(size)
    bits = np.bitwise_xor.reduceat(maps[spans(e["at"], wide)], np.cumsum(wide) - wide) if len(size) else maps
    place = (key.astype(np.int64) << 32) | size
    last = np.searchsorted(place, (key.astype(np.int64) << 32) | (100 * size // percent), "right")
    count = np.where(size - rank + 1 >= _overlap(size, size, percent), last - np.arange(len(size)) - 1, 0)
    ends, found, i = np.cumsum(count), [], 0
    while i < len(count):
        done = int(ends[i] - count[i])
        j = max(i + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
        if ends[j - 1] > done:
            a = np.repeat(np.arange(i, j), count[i:j])
            b = a + 1 + np.arange(len(a)) - np.repeat(ends[i:j] - count[i:j] - done, count[i:j])
            least = _overlap(size[a], size[b], percent)
            fits = (np.minimum(size[a] - rank[a], size[b] - rank[b]) + 1 >= least)
            a, b, least = a[fits], b[fits], least[fits]
            far = np.bitwise_count(bits[a] ^ bits[b]).astype(np.int64)
            near = far <= size[a] + size[b] - 2 * least
            a, b, far, least = a[near], b[near], far[near], least[near]
            more = np.flatnonzero(np.minimum(wide[a], wide[b]) > 1)
            far[more] = _far(maps, e["at"], wide, a[more], b[more])
            near = far <= size[a] + size[b] - 2 * least
            a, b, far = a[near], b[near], far[near]
            first = (docs[a] < docs[b]) | ((docs[a] == docs[b]) & (lines[a] < lines[b]))
            later, other = np.where(first, b, a), np.where(first, a, b)
            asks = (e["probes"][later] == 1) & ((docs[a] != docs[b]) | (lines[a] != lines[b]))
            found.append(_best(later[asks], other[asks], far[asks], np.zeros(int(asks.sum()), bool), limit))
        i = j
    later, other, far, more = _best(*[np.concatenate(c) for c in zip(*found)], limit) if found else (
        np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)
    n, m = len(gone["docs"]) + len(own["own_docs"]), len(later)

    def column(a: np.ndarray, b: np.ndarray, c: np.ndarray, kind) -> pa.Array:
        return pa.array(np.concatenate((a, b, c)).astype(kind))

    def pair(c: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate((np.zeros(n, np.int64), c.view(np.int64))), mask=np.arange(n + m) < n)

    return pa.table({
        "doc": column(gone["docs"], own["own_docs"], docs[later], np.int64),
        "tag": column(gone["tags"], own["own_tags"], e["tags"][later], np.int32),
        "line": column(gone["lines"], own["own_lines"], lines[later], np.int32),
        "a": pair(e["sets"][later]), "b": pair(e["sets"][other]),
        "a_at": pair(_place(docs[later], lines[later])), "b_at": pair(_place(docs[other], lines[other])),
        "b_doc": pair(docs[other]), "far": pair(far),
        "more": pa.array(np.concatenate((np.zeros(n, bool), more)) if m else np.zeros(n, bool))})


def _open_keys(asked: DataFrame, counters: np.ndarray, percent: int) -> DataFrame:
    """key: the prefix tokens of the lines that ask."""
    shared = asked.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", SENT_BYTES):
            x = Lines(b.column("text"), shared.value)
            if len(x.doc):
                own = _prefixes(x, percent) & _asks(x, b.column("probe"))[x.of]
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.unique(x.keys[own]).view(np.int64))})

    return asked.mapInArrow(run, "key long")


def _met(rows: DataFrame, counters: np.ndarray, percent: int, limit: int | None, wanted: np.ndarray | None = None) -> DataFrame:
    """doc, tag, line of lines that repeat an earlier set (a and b null), and candidates a, b with their places, the bits in
    which they differ and `more`."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-2 * total // BUCKET_BYTES))
    shared = rows.sparkSession.sparkContext.broadcast((counters, wanted))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", SENT_BYTES):
            got = list(_send(b, *shared.value, n_buckets, percent))
            if got:
                yield pa.RecordBatch.from_pylist(got, schema=_SENT)

    sent = rows.mapInArrow(send, ", ".join(
        f"{f.name} { {'bucket': 'int', 'base': 'long'}.get(f.name, 'binary')}" for f in _SENT))
    return sent.groupBy("bucket").applyInArrow(
        lambda g: _meet(g, percent, limit), "doc long, tag int, line int, a long, b long, a_at long, b_at long, b_doc long, far long, more boolean")


def _token_sets(rows: DataFrame, pairs: DataFrame, counters: np.ndarray) -> DataFrame:
    """set, keys of every set of the pairs (and few others), from the lines named with them; each once."""
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("set"), F.col("a_at").alias("at"), F.col("doc")),
        F.struct(F.col("b").alias("set"), F.col("b_at").alias("at"), F.col("b_doc").alias("doc")))))
    shared = rows.sparkSession.sparkContext.broadcast((counters, bit_set(both, "at"), bit_set(both, "doc")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, wanted, holders = shared.value
        some = (b.filter(pa.array(may_hold(holders, int64s(b.column("doc"))))) for b in batches)
        for b in pieces(some, "text", SENT_BYTES):
            docs = int64s(b.column("doc"))
            x = Lines(b.column("text"), counters, lambda doc, line: may_hold(wanted, _place(docs[doc], line)))
            _, at = np.unique(x.set, return_index=True)
            if len(at):
                keys = pa.array(x.keys[spans(x.begin[at], x.size[at])].view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(x.set[at].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(x.size[at]))), pa.int32()), keys),
                ], names=["set", "keys"])

    found = rows.select("doc", "text").mapInArrow(run, "set long, keys array<long>")
    return found.join(both.select("set").distinct(), "set", "left_semi").dropDuplicates(["set"])


def _candidates(met: DataFrame, first: int) -> DataFrame:
    """For each later line its `first` nearest candidates, the others, and whether there may be more."""
    other = F.struct("far", "b", "b_at", "b_doc")
    own = met.where(F.col("a").isNotNull()).groupBy("doc", "tag", "line", "a", "a_at").agg(
        F.sort_array(F.collect_set(other)).alias("all"), F.max("more").alias("more"))
    return settle(own.select("doc", "tag", "line", "a", "a_at", F.slice("all", 1, first).alias("first"), F.when(
        F.size("all") > first, F.slice("all", first + 1, F.size("all"))).alias("rest"), "more"))


def _verified(rows: DataFrame, lines: DataFrame, others: str, counters: np.ndarray, percent: int) -> DataFrame:
    """a of the lines with a similar one among these others."""
    pairs = lines.select("doc", "a", "a_at", F.inline(others))
    return settle(_similar(pairs.select("a", "b").distinct(), _token_sets(rows, pairs, counters), percent))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a of all pairs whose sets are similar, by exact intersection."""
    left = sets.select(F.col("set").alias("a"), F.col("keys").alias("ka"))
    right = sets.select(F.col("set").alias("b"), F.col("keys").alias("kb"))
    both = F.size(F.array_intersect("ka", "kb"))
    return pairs.join(left, "a").join(right, "b").where(
        100 * both >= percent * (F.size("ka") + F.size("kb") - both)).select("a").distinct()


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc, tag, line (from 0) of every line with a similar earlier line. Null doc_ids are the smallest number."""
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), _tag(text).alias("tag"),
        F.col(text).alias("text"))
    counters = count_keys(rows.select("text"), _piece_words)
    every = rows.withColumn("probe", F.lit(None).cast("array<int>"))
    met = settle(_met(every, counters, percent, BEST))
    gone = met.where(F.col("a").isNull()).select("doc", "tag", "line")
    lines = _candidates(met, FIRST)
    similar = _verified(rows, lines, "first", counters, percent)
    left = lines.where(F.col("rest").isNotNull()).join(similar, "a", "left_anti")
    if not left.isEmpty():
        similar = similar.unionAll(_verified(rows, left, "rest", counters, percent))
    gone = gone.unionAll(lines.join(similar, "a", "left_semi").select("doc", "tag", "line"))
    open_lines = settle(lines.where("more").join(similar, "a", "left_anti").select("doc", "tag", "line"))
    if not open_lines.isEmpty():  # lines whose candidates failed, although there are more: take all of theirs
        asked = open_lines.groupBy("doc", "tag").agg(F.collect_list("line").alias("probe"))
        again = rows.join(asked, ["doc", "tag"], "left").withColumn("probe", F.coalesce("probe", F.array().cast("array<int>")))
        keys = _open_keys(again.where(F.size("probe") > 0).select("text", "probe"), counters, percent)
        near = settle(_met(again.select("doc", "tag", "text", "probe"), counters, percent, None, bit_set(keys, "key")).where(
            F.col("a").isNotNull()))
        pairs = near.select("doc", "a", "a_at", "b", "b_at", "b_doc")
        similar = settle(_similar(pairs.select("a", "b").distinct(), _token_sets(rows, pairs, counters), percent))
        gone = gone.unionAll(near.join(similar, "a", "left_semi").select("doc", "tag", "line").distinct())
    return gone


def _tag(text: str):
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(1 << 16)).cast("int")


def _piece_words(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in pieces(iter([b]), "text"):
        yield Words(part.column("text"), SPACED, fold=True).hashes


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with text less its removed lines, n_lines and n_removed.

    Lines are what \\n separates. A line goes when an earlier line of the input (smaller doc_id, or before in the
    same document; itself kept or not) has a token set with a Jaccard similarity of percent / 100 or more. Tokens
    are words, A-Z lower-cased. Lines without a word stay. Null text stays null and has no lines; a null doc_id
    comes first. Rows with one doc_id and one text are the same document. Columns named n_lines or n_removed are
    replaced.
    """
    docs = docs.drop(*[c for c in ("n_lines", "n_removed") if c not in (doc_id, text)])
    gone = removed_lines(docs, doc_id, text, percent)
    by_doc = settle(gone.groupBy(F.col("doc").alias("__of"), F.col("tag").alias("__of_tag")).agg(
        F.collect_set("line").alias("__gone")))
    keyed = docs.withColumns({
        "__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), "__tag": _tag(text)})
    some, whole = split(keyed, by_doc.select(F.col("__of").alias("__doc")), "__doc")
    out = some.join(by_doc, (F.col("__doc") == F.col("__of")) & (F.col("__tag") == F.col("__of_tag")), "left").select(
        *docs.columns, "__gone").unionByName(whole.select(*docs.columns, F.lit(None).cast("array<int>").alias("__gone")))
    lines = F.split(F.col(text), "\n")
    n_gone = F.coalesce(F.size("__gone"), F.lit(0))
    left = let(lines, lambda own: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(own) - 1), "__gone"), lambda i: F.get(own, i)), "\n"))
    kept = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left)
    return out.select(
        *[kept.alias(text) if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(n_gone).cast("long").alias("n_removed"))
