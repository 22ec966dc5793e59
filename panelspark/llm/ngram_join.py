"""Near-duplicate texts: a Jaccard join of word n-gram sets with adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.components import components
from panelspark.llm.membership import bit_set, may_hold, split
from panelspark.llm.rarity import bucket_of, count_keys, packed, rare_first, unpacked
from panelspark.llm.words import SPACED, Words, extended, pieces, sequence_hash
from panelspark.sources.sinks import settle

LEVELS = 6  # longest multi-match: this many shared prefix keys
BUCKET_BYTES = 24 << 20
SKETCH = 2048  # bits of a set's parity sketch
VERIFY = 4  # cost of a candidate, in units of a list entry
BLOCK_KEYS, BLOCK_SETS = 1 << 19, 1024  # a component's sets are counted block against block of about this size
GROUP_KEYS = 1 << 17  # small components share a group of about this size
LIST_SETS = 4096  # of a key's list that meet in one group
GROUP_ENTRIES = 1 << 15
PAIRS = 1 << 19  # looked at at once
FOLD = 4  # longs of a folded sketch
DENSE = 50  # a key held by more than one pair of sets in so many is counted in a matrix product
_ENTRY = {"keys": "<u8", "ids": "<i8", "sizes": "<i4", "ranks": "<i4"}


def shingles(words: np.ndarray, whole: np.ndarray, n: int, lo: int, hi: int) -> np.ndarray:
    """The distinct hashes of n-word shingles of words[lo:hi], sorted; fewer words: of the whole sequence.

    whole: sequence_hash(words, n) of all texts in a row.
    """
    if hi - lo >= n:
        return np.unique(whole[lo:hi - n + 1])
    return sequence_hash(words[lo:hi], hi - lo) if hi > lo else np.empty(0, np.uint64)


def _sets(b: pa.RecordBatch, text: str, n: int) -> Iterator[np.ndarray]:
    w = Words(b.column(text), SPACED, fold=True)
    whole = sequence_hash(w.hashes, n)
    for lo, hi in zip(w.first[:-1], w.first[1:]):
        yield shingles(w.hashes, whole, n, int(lo), int(hi))


def _identity(keys: np.ndarray) -> int:
    """A number for the set, the same for equal sets."""
    return int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(size, percent: int):
    """Least overlap with any set that can link: ceil(percent * size / 100)."""
    return (percent * size + 99) // 100


def _prefixes(docs: DataFrame, text: str, n: int, percent: int, counters: np.ndarray) -> DataFrame:
    """docs without text, with n_shingles, set_id, prefix (the rarest keys, for the longest multi-match) and sketch.

    A bit of the sketch is the parity of the keys that fall on it. In the exclusive or of two sketches common keys
    cancel, so its bits are at most the keys in which the sets differ.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            size, ids, prefix, sketch = [], [], [], []
            for keys in _sets(b, text, n):
                size.append(len(keys))
                ids.append(_identity(keys))
                order = np.sort(rare_first(keys, shared.value))
                prefix.append(order[:len(keys) - needed(len(keys), percent) + LEVELS].tobytes())
                odd = np.bincount((keys >> np.uint64(20) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
                sketch.append(np.packbits(odd.astype(bool)).view(np.int64))
            kept = b.drop_columns([text])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(size, pa.int64()), pa.array(ids, pa.int64()), pa.array(prefix, pa.binary()),
                 pa.array(sketch, pa.list_(pa.int64()))],
                names=[*kept.schema.names, "n_shingles", "set_id", "prefix", "sketch"])

    return docs.mapInArrow(run, extended(docs.drop(text), "n_shingles long, set_id long, prefix binary, sketch array<long>"))


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """key, id, size, rank, level, df of each prefix key that two sets or more have.

    A key's level is the least multi-match whose prefix has it. Sets are exchanged by key in packed rows; within a
    bucket a set has each key once, and equal sets count once, so that no bucket gathers copies.
    """
    total = sets.agg(F.sum(F.length("prefix"))).first()[0] or 0
    n_buckets = max(1, -(-3 * total // BUCKET_BYTES))
    one = sets.groupBy("set_id").agg(F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("prefix").to_pylist()
            counts = np.array([len(p) // 8 for p in raw], dtype=np.int64)
            keys = np.frombuffer(b"".join(raw), "<u8")
            size = np.repeat(b.column("size").to_numpy(), counts)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            rows = list(packed(bucket_of(keys, n_buckets), {
                "keys": keys, "ids": np.repeat(b.column("set_id").to_numpy(), counts),
                "sizes": size.astype("<i4"), "ranks": place.astype("<i4")}))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_PACKED)

    def meet(group: pa.Table) -> pa.Table:
        e = unpacked(group, _ENTRY)
        _, which, times = np.unique(e["keys"], return_inverse=True, return_counts=True)
        df = times[which]
        keep = df > 1
        size, rank = e["sizes"][keep].astype(np.int64), e["ranks"][keep]
        return pa.table({
            "key": e["keys"][keep].view(np.int64), "id": e["ids"][keep], "size": size, "rank": rank,
            "level": np.maximum(1, rank - (size - needed(size, percent))).astype(np.int32), "df": df[keep]})

    sent = one.where(F.col("size") > 0).mapInArrow(
        send, "bucket int, " + ", ".join(f"{c} binary" for c in _ENTRY))
    return sent.groupBy("bucket").applyInArrow(meet, "key long, id long, size long, rank int, level int, df long")


_PACKED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in _ENTRY)])


def adaptive_lengths(postings: DataFrame, percent: int) -> DataFrame:
    """id, match and weight (the length of its lists): how many shared prefix keys a set asks for; no row where it can
    have no partner.

    For match m and partners of its own size, the lists of the keys in its prefix hold C(m) entries; at most C(m) / m
    candidates have m of them. The chosen m has the least C(m) + VERIFY * C(m) / m. A set with a partner has m shared keys up to level
    m for every m it may ask for (its least overlap is at least m); a set that lacks them for one m is left out.
    """
    levels = range(1, LEVELS + 1)
    least = F.floor((2 * percent * F.col("size") + 99 + percent) / (100 + percent))
    one = postings.groupBy("id").agg(F.first("size").alias("size"), *[
        x for m in levels for x in (
            F.count(F.when(F.col("level") <= m, 1)).alias(f"n{m}"),
            F.sum(F.when(F.col("rank") <= F.col("size") - least + m, F.col("df")).otherwise(0)).alias(f"c{m}"))],
        F.sum("df").alias("weight"))
    most = F.least(F.lit(LEVELS), F.floor((percent * F.col("size") + 99) / 100))
    alive: Column = F.lit(True)
    for m in levels:
        alive = alive & ((F.lit(m) > most) | (F.col(f"n{m}") >= m))
    cost = [F.struct(
        F.when(F.lit(m) <= most, F.col(f"c{m}") * (1 + F.lit(VERIFY) / m)).otherwise(float("inf")).alias("cost"),
        F.lit(m).alias("m")) for m in levels]
    return one.where(alive).select(
        "id", F.array_min(F.array(*cost))["m"].alias("match"), "weight")


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Sizes of sets that can link."""
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be similar: their sketches differ in no more bits than similar sets have keys apart."""
    left = sketches.select(F.col("set_id").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("xa"))
    right = sketches.select(F.col("set_id").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("xb"))
    total = F.col("na") + F.col("nb")
    apart = total - 2 * F.floor((percent * total + 99 + percent) / (100 + percent))
    bits = F.aggregate(F.zip_with("xa", "xb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return pairs.join(left, "a").join(right, "b").where(bits <= apart).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity is at least percent / 100, by exact intersection.

    Only the texts of one row of each set of a pair are read again; bit sets of fixed size choose them where they lie.
    """
    pairs = settle(pairs)
    wanted = pairs.select(F.col("a").alias("set_id")).unionAll(pairs.select("b")).distinct()
    full = settle(_wanted_sets(wanted, docs, sets, text, n))
    left = full.select(F.col("set_id").alias("a"), F.col("keys").alias("ka"))
    right = full.select(F.col("set_id").alias("b"), F.col("keys").alias("kb"))
    both = F.size(F.array_intersect("ka", "kb"))
    return pairs.join(left, "a").join(right, "b").where(
        100 * both >= percent * (F.size("ka") + F.size("kb") - both)).select("a", "b").distinct()


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Common keys of every set of a with every set of b (float32, exact up to 2^24)."""
    (ka, kb), (ra, rb) = (np.concatenate(x) for x in (a, b)), (np.repeat(np.arange(len(x)), [len(k) for k in x]) for x in (a, b))
    both = np.intersect1d(ka, kb)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    if not len(both):
        return out

    def held(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, keys), len(both) - 1)
        keep = both[at] == keys
        at, rows = at[keep], rows[keep]
        order = np.argsort(at, kind="stable")
        return at[order], rows[order], np.bincount(at, minlength=len(both))

    (pa_, ra, na), (pb, rb, nb) = held(ka, ra), held(kb, rb)
    dense = na * nb * DENSE > len(a) * len(b)
    place = np.cumsum(dense) - 1
    for lo in range(0, int(dense.sum()), 4096):
        part = []
        for at, rows, size in ((pa_, ra, len(a)), (pb, rb, len(b))):
            use = dense[at] & (place[at] >= lo) & (place[at] < lo + 4096)
            m = np.zeros((size, min(4096, int(dense.sum()) - lo)), dtype=np.float32)
            m[rows[use], place[at[use]] - lo] = 1
            part.append(m)
        out += part[0] @ part[1].T
    # the other keys: each entry of a meets the entries of b with its key
    first = np.cumsum(nb) - nb
    rare = ~dense[pa_]
    at, rows = pa_[rare], ra[rare]
    ends = np.cumsum(nb[at])
    lo = 0
    while lo < len(at):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + (1 << 22), "right")))
        times = nb[at[lo:hi]]
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        cell = np.repeat(rows[lo:hi], times) * len(b) + rb[np.repeat(first[at[lo:hi]], times) + step]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape).astype(np.float32)
        lo = hi
    return out


def _partners(docs: DataFrame, sets: DataFrame, parts: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """set_id, others: rows of the other sets each set of a component is similar to, by exact intersection.

    All links of a set lie in its component. Every pair of a component's sets meets once: sets are dealt into blocks by
    their hash, and a group holds two blocks of one component or many small components whole. Groups return a count for
    each set, so no pair becomes a row. A component of two sets has the one link that made it.
    """
    known = settle(sets.groupBy("set_id").agg(F.count("*").alias("rows"), F.first("n_shingles").alias("size")).join(
        parts.withColumnRenamed("node", "set_id"), "set_id"))
    whole = known.groupBy("component").agg(
        F.count("*").alias("n_sets"), F.sum("rows").alias("all_rows"), F.sum("size").alias("n_keys"))
    known = settle(known.join(whole, "component"))
    two = known.where("n_sets = 2").select("set_id", (F.col("all_rows") - F.col("rows")).alias("others"))
    more = known.where("n_sets > 2")
    n_groups = max(1, -(-(more.agg(F.sum("size")).first()[0] or 0) // GROUP_KEYS))
    blocks = F.greatest(F.ceil(F.col("n_keys") / BLOCK_KEYS), F.ceil(F.col("n_sets") / BLOCK_SETS)).cast("int")
    large = F.col("blocks") > 1
    x = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = more.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")).withColumn("other", x).select(
        "set_id", "rows", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        large.alias("large"), F.when(large, F.col("component")).otherwise(
            F.pmod(F.xxhash64("component"), F.lit(n_groups))).alias("place"))
    full = settle(_wanted_sets(more.select("set_id"), docs, sets, text, n))

    def meet(group: pa.Table) -> pa.Table:
        ids, at = np.unique(group["set_id"].to_numpy(), return_index=True)  # a set can have been read from several rows
        group = group.take(pa.array(at))
        column = group["keys"].combine_chunks()
        flat, edges = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        keys = [flat[i:j] for i, j in zip(edges[:-1], edges[1:])]
        weight, block = group["rows"].to_numpy(), group["block"].to_numpy()
        size, others = np.diff(edges), np.zeros(len(ids), dtype=np.int64)
        component = group["component"].to_numpy()
        order = np.argsort(component, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            left, right = own[block[own] == block[own].min()], own[block[own] == block[own].max()]
            same = group["lo"][0].as_py() == group["hi"][0].as_py()
            if not same and block[own].min() == block[own].max():
                continue  # one of the two blocks has no set
            common = _intersections([keys[i] for i in left], [keys[i] for i in right]).astype(np.int64)
            near = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
            if same:
                np.fill_diagonal(near, False)
            else:
                others[right] += weight[left] @ near
            others[left] += near @ weight[right]
        return pa.table({"set_id": ids, "others": others})

    counted = full.join(dealt, "set_id").groupBy("large", "place", "lo", "hi").applyInArrow(meet, "set_id long, others long")
    return two.unionAll(counted.groupBy("set_id").agg(F.sum("others").alias("others")))


def _list_pairs(entries: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """a, b: sets of different parts with as many shared prefix keys as the longer of both adaptive prefixes asks for.

    entries: key, id, size, rank, match, part. Pairs are looked at where a list lies and leave it only if the sets' sizes,
    the places of the key and folded sketches let them be similar. A list of more than LIST_SETS sets is cut into blocks
    that meet two by two, each two in any task.
    """
    def folded(j: int) -> Column:
        own = F.filter("sketch", lambda _, i: i % FOLD == j)
        return F.aggregate(own, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))

    fold = F.array(*map(folded, range(FOLD)))
    known = entries.join(sketches.select(F.col("set_id").alias("id"), fold.alias("fold")), "id")
    lists = settle(entries.groupBy("key").agg(F.ceil(F.count("*") / LIST_SETS).cast("int").alias("blocks"), F.count("*").alias("n")))
    n_groups = 1 + (lists.agg(F.sum(F.col("blocks") * F.col("n"))).first()[0] or 0) // GROUP_ENTRIES
    dealt = known.join(lists, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "id", "size", "rank", "match", "part", "fold", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(n_groups)))

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("key", "lo", "hi")])
        e = {c: group[c].to_numpy().astype(np.int64) for c in ("key", "lo", "hi", "id", "size", "rank", "match", "part", "block")}
        fold = group["fold"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, FOLD)
        new = np.ones(len(fold), dtype=bool)
        new[1:] = np.logical_or.reduce([e[c][1:] != e[c][:-1] for c in ("key", "lo", "hi")])
        ends = np.append(np.flatnonzero(new)[1:], len(new))[np.cumsum(new) - 1]
        count = ends - np.arange(len(new)) - 1
        total, found, i = np.cumsum(count), [], 0
        while i < len(count):
            done = int(total[i] - count[i])
            j = max(i + 1, int(np.searchsorted(total, done + PAIRS, "right")))
            a = np.repeat(np.arange(i, j), count[i:j])
            b = a + 1 + np.arange(len(a)) - np.repeat(total[i:j] - count[i:j] - done, count[i:j])
            keep = (e["part"][a] != e["part"][b]) & ((e["lo"][a] == e["hi"][a]) | (e["block"][a] != e["block"][b]))
            a, b = a[keep], b[keep]
            na, nb, m = e["size"][a], e["size"][b], np.maximum(e["match"][a], e["match"][b])
            least = (percent * (na + nb) + 99 + percent) // (100 + percent)
            keep = (least <= np.minimum(na, nb)) & (e["rank"][a] <= na - least + m) & (e["rank"][b] <= nb - least + m)
            a, b, m, apart = a[keep], b[keep], m[keep], (na + nb - 2 * least)[keep]
            keep = np.bitwise_count(fold[a] ^ fold[b]).sum(axis=1) <= apart
            found.append((e["id"][a[keep]], e["id"][b[keep]], m[keep]))
            i = j
        a, b, m = (np.concatenate(x) for x in zip(*found))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "m": m})

    shared = dealt.groupBy("group").applyInArrow(meet, "a long, b long, m long")
    return shared.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("m").alias("m")).where("n >= m").select("a", "b")


def link(docs: DataFrame, text: str = "text", n: int = 5, percent: int = 80, count: bool = True) -> DataFrame:
    """__d, n_shingles, set_id, component (a set_id) and n_links of docs with __d (a number for the row) and text.

    A text's set: the distinct n-word shingles of its words, A-Z lower-cased; fewer words: the whole sequence as
    one; no word or null text: empty and linked with nothing. Texts link when 100 * intersection >= percent * union.
    n_links: the other rows a row links with, those with an equal set included; null without count.

    Equal sets are joined first. Prefix keys in a global order from rare to frequent meet in buckets. A first round
    verifies each set against two sets of its lists only: the one whose own lists are longest (of a group of variants
    this is the text they vary) and the one with most rows; sets joined by these links need no more
    links among themselves, so the second round takes only pairs from different components, with as many shared
    prefix keys as the longer of both adaptive prefixes asks for, counted in prefixes as short as the overlap that sets
    of both sizes need allows. No list is ever expanded into all its pairs, and
    no link between components is lost. These rounds find the components; n_links takes all pairs inside them.
    """
    counters = count_keys(docs.select(text), lambda b: _piece_sets(b, text, n))
    sets = settle(_prefixes(docs, text, n, percent, counters))
    postings = settle(_postings(sets.where(F.col("n_shingles") > 0), percent))
    entries = settle(postings.join(adaptive_lengths(postings, percent), "id").drop("df"))
    alive = entries.select(F.col("id").alias("set_id")).distinct()
    sketches = settle(sets.join(alive, "set_id").groupBy("set_id").agg(
        F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")))

    rows = sets.groupBy(F.col("set_id").alias("id")).agg(F.count("*").alias("rows"))
    known = settle(entries.join(rows, "id"))
    lead = known.groupBy("key").agg(
        F.max(F.struct("weight", "rows", "id", "size")).alias("center"), F.max(F.struct("rows", "weight", "id", "size")).alias("copied"))
    met = known.select("key", F.col("id").alias("a"), F.col("size").alias("sa")).join(lead, "key")
    stars = None
    for side in ("center", "copied"):
        near = met.where((F.col("a") != F.col(f"{side}.id")) & _fits(F.col("sa"), F.col(f"{side}.size"), percent))
        best = near.groupBy("a", F.col(f"{side}.id").alias("b")).count().groupBy("a").agg(
            F.max(F.struct("count", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        stars = best if stars is None else stars.unionAll(best)
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = settle(_verified(_near(stars, sketches, percent), docs, sets, text, n, percent))
    parts = components(links)

    own = F.coalesce("component", "id")
    tagged = settle(entries.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", own).drop("component"))
    mixed = tagged.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    pairs = _list_pairs(tagged.join(mixed, "key"), sketches, percent)
    bridges = settle(_verified(_near(pairs, sketches, percent), docs, sets, text, n, percent))
    links = links.unionAll(bridges)
    parts = settle(components(links))
    out = sets.drop("prefix", "sketch").join(parts.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id"))
    if not count:
        return out.withColumn("n_links", F.lit(None).cast("long"))
    others = settle(_partners(docs, sets, parts, text, n, percent))
    out = out.join(rows.withColumnRenamed("id", "set_id"), "set_id").join(others, "set_id", "left")
    return out.withColumn("n_links", F.when(
        F.col("n_shingles") > 0, F.coalesce("others", F.lit(0)) + F.col("rows") - 1).otherwise(0)).drop("rows", "others")


def _piece_sets(b: pa.RecordBatch, text: str, n: int) -> Iterator[np.ndarray]:
    for part in pieces(iter([b]), text):
        sets = list(_sets(part, text, n))
        yield np.concatenate(sets) if sets else np.empty(0, np.uint64)


def _full_sets(docs: DataFrame, rows: np.ndarray, ids: np.ndarray, text: str, n: int) -> DataFrame:
    """set_id, keys of the wanted sets, from the texts of wanted rows (and of few others)."""
    shared = docs.sparkSession.sparkContext.broadcast((rows, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids = shared.value
        for b in batches:
            b = b.filter(pa.array(may_hold(rows, b.column("__d").to_numpy())))
            for part in pieces(iter([b]), text):
                own = [(_identity(keys), keys) for keys in _sets(part, text, n)]
                keep = may_hold(ids, np.array([i for i, _ in own], dtype=np.int64)).tolist()
                own = [x for x, k in zip(own, keep) if k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in own], pa.int64()),
                     pa.array([k.view(np.int64) for _, k in own], pa.list_(pa.int64()))], names=["set_id", "keys"])

    return docs.select("__d", text).mapInArrow(run, "set_id long, keys array<long>")


def _wanted_sets(wanted: DataFrame, docs: DataFrame, sets: DataFrame, text: str, n: int) -> DataFrame:
    """set_id, keys of the wanted set_ids; a set can come more than once."""
    source = sets.join(wanted, "set_id").groupBy("set_id").agg(F.min("__d").alias("__d"))
    return _full_sets(docs, bit_set(source, "__d"), bit_set(wanted, "set_id"), text, n)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, count: bool = True,
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) and n_links (the other rows
    it links with, copies included; null without count) of each row.

    A null doc_id counts as the smallest; as a component_id it is null. Rows of a repeated doc_id are separate texts.
    """
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(least)).alias("__d"), F.col(text).alias("text"))
    linked = settle(link(rows, "text", n, percent, count))
    some, none = linked.where(F.col("n_shingles") > 0), linked.where(F.col("n_shingles") == 0)
    first = some.groupBy("component").agg(F.min("__d").alias("component_id"))
    out = some.join(first, "component").unionByName(none.withColumn("component_id", F.col("__d")))
    known = [F.when(F.col(c) != least, F.col(c)).alias(name) for c, name in (("__d", doc_id), ("component_id",) * 2)]
    return out.select(known[0], "n_shingles", known[1], "n_links")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near duplicates: of each component the row with its smallest doc_id stays.

    Rows without words all stay, as do rows with a null doc_id. Rows that repeat a doc_id are one document: they go
    together. Only rows that may go are exchanged.
    """
    gone = settle(near_duplicates(docs, doc_id, text, n, percent, count=False).where(
        F.col(doc_id) != F.coalesce("component_id", F.lit(-(1 << 63)))).select(F.col(doc_id).alias("__gone")).distinct())
    some, whole = split(docs, gone.select(F.col("__gone").alias(doc_id)), doc_id)
    return some.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti").unionByName(whole)
