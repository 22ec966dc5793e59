"""Alignment of two tokenizers' tokens: links between tokens whose bytes overlap, and the cuts where both end."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from panelspark.llm.bpe import byte_letters
from panelspark.llm.words import Recent, extended, pieces
from panelspark.sources.sinks import new_path, settle

BATCH = 4 << 20  # bytes of text encoded together
ALIGNED = 1 << 19  # bytes of the ids of A aligned together
LANE = 512  # tokens of A after which a long document may go on in another lane
KEPT = 200_000  # pieces of text whose ids a task keeps
HELD_PAIRS = 1 << 20  # id pairs that a task adds up before it sends them
TABLE_PAIRS = 2_000_000  # id pairs that reach the driver and every task at once: 34 MB


class Encoders:
    """A: a byte-level BPE file of the tokenizers library; B: a sentencepiece model that puts a space first.

    Neither has a token that goes from a character that isn't white space over a space that another such character
    follows, so texts are cut before those spaces and each distinct piece is encoded and compared once.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = {c: b for b, c in byte_letters().items()}
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", n) for n in names):
            raise ValueError("a piece with a space after other characters: texts can't be cut at spaces")
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode()
                        for i, n in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.kind = "<u2" if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else "<u4"
        self.known_a, self.known_b = Recent(KEPT), Recent(KEPT)
        self.at = re.compile(r"(?<=\S) (?=\S)")

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of each text as integers of `kind`, by A (of a space and the text) and by B. None of either where a
        tokenizer's bytes aren't those of a space and the text."""
        cut = [t.split(" ") if t else [] for t in texts]
        asked = set().union(*cut)
        edged = {x for x in asked if not x or x[0].isspace() or x[-1].isspace()}  # a space beside white space is no place to cut
        if edged:
            for k, own in enumerate(cut):
                if not edged.isdisjoint(own):
                    # with a space before it, such a piece is no other's key
                    cut[k] = [" " + x if x in edged or " " in x else x for x in self.at.split(texts[k])]
            asked = set().union(*cut)
        new = self.known_a.missing(asked)
        self.known_b.missing(asked)
        for i in range(0, len(new), 20_000):
            some = new[i:i + 20_000]
            self._learn(some, [x if x[:1] == " " else " " + x for x in some])
        a, b, out = self.known_a.young.__getitem__, self.known_b.young.__getitem__, []
        for own in cut:
            try:
                out.append((b"".join(map(a, own)), b"".join(map(b, own))))
            except TypeError:  # a piece without ids
                out.append((b"", b""))
        return out

    def _learn(self, keys: list[str], spaced: list[str]) -> None:
        both = ([e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)],
                self.b.encode([x[1:] for x in spaced], num_threads=1))
        raw = [x.encode() for x in spaced]
        right = np.ones(len(keys), dtype=bool)
        for ids, tokens in zip(both, (self.bytes_a, self.bytes_b)):
            if b"".join([tokens[k] for own in ids for k in own]) != b"".join(raw):
                right &= [b"".join([tokens[k] for k in own]) == x for own, x in zip(ids, raw)]
        width = int(self.kind[2:])
        for ids, known in zip(both, (self.known_a.young, self.known_b.young)):
            flat = np.array([k for own in ids for k in own], dtype=self.kind).tobytes()
            ends = [0, *np.cumsum([width * len(own) for own in ids]).tolist()]
            known.update(zip(keys, [flat[i:j] if ok else None for i, j, ok in zip(ends[:-1], ends[1:], right.tolist())]))


_encoders: dict[tuple[str, str], Encoders] = {}


def encoders(path_a: str, path_b: str) -> Encoders:
    """Both tokenizers, read once in each process."""
    if (path_a, path_b) not in _encoders:
        _encoders[path_a, path_b] = Encoders(path_a, path_b)
    return _encoders[path_a, path_b]


def merge(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Positions (in A, in B) of all linked tokens, and of the tokens before each cut.

    end_a, end_b: byte offsets where the tokens of all documents in a row end; first_a, first_b: each document's first
    token, and the number of tokens at the end. The pointers of all documents advance in lockstep: each step emits one
    link a document and moves on the token that ends first, or both, which is a cut. Finished documents leave the state.
    A long document enters as several, parted after a token at every LANE-th place whose end is an end in B as well.
    """
    n = np.diff(first_a)
    i = np.repeat(first_a[:-1], -(-n // LANE))
    i = i + (np.arange(len(i)) - np.repeat(np.cumsum(-(-n // LANE)) - -(-n // LANE), -(-n // LANE))) * LANE
    begin = np.concatenate(([0], end_a))[i]
    j = np.searchsorted(end_b, begin, side="right")
    whole = (j > 0) & (end_b[np.maximum(j - 1, 0)] == begin) | (begin == 0)
    i, j = i[whole], j[whole]
    last = np.append(i[1:], len(end_a))
    links, cuts = [], []
    while len(i):
        links.append((i, j))
        a, b = end_a[i], end_b[j]
        both = a == b
        cuts.append((i[both], j[both]))
        i, j = i + (a <= b), j + (b <= a)
        go = i < last
        if not go.all():
            i, j, last = i[go], j[go], last[go]
    pairs = [np.concatenate([x[k] for x in part] or [np.zeros(0, np.int64)]) for part in (links, cuts) for k in (0, 1)]
    return tuple(pairs)


class Aligned:
    """The documents of a batch, aligned."""

    def __init__(self, enc: Encoders, a: list[bytes], b: list[bytes]):
        width = int(enc.kind[2:])
        self.a, self.b = (np.frombuffer(b"".join(x), enc.kind).astype(np.int64) for x in (a, b))
        self.first_a, self.first_b = (np.concatenate(([0], np.cumsum([len(x) // width for x in own]))).astype(np.int64) for own in (a, b))
        end_a, end_b = np.cumsum(enc.size_a[self.a]), np.cumsum(enc.size_b[self.b])
        self.link_a, self.link_b, self.cut_a, self.cut_b = merge(end_a, end_b, self.first_a, self.first_b)
        self.doc = np.searchsorted(self.first_a, self.link_a, side="right") - 1
        self.keys = (self.a[self.link_a].astype(np.uint64) << np.uint64(32)) | self.b[self.link_b].astype(np.uint64)
        self.cut_a.sort()
        self.cut_b.sort()

    def per_doc(self, weights: np.ndarray | None = None) -> np.ndarray:
        """Sums over each document's links, exact as integers."""
        n = len(self.first_a) - 1
        if weights is None:
            return np.bincount(self.doc, minlength=n)
        out = np.zeros(n, dtype=np.int64)
        np.add.at(out, self.doc, weights)
        return out

    def groups(self) -> list[bytes]:
        """a1,a2|b1;a3|b2,b3 of each document, in ids."""
        parts = []
        for ids, cut, then in ((self.a, self.cut_a, 1), (self.b, self.cut_b, 2)):
            mark = np.zeros(len(ids), dtype=np.int64)
            mark[cut] = then
            group = np.cumsum(mark > 0) - (mark > 0)
            parts.append((group, mark, ids))
        group = np.concatenate((2 * parts[0][0], 2 * parts[1][0] + 1))
        order = np.argsort(group, kind="stable")
        code = np.concatenate([4 * ids + mark for _, mark, ids in parts])[order].tolist()
        text, at = _decimals(max(len(self.a) and int(self.a.max()), len(self.b) and int(self.b.max())) + 1), self.first_a + self.first_b
        return [b"".join([text[c] for c in code[i:j]])[:-1] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


_texts: list[bytes] = []


def _decimals(n: int) -> list[bytes]:
    """At 4 * id + mark the id's decimal digits with the comma, bar or semicolon that follows."""
    for i in range(len(_texts) // 4, n):
        _texts.extend(b"%d%s" % (i, c) for c in (b",", b"|", b";", b""))
    return _texts


def encode_both(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """docs with a_ids and b_ids (integers of Encoders.kind in a binary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(path_a, path_b)
        for b in pieces(batches, text, BATCH):
            got = enc.encode([t or "" for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array([x[k] for x in got], pa.binary()) for k in (0, 1))],
                names=[*b.schema.names, "a_ids", "b_ids"])

    return docs.mapInArrow(run, extended(docs, "a_ids binary, b_ids binary"))


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    enc = encoders(path_a, path_b)
    for b in pieces(batches, "a_ids", ALIGNED):
        yield b, Aligned(enc, *(b.column(c).to_pylist() for c in ("a_ids", "b_ids")))


def pair_counts(coded: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a, b, n: how many links of all documents hold each id pair linked. Each task adds up what it has first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def total() -> tuple[np.ndarray, np.ndarray]:
            keys, of = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.zeros(len(keys), dtype=np.int64)
            np.add.at(n, of, np.concatenate([x for _, x in held]))
            return keys, n

        def rows() -> pa.RecordBatch:
            keys, n = total()
            return pa.RecordBatch.from_pydict({
                "a": (keys >> np.uint64(32)).astype(np.int32), "b": (keys & np.uint64(0xFFFFFFFF)).astype(np.int32), "n": n})

        for _, al in _aligned(batches, path_a, path_b):
            held.append(np.unique(al.keys, return_counts=True))
            if sum(len(k) for k, _ in held) > HELD_PAIRS:
                held = [total()]
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield rows()
                    held = []
        if held:
            yield rows()

    return coded.select("a_ids", "b_ids").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(
    docs: DataFrame, path_a: str, path_b: str, text: str = "text", digest: bool = False, keep: Sequence[str] | None = None,
) -> DataFrame:
    """docs (of `keep` only these columns) with n_a, n_b, n_groups, n_links, n_best, count_sum (long), a_ids, b_ids (array of int) and cuts: for each group
    of tokens between cuts the number of A and B tokens up to its end, in a row.

    A encodes a space and the text, B the text; special tokens' strings are plain text. A link joins an A and a B token
    whose bytes overlap; a cut is where both end. The count of an id pair is the number of links of all documents that
    hold it; n_best are a document's links whose count is the highest that their B id has, count_sum adds up the counts
    of its links. A null or empty text, or one that a tokenizer does not give back byte by byte, has no tokens. Equal
    rows count each. No rows: no rows. Columns with the names of results are replaced. With `digest`, groups_sha256 in
    place of the arrays: of a1,a2|b1;a3|b2,b3, empty without tokens.

    The counts are read in tables of TABLE_PAIRS pairs at most, one pass over the documents' ids for each table.
    """
    counted = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    more = ["groups_sha256"] if digest else ["a_ids", "b_ids", "cuts"]
    docs = docs.drop(*[c for c in (*counted, *more) if c != text])
    spark, names = docs.sparkSession, [f"__{i}" for i in range(len(docs.columns))]  # none of docs' names can clash
    coded = encode_both(docs.toDF(*names), path_a, path_b, names[docs.columns.index(text)])
    wanted = [c for c in docs.columns if keep is None or c in keep]
    kept = [names[docs.columns.index(c)] for c in wanted]
    coded = coded.select(*kept, "a_ids", "b_ids", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    path = new_path(spark, "aligned")
    coded.write.option("compression", "zstd").parquet(path)
    inner, coded = coded.select(*kept), spark.read.schema(coded.schema).parquet(path)
    pairs = settle(pair_counts(coded, path_a, path_b))
    best = pairs.join(pairs.groupBy("b").agg(F.max("n").alias("most")), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    n_tables = 1 + pairs.count() // TABLE_PAIRS

    def add(df: DataFrame, k: int, last: bool) -> DataFrame:
        rows = best.where(F.pmod(F.xxhash64("a", "b"), F.lit(n_tables)) == k).toArrow()
        keys = (rows["a"].to_numpy().astype(np.uint64) << np.uint64(32)) | rows["b"].to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        table = spark.sparkContext.broadcast((keys[order], rows["n"].to_numpy()[order], rows["best"].to_numpy()[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n, top = table.value
            for b, al in _aligned(batches, path_a, path_b):
                weight, hits = np.zeros(len(al.keys), np.int64), np.zeros(len(al.keys), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, al.keys), len(keys) - 1)
                    found = keys[at] == al.keys
                    weight, hits = np.where(found, n[at], 0), (found & top[at]).astype(np.int64)
                sums = [al.per_doc(w) + b.column(c).to_numpy() for c, w in (("n_best", hits), ("count_sum", weight))]
                out = {c: b.column(c) for c in kept}
                if not last:
                    out |= {"a_ids": b.column("a_ids"), "b_ids": b.column("b_ids"), "n_best": sums[0], "count_sum": sums[1]}
                    yield pa.RecordBatch.from_pydict(out)
                    continue
                edges = np.searchsorted(al.cut_a, al.first_a)
                out |= dict(zip(counted, (np.diff(al.first_a), np.diff(al.first_b), np.diff(edges), al.per_doc(), *sums)))
                if digest:
                    out["groups_sha256"] = [hashlib.sha256(x).hexdigest() if x else "" for x in al.groups()]
                else:
                    doc = np.searchsorted(al.first_a, al.cut_a, side="right") - 1
                    cuts = np.stack([al.cut_a + 1 - al.first_a[doc], al.cut_b + 1 - al.first_b[doc]], axis=1).ravel()
                    for c, flat, first in (("a_ids", al.a, al.first_a), ("b_ids", al.b, al.first_b), ("cuts", cuts, 2 * edges)):
                        out[c] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

        if not last:
            return df.mapInArrow(run, df.schema)
        lists = "groups_sha256 string" if digest else "a_ids array<int>, b_ids array<int>, cuts array<int>"
        return df.mapInArrow(run, extended(inner, ", ".join(f"{c} long" for c in counted) + ", " + lists))

    for k in range(n_tables):
        coded = add(coded, k, k == n_tables - 1)
        if k < n_tables - 1:
            coded = settle(coded)
    return coded.toDF(*wanted, *counted, *more)
