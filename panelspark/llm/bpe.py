"""Byte-level BPE encoding by a pair occurrence index over the distinct pre-tokens of a batch, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelspark.llm.words import Recent, extended, pieces

BATCH = 8 << 20  # bytes of text whose pre-tokens are encoded together
KEPT = 400_000  # chunks of text, and pre-tokens, whose ids a task keeps for its next batches
#: The pre-token pattern of byte-level BPE.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_END = -1  # between pre-tokens
_GONE = -2  # merged into the symbol before


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary of the tokenizers library's file format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        if spec["normalizer"] or spec["pre_tokenizer"] != {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only plain byte-level vocabularies are encoded")
        byte_of = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], dtype=np.int64) for i in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order
        self.left, self.right = left, right
        self.pattern = regex.compile(PRE_TOKEN)
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) \
            if self.special else None
        self.dense = regex.compile(r"(?<=\s)\s|^\s|\s$")
        self.decimal = [b"%d" % i for i in range(size)]
        self.parts, self.tokens = Recent(KEPT), Recent(KEPT)

    def forget(self) -> None:
        """Drop the ids kept of earlier texts."""
        self.parts, self.tokens = Recent(KEPT), Recent(KEPT)

    # -- merges ---------------------------------------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, or -1."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids (4 bytes each) of each word (bytes of one pre-token).

        All words lie in one array of symbols. The index maps a pair, by its rank, to the positions of all its
        occurrences. Active ranks are taken in ascending order; each merges all its occurrences at once, and the
        pairs this makes on both sides join the lists of their ranks. A pair that uses a merged symbol has a higher
        rank than that merge, so each rank is taken once.
        """
        if not words:
            return []
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        sym = np.full(begin[-1], _END, dtype=np.int64)
        inside = np.ones(begin[-1], dtype=bool)
        inside[begin[1:] - 1] = False
        sym[inside] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[(at >= 0) & (after[at] < n)]
            rank = self._ranks(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], edges))].tolist() if len(rank) else [], np.split(at, edges)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        add(np.arange(n - 1))
        while active:
            r = heapq.heappop(active)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.left[r], self.right[r]
            at = at[sym[at] == a]
            at = at[sym[after[at]] == b]
            if a == b:
                at = _every_other(at, after)
            if not len(at):
                continue
            gone = after[at]
            sym[at], sym[gone] = self.merged[r], _GONE
            after[at] = after[gone]
            follows = after[at]
            before[follows[follows < n]] = at[follows < n]
            add(np.unique(np.concatenate((before[at], at))))
        sym = sym[sym != _GONE]
        ends = np.flatnonzero(sym == _END) - np.arange(len(words))
        flat = sym[sym != _END].astype("<i4").tobytes()
        at = [0, *(4 * ends).tolist()]
        return [flat[i:j] for i, j in zip(at[:-1], at[1:])]

    # -- texts ----------------------------------------------------------------------------------------------

    def chunks(self, text: str) -> list[str] | None:
        """The text cut before every space, if no pre-token can cross such a cut; else None."""
        if self.dense.search(text) or any(s in text for s in self.special):
            return None
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def pre_tokens(self, text: str) -> list[str]:
        out, at = [], 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            out += self.pattern.findall(text[at:m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.chunks(t) or self.pre_tokens(t) for t in texts]
        new = self.parts.missing(set().union(*cut))
        tokens = {c: [c] if c in self.special else self.pattern.findall(c) for c in new}
        words = self.tokens.missing({w for own in tokens.values() for w in own})
        for s in self.special:
            self.tokens.young[s] = self.special[s].to_bytes(4, "little")
        words = sorted(w for w in words if w not in self.special)
        token, part = self.tokens.young, self.parts.young
        token.update(zip(words, self.encode_words([w.encode("utf-8", "surrogatepass") for w in words])))
        for c, own in tokens.items():
            part[c] = token[own[0]] if len(own) == 1 else b"".join([token[w] for w in own])
        return [np.frombuffer(b"".join([part[c] for c in parts]), "<i4") for parts in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of these ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def _every_other(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of positions of a pair of equal symbols, those that a merge from left to right takes: no two overlap."""
    if len(at) < 2:
        return at
    at = np.sort(at)
    joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
    begin = np.flatnonzero(~joined)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    return at[place % 2 == 0]


_vocabularies: dict[str, ByteBpe] = {}


def vocabulary(path: str) -> ByteBpe:
    """The vocabulary of a file, read once in each process."""
    if path not in _vocabularies:
        _vocabularies[path] = ByteBpe(path)
    return _vocabularies[path]


def _texts(batches: Iterator[pa.RecordBatch], text: str, limit: int = BATCH) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for b in pieces(batches, text, limit):
        yield b, [t or "" for t in b.column(text).to_pylist()]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded_sha256: str | None = None) -> DataFrame:
    """docs with the token ids of each whole text (array of int), as the tokenizers library encodes it without
    adding special tokens. A null or empty text has no ids; a column of that name is replaced. decoded_sha256: a column
    for the digest (lowercase hex) of the text that the ids decode to, so that a round trip can be told without a second pass."""
    docs = docs.drop(*[c for c in (ids, decoded_sha256) if c and c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b, texts in _texts(batches, text, BATCH // 4):
            got = bpe.encode_batch(texts)
            made = {ids: pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum([len(x) for x in got]))), pa.int32()), pa.array(np.concatenate(got)))}
            if decoded_sha256:
                made[decoded_sha256] = pa.array([hashlib.sha256(bpe.decode(x.tolist()).encode()).hexdigest() for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *made.values()], names=[*b.schema.names, *made])
        bpe.forget()  # the worker goes on with other work

    return docs.mapInArrow(run, extended(docs, f"`{ids}` array<int>" + (f", `{decoded_sha256}` string" if decoded_sha256 else "")))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of each list of ids, as the library decodes it with special tokens kept. Null ids: null."""
    docs = docs.drop(*[c for c in (text,) if c != ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            got = [bpe.decode(x.as_py()) if x.is_valid else None for x in b.column(ids)]  # one list of ids at a time
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, text])

    return docs.mapInArrow(run, extended(docs, f"`{text}` string"))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded text)."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    docs = docs.drop(*[c for c in made if c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b, texts in _texts(batches, text):
            count, ids_hash, text_hash = [], [], []
            for own in bpe.encode_batch(texts):
                ids = own.tolist()
                count.append(len(ids))
                ids_hash.append(hashlib.sha256(b",".join([bpe.decimal[i] for i in ids])).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(count, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
                names=[*b.schema.names, *made])

    return docs.mapInArrow(run, extended(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string"))
