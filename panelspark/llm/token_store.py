"""Token ids in shards, each one compressed file that holds a wavelet matrix of its ids."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from panelspark.llm.words import Recent, pieces, spans

SHARD_TOKENS = 1 << 22  # a shard ends with the document that reaches it
PART_BYTES = 64 << 20  # of the texts of a partition
BLOCK = 512  # bits between stored ranks
TOGETHER = 100  # parts of words encoded as one text
_WORDS = 1 << 18  # words whose ids are put together at once
KEPT = 500_000  # parts of words whose ids a task keeps
KEPT_WORDS, KEPT_BYTES = 1_000_000, 64 << 20  # words whose ids it keeps, and their bytes


class WaveletMatrix:
    """Succinct sequence of ids below 2^bits: one plane of bits per level, most significant first, with rank blocks.

    access, count and occurrences touch only the planes. `planes` is the packed form of all levels, `ranks` the
    number of ones before each block of 512 bits.
    """

    def __init__(self, n: int, bits: int, planes: np.ndarray, ranks: np.ndarray):
        self.n, self.bits, self.planes, self.ranks = n, bits, planes, ranks
        self.zeros = [n - self._rank1(level, n) for level in range(bits)]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n, level_bytes = len(ids), -(-max(len(ids), 1) // BLOCK) * BLOCK // 8
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, ranks = np.zeros((bits, level_bytes), np.uint8), []
        for level in range(bits):
            one = (ids & ids.dtype.type(1 << (bits - 1 - level))).astype(bool)
            packed = np.packbits(one, bitorder="little")
            planes[level, :len(packed)] = packed
            ones = np.bitwise_count(planes[level].reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
            ranks.append(np.concatenate(([0], np.cumsum(ones))))
            ids = np.concatenate((ids[~one], ids[one]))
        return cls(n, bits, planes, np.array(ranks, dtype=np.int64).reshape(bits, -1))

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.planes.tobytes(), self.ranks.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, n: int, bits: int, planes: bytes, ranks: bytes) -> WaveletMatrix:
        return cls(n, bits, np.frombuffer(planes, np.uint8).reshape(bits, -1),
                   np.frombuffer(ranks, "<u4").astype(np.int64).reshape(bits, -1))

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i >> 3] >> (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        block = i // BLOCK
        lo, hi = block * BLOCK // 8, i >> 3
        ones = int(self.ranks[level, block]) + int(np.bitwise_count(self.planes[level, lo:hi]).sum())
        return ones + (int(self.planes[level, hi] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            one = token >> (self.bits - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the token at positions lo .. hi-1."""
        if token >> self.bits or token < 0:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a level."""
        ranks = self.ranks[level] if bit else np.arange(self.ranks.shape[1]) * BLOCK - self.ranks[level]
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        cells = np.unpackbits(self.planes[level, block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(cells == bit)[k - int(ranks[block])])

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the token."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - level) & 1
            i = self._select(level, one, i - self.zeros[level] if one else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.occurrence(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """The whole sequence, rebuilt from the last plane up: each level undoes one stable partition."""
        value = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            one = np.unpackbits(self.planes[level], bitorder="little", count=self.n).view(bool)
            z, up = self.zeros[level], np.empty_like(value)
            up[~one], up[one] = value[:z], value[z:] | value.dtype.type(1 << (self.bits - 1 - level))
            value = up
        return value.astype(np.uint32)


#: The pre-token pattern of the vocabulary, on lower-cased text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Encodes with the tokenizers library word by word; words are cut at ASCII white space only.

    For a vocabulary whose pre-tokens never hold white space, the ids of a text are those of its words in a row. When
    the vocabulary lower-cases and cuts by PRE_TOKEN, words of plain Latin letters are cut so before the library
    encodes the parts, so that each part is encoded once whatever stands beside it. Where the last token of a pre-token
    has a suffix of its own, the library takes many such parts as one text, and its ids are cut behind these tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads cost more than they save
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.parts = Recent(KEPT)
        self._forget()
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.cut = regex.compile(PRE_TOKEN) if steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get(
            "pattern", {}).get("Regex") == PRE_TOKEN and cuts[0]["invert"] else None
        self.plain = regex.compile(r"[\x21-\x7E\xA1-\u024F]+")
        self.marks = sorted({t["content"][:2] for t in spec["added_tokens"]})
        suffix = spec["model"].get("end_of_word_suffix")
        self.last = None
        if self.cut and suffix:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _parts(self, word: str) -> list[str] | None:
        """The parts of a word, or none if the library has to see it whole."""
        if not self.cut:
            return None
        if word.isascii():
            if word.isalpha():
                return [word.lower()]
            if not word.isprintable():
                return None
            if word[:-1].isalpha() and not word[-1].isdigit():  # a word and a mark
                return [word[:-1].lower(), word[-1]]
        elif not self.plain.fullmatch(word):
            return None
        for m in self.marks:
            if m in word:
                return None
        return self.cut.findall(word.lower())

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each of these parts, all of them pre-tokens."""
        if self.last is None:
            return self._encoded(parts)
        groups, out = [parts[i:i + TOGETHER] for i in range(0, len(parts), TOGETHER)], []
        for own, raw in zip(groups, self._encoded([" ".join(g) for g in groups])):
            ends = (np.flatnonzero(self.last[np.frombuffer(raw, "<u4")]) + 1) * 4
            if len(ends) == len(own) and ends[-1] == len(raw):
                ends = ends.tolist()
                out += [raw[i:j] for i, j in zip([0, *ends], ends)]
            else:
                out += self._encoded(own)
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        for c in "\n\t\r":
            texts = pc.replace_substring(texts, c, " ")
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        place = self._places(coded.dictionary.cast(pa.large_string()))[coded.indices.to_numpy()]
        begin, size, flat = self.begin, self.size, self.flat
        ids = [flat[spans(begin[p], size[p])] for p in (place[i:i + _WORDS] for i in range(0, len(place), _WORDS))]
        ids = np.concatenate(ids) if ids else flat[:0]
        first = np.concatenate(([0], np.cumsum(size[place])))[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return [ids[i:j].tobytes() for i, j in zip(first[:-1], first[1:])]

    def _forget(self) -> None:
        """Start anew: `words` are the kept ones, in `flat` lie the ids of each, `used` is the call that last asked for it."""
        self.words, self.flat = pa.array([], pa.large_string()), np.empty(0, dtype="<u4")
        self.begin = self.size = self.used = np.empty(0, dtype=np.int64)
        self.calls = 0

    def _shrink(self) -> None:
        """Keep at most half of KEPT_WORDS words, those asked for last."""
        keep = np.flatnonzero(self.used > np.partition(self.used, -(KEPT_WORDS // 2))[-(KEPT_WORDS // 2)])
        self.words, self.flat = self.words.take(pa.array(keep)), self.flat[spans(self.begin[keep], self.size[keep])]
        self.size, self.used = self.size[keep], self.used[keep]
        self.begin = np.cumsum(self.size) - self.size

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where these words, each named once, stand among the kept ones; those not there are encoded and entered."""
        if len(self.words) > KEPT_WORDS:
            self._shrink()
        if self.words.nbytes > KEPT_BYTES:
            self._forget()
        have = len(self.words)
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(place < 0)
        new = words.take(pa.array(missing))
        own = self._learn(new.to_pylist())
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        place[missing] = np.arange(have, have + len(own))
        self.words = pa.concat_arrays([self.words, new])
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(own), "<u4")))
        self.size = np.concatenate((self.size, size))
        self.begin = np.cumsum(self.size) - self.size
        self.calls += 1
        self.used = np.concatenate((self.used, np.zeros(len(own), dtype=np.int64)))
        self.used[place] = self.calls
        return place

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of these words, each named once."""
        parts = [self._parts(w) for w in words]
        rest = self.parts.missing({p for own in parts if own for p in own})
        part = self.parts.young
        for i in range(0, len(rest), 20_000):
            part.update(zip(rest[i:i + 20_000], self._encoded_parts(rest[i:i + 20_000])))
        whole = [w for w, own in zip(words, parts) if own is None]
        seen = iter([ids for i in range(0, len(whole), 20_000) for ids in self._encoded(whole[i:i + 20_000])])
        return [next(seen) if own is None else part[own[0]] if len(own) == 1 else b"".join([part[p] for p in own]) for own in parts]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(
    docs: DataFrame, out: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
    partitions: int | None = None, shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Write the ids of every whole text, each followed by end_id, in ascending doc_id order, as shard files at `out`.

    Documents are sorted over all partitions by a range exchange; each partition is encoded and cut into shards at
    document ends. A shard is one row of one Parquet file (zstd): its place (part, seq), how many tokens, the id bits,
    the bit-planes and rank blocks of its wavelet matrix, and the ids and lengths of its documents. Null text: no ids
    but the end id. A null doc_id comes first. Equal doc_ids are ordered by a hash of the text, so that many of them don't
    meet in one partition. Partitions follow the bytes of the texts. An empty table writes no shard.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        bits = max(enc.bits, int(end_id).bit_length())
        held: list[bytes] = []
        keys: list[int | None] = []
        size = seq = 0

        def close() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(held), "<u4")
            planes, ranks = WaveletMatrix.build(flat, bits).to_bytes()
            row = {"seq": seq, "n_tokens": len(flat), "bits": bits, "planes": planes, "ranks": ranks, "doc_ids": keys,
                   "lengths": [len(h) // 4 for h in held]}
            return pa.RecordBatch.from_pylist([row], schema=_SHARD)

        for b in pieces(batches, "text"):
            got = enc.encode(b.column("text"))
            for k, v in zip(b.column("doc_id").to_pylist(), got):
                held.append(v + end)
                keys.append(k)
                size += len(held[-1]) // 4
                if size >= shard_tokens:
                    yield close()
                    held, keys, size, seq = [], [], 0, seq + 1
        if held:
            yield close()

    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    # texts are exchanged, not ids: the exchange samples its input, which would be encoded twice
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    made = ordered.mapInArrow(shards, "seq int, n_tokens long, bits int, planes binary, ranks binary, "
                                      "doc_ids array<long>, lengths array<long>")
    made.select(F.spark_partition_id().alias("part"), "*").write.option("maxRecordsPerFile", 1).option(
        "compression", "zstd").parquet(out)


_SHARD = pa.schema([
    ("seq", pa.int32()), ("n_tokens", pa.int64()), ("bits", pa.int32()), ("planes", pa.binary()),
    ("ranks", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq and the number of tokens before each shard: sums by part first, so no window holds all shards."""
    heads = spark.read.parquet(path).select("part", "seq", "n_tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("base"))  # one row a part
    inside = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("seq")), F.lit(0))
    return heads.select("part", "seq", inside.alias("inside")).join(parts, "part").select(
        "part", "seq", (F.col("base") + F.col("inside")).alias("start"))


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix.from_bytes(row["n_tokens"], row["bits"], row["planes"], row["ranks"])


def read_documents(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens and ids of each document, decoded from the shards.

    With `digest`, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) instead of ids. Shards are decoded
    where they lie; only the rows of documents meet the shards' starts.
    """
    last = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                flat = _matrix(row).ids()
                ends = np.concatenate(([0], np.cumsum(row["lengths"])))
                for i in range(0, len(ends) - 1, 2_000):
                    lo, hi = ends[i:i + 2_001][:-1], ends[i:i + 2_001][1:]
                    own = [flat[x:y] for x, y in zip(lo, hi)]
                    made = pa.array([zlib.crc32(o.astype("<u4")) for o in own], pa.int64()) if digest else pa.array(
                        [o.astype(np.int32) for o in own], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["part"]] * len(own), pa.int32()), pa.array([row["seq"]] * len(own), pa.int32()),
                         pa.array(row["doc_ids"][i:i + 2_000], pa.int64()), pa.array(lo), pa.array(hi - lo), made],
                        names=["part", "seq", "doc_id", "inside", "n_tokens", last.split()[0]])

    rows = spark.read.parquet(path).mapInArrow(
        run, f"part int, seq int, doc_id long, inside long, n_tokens long, {last}")
    return rows.join(shard_starts(spark, path), ["part", "seq"]).select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", last.split()[0])


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each token occurs, from the planes alone (no decoding)."""
    tokens = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                m = _matrix(row)
                yield pa.RecordBatch.from_pydict({"token": tokens, "n": [m.count(t) for t in tokens]})

    heads = spark.read.parquet(path).select("n_tokens", "bits", "planes", "ranks")
    return heads.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """position: every place of the token in the whole sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                got = np.array(_matrix(row).occurrences(token), dtype=np.int64) + row["start"]
                yield pa.RecordBatch.from_pydict({"position": pa.array(got, pa.int64())})

    shards = spark.read.parquet(path).join(shard_starts(spark, path), ["part", "seq"])
    return shards.select("n_tokens", "bits", "planes", "ranks", "start").mapInArrow(run, "position long")


def token_at(spark: SparkSession, path: str, position: int) -> DataFrame:
    """token: the id at a place of the whole sequence; reads one shard's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_pydict({"token": pa.array([_matrix(row).access(position - row["start"])])})

    starts = shard_starts(spark, path)
    shards = spark.read.parquet(path).join(starts, ["part", "seq"])
    one = shards.where((F.col("start") <= position) & (F.col("start") + F.col("n_tokens") > position))
    return one.select("n_tokens", "bits", "planes", "ranks", "start").mapInArrow(run, "token long")
