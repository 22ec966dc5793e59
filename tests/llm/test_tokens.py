"""Token operators against the library, and the wavelet matrix against plain arrays."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelspark.llm import bpe, token_store
from tests.llm.util import SCHEMA, documents, fixture

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "Ab", " ", "  ", "\n", " \n", "\t", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "é", "e\u0301", "½", "²",
       "中", "\x1c", "\x85", "🙂", "aaaa", "!!", "1234", "\r\n", "\u200b", "Σ", "İ", "\xa0", "_", "ß", "it's"]


def odd_texts(n=400, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_bpe_equals_the_library_and_decodes():
    lib, own = Tokenizer.from_file(BYTES), bpe.ByteBpe(BYTES)
    texts = odd_texts() + [t or "" for _, t in fixture()] + ["a" * 50, "ab" * 40]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode_batch(texts)] == want
    assert [own.decode(i) for i in want] == [lib.decode(i, skip_special_tokens=False) for i in want]
    assert own.decode([want[0][0], 50256]) == lib.decode([want[0][0], 50256], skip_special_tokens=False)


def test_bpe_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    own, texts = bpe.ByteBpe(BYTES), odd_texts(60, 9)
    first = [own.encode_batch([t])[0].tolist() for t in texts]
    assert [own.encode_batch([t])[0].tolist() for t in texts] == first


def test_bpe_frames(spark):
    rows = [(1, "Hello  there\n"), (2, None), (None, ""), (2, None)]
    lib = Tokenizer.from_file(BYTES)
    df = documents(spark, rows).withColumnRenamed("lang", "ids_sha256")
    got = bpe.digests(df, BYTES).collect()
    for r in got:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, BYTES), BYTES).collect()
    assert len(got) == len(back) == 4 and all(r.decoded == (r.text or "") for r in back)
    assert bpe.digests(spark.createDataFrame([], SCHEMA), BYTES).count() == 0


def test_bpe_digest_of_the_round_trip(spark):
    rows = [(1, "a b\u00e9 <|endoftext|>"), (2, None), (3, ""), (4, "\U0001F642 " * 300)]
    df = documents(spark, rows).withColumnRenamed("lang", "ids")
    got = {r.doc_id: r for r in bpe.encode(df, BYTES, decoded_sha256="source").collect()}
    for i, t in rows:
        assert got[i].source == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[i].ids == Tokenizer.from_file(BYTES).encode(t or "", add_special_tokens=False).ids


def test_word_encoder_equals_the_library():
    lib, own = Tokenizer.from_file(WORDS), token_store.WordEncoder(WORDS)
    texts = odd_texts(600, 5) + [t or "" for _, t in fixture()]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want


def test_word_encoder_gives_the_library_many_parts_at_once(monkeypatch):
    own, calls = token_store.WordEncoder(WORDS), []
    real, lib = own._encoded, Tokenizer.from_file(WORDS)
    monkeypatch.setattr(own, "_encoded", lambda texts: calls.append(len(texts)) or real(texts))
    texts = [" ".join(f"{a}{b}{c}, it's" for a in "abcdefgh" for b in "xyz" for c in "klmnop"), None, "", "İx d1 <|endoftext|> ''s\x01"]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    assert sum(calls) <= 5  # about 150 parts, two words that the library has to see whole


def test_known_words_stay_in_arrow(monkeypatch):
    """Every distinct word of every piece became a Python string, known or not; a word is now made one when it is learned."""
    own, learned, learn = token_store.WordEncoder(WORDS), [], token_store.WordEncoder._learn
    monkeypatch.setattr(token_store.WordEncoder, "_learn", lambda self, words: learned.append(sorted(words)) or learn(self, words))
    lib = Tokenizer.from_file(WORDS)
    want = lambda texts: [np.array(e.ids, dtype="<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    one, two = ["the cat sat", "a cat, zebra\u00e9"], ["zebra\u00e9 sat the dog", "", "the the"]
    assert own.encode(one) == want(one) and own.encode(two) == want(two)
    assert own.encode(pa.array(two, pa.large_string())) == want(two) and own.encode([]) == []
    assert [[w for w in ws if w] for ws in learned] == [["a", "cat", "cat,", "sat", "the", "zebra\u00e9"], ["dog"], [], []]


def test_forgotten_words_are_learned_again(monkeypatch):
    monkeypatch.setattr(token_store, "KEPT_WORDS", 4)
    lib, texts = Tokenizer.from_file(WORDS), ["one two three four five six", "two seven", "eight nine one", "two one ten", "ten two", "one"]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    for limit in (64 << 20, 1):
        monkeypatch.setattr(token_store, "KEPT_BYTES", limit)
        own = token_store.WordEncoder(WORDS)
        for _ in range(3):
            assert [own.encode([t])[0] for t in texts] == want
            assert len(own.words) <= 4 + 6


def test_word_encoder_takes_parts_one_by_one_where_they_can_not_be_told_apart():
    own = token_store.WordEncoder(WORDS)
    parts = ["cat", "thing"]
    alone = own._encoded(parts)
    own.last[:] = False
    assert own._encoded_parts(parts) == alone


@pytest.mark.parametrize("n, bits", [(0, 4), (1, 1), (700, 3), (2500, 16)])
def test_wavelet_matrix(n, bits):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
    ids[: n // 3] = ids[:1]
    m = token_store.WaveletMatrix.build(ids, bits)
    m = token_store.WaveletMatrix.from_bytes(n, bits, *m.to_bytes())
    assert (m.ids() == ids).all()
    assert [m.access(i) for i in range(0, n, 37)] == ids[::37].tolist()
    for t in set(ids[:3].tolist()) | {0, (1 << bits) - 1, 1 << bits}:
        assert m.count(t) == (ids == t).sum() and m.count(t, n // 4, n // 2) == (ids[n // 4:n // 2] == t).sum()
        assert m.occurrences(t) == np.flatnonzero(ids == t).tolist()
    with pytest.raises(IndexError):
        m.occurrence(0, n)


def test_token_files(spark, tmp_path):
    rows = fixture()[::2] + [(50, None), (50, None)]
    path = str(tmp_path / "tokens")
    token_store.write_tokens(documents(spark, rows), path, WORDS, 2, partitions=3, shard_tokens=500)
    lib, at, want, flat = Tokenizer.from_file(WORDS), 0, [], []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        flat += ids
        at += len(ids)
    got = token_store.read_documents(spark, path, digest=True).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    plain = {(r.doc_id, r.start): r.ids for r in token_store.read_documents(spark, path).collect()}
    assert [x for k in sorted(plain, key=lambda k: k[1]) for x in plain[k]] == flat
    assert spark.read.parquet(path).count() > 3
    token = flat[5]
    assert token_store.count_tokens(spark, path, [token, 2, token]).where(f"token = {token}").first().n == flat.count(token)
    assert sorted(r.position for r in token_store.find_token(spark, path, token).collect()) == [
        i for i, x in enumerate(flat) if x == token]
    assert token_store.token_at(spark, path, 777).first().token == flat[777]


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    token_store.write_tokens(spark.createDataFrame([], SCHEMA), path, WORDS, 2)
    assert token_store.read_documents(spark, path, digest=True).count() == 0
