"""Alignment of tokens against brute force over the libraries' own ids."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelspark.llm import token_alignment as ta
from panelspark.llm.bpe import byte_letters
from tests.llm.util import documents, fixture

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def twin():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letter = {c: x for x, c in byte_letters().items()}

    def tokens(text):
        """(ids, end offsets) of both, of the whole text at once."""
        if not text:
            return ([], []), ([], [])
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = ([bytes(letter[c] for c in a.id_to_token(i)) for i in ids[0]],
               [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids[1])])
        if any(b"".join(r) != (" " + text).encode() for r in raw):
            return ([], []), ([], [])
        return tuple((i, np.cumsum([len(x) for x in r]).tolist()) for i, r in zip(ids, raw))

    def aligned(texts):
        docs = []
        for t in texts:
            (ia, ea), (ib, eb) = tokens(t)
            ba, bb = [0, *ea][:-1], [0, *eb][:-1]
            links = [(x, y) for x in range(len(ia)) for y in range(len(ib)) if max(ba[x], bb[y]) < min(ea[x], eb[y])]
            groups, i, j = [], 0, 0
            for end in sorted(set(ea) & set(eb)):
                k, m = ea.index(end) + 1, eb.index(end) + 1
                groups.append((ia[i:k], ib[j:m]))
                i, j = k, m
            docs.append((ia, ib, [(ia[x], ib[y]) for x, y in links], groups))
        n = Counter(p for d in docs for p in d[2])
        most = Counter()
        for (x, y), c in n.items():
            most[y] = max(most[y], c)
        out = []
        for ia, ib, links, groups in docs:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((len(ia), len(ib), len(groups), len(links), sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links),
                        hashlib.sha256(text.encode()).hexdigest() if groups else ""))
        return out

    return aligned


ODD = ["  two  spaces ", "a\n\n b\t c ", " lead", "trail ", " ", "\n", "<|endoftext|> <s> </s> <0x41>", "▁under score", "naïve café → ﬁ ﷽ 東京都 日本",
       "x y　z   \u0085 q", "\x00 a\x1cb \x1f", "🙂🙂 🙃", "a" * 90, "'s don't WE'LL 12345 ... !!!???", "é ​ x", None, ""]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("limits", [{}, {"TABLE_PAIRS": 300}])
def test_against_brute_force(spark, monkeypatch, twin, limits):
    for k, v in limits.items():
        monkeypatch.setattr(ta, k, v)
    rows = [(i, t) for i, t in fixture() if len(t or "") < 1500] + list(enumerate(ODD)) + [(None, "one more"), (3, "one more")]
    got = ta.align(documents(spark, rows).repartition(3), A, B, digest=True).collect()
    want = twin([t for _, t in rows])
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want))


def test_lists_hold_the_groups(spark):
    rows = [(1, "Tokenization of unbelievable words, repeatedly 1234567"), (2, None), (3, "▁")]
    df = documents(spark, rows).withColumnsRenamed({"lang": "a_ids", "source": "doc", "n_chars": "best"})
    got = {r.doc_id: r for r in ta.align(df, A, B).collect()}
    one = got[1]
    ends = list(zip(one.cuts[0::2], one.cuts[1::2]))
    assert ends[-1] == (one.n_a, one.n_b) == (len(one.a_ids), len(one.b_ids)) and len(ends) == one.n_groups
    assert (got[2].a_ids, got[2].cuts, got[3].n_a, got[3].n_links) == ([], [], 0, 0) and one.best == len(rows[0][1])
    assert ta.align(df.limit(0), A, B).collect() == []


def test_lanes_of_long_documents():
    """Documents of any length, cut into lanes or not, against a plain merge."""
    rnd = random.Random(7)
    end_a, end_b, first_a, first_b, at = [], [], [0], [0], 0
    for n in (5, 0, 40_000, 3, 9_000, 1):
        a, b = (sorted({*(rnd.randrange(1, n) for _ in range(n // 3)), n} if n else ()) for _ in range(2))
        end_a += [at + x for x in a]
        end_b += [at + x for x in b]
        at += n
        first_a.append(len(end_a))
        first_b.append(len(end_b))
    la, lb, ca, cb = ta.merge(*(np.array(x, dtype=np.int64) for x in (end_a, end_b, first_a, first_b)))
    i = j = 0
    links, cuts = [], []
    while i < len(end_a):
        links.append((i, j))
        x, y = end_a[i], end_b[j]
        if x == y:
            cuts.append((i, j))
        i, j = i + (x <= y), j + (y <= x)
    assert sorted(zip(la.tolist(), lb.tolist())) == links and sorted(zip(ca.tolist(), cb.tolist())) == cuts


def test_long_text(spark, twin):
    text = " ".join(["alpha beta", "gamma-delta", "12.5%"] * 60_000)
    r = ta.align(documents(spark, [(1, text)]), A, B, digest=True).first()
    assert r.n_a > 300_000 and r.n_groups <= min(r.n_a, r.n_b) <= r.n_links
