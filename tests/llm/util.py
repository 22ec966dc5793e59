"""Fixtures and brute-force twins of the text operators."""

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return (text or "").translate(FOLD)


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{min(int(rnd.paretovariate(0.6)), vocabulary)}{'x' * (i % 3)}" for i in range(n))


def documents(spark, rows=None):
    rows = fixture() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], SCHEMA)


def fixture(seed=5):
    """Prose with exact and near copies, shared passages, nulls, empty and one-word texts, and a long one."""
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randint(30, 120)) for _ in range(12)]
    passage = prose(rnd, 45)
    texts = list(base)
    for k in range(25):
        w = base[0].split(" ")
        w[rnd.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [base[1]] * 4 + [base[2] + " " + passage, passage + "\n" + base[3], "intro words " + passage]
    texts += [None, "", "  \n\t ", "one", "one", "two words", "Two\twords", "a a a a a a a a a a a a a a a a a a a a a a a"]
    lines = [prose(rnd, 12) for _ in range(6)]
    texts += ["\n".join(rnd.choice(lines) for _ in range(4)) for _ in range(8)]
    texts += [lines[0] + " more", lines[0].upper(), "\n\n" + lines[1]]
    texts.append("\n".join(prose(rnd, 60) for _ in range(60)))
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [(100 + 3 * i, texts[k]) for i, k in enumerate(order)]


def set_links(sets, percent):
    """Pairs of keys whose sets are similar."""
    keys = list(sets)
    return [(a, b) for i, a in enumerate(keys) for b in keys[:i] if sets[a] and sets[b] and
            100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def least_reachable(keys, links):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def shingle_set(text, n):
    w = words(folded(text))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def deduped_lines(rows, percent=80):
    """doc -> (kept text, lines, removed); every earlier line counts, removed or not. rows: (doc_id, text)."""
    seen, out = Counter(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        keep, cut = [], (t or "").split("\n")
        for line in cut:
            s = frozenset(words(folded(line)))
            hit = bool(s) and any(100 * len(s & x) >= percent * len(s | x) for x in seen)
            if s:
                seen[s] += 1
            if not hit:
                keep.append(line)
        out[i] = (None if t is None else "\n".join(keep), 0 if t is None else len(cut), len(cut) - len(keep))
    return out
