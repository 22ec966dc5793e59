"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.llm.words import extended

PROFILE = 300  # most frequent n-grams of a profile
MAX_LANGUAGES = 2_000  # profiles are handed to every task: PROFILE x MAX_LANGUAGES n-grams at most
UNKNOWN = "und"
_ONE, _TWO = np.uint64(3 << 62), np.uint64(1 << 63)
_S1, _S2 = np.uint64(21), np.uint64(42)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Lower-cased code point of each letter of the basic plane, 0 for all else."""
    if not _letters:
        t = np.zeros(1 << 16, dtype=np.uint32)
        for c in range(1 << 16):
            if chr(c).isalpha():
                t[c] = ord(chr(c).lower()[0])
        _letters.append(t)
    return _letters[0]


def _letter_codes(text: str) -> np.ndarray:
    """Lower-cased letters with one 0 between words and at both ends; empty without a letter."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _letter_table()[np.minimum(raw, 0xFFFF)]
    for c in np.unique(raw[raw > 0xFFFF]):
        codes[raw == c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
    codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    keep[0] = True
    codes = codes[keep]
    return codes if len(codes) > 1 and codes.any() else codes[:0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of 1 to 3 letters (word ends count as a letter, but not alone or inside) and their counts."""
    c = _letter_codes(text) if text else np.empty(0, np.uint64)
    if not len(c):
        return c.astype(np.uint64), np.empty(0, np.int64)
    mid = c[1:-1] > 0
    three = ((c[:-2] << _S2) | (c[1:-1] << _S1) | c[2:])[mid]
    two = _TWO | (c[:-1] << _S1) | c[1:]
    return np.unique(np.concatenate((c[c > 0] | _ONE, two, three)), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The `size` most frequent keys, by count descending, then key ascending."""
    if len(keys) > size:
        least = -np.partition(-counts, size - 1)[size - 1]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:size]


def _sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    unique, where = np.unique(k, return_inverse=True)
    return unique, np.bincount(where, weights=c, minlength=len(unique)).astype(np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language: its `size` most frequent n-grams over all given texts, in order.

    Rows whose language is null are left out. n-grams are counted in each task, then added up by key; only the
    profiles come to the driver (at most MAX_LANGUAGES).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}

        def fold(name: str) -> None:
            k, c = _sum_by_key(*held[name])
            held[name] = ([k], [c])

        for b in batches:
            for t, name in zip(b.column(0), b.column(1).to_pylist()):
                k, c = ngram_counts(t.as_py())
                own = held.setdefault(name, ([], []))
                own[0].append(k)
                own[1].append(c)
                if len(own[0]) >= 256:
                    fold(name)
        for name in held:
            fold(name)
            (k,), (c,) = held[name]
            for i in range(0, len(k), 50_000):
                part = k[i:i + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(c[i:i + 50_000])],
                    names=["lang", "key", "n"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sums = rows.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    # unsigned order of the key, so that ties fall as in `ranked`
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("key") < 0, "key")
    top = sums.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
    got = top.orderBy("lang", "r").limit(size * MAX_LANGUAGES + 1).collect()
    if len(got) > size * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found: dict[str, list[int]] = {}
    for r in got:
        found.setdefault(r["lang"], []).append(r["key"])
    return {name: np.array(k, dtype=np.int64).view(np.uint64) for name, k in found.items()}


class Profiles:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.keys = np.unique(np.concatenate([profiles[n] for n in self.names])) if profiles else np.empty(0, np.uint64)
        self.rank = np.full((len(self.keys) + 1, len(self.names)), -1, dtype=np.int64)
        for j, name in enumerate(self.names):
            self.rank[np.searchsorted(self.keys, profiles[name]), j] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: the first name) and 1 - distance / largest distance."""
        own = ranked(*ngram_counts(text), self.size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at[self.keys[at] != own] = len(self.keys)  # the last row: in no profile
        rank = self.rank[at]
        place = np.arange(len(own))[:, None]
        off = np.where(rank < 0, self.size, np.abs(rank - place)).sum(axis=0)
        best = int(off.argmin())
        return self.names[best], 1.0 - float(off[best]) / (self.size * len(own))


def identify(
    docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", size: int = PROFILE,
) -> DataFrame:
    """docs with lang_pred and score (0 to 1) for every whole text.

    A null text, or one without a letter, has `und` and 0, as has every text when nothing was learned. Columns of
    docs with these names are replaced.
    """
    docs = docs.drop(*[c for c in ("lang_pred", "score") if c != text])
    model = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for b in batches:
            got = [p.predict(t.as_py()) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, extended(docs, "lang_pred string, score double"))


def learns(doc_id: str = "doc_id"):
    """Documents to learn from: crc32 of the id as text, modulo 4, is not 2. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) != 2
