"""Words of whole texts as 64-bit hashes, worked out over the UTF-8 bytes of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
PIECE = 4 << 20  # bytes of text worked on at once, unless one text is longer
_STEP = 1 << 18  # bytes hashed at once, unless one word is longer


def _byte_table(separators: list[range]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    for r in separators:
        t[r.start:r.stop] = False
    return t


#: Bytes of words: all but space and \t to \r; letters, digits and everything beyond ASCII.
SPACED = _byte_table([range(0x20, 0x21), range(0x09, 0x0E)])
ALNUM = _byte_table([range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    h = np.asarray(h, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_FOLDED = _BYTE.copy()
_FOLDED[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the table grows on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(n, _STEP), np.uint64(base)))))
        if n <= 4 * _STEP:
            _powers[base] = have
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """sum(table[byte i of word] * base^i), by differences of a running sum; then mixed."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _STEP, side="right")))
        n = int(ends[j - 1] - lo)
        run = np.empty(n + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum(table[data[lo:lo + n]] * powers(_BASE, n), out=run[1:])
        s = starts[i:j] - lo
        out[i:j] = (run[ends[i:j] - lo] - run[s]) * powers(_INVERSE, n)[s]
        i = j
    return mix(out)


class Words:
    """The words of some texts in order: `hashes`, and `first`, where each text's words begin (one more than texts)."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray = SPACED, fold: bool = False):
        data, offsets = text_bytes(texts)
        inside = is_word[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        edges = offsets[offsets < len(data)]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        self.data, self.starts, self.ends, self.offsets = data, starts, ends, offsets
        self.hashes = _hash_spans(data, starts, ends, _FOLDED if fold else _BYTE)
        self.first = np.searchsorted(starts, offsets)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offset of each; null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most `limit` bytes of text (or one row)."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        i = 0
        while i < b.num_rows:
            base = ends[i] - sizes[i]
            j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(i, j - i)
            i = j


def sequence_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, for every start; empty where there are fewer."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    p = powers(_BASE, n)
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        h += words[i:len(words) - n + 1 + i] * p[i]
    return mix(h ^ np.uint64(n))


def int64s(column: pa.Array) -> np.ndarray:
    """A column of integers, null as the smallest one."""
    return pc.fill_null(column.cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)


def spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin .. begin+count-1 of each, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)


class Recent:
    """A dict of bounded size: what was not asked for while `size` others came is forgotten."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The keys not known; all others are in `young` afterwards."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out


def extended(df: DataFrame, fields: str) -> StructType:
    """df's schema followed by these fields (as in DDL)."""
    return StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])
