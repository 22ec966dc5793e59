"""How often keys occur, as counters of fixed number, and exchanges of packed keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BITS = 20  # 2^20 counters of 8 bytes: 8 MB, whatever the input
_SEGMENTS, _FAN_IN = 16, 256


def count_keys(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = BITS) -> np.ndarray:
    """Occurrences of all keys of df, added up in 2^bits counters by the keys' low bits.

    Counters of tasks are summed in two steps of bounded groups. What comes to the driver has a fixed size.
    """
    mask, size = np.uint64((1 << bits) - 1), 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for keys in keys_of(b):
                total += np.bincount((keys & mask).astype(np.int64), minlength=size)
        if total.any():
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array(range(_SEGMENTS), pa.int32()),
                "n": pa.array([_narrow(x).tobytes() for x in np.split(total, _SEGMENTS)], pa.binary())})

    width = size // _SEGMENTS

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.uint64)
        for x in group["n"]:
            raw = x.as_py()
            total += np.frombuffer(raw, f"<u{len(raw) // width}")
        return pa.table({"segment": group["segment"].slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

    parts = df.mapInArrow(count, "segment int, n binary").withColumn(
        "g", F.pmod(F.spark_partition_id(), F.lit(_FAN_IN)))
    parts = parts.groupBy("segment", "g").applyInArrow(add, "segment int, n binary")
    rows = parts.groupBy("segment").applyInArrow(add, "segment int, n binary").collect()
    total = np.zeros((_SEGMENTS, width), dtype=np.uint64)
    for r in rows:
        total[r["segment"]] = np.frombuffer(r["n"], "<u8")
    return total.ravel()


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The counts in the fewest bytes that hold them all."""
    return counts.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if int(counts.max()) < 1 << 8 * w))


def rare_first(keys: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """64-bit keys whose ascending order is a global order from rare to frequent.

    The top byte is a class of the key's counter (seven to each doubling), the rest the key's own top 56 bits.
    """
    n = counters[(keys & np.uint64(len(counters) - 1)).astype(np.int64)]
    level = np.minimum(7 * np.log2(n.astype(np.float64) + 1), 255).astype(np.uint64)
    return (level << np.uint64(56)) | (keys >> np.uint64(8))


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def packed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[dict]:
    """One row for each bucket with its entries of every column as bytes."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = {k: np.ascontiguousarray(v[order]) for k, v in columns.items()}
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for i, j in zip(edges[:-1], edges[1:]):
        yield {"bucket": int(bucket[i])} | {k: v[i:j].tobytes() for k, v in columns.items()}


def unpacked(rows: pa.Table, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(b"".join(rows[k].to_pylist()), kind) for k, kind in kinds.items()}
