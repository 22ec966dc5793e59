"""A bit set of fixed size that says which numbers may be in a column: to read less, never to decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SLOTS = 67_108_859  # a prime; 8 MB of bits, whatever the input


def bit_set(ids: DataFrame, column: str, slots: int = SLOTS) -> np.ndarray:
    """Packed bits: bit (id modulo slots) is set for each id. At most slots / 64 words come to the driver."""
    slot = F.pmod(F.col(column), F.lit(slots))
    words = ids.where(F.col(column).isNotNull()).select(
        F.floor(slot / 64).alias("w"), F.expr(f"shiftleft(1L, CAST(pmod(pmod({column}, {slots}), 64) AS INT))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(-(-slots // 64), dtype=np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint8)


def may_hold(bits: np.ndarray, ids: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    at = np.mod(np.asarray(ids, dtype=np.int64), slots)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split(df: DataFrame, ids: DataFrame, column: str, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """df's rows whose `column` may be among the ids' (all that are, and few others), and all other rows.

    For a join with few ids: only the first part needs an exchange. Null counts as the smallest number.
    """
    shared = df.sparkSession.sparkContext.broadcast(bit_set(ids, column, slots))

    def part(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(column).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(may_hold(shared.value, keys, slots) == inside))

        return df.mapInArrow(run, df.schema)

    return part(True), part(False)
