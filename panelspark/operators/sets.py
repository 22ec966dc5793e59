"""Distinct-on, intersections and deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


_FIXED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def pick_columns(df: DataFrame, cols: Sequence[str], order, agg) -> tuple[list[Column], list[Column]]:
    """(aggregates, columns) that take `cols` from the row with the extreme order value.

    Fixed-width columns are taken one by one, which keeps the aggregate a hash aggregate; wider rows go as
    one struct. The order must be unique per key, or the columns could come from different rows.
    """
    if isinstance(order, str) and all(isinstance(df.schema[c].dataType, _FIXED) for c in [*cols, order]):
        return [agg(F.col(c), F.col(order)).alias(f"_p_{c}") for c in cols], [F.col(f"_p_{c}").alias(c) for c in cols]
    return [agg(F.struct(*cols), order).alias("_p")], [F.col(f"_p.{c}").alias(c) for c in cols]


def _pick(df: DataFrame, keys: Sequence[str], order, agg) -> DataFrame:
    aggs, cols = pick_columns(df, [c for c in df.columns if c not in keys], order, agg)
    return df.groupBy(*keys).agg(*aggs).select(*keys, *cols)


def last_wins(df: DataFrame, keys: Sequence[str], seq: str | Column) -> DataFrame:
    """Last version of each key by an explicit sequence (files carry no order of their own)."""
    return _pick(df, keys, seq, F.max_by)


def first_wins(df: DataFrame, keys: Sequence[str], seq: str | Column) -> DataFrame:
    return _pick(df, keys, seq, F.min_by)


def period_intersection(frames: Sequence[DataFrame], t: str) -> DataFrame:
    out = frames[0].select(t)
    for f in frames[1:]:
        out = out.intersect(f.select(t))
    return out


def stratified_sample(df: DataFrame, stratum: str, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """The same n rows per stratum on every run and engine: smallest md5 of seed and keys."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    w = Window.partitionBy(stratum).orderBy("_h", *keys)
    return df.withColumn("_h", h).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_h", "_rn")


def best_row(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First row by lexicographic keys with mixed directions (a distributed top-1, not a full sort)."""
    return df.orderBy(*order).limit(1)


def best_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 1).drop("_rn")
