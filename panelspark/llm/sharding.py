"""Uniform shuffle into shards of exact size, from a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

GROUP_ROWS = 100_000  # rows of a source group or of a slice of a shard that one task orders
LIST_CELLS = 50_000  # cells of the matrix handed over in one literal


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """How many rows each source group sends to each shard in a uniformly random permutation of all rows.

    Row sums are `counts`, column sums are `sizes`; each row of the matrix is a multivariate hypergeometric draw
    from what the rows before it left of the shards.
    """
    if sum(counts) != sum(sizes):
        raise ValueError("counts and sizes must have the same sum")
    rng, left = np.random.default_rng(seed), np.array(sizes, dtype=np.int64)
    matrix = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for g, n in enumerate(counts):
        rest, pool = n, int(left.sum())
        for s in range(len(sizes)):  # one shard after the other: exact at any size of the pool
            pool -= int(left[s])
            matrix[g, s] = rest if pool == 0 else _draw(rng, int(left[s]), pool, rest)
            rest -= int(matrix[g, s])
        left -= matrix[g]
    return matrix


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without return are among the `good` ones."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    # beyond the generator's range: inversion over all values within 40 deviations of the mean
    mean = n * good / (good + bad)
    reach = 40 * int(np.sqrt(mean * bad / (good + bad)) + 1)
    x = np.arange(max(lo, int(mean) - reach), min(hi, int(mean) + reach) + 1, dtype=np.float64)
    step = np.log(good - x[:-1]) + np.log(n - x[:-1]) - np.log(x[1:]) - np.log(bad - n + x[1:])
    weight = np.concatenate(([0.0], np.cumsum(step)))
    share = np.cumsum(np.exp(weight - weight.max()))
    return int(x[np.searchsorted(share, rng.random() * share[-1], side="right").clip(0, len(x) - 1)])


def _random(seed: int, salt: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *cols)


def shuffle_into_shards(
    df: DataFrame, key: list[str], shards: int, seed: int = 7, shard: str = "shard", slot: str = "slot",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """df with `shard` (0 .. shards-1) and `slot` (gapless from 0 in its shard): a uniform random shuffle.

    Shard sizes differ by one at most. Rows are dealt into source groups of about `group_rows` by a hash of the
    `key` columns; one aggregate counts them; the matrix (groups x shards) is drawn from these counts; each group
    is permuted by a keyed hash and cut by its row of the matrix; each shard is then permuted again in slices that
    are placed by their counted sizes. Everything follows from the keys and the seed, so that a lost task gives the
    same rows again.

    Nulls count as values of the key. Rows with equal keys are ordered arbitrarily among themselves; if they
    are equal in all columns the result is the same in any order. An empty table gives an empty one. Columns named
    `shard` or `slot` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = df.count()
    n_groups = max(1, -(-rows // group_rows))
    k = [F.col(c) for c in key]
    df = df.drop(shard, slot)
    dealt = df.withColumn("__g", F.pmod(_random(seed, 1, *k), F.lit(n_groups)).cast("int"))
    found = {r["__g"]: r["count"] for r in dealt.groupBy("__g").count().collect()}  # one row a group
    counts = [found.get(g, 0) for g in range(n_groups)]
    total = sum(counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    ends = np.cumsum(communication_matrix(counts, sizes, seed), axis=1)
    local = dealt.withColumn("__r", F.row_number().over(
        Window.partitionBy("__g").orderBy(_random(seed, 2, *k), *k)))
    out = local.join(_cells(df, ends), "__g").withColumn(
        shard, F.size(F.filter("__ends", lambda e: e < F.col("__r"))).cast("int")).drop("__ends", "__r", "__g")
    slices = max(1, -(-total // (shards * group_rows)))
    out = out.withColumn("__s", F.pmod(_random(seed, 3, *k), F.lit(slices)).cast("int"))
    before = (
        out.groupBy(shard, "__s").agg(F.count("*").alias("__n"))
        .withColumn("__base", F.coalesce(F.sum("__n").over(
            Window.partitionBy(shard).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("__n"))
    placed = out.withColumn("__r", F.row_number().over(
        Window.partitionBy(shard, "__s").orderBy(_random(seed, 4, *k), *k)))
    return placed.join(before, [shard, "__s"]).withColumn(
        slot, F.col("__base") + F.col("__r") - 1).drop("__s", "__r", "__base")


def _cells(df: DataFrame, ends: np.ndarray) -> DataFrame:
    """The matrix as rows (_g, _ends), from literals of bounded length."""
    spark, step, parts = df.sparkSession, max(1, LIST_CELLS // ends.shape[1]), None
    for lo in range(0, len(ends), step):
        text = ";".join(",".join(map(str, row)) for row in ends[lo:lo + step])
        part = spark.range(1).select(F.posexplode(F.split(F.lit(text), ";")).alias("__i", "__t")).select(
            (F.col("__i") + lo).cast("int").alias("__g"),
            F.split("__t", ",").cast("array<bigint>").alias("__ends"))
        parts = part if parts is None else parts.unionAll(part)
    return parts
