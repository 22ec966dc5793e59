"""Block bootstrap: weights are made where the blocks lie, and replicates are never rows of blocks or scores.

A replicate draws as many blocks as there are. How many of its draws fall on each range of RANGE blocks follows from a
tree of binomial splits, keyed by seed and node, so that every task finds its own number without the others'; inside a
range, draws are portable hashes of (seed, replicate, range, slot), so that any engine repeats them and a lost task
recomputes the same ones. Tasks return one row of sums a replicate. The random-at-budget arm of a replicate is its
conditional expectation k/n, so intervals for a difference to it are narrower than with a drawn arm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.sinks import settle
from .ranking import ROWS, _dealt, dense_index

Z_975, Z_80 = 1.959963984540054, 0.8416212335729143
RANGE = 1 << 14  # blocks whose draws are made together
CELLS = 1 << 22  # of replicates x rows that a sweep holds at once
_MASK = (1 << 32) - 1


def _mix(x):
    """A bijection of 32-bit integers, in arithmetic that never leaves 63 bits."""
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 73244475) & _MASK
    return x ^ (x >> 16)


def range_draws(seed: int, reps: int, n: int, at: int) -> np.ndarray:
    """For each replicate how many of its n draws fall on range number `at` of n blocks.

    From the root, a node of ranges [a, b) deals its draws to its halves by a binomial law; the generator of a node is
    keyed by the seed and the node alone.
    """
    count, a, b = np.full(reps, n, dtype=np.int64), 0, -(-n // RANGE)
    while b - a > 1:
        m = (a + b) // 2
        rng = np.random.Generator(np.random.Philox(key=seed & _MASK, counter=[0, 0, a, b]))
        left = rng.binomial(count, (m - a) * RANGE / (min(b * RANGE, n) - a * RANGE))
        count, a, b = (left, a, m) if at < m else (count - left, m, b)
    return count


def range_weights(seed: int, reps: int, n: int, at: int) -> Iterator[np.ndarray]:
    """For each replicate, how often it draws each block of a range."""
    count, size = range_draws(seed, reps, n, at), min(n - at * RANGE, RANGE)
    slots = _mix(np.arange(int(count.max(initial=0)), dtype=np.int64))
    for rep in range(reps):
        key = _mix((seed * 1000003 + rep + at * 2654435) & _MASK)
        yield np.bincount(_mix(slots[:count[rep]] ^ key) % size, minlength=size)


def weights(seed: int, reps: int, n: int) -> np.ndarray:
    """replicates x blocks, for a number of blocks that the calendar bounds."""
    if n > RANGE:
        raise ValueError(f"{n} blocks: a sweep takes {RANGE} at most")
    return np.stack(list(range_weights(seed, reps, n, 0))) if n else np.zeros((reps, 0), np.int64)


def indexed(blocks: DataFrame, key: str) -> DataFrame:
    """Number the blocks by ascending numeric key, from 0."""
    return blocks.join(dense_index(blocks, key), key)


def replicate_sums(blocks: DataFrame, key: str, sums: Sequence[str], reps: int, seed: int) -> DataFrame:
    """Sums (double) of the drawn blocks per replicate. Each range of blocks draws for itself and sends `reps` rows.

    A missing value counts as 0, as in sums of rows.
    """
    sums = list(sums)
    at = settle(indexed(blocks, key).select("idx", *[F.col(c).cast("double") for c in sums]))
    n = at.count()

    def draw(group: pa.Table) -> pa.Table:
        idx = group["idx"].to_numpy()
        own = int(idx[0]) // RANGE
        x = np.nan_to_num(np.stack([group[c].to_numpy() for c in sums], axis=1)[np.argsort(idx)])
        out = np.array([w @ x for w in range_weights(seed, reps, n, own)])
        return pa.table({"rep": np.arange(reps, dtype=np.int64)} | {c: out[:, i] for i, c in enumerate(sums)})

    parts = at.groupBy(F.floor(F.col("idx") / RANGE)).applyInArrow(draw, "rep long, " + ", ".join(f"`{c}` double" for c in sums))
    return parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in sums])


def _sweep(df: DataFrame, block: str, score: str, event: Column, part, fields: str, rows: int) -> DataFrame:
    """part() of each stretch of the scores in descending order, in one range exchange of (score, block) counts.

    part gets number of blocks, block, n and p of the stretch's cells, the cells where ties end, and of every block the
    counts before the stretch, in it and in all, and whether it is the first one. A score shared by many rows is one cell a block.
    """
    at = dense_index(df.select(block).distinct(), block, "_i")
    cells = df.where(F.col(score).isNotNull()).join(at, block).groupBy("_i", F.col(score).alias("_s")).agg(
        F.count("*").alias("n"), F.count_if(event).alias("p"))
    cells, _ = _dealt(cells.select("_i", "_s", "n", "p"), [F.col("_s").desc()], rows)
    n_blocks = at.count()
    have = cells.groupBy("_b", "_i").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    grid = have.select("_b").distinct().select("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_blocks, 1) - 1).cast("long"))).alias("_i"))
    own = grid.join(have, ["_b", "_i"], "left").na.fill(0, ["n", "p"])
    w = Window.partitionBy("_i")
    before = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    known = own.select(F.col("_b").alias("_at"), F.col("_i").alias("_i"), "n", "p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "p")],
                       *[F.sum(c).over(w).alias(f"{c}_all") for c in ("n", "p")], (F.col("_b") == F.min("_b").over(w)).alias("first"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s = left["_s"].to_numpy().astype(float)
        order = np.argsort(-s, kind="stable")
        s = s[order]
        ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
        place = np.argsort(right["_i"].to_numpy())
        counts = {c: right[c].to_numpy()[place].astype(np.float64) for c in ("n", "p", "n_before", "p_before", "n_all", "p_all")}
        return part(n_blocks, left["_i"].to_numpy()[order], left["n"].to_numpy()[order], left["p"].to_numpy()[order], ends,
                    counts, bool(right["first"][0].as_py()))

    return cells.groupBy("_b").cogroup(known.groupBy("_at")).applyInArrow(run, fields)


def _running(w: np.ndarray, block: np.ndarray, ends: np.ndarray, *counts: np.ndarray) -> Iterator[tuple]:
    """For some replicates at a time: their numbers, and the weighted running totals of each count where ties end."""
    step = max(1, CELLS // max(1, len(block)))
    for i in range(0, len(w), step):
        own = w[i:i + step][:, block]
        yield slice(i, i + step), *[np.cumsum(own * c, axis=1, dtype=np.float64)[:, ends] for c in counts]


def auc_replicates(
    df: DataFrame, block: str, score: str, event: Column, reps: int, seed: int, rows: int = ROWS,
) -> DataFrame:
    """rep, roc_auc (ties count half), avg_precision (tied scores are one step) of each replicate of whole blocks, on raw
    scores. Replicates without both classes are left out, rows without a score as well."""
    def part(n_blocks, at, n, p, ends, counts, first) -> pa.Table:
        w = weights(seed, reps, n_blocks)
        area, steps = np.zeros(reps), np.zeros(reps)
        for own, cum_n, cum_p in _running(w, at, ends, n, p):
            p0, n0 = (w[own] @ counts[c] for c in ("p_before", "n_before"))
            hits = np.diff(cum_p, axis=1, prepend=0)
            misses = np.diff(cum_n - cum_p, axis=1, prepend=0)
            cum_p, cum_n = cum_p + p0[:, None], cum_n + n0[:, None]
            below = (w[own] @ (counts["n_all"] - counts["p_all"]))[:, None] - (cum_n - cum_p)
            area[own] = (hits * (below + misses / 2)).sum(axis=1)
            steps[own] = (hits * np.divide(cum_p, cum_n, out=np.zeros_like(cum_p), where=cum_n > 0)).sum(axis=1)
        return pa.table({"rep": np.arange(reps, dtype=np.int64), "area": area, "steps": steps,
                         "P": w @ counts["p_all"], "N": w @ (counts["n_all"] - counts["p_all"])})

    parts = _sweep(df, block, score, event, part, "rep long, area double, steps double, P double, N double", rows)
    g = parts.groupBy("rep").agg(F.sum("area").alias("area"), F.sum("steps").alias("steps"), F.max("P").alias("P"), F.max("N").alias("N"))
    return g.where("P > 0 AND N > 0").select("rep", (F.col("area") / (F.col("P") * F.col("N"))).alias("roc_auc"), (F.col("steps") / F.col("P")).alias("avg_precision"))


def budget_replicates(
    df: DataFrame, block: str, score: str, event: Column, budgets: Sequence[float], reps: int, seed: int, rows: int = ROWS,
) -> DataFrame:
    """rep, budget, recall of the top share by raw score of each replicate; a cut through tied scores takes its expected
    part of their events. A stretch of scores is looked at row by row only for the replicates whose cut lies in it.
    Without an event, recall is null; a budget of no row finds nothing."""
    def part(n_blocks, at, n, p, ends, counts, first) -> pa.Table:
        w = weights(seed, reps, n_blocks)
        total = {c: w @ x for c, x in counts.items()}
        out: list[tuple] = []
        for budget in map(float, budgets):
            k = np.rint(budget * total["n_all"])
            here = np.flatnonzero((total["n_before"] < k) & (k <= total["n_before"] + total["n"]))
            for own, cum_n, cum_p in _running(w[here], at, ends, n, p):
                need = (k - total["n_before"])[here[own]]
                cut = (cum_n < need[:, None]).sum(axis=1)
                row = np.arange(len(cut))
                above_n, above_p = (np.where(cut > 0, x[row, cut - 1], 0.0) for x in (cum_n, cum_p))
                size, events = cum_n[row, cut] - above_n, cum_p[row, cut] - above_p
                hits = total["p_before"][here[own]] + above_p + events * ((need - above_n) / size)
                out += zip(here[own].tolist(), [budget] * len(cut), hits.tolist())
            out += [(r, budget, 0.0) for r in np.flatnonzero(k == 0).tolist() if first]
        rep, budget, hits = zip(*out) if out else ((), (), ())
        return pa.table({"rep": pa.array(rep, pa.int64()), "budget": pa.array(budget, pa.float64()), "hits": pa.array(hits, pa.float64()),
                         "P": pa.array([total["p_all"][r] for r in rep], pa.float64())})

    found = _sweep(df, block, score, event, part, "rep long, budget double, hits double, P double", rows)
    return found.select("rep", "budget", (F.col("hits") / F.nullif(F.col("P"), F.lit(0.0))).alias("recall"))


def interval(df: DataFrame, stats: dict[str, Column], lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Mean, sd and percentile interval of each statistic over the replicates (a bounded number)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("quantity"), c.cast("double").alias("x")) for n, c in stats.items()])).alias("_s")).select("_s.*")
    return long.where(F.col("x").isNotNull()).groupBy("quantity").agg(
        F.count("*").alias("n_reps"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("se"),
        F.percentile("x", lo).alias("lo"), F.percentile("x", hi).alias("hi"),
    )


def recall_sums(df: DataFrame, block: Column, event: Column, preds: dict[str, Column]) -> DataFrame:
    """Per block: rows, events, and per method hits; the sufficient statistics of recall."""
    return df.groupBy(block.alias("block")).agg(
        F.count("*").alias("n"), F.count_if(event).alias("m"), *[F.count_if(event & p).alias(f"hit_{k}") for k, p in preds.items()]
    )


def recall_replicates(blocks: DataFrame, fire_rate: Column, methods: Sequence[str], main: str, reps: int, seed: int) -> DataFrame:
    """Recall per method, the random floor and the difference of `main` to it, one row per replicate."""
    r = replicate_sums(blocks, "block", ["n", "m", *[f"hit_{k}" for k in methods]], reps, seed).where(F.col("m") > 0)
    r = r.withColumn("_k", F.bround(fire_rate * F.col("n")))
    out = r.select("rep", *[(F.col(f"hit_{k}") / F.col("m")).alias(k) for k in methods], (F.col("_k") / F.col("n")).alias("random"))
    return out.withColumn("difference", F.col(main) - F.col("random"))


def minimum_detectable(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("mde", (Z_975 + Z_80) * F.col("se"))


def equivalence(reps: DataFrame, diff: str, margin: float) -> DataFrame:
    """Two one-sided checks of |difference| < margin from bootstrap replicates."""
    d = F.col(diff)
    g = reps.agg(F.percentile(diff, 0.025).alias("lo"), F.percentile(diff, 0.975).alias("hi"),
                 F.avg((d < margin).cast("double")).alias("_b"), F.avg((d > -margin).cast("double")).alias("_a"))
    return g.select("lo", "hi", (1 - F.least("_b", "_a")).alias("tost_p"), ((F.col("lo") > -margin) & (F.col("hi") < margin)).alias("equivalent"))


def paired_returns(series: DataFrame, t_index: str, a: str, b: str, reps: int, seed: int) -> DataFrame:
    """Annualised mean and Sharpe difference of two period series per replicate of whole periods."""
    s = series.select(F.col(t_index).alias("block"), F.lit(1).cast("bigint").alias("n"), F.col(a).alias("a"), F.col(b).alias("b"),
                      (F.col(a) * F.col(a)).alias("aa"), (F.col(b) * F.col(b)).alias("bb"))
    r = replicate_sums(s, "block", ["n", "a", "b", "aa", "bb"], reps, seed)
    n = F.col("n")

    def sharpe(x: str) -> Column:
        var = (F.col(x + x) - F.col(x) * F.col(x) / n) / (n - 1)
        return F.col(x) / n / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0))

    return r.select("rep", ((F.col("a") - F.col("b")) / n * 12).alias("d_mean"), ((sharpe("a") - sharpe("b")) * F.sqrt(F.lit(12.0))).alias("d_sharpe"))
