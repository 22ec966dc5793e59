"""Exact ranks, prefix sums and quantiles without putting a large group into one task.

Rows (for sums and quantiles: one per distinct value) are written once, which counts them. Up to ROWS of them are
ordered by a plain window. More are dealt by a range exchange on (group, value, tie) into partitions of about ROWS
rows, numbered in that order, and the partition's number is written with them: per group, the totals of the
partitions before are added to what a window finds inside each. The order is that of the raw columns, and the number
of partitions follows from the counted rows. A value shared by a third of all rows is one row, or is cut by its tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.sinks import settle

ROWS = 1_000_000


def _dealt(df: DataFrame, order: Sequence[Column], rows: int) -> tuple[DataFrame, bool]:
    """df, written once, with `_b`: a number that ascends with the order; and whether there is more than one."""
    df = settle(df)
    n = -(-df.count() // rows)
    if n < 2:
        return df.withColumn("_b", F.lit(0)), False
    return settle(df.repartitionByRange(n, *order).withColumn("_b", F.spark_partition_id())), True


def _before(cells: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per group and partition the totals of the partitions before: one row per partition that has rows."""
    w = Window.partitionBy(*group).orderBy("_b") if group else Window.orderBy("_b")
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    return cells.groupBy(*group, "_b").agg(*[F.sum(n).alias(n) for n in names]).select(
        *group, "_b", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_off_{n}") for n in names])


def ranked_totals(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    sums: dict[str, Column],
    descending: bool = False,
    rows: int = ROWS,
) -> DataFrame:
    """One row per (group, distinct value) with each sum and its inclusive prefix sum `cum_<name>`.

    NULL values are left out. Use `before = cum_x - x` for the exclusive prefix.
    """
    group, names = list(group), list(sums)
    cells = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    cells, many = _dealt(cells, [*map(F.col, group), order], rows)
    keys = [*group, "_b"] if many else group
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0)
    out = cells.select("*", *[F.sum(n).over(w).alias(f"cum_{n}") for n in names])
    if many:
        out = _join(out, _before(cells, group, names), keys).withColumns(
            {f"cum_{n}": F.col(f"cum_{n}") + F.col(f"_off_{n}") for n in names})
    return out.drop("_b", *[f"_off_{n}" for n in names])


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on keys that may be null."""
    right = right.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[f"_j_{k}"])
    return left.join(right, same).drop(*[f"_j_{k}" for k in keys])


def rank_in_group(
    df: DataFrame, group: Sequence[str], value: str, tie: str, descending: bool = True,
    out: str = "rk", totals: dict[str, Column] | None = None, rows: int = ROWS,
) -> DataFrame:
    """Exact row number by (value, tie ascending) in each group; tie is a key unique per group.

    `totals` adds per-group sums. Rows without a value are left out.
    """
    group, totals = list(group), totals or {}
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(tie).asc()]
    found = df.where(F.col(value).isNotNull()).withColumns({f"_t_{n}": c for n, c in totals.items()})
    found, many = _dealt(found, [*map(F.col, group), *order], rows)
    keys = [*group, "_b"] if many else group
    part = Window.partitionBy(*keys)
    ranked = found.withColumn(out, F.row_number().over(part.orderBy(*order)))
    if not many:
        return ranked.withColumns({n: F.sum(f"_t_{n}").over(part) for n in totals}).drop("_b", *[f"_t_{n}" for n in totals])
    cells = found.groupBy(*keys).agg(F.count("*").alias("_rows"), *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in totals])
    whole = Window.partitionBy(*group)
    offsets = cells.select(*keys, *[F.sum(f"_t_{n}").over(whole).alias(n) for n in totals], F.coalesce(F.sum("_rows").over(
        whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    ranked = ranked.drop(*[f"_t_{n}" for n in totals], *totals)
    return _join(ranked, offsets, keys).withColumn(out, F.col("_off") + F.col(out)).drop("_b", "_off")


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float], rows: int = ROWS
) -> DataFrame:
    """Linear-interpolated quantiles per group, exact, one row per group.

    The built-in exact `percentile` keeps every distinct value of a group in one buffer; this does not.
    """
    group = list(group)
    cum = ranked_totals(df, group, value, {"_n": F.lit(1).cast("bigint")}, False, rows)
    totals = cum.groupBy(*group).agg(F.max("cum__n").alias("_tot"))
    if group:
        cum = cum.join(totals, group)
    else:
        cum = cum.withColumn("_tot", totals.scalar())
    hi, lo = F.col("cum__n"), F.col("cum__n") - F.col("_n")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_tot") - 1)
        f, c = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((lo <= f) & (f < hi), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((lo <= c) & (c < hi), F.col(value))).alias(f"_hi_{name}"),
            F.max(pos - f).alias(f"_w_{name}"),
        ]
    out = cum.groupBy(*group).agg(*aggs)
    return out.select(
        *group,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
    )


def dense_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """0-based position of each distinct numeric key in ascending order."""
    cum = ranked_totals(df, [], key, {"_n": F.lit(1).cast("bigint")})
    return cum.select(key, (F.col("cum__n") - F.col("_n")).alias(out))


def top_n(df: DataFrame, group: Sequence[str], score: str, key: str, n: int, out: str = "rk") -> DataFrame:
    """Top n per group by score, ties by key ascending.

    The constant bound lets Catalyst cut each task's rows to n per group before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(key).asc())
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def top_share(
    df: DataFrame, group: Sequence[str], score: str, key: str, share: float, min_rows: int = 1
) -> DataFrame:
    """Top ceil(share * n) per group, at least `min_rows`, at most n."""
    ranked = rank_in_group(df, group, score, key, totals={"_n": F.lit(1).cast("bigint")})
    k = F.least(F.greatest(F.ceil(F.lit(share) * F.col("_n")), F.lit(min_rows)), F.col("_n"))
    return ranked.where(F.col("rk") <= k).drop("_n")


def top_by_budget(
    df: DataFrame, group: Sequence[str], score: str, key: str, flag: Column
) -> DataFrame:
    """Per group, as many top rows by score as there are flagged rows."""
    ranked = rank_in_group(df, group, score, key, totals={"_k": flag.cast("bigint")})
    return ranked.where(F.col("rk") <= F.col("_k")).drop("_k")


def budget_curve(df: DataFrame, score: str, key: str, event: Column, budgets: Sequence[float]) -> DataFrame:
    """Recall and precision of the top round(b*n) rows for several budgets b (half-even rounding).

    Ties at the cut are resolved by key ascending. Only the rows of the boundary values are ranked.
    """
    ev = event.cast("bigint")
    cum = ranked_totals(df, [], score, {"n": F.lit(1).cast("bigint"), "hits": ev}, True)
    tot = df.where(F.col(score).isNotNull()).agg(F.count("*").alias("n_all"), F.sum(ev).alias("hits_all"))
    plan = tot.select(
        "n_all", "hits_all", F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget")
    ).withColumn("k", F.bround(F.col("budget") * F.col("n_all")).cast("bigint"))
    # one pass over the values: for every budget, the totals above its cut and the value at the cut
    ks = plan.agg(F.sort_array(F.collect_list(F.struct("budget", "k"))).alias("ks")).scalar()
    cells = cum.withColumn("_ks", ks).select("*", F.explode("_ks").alias("_q")).select(
        score, "n", "hits", "cum_n", "cum_hits", F.col("_q.budget").alias("budget"), F.col("_q.k").alias("k")
    )
    cut = (F.col("cum_n") > F.col("k")) & (F.col("cum_n") - F.col("n") < F.col("k"))
    per = cells.groupBy("budget").agg(
        F.max(F.when(F.col("cum_n") <= F.col("k"), F.col("cum_hits"))).alias("_above"),
        F.max(F.when(cut, F.col(score))).alias("_cut"),
        F.max(F.when(cut, F.col("k") - F.col("cum_n") + F.col("n"))).alias("_need"),
    )
    edge = per.where(F.col("_cut").isNotNull())
    at_cut = df.withColumn("_hit", ev).join(
        edge.select(F.col("_cut").alias(score), "budget", "_need"), score
    )
    ranked = rank_in_group(at_cut, ["budget"], "_need", key)
    tie_hits = ranked.where(F.col("rk") <= F.col("_need")).groupBy("budget").agg(F.sum("_hit").alias("_tie"))
    return (
        plan.join(per, "budget", "left").join(tie_hits, "budget", "left")
        .withColumn("hits", F.coalesce("_above", F.lit(0)) + F.coalesce("_tie", F.lit(0)))
        .select(
            "budget", "k", F.col("n_all").alias("n"), "hits",
            (F.col("hits") / F.nullif(F.col("hits_all"), F.lit(0))).alias("recall"),
            (F.col("hits") / F.nullif(F.col("k"), F.lit(0))).alias("precision"),
            (F.col("k") / F.nullif(F.col("n_all"), F.lit(0))).alias("random_recall"),
        )
    )
