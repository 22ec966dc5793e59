"""Point-in-time, interval and validated joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import band_label
from . import calendar as cal
from .sets import pick_columns


def asof_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], t: str, as_of: str,
    cols: Sequence[str], order_by: Sequence[str],
) -> DataFrame:
    """Latest right row with as_of <= t (inclusive) for each left row; unmatched left rows keep NULLs.

    `order_by` decides between right rows of one day and must be given. A right row without a date was known at no
    time and is never matched.

    Both sides are first reduced to one row per (key, day): the right side to its last row by
    `order_by`, the left side to its distinct days. The ordered window therefore sees at most two rows
    per calendar day and key, however many rows a key has, and no pair is ever formed by inequality.
    `t` and `as_of` are dates.
    """
    if not order_by:
        raise ValueError("order_by must name the columns that decide between rows of one day")
    key, right = list(key), right.where(F.col(as_of).isNotNull())
    order = order_by[0] if len(order_by) == 1 else F.struct(*order_by)
    aggs, picked = pick_columns(right, list(cols), order, F.max_by)
    best = right.groupBy(*key, F.col(as_of).alias("_d")).agg(*aggs).select(
        *key, "_d", F.struct(F.col("_d").alias(as_of), *picked).alias("_r")
    )
    points = left.select(*key, F.col(t).alias("_d")).distinct()
    both = best.select(*key, "_d", F.lit(0).alias("_side"), "_r").unionByName(
        points.select(*key, "_d", F.lit(1).alias("_side")), allowMissingColumns=True
    )
    w = Window.partitionBy(*key).orderBy("_d", "_side") if key else Window.orderBy("_d", "_side")
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    hit = hit.select(*key, F.col("_d").alias(t), F.col(f"_r.{as_of}").alias(as_of), *[F.col(f"_r.{c}").alias(c) for c in cols])
    # NULL dates on the left find nothing but stay
    return left.join(hit, [*key, t], "left")


def asof_wide(
    left: DataFrame, facts: DataFrame, key: Sequence[str], t: str, as_of: str,
    concept: str, value: str, names: dict[str, str], order_by: Sequence[str],
) -> DataFrame:
    """As-of value of each concept (concept -> output column) next to every left row."""
    points = left.select(*key, t).distinct().withColumn(
        concept, F.explode(F.array(*[F.lit(c) for c in names]))
    )
    long = asof_join(points, facts.where(F.col(concept).isin(*names)), [*key, concept], t, as_of, [value], order_by)
    wide = long.groupBy(*key, t).agg(
        *[F.max(F.when(F.col(concept) == c, F.col(value))).alias(n) for c, n in names.items()]
    )
    return left.join(wide, [*key, t], "left")


def interval_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], t: str, ts: str,
    months_back: int = 0, months_ahead: int = 0, how: str = "inner",
) -> DataFrame:
    """Right rows whose `ts` lies near `t`: [t - months_back, t], (t, t + months_ahead], or with both bounds
    [t - months_back, t + months_ahead]. With how="left", left rows without a hit stay, each once.

    Month buckets turn the interval into an equality, so that the join shuffles on (key, month) and a
    heavy key is spread over its months. Each left row is repeated once per month it reaches.
    """
    key = list(key)
    lo = F.add_months(t, -months_back) if months_back else F.col(t)
    hi = F.add_months(t, months_ahead) if months_ahead else F.col(t)
    reach = F.explode(F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("interval 1 month")))
    points = left if how == "inner" else left.select(*key, t).distinct()
    from_ = F.col(ts) >= lo if months_back or not months_ahead else F.col(ts) > F.col(t)
    hits = points.withColumn("_m", reach).join(right.withColumn("_m", F.trunc(ts, "month")), [*key, "_m"])
    hits = hits.where(from_ & (F.col(ts) <= hi)).drop("_m")
    return hits if how == "inner" else left.join(hits, [*key, t], "left")


def outer_align(series: dict[str, DataFrame], t: str, value: str) -> DataFrame:
    """Full outer merge of many (t, value) series: one union and one aggregate instead of n joins."""
    long = None
    for name, df in series.items():
        part = df.select(t, F.lit(name).alias("_s"), F.col(value).alias("_v"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(t).agg(*[F.max(F.when(F.col("_s") == n, F.col("_v"))).alias(n) for n in series])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def join_1to1(left: DataFrame, right: DataFrame, keys: Sequence[str], keep_all: bool = True) -> DataFrame:
    """One-to-one join. A key found twice on a side, or (keep_all) on one side only, fails the job."""
    keys = list(keys)
    rest_l, rest_r = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    cell = lambda cols: F.struct(*[F.col(c) for c in cols]) if cols else F.struct(F.lit(1).alias("_one"))
    l = left.select(*keys, cell(rest_l).alias("_l"))
    r = right.select(*keys, cell(rest_r).alias("_r"))
    lg = l.groupBy(*keys).agg(F.count("*").alias("_nl"), F.any_value("_l").alias("_l"))
    rg = r.groupBy(*keys).agg(F.count("*").alias("_nr"), F.any_value("_r").alias("_r"))
    both = lg.join(rg, keys, "full" if keep_all else "inner")
    bad = (F.coalesce("_nl", F.lit(0)) != 1) | (F.coalesce("_nr", F.lit(0)) != 1)
    ok = F.when(bad, F.raise_error(F.lit("join is not one-to-one"))).otherwise(F.lit(True))
    return both.where(ok).select(
        *keys, *[F.col(f"_l.{c}").alias(c) for c in rest_l], *[F.col(f"_r.{c}").alias(c) for c in rest_r]
    )


def previous_record(df: DataFrame, key: Sequence[str], ts: str, tie: str, cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Columns of the previous row of the same key by (ts, tie); the tie is unique per key and day.

    Done in two levels: inside a day, and from the last row of the previous day. No task holds more
    than one key's day, or one row per day of a key.
    """
    key = list(key)
    cell = F.struct(F.col(tie), *[F.col(c) for c in cols if c != tie])
    w = Window.partitionBy(*key, ts).orderBy(tie)
    inner = df.withColumn("_p", F.lag(cell).over(w))
    last = df.groupBy(*key, ts).agg(F.max_by(cell, F.col(tie)).alias("_last"))
    carry = last.select(*key, ts, F.lag("_last").over(Window.partitionBy(*key).orderBy(ts)).alias("_carry"))
    out = inner.join(carry, [*key, ts], "left").withColumn("_p", F.coalesce("_p", "_carry")).drop("_carry")
    names = [tie, *[c for c in cols if c != tie]]
    return out.withColumns({f"{prefix}{c}": F.col(f"_p.{c}") for c in names}).drop("_p")


def spine(df: DataFrame, t: str, sectors: DataFrame, sector: str, strategies: Sequence[str], strategy: str = "strategy") -> DataFrame:
    """Every (strategy, period, sector) cell: the distinct periods, expanded by two small lists."""
    names = sectors.agg(F.collect_set(sector).alias("s")).scalar()
    return (
        df.select(t).distinct()
        .withColumn(strategy, F.explode(F.array(*[F.lit(s) for s in strategies])))
        .withColumn(sector, F.explode(names))
    )


def common_periods(df: DataFrame, t: str, series: str, n_series: int) -> DataFrame:
    """Rows of the periods that occur in every one of `n_series` series."""
    full = df.groupBy(t).agg(F.countDistinct(series).alias("_n")).where(F.col("_n") == n_series).select(t)
    return df.join(full, t, "left_semi")


def compare_logs(a: DataFrame, b: DataFrame, keys: Sequence[str], label: str, flag_value: str) -> DataFrame:
    """Agreement of two labelled logs over the same keys, with flags added and removed."""
    j = a.select(*keys, F.col(label).alias("_a")).join(b.select(*keys, F.col(label).alias("_b")), list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    fa, fb = F.col("_a") == flag_value, F.col("_b") == flag_value
    return j.agg(
        F.count_if(both).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
        F.count_if(both & (F.col("_a") == F.col("_b"))).alias("n_agree"),
        F.count_if(both & ~fa & fb).alias("flags_added"), F.count_if(both & fa & ~fb).alias("flags_removed"),
    )


def build_panel(signals: DataFrame, entity: DataFrame, macro: DataFrame, band: float | Column, key: str = "k", t: str = "t", ret: str = "ret_1m") -> DataFrame:
    """Observations + entity dimension + period series + next-period return and its label."""
    p = cal.forward_return(signals, [key], t, ret)
    return p.join(entity, key, "left").join(macro, t, "left").withColumn("label", band_label("fwd_ret", band))


def enrich(panel: DataFrame, sides: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left joins that may not change the row count: a repeated key on a side fails the job."""
    for side, keys in sides:
        rest = [c for c in side.columns if c not in keys]
        one = side.groupBy(*keys).agg(
            F.count("*").alias("_c"), F.any_value(F.struct(*rest)).alias("_s")
        )
        ok = F.when(F.col("_c") > 1, F.raise_error(F.lit(f"repeated key {list(keys)}"))).otherwise(F.lit(True))
        one = one.where(ok).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])
        panel = panel.join(one, list(keys), "left")
    return panel


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    one = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in cols])
    return one.unpivot("n_rows", list(cols), "feature", "n_present").withColumn(
        "coverage", F.col("n_present") / F.nullif(F.col("n_rows"), F.lit(0))
    )
