"""Rolling, cross-sectional and bucket features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import exact_quantiles, rank_in_group


def trailing(df: DataFrame, key: Sequence[str], t: str, specs: dict[str, tuple[str, str, int]]) -> DataFrame:
    """name -> (sum|avg, column, k): over the last k rows, at least one."""
    fns = {"sum": F.sum, "avg": F.avg}
    w = Window.partitionBy(*key).orderBy(t)
    return df.withColumns({n: fns[f](c).over(w.rowsBetween(-(k - 1), 0)) for n, (f, c, k) in specs.items()})


def nav_and_drawdown(df: DataFrame, key: Sequence[str], t: str, ret: str, nav: str = "nav", dd: str = "drawdown") -> DataFrame:
    """Compounded value of a period return series and its drawdown."""
    w = Window.partitionBy(*key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(nav, F.product(1 + F.col(ret)).over(w)).withColumn(
        dd, F.col(nav) / F.max(nav).over(w) - 1
    )


def market_mean(df: DataFrame, t: str, value: str, out: str) -> DataFrame:
    """Cross-sectional mean per period, joined back (partial aggregation, no window over a period)."""
    return df.join(df.groupBy(t).agg(F.avg(value).alias(out)), t, "left")


def illiquidity(df: DataFrame, key: Sequence[str], ts: str, ret: str, value: str, rows: int = 21, min_history: int = 30) -> DataFrame:
    """Mean of |return| / traded value over the last `rows` days, at each key's last day of the month."""
    w = Window.partitionBy(*key).orderBy(ts)
    daily = F.abs(F.col(ret)) / F.nullif(F.col(value), F.lit(0.0)) * 1e9
    d = df.withColumn("_a", daily).select(
        *key, ts, F.avg("_a").over(w.rowsBetween(-(rows - 1), 0)).alias("illiq"),
        F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_n"),
    )
    m = d.groupBy(*key, F.last_day(ts).alias("t")).agg(F.max_by(F.struct("illiq", "_n"), ts).alias("_s"))
    return m.select(*key, "t", F.when(F.col("_s._n") >= min_history, F.col("_s.illiq")).alias("illiq"))


def residual_volatility(
    df: DataFrame, key: Sequence[str], ts: str, ret: str, market: str,
    rows: int = 63, min_pairs: int = 40, min_history: int = 30, scale: float = 252.0,
) -> DataFrame:
    """Residual sd of a trailing market-model regression from rolling sums; window cut before nulls go."""
    w = Window.partitionBy(*key).orderBy(ts)
    r = w.rowsBetween(-(rows - 1), 0)
    both = F.col(ret).isNotNull() & F.col(market).isNotNull()
    x, y = F.when(both, F.col(market)), F.when(both, F.col(ret))
    d = df.select(
        *key, ts,
        F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_h"),
        F.count(x).over(r).alias("_n"), F.sum(x).over(r).alias("_x"), F.sum(y).over(r).alias("_y"),
        F.sum(x * x).over(r).alias("_xx"), F.sum(y * y).over(r).alias("_yy"), F.sum(x * y).over(r).alias("_xy"),
    )
    m = d.groupBy(*key, F.last_day(ts).alias("t")).agg(
        F.max_by(F.struct("_h", "_n", "_x", "_y", "_xx", "_yy", "_xy"), ts).alias("_s")
    ).select(*key, "t", "_s.*")
    n = F.col("_n").cast("double")
    sxx = F.col("_xx") - F.col("_x") * F.col("_x") / n
    syy = F.col("_yy") - F.col("_y") * F.col("_y") / n
    sxy = F.col("_xy") - F.col("_x") * F.col("_y") / n
    sse = F.greatest(syy - sxy * sxy / F.nullif(sxx, F.lit(0.0)), F.lit(0.0))
    ok = (F.col("_h") >= min_history) & (F.col("_n") >= min_pairs) & (sxx > 0)
    return m.select(*key, "t", F.when(ok, F.sqrt(sse / (n - 1)) * F.sqrt(F.lit(scale))).alias("idio_vol"))


def carry_to_months(df: DataFrame, months: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Trailing features at every month of `months` from the key's first row on, also after it stops."""
    last = months.agg(F.max("t").alias("m")).scalar()
    first = df.groupBy(*key).agg(F.min("t").alias("_t0")).withColumn("_t1", last).where(F.col("_t0") <= F.col("_t1"))
    every = F.sequence(F.trunc("_t0", "month"), F.trunc("_t1", "month"), F.expr("interval 1 month"))
    grid = first.select(*key, F.explode(every).alias("_m")).select(*key, F.last_day("_m").alias("t")).join(months, "t", "left_semi")
    return grid.join(df, [*key, "t"], "left").withColumns({
        c: F.last(c, ignorenulls=True).over(
            Window.partitionBy(*key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        ) for c in cols
    })


def half_split(df: DataFrame, score: str, key: str, out: str = "half") -> DataFrame:
    """Lower and upper half by (score, key): the first floor(n/2) rows are `low`."""
    n = df.where(F.col(score).isNotNull()).agg((F.count("*") / 2).cast("bigint").alias("h")).scalar()
    return rank_in_group(df, [], score, key, descending=False).withColumn(
        out, F.when(F.col("rk") <= n, "low").otherwise("high")
    )


def median_split(df: DataFrame, score: str, out: str = "side") -> DataFrame:
    """`high` above the median; ties at the median are `low`."""
    m = exact_quantiles(df, [], score, {"m": 0.5}).scalar()
    return df.withColumn(out, F.when(F.col(score) > m, "high").otherwise("low"))


def quantile_bucket(df: DataFrame, value: str, groups: int, out: str = "bucket") -> DataFrame:
    """1-based equal-frequency group by interpolated edges, right-closed."""
    q = exact_quantiles(df, [], value, {f"e{i}": i / groups for i in range(1, groups)})
    edges = q.select(F.array(*[f"e{i}" for i in range(1, groups)])).scalar()
    v = F.col(value)
    df = df.withColumn("_edges", edges)
    return df.withColumn(out, F.when(v.isNotNull(), 1 + F.size(F.filter("_edges", lambda e: v > e)))).drop("_edges")
