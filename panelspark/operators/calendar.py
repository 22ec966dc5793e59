"""Calendar resampling, lags and growth on (entity, period) series.

Month-grain windows per entity are bounded by the number of months, day-grain ones by the number of days,
whatever the raw row count of an entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _w(key: Sequence[str], t: str):
    return Window.partitionBy(*key).orderBy(t) if key else Window.orderBy(t)


def fill_months(df: DataFrame, key: Sequence[str], t: str = "t") -> DataFrame:
    """Insert the empty months between consecutive month-ends of each key; other columns are NULL there.

    A `lead` and an `explode` instead of a spine joined back: one shuffle by key, which every later
    window on the key reuses.
    """
    rest = [c for c in df.columns if c not in (*key, t)]
    nxt = F.lead(t).over(_w(key, t))
    first = F.trunc(t, "month")
    out = df.withColumn("_nxt", nxt)
    months = F.when(F.col("_nxt").isNull(), F.array(first)).otherwise(
        F.sequence(first, F.add_months(F.trunc("_nxt", "month"), -1), F.expr("interval 1 month"))
    )
    out = out.select(*key, *rest, F.posexplode(months).alias("_i", "_m"))
    return out.select(
        *key, F.last_day("_m").alias(t), *[F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in rest]
    )


def month_end_last(
    df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str], out: str = "t", also: dict[str, Column] | None = None
) -> DataFrame:
    """Last non-null value of each column per month, empty months kept inside each key's span.

    `also` adds other monthly aggregates in the same pass.
    """
    g = df.groupBy(*key, F.last_day(ts).alias(out)).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in cols],
        *[c.alias(n) for n, c in (also or {}).items()],
    )
    return fill_months(g, key, out)


def ffill(df: DataFrame, key: Sequence[str], t: str, cols: Sequence[str]) -> DataFrame:
    w = _w(key, t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def resample_ffill(df: DataFrame, ts: str, cols: Sequence[str], key: Sequence[str] = (), out: str = "t") -> DataFrame:
    """Month-end series of last values carried forward over missing months."""
    return ffill(month_end_last(df, key, ts, cols, out), key, out, cols)


def pct_change(df: DataFrame, key: Sequence[str], t: str, c: str, names: dict[str, int]) -> DataFrame:
    """k-row growth of the forward-filled series, so a gap row shows no change at k = 1."""
    w = _w(key, t)
    pad = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_pad", pad)
    return out.withColumns(
        {n: F.col("_pad") / F.nullif(F.lag("_pad", k).over(w), F.lit(0.0)) - 1 for n, k in names.items()}
    ).drop("_pad")


def differences(df: DataFrame, key: Sequence[str], t: str, specs: dict[str, tuple[str, int]]) -> DataFrame:
    """name -> (column, k): the k-row change of a level."""
    w = _w(key, t)
    return df.withColumns({n: F.col(c) - F.lag(c, k).over(w) for n, (c, k) in specs.items()})


def publication_lag(df: DataFrame, key: Sequence[str], t: str, cols: Sequence[str], k: int = 1) -> DataFrame:
    w = _w(key, t)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols})


def risk_free(df: DataFrame, t: str, annual_pct: str, out: str = "monthly_rf") -> DataFrame:
    """Annual percent to a monthly rate, filled forward, then backward, then with 0."""
    w = Window.orderBy(t)
    rate = F.col(annual_pct) / 100.0 / 12.0
    df = df.withColumn("_r", rate)
    fwd = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    bwd = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(fwd, bwd, F.lit(0.0))).drop("_r")


def monthly_volatility(df: DataFrame, key: Sequence[str], ts: str, ret: str, scale: float = 252.0) -> DataFrame:
    """Annualised sample standard deviation of daily returns inside each month."""
    return df.groupBy(*key, F.last_day(ts).alias("t")).agg(annualised_sd(ret, scale).alias("vol_annualized"))


def annualised_sd(ret: str, scale: float = 252.0) -> Column:
    return F.stddev_samp(ret) * F.sqrt(F.lit(scale))


def forward_return(df: DataFrame, key: Sequence[str], t: str, ret: str, out: str = "fwd_ret") -> DataFrame:
    """Next row's return; the last row of each key, which has none, is dropped."""
    return df.withColumn(out, F.lead(ret).over(_w(key, t))).where(F.col(out).isNotNull())


def running_drawdown(df: DataFrame, key: Sequence[str], t: str, c: str) -> DataFrame:
    """Running maximum and drawdown; both NULL where the value itself is NULL."""
    w = _w(key, t).rowsBetween(Window.unboundedPreceding, 0)
    mx = F.when(F.col(c).isNotNull(), F.max(c).over(w))
    return df.withColumn("running_max", mx).withColumn(
        "drawdown", F.col(c) / F.nullif(F.col("running_max"), F.lit(0.0)) - 1
    )


def implied_dividends(df: DataFrame, key: Sequence[str], ts: str, close: str, adj: str, noise: float = 1e-4) -> DataFrame:
    """Cash implied by adjusted against raw price changes; gaps below `noise` count as zero."""
    df = pct_change(pct_change(df, key, ts, adj, {"total_ret": 1}), key, ts, close, {"price_ret": 1})
    gap = F.col("total_ret") - F.col("price_ret")
    amount = F.lag(close, 1).over(_w(key, ts)) * gap
    quiet = F.abs(gap) < noise
    return df.withColumn("div_amount", F.when(quiet, F.lit(0.0)).otherwise(amount)).withColumn(
        "div_ret", F.when(quiet, F.lit(0.0)).otherwise(gap)
    )


def trailing_yield(df: DataFrame, key: Sequence[str], ts: str, amount: str, close: str, rows: int = 12) -> DataFrame:
    """Monthly cash, its trailing sum over `rows` observed months, and the yield on the month-end price."""
    m = df.groupBy(*key, F.last_day(ts).alias("t")).agg(
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("div_month"),
        F.max_by(close, F.when(F.col(close).isNotNull(), F.col(ts))).alias("close"),
    )
    w = _w(key, "t").rowsBetween(-(rows - 1), 0)
    return m.withColumn("div_trailing", F.sum("div_month").over(w)).withColumn(
        "div_yield", F.col("div_trailing") / F.nullif(F.col("close"), F.lit(0.0))
    )


def market_series(df: DataFrame, t: str, means: dict[str, str], constants: Sequence[str] = ()) -> DataFrame:
    """Entity panel to one row per period: averages, and any value of period-constant columns."""
    return df.groupBy(t).agg(
        *[F.avg(c).alias(n) for n, c in means.items()], *[F.any_value(c, True).alias(c) for c in constants]
    )


def bad_periods(df: DataFrame, t: str, event: Column, factor: float = 2.0) -> DataFrame:
    """Event rate per period and a flag where it exceeds `factor` times the pooled rate."""
    e = event.cast("bigint")
    per = df.groupBy(t).agg(F.sum(e).alias("_e"), F.count("*").alias("n_obs"))
    pooled = per.agg((F.sum("_e") / F.sum("n_obs")).alias("p")).scalar()
    return per.select(
        t, "n_obs", (F.col("_e") / F.col("n_obs")).alias("event_rate"),
        (F.col("_e") / F.col("n_obs") > factor * pooled).alias("bad"),
    )
