"""Portfolio accounting: selection rules, turnover, value series and performance tables.

Holdings are one row per (strategy, period, entity); everything after the first aggregate is one row per
(strategy, period).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import nav_and_drawdown


def select_holdings(ranked: DataFrame, rules: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """Rows picked by each rule (name -> condition), as rows with a `strategy` column."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return ranked.select(*keep, F.explode(names).alias("strategy"))


def period_series(holdings: DataFrame, periods: DataFrame, strategies: Sequence[str], t: str, ret: str) -> DataFrame:
    """Equal-weight return and size per (strategy, period); periods without holdings earn 0."""
    per = holdings.groupBy("strategy", t).agg(
        F.count("*").alias("n_holdings"), F.avg(F.coalesce(F.col(ret), F.lit(0.0))).alias("gross_return")
    )
    grid = periods.select(t).distinct().withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))
    return grid.join(per, ["strategy", t], "left").select(
        "strategy", t, F.coalesce("n_holdings", F.lit(0)).alias("n_holdings"),
        F.coalesce("gross_return", F.lit(0.0)).alias("gross_return"),
    )


def turnover(holdings: DataFrame, series: DataFrame, t: str, key: str, ret: str, drift: bool = True) -> DataFrame:
    """Half the absolute weight change against the previous period, per (strategy, period).

    With `drift`, last period's weights first grow with their own returns; a period that was empty or
    lost everything leaves nothing behind. Not recursive: this period's weights and the negated old ones
    are unioned and summed per entity.
    """
    w = Window.partitionBy("strategy").orderBy(t)
    per = series.select(
        "strategy", t, "n_holdings", "gross_return", F.lead(t).over(w).alias("_next")
    )
    held = holdings.join(per, ["strategy", t]).withColumn("_w", 1.0 / F.col("n_holdings"))
    old = F.col("_w") * (1 + F.coalesce(F.col(ret), F.lit(0.0))) / (1 + F.col("gross_return")) if drift else F.col("_w")
    alive = F.col("_next").isNotNull() & ((F.col("gross_return") > -1) if drift else F.lit(True))
    both = held.withColumn("_cells", F.array(
        F.struct(F.col(t).alias("t"), F.col("_w").alias("x")),
        F.when(alive, F.struct(F.col("_next").alias("t"), (-old).alias("x"))),
    )).select("strategy", key, F.explode("_cells").alias("_c")).where(F.col("_c").isNotNull())
    move = both.groupBy("strategy", F.col("_c.t").alias(t), key).agg(F.sum("_c.x").alias("_d"))
    to = move.groupBy("strategy", t).agg((F.sum(F.abs("_d")) / 2).alias("turnover"))
    return series.join(to, ["strategy", t], "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))


def average_turnover(series: DataFrame, t: str) -> DataFrame:
    """Mean turnover per strategy over periods with holdings, the first one left out."""
    w = Window.partitionBy("strategy").orderBy(t)
    s = series.withColumn("_i", F.row_number().over(w)).where((F.col("_i") > 1) & (F.col("n_holdings") > 0))
    return s.groupBy("strategy").agg(F.avg("turnover").alias("avg_turnover"))


def value_series(series: DataFrame, t: str, cost: float, rf: str = "monthly_rf") -> DataFrame:
    """Net and excess returns, compounded value and drawdown, gross and net."""
    s = series.withColumn("net_return", F.col("gross_return") - cost * F.col("turnover"))
    s = s.withColumn("excess_gross", F.col("gross_return") - F.col(rf)).withColumn("excess_net", F.col("net_return") - F.col(rf))
    s = nav_and_drawdown(s, ["strategy"], t, "gross_return", "nav_gross", "drawdown_gross")
    return nav_and_drawdown(s, ["strategy"], t, "net_return", "nav_net", "drawdown_net")


def rebase(series: DataFrame, t: str, start, end, cost: float) -> DataFrame:
    """Value series of a sub-period, starting again at 1."""
    s = series.where(F.col(t).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return value_series(s, t, cost)


def performance(values: DataFrame) -> DataFrame:
    """One row per strategy. Ratios are NULL where volatility is 0."""
    n = F.col("n_periods")
    g = values.groupBy("strategy").agg(
        F.count("*").alias("n_periods"), F.product(1 + F.col("gross_return")).alias("final_nav_gross"),
        F.product(1 + F.col("net_return")).alias("final_nav_net"),
        (F.avg("excess_gross") * 12).alias("ann_excess_gross"), (F.avg("excess_net") * 12).alias("ann_excess_net"),
        (F.stddev_samp("gross_return") * F.sqrt(F.lit(12.0))).alias("ann_vol_gross"),
        (F.stddev_samp("net_return") * F.sqrt(F.lit(12.0))).alias("ann_vol_net"),
        F.min("drawdown_gross").alias("max_drawdown_gross"), F.min("drawdown_net").alias("max_drawdown_net"),
        F.avg("n_holdings").alias("avg_holdings"), F.avg("turnover").alias("avg_turnover"),
    )
    return g.withColumns({
        "ann_return_gross": F.pow("final_nav_gross", 12.0 / n) - 1, "ann_return_net": F.pow("final_nav_net", 12.0 / n) - 1,
        "sharpe_gross": F.when(F.col("ann_vol_gross") > 0, F.col("ann_excess_gross") / F.col("ann_vol_gross")),
        "sharpe_net": F.when(F.col("ann_vol_net") > 0, F.col("ann_excess_net") / F.col("ann_vol_net")),
    })


def buy_and_hold(monthly: DataFrame, key: str, t: str, price: str) -> DataFrame:
    """Next-period return of holding one entity, months without a price left out."""
    w = Window.partitionBy(key).orderBy(t)
    m = monthly.where(F.col(price).isNotNull()).withColumn("gross_return", F.lead(price).over(w) / F.col(price) - 1)
    return m.where(F.col("gross_return").isNotNull()).select(
        F.concat(F.lit("hold "), F.col(key).cast("string")).alias("strategy"), t, "gross_return",
        F.lit(1).cast("bigint").alias("n_holdings"), F.lit(0.0).alias("turnover"),
    )


def oracle_summary(values: DataFrame) -> DataFrame:
    """Return range, negative and zero periods, worst drawdown and mean size of a value series."""
    r = F.col("gross_return")
    return values.groupBy("strategy").agg(
        F.count("*").alias("n_periods"), F.min(r).alias("min_return"), F.avg(r).alias("mean_return"), F.max(r).alias("max_return"),
        F.count_if(r < 0).alias("n_negative"), F.count_if(F.abs(r) <= 1e-8).alias("n_zero"),
        F.min("drawdown_gross").alias("max_drawdown"), F.avg("n_holdings").alias("avg_holdings"),
    )


def sector_weights(holdings: DataFrame, series: DataFrame, spine: DataFrame, t: str, sector: str) -> DataFrame:
    """Mean, largest and smallest weight of each sector over all periods, absent sectors at 0."""
    cells = holdings.groupBy("strategy", t, sector).agg(F.count("*").alias("_n"))
    cells = cells.join(series.select("strategy", t, "n_holdings"), ["strategy", t]).withColumn("_w", F.col("_n") / F.col("n_holdings"))
    full = spine.join(cells, ["strategy", t, sector], "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    return full.groupBy("strategy", sector).agg(
        F.avg("_w").alias("avg_weight"), F.max("_w").alias("max_weight"), F.min("_w").alias("min_weight")
    )


def screen_value(series: DataFrame, avg_to: DataFrame, cost_bps: float, aversion: float) -> DataFrame:
    """Economics of a screened portfolio from its (strategy, period) returns and risk-free rates.

    Sharpe ratio with its iid standard error, cost-adjusted Sharpe (round trip every period) and
    mean-variance certainty equivalent. Needs nav/drawdown columns of `value_series`.
    """
    g = series.groupBy("strategy").agg(
        F.count("*").alias("n_periods"), (F.avg("gross_return") * 12).alias("ann_return"),
        (F.avg("excess_gross") * 12).alias("ann_excess"), (F.stddev_samp("excess_gross") * F.sqrt(F.lit(12.0))).alias("ann_vol"),
        F.min("drawdown_gross").alias("max_drawdown"),
    ).join(avg_to, "strategy", "left").withColumn("avg_turnover", F.coalesce("avg_turnover", F.lit(0.0)))
    vol = F.when(F.col("ann_vol") > 0, F.col("ann_vol"))
    drag = 2 * F.col("avg_turnover") * (cost_bps / 1e4) * 12
    g = g.withColumn("sharpe", F.col("ann_excess") / vol)
    return g.withColumns({
        "sharpe_se": F.sqrt((1 + F.col("sharpe") * F.col("sharpe") / 2) / F.col("n_periods")),
        "sharpe_net": (F.col("ann_excess") - drag) / vol,
        "cer": F.col("ann_excess") - aversion / 2 * F.col("ann_vol") * F.col("ann_vol"),
    })


def hurdles(perf: DataFrame, metric: str, benchmarks: Sequence[str], must_beat: Sequence[str]) -> DataFrame:
    """Compare each strategy's metric with that of named benchmark rows (a bounded list)."""
    bars = perf.agg(*[F.max(F.when(F.col("strategy") == b, F.col(metric))).alias(f"b{i}") for i, b in enumerate(benchmarks)])
    out = perf.withColumn("_b", bars.select(F.struct("*")).scalar())
    beats = {b: F.coalesce(F.col(metric) > F.col(f"_b.b{i}"), F.lit(False)) for i, b in enumerate(benchmarks)}
    every = F.lit(True)
    for b in must_beat:
        every = every & beats[b]
    return out.select(
        "strategy", metric, *[F.col(f"_b.b{i}").alias(f"hurdle_{b}") for i, b in enumerate(benchmarks)],
        *[c.alias(f"beats_{b}") for b, c in beats.items()], every.alias("beats_all"),
    )


def liquidity(daily: DataFrame, key: str, ts: str, price: str, volume: str, threshold: float, months: int = 3) -> DataFrame:
    """Mean traded value per month, its trailing mean over `months` rows and whether that is liquid."""
    v = daily.where(F.col(price).isNotNull() & F.col(volume).isNotNull())
    m = v.groupBy(key, F.last_day(ts).alias("t")).agg(
        F.avg(F.col(price) * F.col(volume)).alias("avg_value"), F.count("*").alias("n_days")
    )
    w = Window.partitionBy(key).orderBy("t").rowsBetween(-(months - 1), 0)
    return m.withColumn("trailing_value", F.avg("avg_value").over(w)).withColumn("is_liquid", F.col("trailing_value") >= threshold)
