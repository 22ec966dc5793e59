"""Aggregate statistics: distributions, correlation, regression sums, dispersion, Newey-West."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import CLASSES
from .prep import long_form
from .ranking import exact_quantiles, ranked_totals




def conditional_rates(df: DataFrame, group: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Count and rate of each condition per group."""
    aggs = [F.count("*").alias("n_obs")]
    for n, c in flags.items():
        aggs += [F.count_if(c).alias(f"n_{n}"), F.avg(c.cast("double")).alias(f"rate_{n}")]
    return df.groupBy(*group).agg(*aggs)


def class_distribution(df: DataFrame, group: Sequence[str], label: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Count and share of every class per group, zeros included."""
    g = df.groupBy(*group).agg(F.count(label).alias("_n"), *[F.count_if(F.col(label) == c).alias(f"_{c}") for c in classes])
    cells = F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(f"_{c}").alias("n"), (F.col(f"_{c}") / F.nullif(F.col("_n"), F.lit(0))).alias("share"))
        for c in classes
    ])
    return g.select(*group, F.inline(cells))


def describe(df: DataFrame, cols: Sequence[str], t: str) -> DataFrame:
    """n, mean, sd, min, median, max per column and the mean within-period cross-sectional sd."""
    long = long_form(df, [t], cols)
    by_t = long.groupBy("feature", t).agg(
        F.count("value").alias("_n"), F.sum("value").alias("_s"), F.min("value").alias("_mn"), F.max("value").alias("_mx"),
        F.stddev_pop("value").alias("_xs"),
    )
    basic = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    top = by_t.groupBy("feature").agg(
        F.sum("_n").alias("n"), F.min("_mn").alias("min"), F.max("_mx").alias("max"), F.avg("_xs").alias("xs_sd")
    )
    med = exact_quantiles(long, ["feature"], "value", {"median": 0.5})
    return top.join(basic, "feature").join(med, "feature", "left")


def quantile_summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """count, mean, min, max and exact quartiles per group, with a row `all` over everything."""
    if group:
        g = group[0]
        both = df.select(F.explode(F.array(F.col(g), F.lit("all"))).alias("group"), F.col(value))
    else:
        both = df.select(F.lit("all").alias("group"), F.col(value))
    basic = both.groupBy("group").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return basic.join(exact_quantiles(both, ["group"], value, {"q25": 0.25, "median": 0.5, "q75": 0.75}), "group")


def _weighted_corr(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    n, sx, sy = F.sum(w), F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(y))
    sxx, syy, sxy = (F.sum(F.col(w) * F.col(a) * F.col(b)) for a, b in ((x, x), (y, y), (x, y)))
    cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
    return df.agg(n.alias("n"), (cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0))).alias("rho"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties: n, rho.

    Works on distinct (x, y) cells with counts, so a value shared by many rows is one row in the joins.
    """
    one = {"_n": F.lit(1).cast("bigint")}
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    avg_rank = F.col("cum__n") - (F.col("_n") - 1) / 2
    rx = ranked_totals(both, [], "_x", one).select("_x", avg_rank.alias("_rx"))
    ry = ranked_totals(both, [], "_y", one).select("_y", avg_rank.alias("_ry"))
    cells = both.groupBy("_x", "_y").agg(F.count("*").cast("double").alias("_w")).join(rx, "_x").join(ry, "_y")
    return _weighted_corr(cells, "_rx", "_ry", "_w").withColumn("n", F.col("n").cast("bigint"))


def simple_regression(df: DataFrame, group: Sequence[str], y: str, x: str, min_n: int = 3) -> DataFrame:
    """Slope, intercept, R2 and residual sample sd per group from one pass of sums."""
    g = df.groupBy(*group).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"), F.regr_sxx(y, x).alias("_sxx"),
    )
    sse = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.nullif(F.col("_sxx"), F.lit(0.0)), F.lit(0.0))
    return g.where(F.col("n") >= min_n).withColumn("resid_sd", F.sqrt(sse / (F.col("n") - 1))).drop("_syy", "_sxy", "_sxx")


def leave_one_out(df: DataFrame, t: str, value: str, min_names: int = 2) -> DataFrame:
    """Mean of the other rows of the period and the excess over it; thin periods are dropped.

    Period totals are joined back (a partial aggregate) instead of a window over whole periods.
    """
    tot = df.groupBy(t).agg(F.sum(value).alias("_s"), F.count(value).alias("_n")).where(F.col("_n") >= min_names)
    out = df.join(tot, t)
    return out.withColumn("loo_mean", (F.col("_s") - F.col(value)) / (F.col("_n") - 1)).withColumn(
        "excess", F.col(value) - F.col("loo_mean")
    ).drop("_s", "_n")


def welch_t(df: DataFrame, cols: Sequence[str], event: Column) -> DataFrame:
    """Two-sample t (unequal variances) of event against other rows, per column."""
    long = long_form(df.withColumn("_e", event), ["_e"], cols)
    a, z = F.when(F.col("_e"), F.col("value")), F.when(~F.col("_e"), F.col("value"))
    g = long.groupBy("feature").agg(
        *[f(x).alias(n) for f, k in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var")) for x, n in ((a, f"{k}_event"), (z, f"{k}_other"))]
    )
    se = F.sqrt(F.col("var_event") / F.col("n_event") + F.col("var_other") / F.col("n_other"))
    return g.withColumn("t", (F.col("mean_event") - F.col("mean_other")) / F.nullif(se, F.lit(0.0)))


def compound(df: DataFrame, group: Sequence[str], ret: str, out: str = "compound") -> DataFrame:
    return df.groupBy(*group).agg(F.count(ret).alias("n"), (F.product(1 + F.col(ret)) - 1).alias(out))


def feature_variation(df: DataFrame, t: str, cols: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """Coverage and mean within-period population sd per column, with a has_signal flag."""
    per = long_form(df, [t], cols).groupBy("feature", t).agg(
        F.count("*").alias("_n"), F.count("value").alias("_c"), F.stddev_pop("value").alias("_s")
    )
    return per.groupBy("feature").agg(
        (F.sum("_c") / F.sum("_n")).alias("coverage"), F.avg("_s").alias("xs_sd")
    ).withColumn("has_signal", F.coalesce(F.col("xs_sd") > eps, F.lit(False)))


def missing_rates(df: DataFrame) -> DataFrame:
    """Share of NULLs in every column, in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return one.unpivot([], list(df.columns), "column", "missing_rate")


def variance_split(df: DataFrame, t: str, value: str) -> DataFrame:
    """Between- and within-period population variance and the shares."""
    per = df.groupBy(t).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    g = per.agg(F.var_pop("_m").alias("between"), F.avg("_v").alias("within"))
    return g.withColumn("systematic_share", F.col("between") / (F.col("between") + F.col("within")))


def event_dispersion(df: DataFrame, t: str, event: Column, factor: float = 2.0) -> DataFrame:
    """Spread of period event rates against the binomial null, and the events in high-rate periods."""
    per = df.groupBy(t).agg(F.count("*").alias("_n"), F.count_if(event).alias("_e"))
    p = per.agg((F.sum("_e") / F.sum("_n")).alias("p")).scalar()
    per = per.withColumn("_p", p).withColumn("_r", F.col("_e") / F.col("_n")).withColumn("_hi", F.col("_r") > factor * F.col("_p"))
    g = per.agg(
        F.max("_p").alias("base_rate"), F.stddev_pop("_r").alias("obs_sd"), F.avg("_n").alias("_avg_n"),
        (F.sum(F.when(F.col("_hi"), F.col("_e")).otherwise(0)) / F.greatest(F.sum("_e"), F.lit(1))).alias("share_in_high"),
        F.count_if(F.col("_hi")).alias("n_high"), F.count("*").alias("n_periods"),
    )
    null = F.sqrt(F.col("base_rate") * (1 - F.col("base_rate")) / F.col("_avg_n"))
    return g.withColumn("null_sd", null).withColumn("dispersion_ratio", F.col("obs_sd") / F.nullif(F.col("null_sd"), F.lit(0.0))).drop("_avg_n")


def period_effect_r2(df: DataFrame, t: str, event: Column) -> DataFrame:
    """R2 of the regression on period dummies: between over total sum of squares, no dummies built."""
    per = df.groupBy(t).agg(F.count("*").alias("_n"), F.sum(event.cast("double")).alias("_e"))
    g = per.agg(F.sum("_n").alias("n"), F.sum("_e").alias("_s"), F.sum(F.col("_e") * F.col("_e") / F.col("_n")).alias("_b"))
    m = F.col("_s") * F.col("_s") / F.col("n")
    return g.select("n", ((F.col("_b") - m) / F.nullif(F.col("_s") - m, F.lit(0.0))).alias("r2"))


def ledger_rollup(
    ledger: DataFrame, decisions: DataFrame, keys: Sequence[str], seq: str, prices: dict[str, tuple[float, float]]
) -> DataFrame:
    """Last entry per key for the decided keys: token totals, cost under each price scenario (per million
    tokens), and how many decided keys have no entry or other token counts."""
    last = ledger.groupBy(*keys).agg(F.max_by(F.struct("prompt_tokens", "completion_tokens"), F.col(seq)).alias("_l"))
    d = decisions.select(*keys, F.col("prompt_tokens").alias("_p"), F.col("completion_tokens").alias("_c"))
    j = d.join(last, list(keys), "left")
    one = j.agg(
        F.count("*").alias("n_decisions"), F.count("_l").alias("n_entries"), F.count_if(F.col("_l").isNull()).alias("n_missing"),
        F.count_if((F.col("_l.prompt_tokens") != F.col("_p")) | (F.col("_l.completion_tokens") != F.col("_c"))).alias("n_mismatch"),
        F.sum("_l.prompt_tokens").alias("prompt_tokens"), F.sum("_l.completion_tokens").alias("completion_tokens"),
    )
    rows = F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(float(p)).alias("_pp"), F.lit(float(q)).alias("_cp")) for n, (p, q) in prices.items()
    ])
    out = one.select("*", F.inline(rows))
    cost = (F.col("prompt_tokens") * F.col("_pp") + F.col("completion_tokens") * F.col("_cp")) / 1e6
    return out.withColumn("cost_usd", cost).drop("_pp", "_cp")


def safe_ratios(df: DataFrame, *, assets, debt, liabilities, equity, interest, income_cover, income, depreciation, shares, price) -> DataFrame:
    """Leverage, debt to equity, interest cover, book to market, size and cash yield.

    Zero debt, assets, liabilities, equity, interest or market value counts as missing; zero income does
    not; missing depreciation counts as zero.
    """
    nz = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    cap = nz(shares) * nz(price)
    dep = F.coalesce(F.col(depreciation), F.lit(0.0))
    return df.withColumns({
        "leverage": nz(debt) / nz(assets),
        "debt_to_equity": nz(liabilities) / nz(equity),
        "interest_cover": (F.col(income_cover) + F.col(interest) + dep) / nz(interest),
        "book_to_market": nz(equity) / cap,
        "ln_mktcap": F.when(cap > 0, F.log(cap)),
        "ffo_yield": (F.col(income) + dep) / cap,
    })


def nav_premium(df: DataFrame, mcap: str, equity: str, acc_dep: str, noi: str, debt: str, caps: Sequence[float]) -> DataFrame:
    """Market value over depreciation-adjusted book, and over capitalised income for each cap rate."""
    book = F.col(equity) + F.col(acc_dep)
    out = df.withColumn("book_premium", F.when(book > 0, F.col(mcap) / book))
    out = out.withColumn("cap", F.explode(F.array(*[F.lit(float(x)) for x in caps])))
    nav = F.col(noi) / F.col("cap") - F.coalesce(F.col(debt), F.lit(0.0))
    return out.withColumn("cap_premium", F.when(nav > 0, F.col(mcap) / nav))


def newey_west(df: DataFrame, group: Sequence[str], t: str, value: str, lags: int | None = None) -> DataFrame:
    """Mean, Newey-West standard error and t of a period series per group.

    Bartlett weights, floor(4 (T/100)^(2/9)) lags unless given, small-sample factor T/(T-1). The series
    has one row per period.
    """
    s = df.where(F.col(value).isNotNull())
    m = s.groupBy(*group).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.stddev_samp(value).alias("_sd"))
    L = F.lit(lags) if lags is not None else F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9.0)))
    d = s.join(m, list(group)).withColumn("_u", F.col(value) - F.col("mean")).withColumn("_L", L.cast("int"))
    w = Window.partitionBy(*group).orderBy(t)
    d = d.withColumn("_i", F.row_number().over(w)).select(*group, "_i", "_u", "_L", "n", "mean", "_sd")
    # each row meets its L successors: an equality join on (group, index)
    lead = d.select(*group, F.col("_i").alias("_j"), F.col("_u").alias("_v"))
    left = d.select(*group, "_i", "_u", "_L", F.explode(F.sequence(F.lit(0), F.col("_L"))).alias("_lag")).withColumn("_j", F.col("_i") + F.col("_lag"))
    prod = left.join(lead, [*group, "_j"])
    wt = F.when(F.col("_lag") == 0, 1.0).otherwise(2.0 * (1 - F.col("_lag") / (F.col("_L") + 1.0)))
    lr = prod.groupBy(*group).agg(F.sum(wt * F.col("_u") * F.col("_v")).alias("_s"), F.max("_L").alias("lags"))
    out = m.join(lr, list(group))
    var = F.greatest(F.col("_s"), F.lit(0.0)) / F.col("n") / F.col("n") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0))
    return out.withColumn("nw_se", F.sqrt(var)).select(
        *group, "n", "lags", "mean", "nw_se",
        (F.col("mean") / F.nullif(F.col("nw_se"), F.lit(0.0))).alias("nw_t"),
        (F.col("mean") / F.nullif(F.col("_sd") / F.sqrt("n"), F.lit(0.0))).alias("plain_t"),
    )
