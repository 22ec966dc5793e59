"""Views over the given tables: the same definitions exist as SQL in `plans.registry`.

Money is summed in whole cents, so that sums do not depend on the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import argmax_label, band_label
from ..operators import calendar as cal

# The five series, the four slices standing for separate raters, the no-information vector.
SERIES = {"s1": "1-URGENT", "s2": "2-HIGH", "s3": "3-MEDIUM", "s4": "4-NOT SPECIFIED", "s5": "5-LOW"}
AGENTS = ("disclosure", "fundamentals", "macro", "price")
AGENT_SLICE = {"disclosure": 0, "macro": 1, "price": 2, "fundamentals": 3}
UNIFORM = (0.34, 0.33, 0.33)
EVAL_BAND = 0.10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def px_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily observations: k, d, close, adj_close, volume, day_value."""
    g = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d"))
        .agg(
            F.sum(_cents("l_extendedprice")).alias("_c"),
            F.sum(_cents("l_extendedprice") * (100 - _cents("l_discount"))).alias("_a"),
            F.sum("l_quantity").alias("volume"),
        )
    )
    return g.select(
        "k", "d",
        (F.col("_c").cast("double") / (F.lit(100.0) * F.col("volume"))).alias("close"),
        (F.col("_a").cast("double") / (F.lit(10000.0) * F.col("volume"))).alias("adj_close"),
        "volume",
        (F.col("_c").cast("double") / F.lit(100.0)).alias("day_value"),
    )


def dim(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        table(spark, sf, "supplier")
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("company"), F.col("r_name").alias("sector"))
    )


def macro_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse daily series s1..s5 (wide)."""
    o = table(spark, sf, "orders")
    cols = []
    for s, p in SERIES.items():
        hit = F.col("o_orderpriority") == p
        n = F.count(F.when(hit, 1))
        total = F.sum(F.when(hit, _cents("o_totalprice"))).cast("double")
        cols.append((total / F.nullif(n.cast("double"), F.lit(0.0)) / F.lit(1e7)).alias(s))
    return o.groupBy(F.to_date("o_orderdate").alias("d")).agg(*cols)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Bitemporal facts: k, concept, end, filed, val, pos."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    end = F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31))
    return (
        table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_nationkey").alias("k"), F.col("o_orderpriority").alias("concept"), end.alias("end_d"),
            F.date_add(end, (F.col("o_orderkey") % 400).cast("int")).alias("filed"),
            F.col("o_totalprice").alias("val"), F.col("o_orderkey").alias("pos"),
        )
    )


def docs(spark: SparkSession, sf: str, text: bool = True) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.col("source").alias("k"), F.col("lang").alias("form"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 720).cast("int")).alias("filed"),
        "doc_id", *(["text"] if text else []),
    )


def price_month(spark: SparkSession, sf: str, px: DataFrame | None = None) -> DataFrame:
    """Month-end prices with the empty months kept; `px` reuses daily rows already at hand."""
    px = px_daily(spark, sf) if px is None else px
    # daily rows of one entity are few and bounded: moving them by entity once serves the monthly
    # aggregate and every later window on the entity
    return cal.month_end_last(px.repartition("k"), ["k"], "d", ["close", "adj_close", "volume"])


def price_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals per entity-month from one pass over the daily rows.

    The daily window already sits on the entity, so the monthly aggregate and all later windows need no
    further shuffle.
    """
    daily = cal.pct_change(px_daily(spark, sf), ["k"], "d", "adj_close", {"ret_d": 1})
    m = cal.month_end_last(daily, ["k"], "d", ["adj_close"], also={"vol_annualized": cal.annualised_sd("ret_d")})
    m = cal.pct_change(m, ["k"], "t", "adj_close", {"ret_1m": 1, "ret_3m": 3, "ret_6m": 6, "ret_12m": 12})
    return cal.running_drawdown(m, ["k"], "t", "adj_close")


def returns(spark: SparkSession, sf: str, px: DataFrame | None = None) -> DataFrame:
    """k, t, adj_close, ret_1m, fwd_ret (last row of each entity dropped)."""
    m = cal.pct_change(price_month(spark, sf, px), ["k"], "t", "adj_close", {"ret_1m": 1, "ret_3m": 3, "ret_12m": 12})
    return cal.forward_return(m, ["k"], "t", "ret_1m")


def truth(spark: SparkSession, sf: str, band: float = EVAL_BAND) -> DataFrame:
    return returns(spark, sf).select("k", "t", "fwd_ret", band_label("fwd_ret", band).alias("label"))


def macro_month(spark: SparkSession, sf: str) -> DataFrame:
    m = cal.resample_ffill(macro_daily(spark, sf), "d", list(SERIES))
    return cal.risk_free(m, "t", "s1")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """One probability triple per (k, t), with one triple per slice of the rows."""
    li = table(spark, sf, "lineitem")
    q, f = F.col("l_quantity"), F.col("l_returnflag")
    total = F.sum("l_quantity")

    def share(flag, part=None):
        cond = f == flag if part is None else (f == flag) & part
        return F.coalesce(F.sum(F.when(cond, q)), F.lit(0.0))

    cols = [(share(x) / total).alias(n) for x, n in (("A", "p_i"), ("N", "p_h"), ("R", "p_r"))]
    for a, i in AGENT_SLICE.items():
        part = F.col("l_linenumber") % 4 == i
        tot = F.sum(F.when(part, q))
        for x, n, u in zip("ANR", "ihr", UNIFORM):
            cols.append(F.coalesce(share(x, part) / tot, F.lit(u)).alias(f"{a}_{n}"))
    return li.groupBy(F.col("l_suppkey").alias("k"), F.last_day(F.to_date("l_shipdate")).alias("t")).agg(*cols)


def log_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Append-only log: several versions of a (k, t) record, numbered by seq."""
    li = table(spark, sf, "lineitem")
    q, f = F.col("l_quantity"), F.col("l_returnflag")
    total = F.sum("l_quantity")
    return li.groupBy(
        F.col("l_suppkey").alias("k"), F.last_day(F.to_date("l_shipdate")).alias("t"),
        F.col("l_linenumber").alias("seq"),
    ).agg(
        *[
            (F.coalesce(F.sum(F.when(f == x, q)), F.lit(0.0)) / total).alias(n)
            for x, n in (("A", "p_i"), ("N", "p_h"), ("R", "p_r"))
        ]
    )


def evaluated(spark: SparkSession, sf: str, agents: bool = False, sector: bool = False) -> DataFrame:
    """Decisions with realised labels: k, t, p_i, p_h, p_r, q_r, pred, base_pred, label, fwd_ret (, sector)."""
    d = decisions(spark, sf)
    extra = [f"{a}_{n}" for a in AGENTS for n in "ihr"] if agents else []
    d = d.select(
        "k", "t", "p_i", "p_h", "p_r", F.col("price_r").alias("q_r"),
        argmax_label("p_i", "p_h", "p_r").alias("pred"),
        argmax_label("price_i", "price_h", "price_r").alias("base_pred"), *extra,
    )
    d = d.join(truth(spark, sf), ["k", "t"])
    return d.join(dim(spark, sf).select("k", "sector"), "k", "left") if sector else d
