import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import ranking, stats

ROWS_IN_TEST = 100  # so that the range exchange is taken


def skewed(n=3000, seed=0):
    """Half of the rows in one group, a third of all values equal."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"g{rng.randrange(4)}", 0.25 if rng.random() < 0.34 else round(rng.random(), 3), i) for i in range(n)]


@pytest.mark.parametrize("desc", [True, False])
@pytest.mark.parametrize("grouped", [True, False])
def test_rank_in_group_is_exact(spark, desc, grouped):
    data = skewed()
    df = spark.createDataFrame(data, "g string, v double, id bigint")
    group = ["g"] if grouped else []
    got = {r.id: (r.rk, r.n) for r in ranking.rank_in_group(df, group, "v", "id", desc, totals={"n": F.lit(1)}, rows=ROWS_IN_TEST).collect()}
    assert len(got) == len(data)
    for g in {d[0] for d in data} if grouped else {None}:
        rows = sorted((d for d in data if g is None or d[0] == g), key=lambda d: (-d[1] if desc else d[1], d[2]))
        assert [got[d[2]] for d in rows] == [(i, len(rows)) for i in range(1, len(rows) + 1)]


def test_totals_of_any_name_over_many_partitions(spark):
    """top_share asks for a total `_n`, which was also the name of the count of a partition."""
    df = spark.createDataFrame(skewed(), "g string, v double, id bigint")
    totals = {"_n": F.lit(1).cast("bigint"), "_rows": F.lit(2).cast("bigint")}
    few = ranking.rank_in_group(df, ["g"], "v", "id", totals=totals).collect()
    many = ranking.rank_in_group(df, ["g"], "v", "id", totals=totals, rows=ROWS_IN_TEST).select("g", "v", "id", "rk", "_n", "_rows").collect()
    assert {(r.id, r.rk, r["_n"], r["_rows"]) for r in many} == {(r.id, r.rk, r["_n"], r["_rows"]) for r in few} and len(many) == 3000


def test_hot_value_is_spread_over_tie_buckets(spark):
    df = spark.range(2000).select(F.lit(1.0).alias("v"), "id")
    out = ranking.rank_in_group(df, [], "v", "id", rows=ROWS_IN_TEST)
    assert out.agg(F.max("rk"), F.countDistinct("rk")).first() == (2000, 2000)


def test_large_keys_are_ordered_exactly(spark):
    """2^53 and 2^53 + 1 are one number as doubles; a value just under a partition's share keeps its order."""
    big = 1 << 53
    data = [(big + i % 7, i) for i in range(700)]
    df = spark.createDataFrame(data, "v bigint, id bigint")
    for desc in (True, False):
        got = {r.id: r.rk for r in ranking.rank_in_group(df, [], "v", "id", desc, rows=ROWS_IN_TEST).collect()}
        want = sorted(data, key=lambda d: (-d[0] if desc else d[0], d[1]))
        assert [got[i] for _, i in want] == list(range(1, 701))


def test_ranked_totals_prefix_sums(spark):
    data = skewed(1500, 2)
    df = spark.createDataFrame(data, "g string, v double, id bigint")
    got = {(r.g, r.v): (r.n, r.cum_n) for r in ranking.ranked_totals(df, ["g"], "v", {"n": F.lit(1).cast("bigint")}, True, ROWS_IN_TEST).collect()}
    for (g, v), (n, cum) in got.items():
        assert n == sum(d[0] == g and d[1] == v for d in data)
        assert cum == sum(d[0] == g and d[1] >= v for d in data)


def test_exact_quantiles_interpolate(spark):
    data = skewed(1000, 5)
    df = spark.createDataFrame(data, "g string, v double, id bigint")
    got = {r.g: r for r in ranking.exact_quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.99}, ROWS_IN_TEST).collect()}
    for g in {d[0] for d in data}:
        v = np.array([d[1] for d in data if d[0] == g])
        assert np.allclose([got[g].a, got[g].m, got[g].z], np.quantile(v, [0.1, 0.5, 0.99]))


def test_budget_curve_half_even_and_ties(spark):
    data = skewed(1001, 7)
    df = spark.createDataFrame([(v, i, i % 3 == 0) for _, v, i in data], "v double, id bigint, y boolean")
    order = sorted(data, key=lambda d: (-d[1], d[2]))
    for r in ranking.budget_curve(df, "v", "id", F.col("y"), [0.1, 0.3, 0.5]).collect():
        k = round(r.budget * len(data))
        assert r.k == k and r.hits == sum(d[2] % 3 == 0 for d in order[:k])


def test_spearman_uses_average_ranks(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 6, 300), rng.integers(0, 4, 300)
    rank = lambda a: np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = stats.spearman(df, "x", "y").first()
    assert got.n == 300 and np.isclose(got.rho, np.corrcoef(rank(x), rank(y))[0, 1])


def test_top_share_bounds(spark):
    df = spark.createDataFrame([("a", float(i), i) for i in range(11)] + [("b", 1.0, 1)], "g string, v double, id bigint")
    n = {r.g: r["count"] for r in ranking.top_share(df, ["g"], "v", "id", 0.3, 2).groupBy("g").count().collect()}
    assert n == {"a": 4, "b": 1}
