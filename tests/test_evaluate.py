import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import columns as c
from panelspark.operators import declog as dl, evaluate as ev, resample as rs


def scored(n=500, seed=1):
    rng = random.Random(seed)
    return [(i, round(rng.random(), 1) if rng.random() < 0.7 else rng.random(), rng.random() < 0.3) for i in range(n)]


def test_auc_and_average_precision_by_brute_force(spark):
    data = scored()
    df = spark.createDataFrame(data, "id bigint, s double, y boolean")
    r = ev.ranking_metrics(df, "s", F.col("y")).first()
    pos, neg = [s for _, s, y in data if y], [s for _, s, y in data if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, hit = 0.0, 0
    for v in sorted({s for _, s, _ in data}, reverse=True):
        tp = sum(y for _, s, y in data if s >= v)
        ap += (tp - hit) / len(pos) * tp / sum(s >= v for _, s, _ in data)
        hit = tp
    assert math.isclose(r.roc_auc, auc) and math.isclose(r.avg_precision, ap)


def test_calibration_edges_are_double_multiples(spark):
    df = spark.createDataFrame([(0.3,), (0.30000000000000004,), (0.1,), (1.0,), (0.0,)], "p double")
    assert [r.b for r in df.select(ev.probability_bin("p").alias("b")).collect()] == [2, 3, 1, 9, 0]


def test_murphy_parts_add_up(spark):
    df = spark.createDataFrame(scored(300, 2), "id bigint, p double, y boolean")
    r = ev.murphy(df, "p", F.col("y")).first()
    assert math.isclose(r.brier, r.reliability - r.resolution + r.uncertainty + r.residual)
    curve = ev.reliability_curve(df.where("p < 0.5"), "p", F.col("y")).collect()
    assert len(curve) == 10 and sum(x.n for x in curve) == df.where("p < 0.5").count() and curve[9].mean_forecast is None


def test_undefined_ratios_are_zero(spark):
    df = spark.createDataFrame([("hold", "hold"), ("hold", "increase")], "label string, pred string")
    r = {x["class"]: x for x in ev.per_class(df, "label", "pred").collect()}
    assert (r["reduce"].recall, r["reduce"].precision, r["reduce"].f1) == (0.0, 0.0, 0.0) and r["hold"].recall == 0.5


def test_argmax_ties_and_band_are_strict(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.3, 0.3, 0.4)], "i double, h double, r double")
    assert [x.y for x in df.select(c.argmax_label("i", "h", "r").alias("y")).collect()] == ["increase", "hold", "reduce"]
    b = spark.createDataFrame([(0.02,), (-0.02,), (0.0200001,), (None,)], "r double")
    assert [x.y for x in b.select(c.band_label("r", 0.02).alias("y")).collect()] == ["hold", "hold", "increase", None]


def test_ties_to_the_event_class(spark):
    df = spark.createDataFrame([(0.4, 0.2, 0.4, True), (0.1, 0.1, 0.8, True), (0.5, 0.5, 0.0, False)], "i double, h double, r double, y boolean")
    t = ev.tie_census(df, "i", "h", "r", F.col("y")).first()
    assert (t.n_tied, t.n_tied_event, t.fired, t.fired_upper, t.recall, t.recall_upper) == (2, 1, 1, 2, 0.5, 1.0)


def test_kappa_and_alpha_by_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (3, 40))
    long = [(i, "d", f"r{j}", int(x[j, i])) for j in range(3) for i in range(40)]
    df = spark.createDataFrame(long, "item int, dim string, rater string, score bigint")
    pairs = dl.rater_pairs(dl.wide_ratings(df, ["r0", "r1", "r2"]), [("r0", "r1")])
    obs = np.zeros((3, 3))
    for a, b in zip(x[0], x[1]):
        obs[a, b] += 1 / 40
    w = np.array([[(i - j) ** 2 / 4 for j in range(3)] for i in range(3)])
    kappa = 1 - (w * obs).sum() / (w * np.outer(obs.sum(1), obs.sum(0))).sum()
    assert math.isclose(dl.quadratic_kappa(pairs).first().kappa, kappa)
    flat = x.flatten().astype(float)
    de = np.mean([(a - b) ** 2 for i, a in enumerate(flat) for b in flat[i + 1:]])
    do = np.mean([(x[i, u] - x[j, u]) ** 2 for u in range(40) for i in range(3) for j in range(i + 1, 3)])
    assert math.isclose(dl.krippendorff_alpha(df, 3).first().alpha, 1 - do / de)
    same = spark.createDataFrame([(i, "d", r, i % 3) for i in range(9) for r in ("r0", "r1")], "item int, dim string, rater string, score bigint")
    assert dl.quadratic_kappa(dl.rater_pairs(dl.wide_ratings(same, ["r0", "r1"]), [("r0", "r1")])).first().kappa == 1.0


def test_replicates_equal_row_resampling(spark):
    def mix(x):
        for _ in range(2):
            x = (x ^ x >> 16) * 0x45d9f3b % 2 ** 32
        return x ^ x >> 16

    rows = [(k, i % 3 == 0) for k in range(7) for i in range(k + 2)]
    df = spark.createDataFrame(rows, "k bigint, y boolean")
    blocks = rs.recall_sums(df, F.col("k"), F.col("y"), {"a": F.lit(True)})
    got = {r.rep: (r.n, r.m) for r in rs.replicate_sums(blocks, "block", ["n", "m"], 5, 3).collect()}
    for rep in range(5):
        draw = [mix(mix(s) ^ mix(3 * 1000003 + rep)) % 7 for s in range(7)]
        sample = [r for k in draw for r in rows if r[0] == k]
        assert got[rep] == (len(sample), sum(y for _, y in sample))


def test_restatement_compares_with_first_filed(spark):
    import datetime as dt

    d = dt.date
    facts = spark.createDataFrame([("a", "c", d(2019, 12, 31), d(2020, 2, 1), 10.0, 1), ("a", "c", d(2019, 12, 31), d(2020, 5, 1), 12.0, 2)],
                                  "k string, concept string, end_d date, filed date, val double, pos bigint")
    pts = spark.createDataFrame([("a", d(2020, 1, 31)), ("a", d(2020, 2, 29)), ("a", d(2020, 5, 31))], "k string, t date")
    got = {r.t: (r.val, r.restated, r.rel_diff) for r in dl.restatements(pts, facts, ["k"], "t").collect()}
    assert got == {d(2020, 2, 29): (10.0, False, None), d(2020, 5, 31): (12.0, True, 0.2)}


@pytest.mark.parametrize("wide", [False, True])
def test_grounding_definitions(spark, wide):
    df = spark.createDataFrame([(["5% up"], None), (["paid $ 3"], None), ([], "covenant"), (["x"], "Tenant left")], "f array<string>, r string")
    g = dl.grounding(F.col("f"), F.col("r"), percent_counts=wide)["grounded"]
    assert [x.g for x in df.select(g.alias("g")).collect()] == [wide, True, False, True]


def test_draws_of_ranges_add_up_and_follow_the_multinomial_law(monkeypatch):
    monkeypatch.setattr(rs, "RANGE", 8)
    n, reps = 29, 4000
    w = np.concatenate([np.stack(list(rs.range_weights(3, reps, n, at))) for at in range(4)], axis=1)
    assert w.shape == (reps, n) and (w.sum(axis=1) == n).all()
    assert np.allclose(w.mean(axis=0), 1, atol=0.08) and np.allclose(w.var(axis=0), 1 - 1 / n, atol=0.12)
    monkeypatch.setattr(rs, "RANGE", 64)
    direct = rs.weights(3, reps, n)
    for own in (w, direct):  # how many blocks are never drawn, and how two blocks vary together
        assert abs((own == 0).mean() - (1 - 1 / n) ** n) < 0.01
        assert abs(np.cov(own[:, 2], own[:, 20])[0, 1] + 1 / n) < 0.06


def test_replicate_sums_over_many_ranges(spark):
    """Every range of blocks finds its own draws; each replicate draws as many blocks as there are."""
    blocks = spark.range(40_000).select((F.col("id") * 3).alias("block"), F.lit(1).alias("n"), F.col("id").alias("x"))
    got = {r.rep: (r.n, r.x) for r in rs.replicate_sums(blocks, "block", ["n", "x"], 6, 5).collect()}
    assert {n for n, _ in got.values()} == {40_000} and len({x for _, x in got.values()}) == 6
    assert all(abs(x / 40_000 - 20_000) < 400 for _, x in got.values())
    want = sum(w @ np.stack([np.ones(w.size), at * rs.RANGE + np.arange(w.size)], axis=1)
               for at in range(3) for w in list(rs.range_weights(5, 6, 40_000, at))[4:5])
    assert got[4] == tuple(want)


def _scored(seed, n=400, blocks=7):
    rnd = random.Random(seed)
    return [(100 + rnd.randrange(blocks), rnd.choice([None, rnd.randrange(12) / 7, rnd.random()]), rnd.random() < 0.3) for _ in range(n)]


@pytest.mark.parametrize("rows", [60, 10 ** 6])
def test_auc_and_budget_replicates_against_rows(spark, rows):
    data, reps = _scored(4), 9
    df = spark.createDataFrame(data, "block long, s double, e boolean").repartition(3)
    data = [r for r in data if r[1] is not None]
    w = rs.weights(11, reps, 7)
    aucs = {r.rep: (r.roc_auc, r.avg_precision) for r in rs.auc_replicates(df, "block", "s", F.col("e"), reps, 11, rows).collect()}
    cuts = {(r.rep, r.budget): r.recall for r in rs.budget_replicates(df, "block", "s", F.col("e"), [0.0, 0.1, 0.35, 1.0], reps, 11, rows).collect()}
    assert len(aucs) == reps and len(cuts) == 4 * reps
    for rep in range(reps):
        own = [(s, e) for b, s, e in data for _ in range(w[rep, b - 100])]
        up, down = [s for s, e in own if e], [s for s, e in own if not e]
        assert math.isclose(aucs[rep][0], sum((x > y) + (x == y) / 2 for x in up for y in down) / len(up) / len(down))
        steps = {s: (sum(x >= s for x in up), sum(x >= s for x, _ in own)) for s in set(up)}
        assert math.isclose(aucs[rep][1], sum(steps[s][0] / steps[s][1] for s in up) / len(up))
        for budget in (0.0, 0.1, 0.35, 1.0):
            k, hits = round(budget * len(own)), 0.0
            for s in sorted({x for x, _ in own}, reverse=True):
                tied = [e for x, e in own if x == s]
                hits += sum(tied) * min(max(k, 0), len(tied)) / len(tied)
                k -= len(tied)
            assert math.isclose(cuts[rep, budget], hits / len(up), abs_tol=1e-12)


def test_replicates_without_events_or_rows(spark):
    none = spark.createDataFrame([(1, 0.5, False), (2, 0.1, False), (2, None, True)], "block long, s double, e boolean")
    assert rs.auc_replicates(none, "block", "s", F.col("e"), 3, 1).collect() == []
    assert {r.recall for r in rs.budget_replicates(none, "block", "s", F.col("e"), [0.5], 3, 1).collect()} <= {None}
    empty = none.limit(0)
    assert rs.auc_replicates(empty, "block", "s", F.col("e"), 3, 1).collect() == []
    assert rs.replicate_sums(empty.select("block", F.lit(1).alias("n")), "block", ["n"], 3, 1).collect() == []
