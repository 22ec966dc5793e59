import datetime as dt
import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from panelspark.functions.columns import t_p_value
from panelspark.functions.udfs import standardised_ols
from panelspark.operators import forest, ml, stats


def test_t_p_values(spark):
    known = [(12.706204736, 1, 0.05), (2.073873068, 22, 0.05), (2.52, 22, 0.0194954557), (0.0, 5, 1.0), (-4.302652730, 2, 0.05),
             (1.962339081, 1000, 0.05), (3.182446305, 3, 0.05), (50.0, 30, 0.0)]
    df = spark.createDataFrame([(t, v, w) for t, v, w in known], "t double, v int, w double")
    assert all(abs(r.p - r.w) < 1e-7 for r in df.select("w", t_p_value("t", "v").alias("p")).collect())
    none = spark.createDataFrame([(None, 3), (1.0, 0)], "t double, v int").select(t_p_value("t", "v").alias("p")).collect()
    assert [r.p for r in none] == [None, None]


def test_slopes_do_not_depend_on_the_origin(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=400)
    rows = [(float(a), float(b), float(a) + 1e8, float(b) - 1e8, float(c), float(c) + 1e8) for (a, b), c in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, a8 double, b8 double, y double, y8 double").repartition(5)
    near = ml.ols(df, [], ["a", "b"], "y").first().fit
    far = ml.ols(df, [], ["a8", "b8"], "y8").first().fit
    assert np.allclose(near.coef, far.coef, atol=1e-6) and np.allclose(near.scale, far.scale, atol=1e-6)
    e = {r.feature: r.value for r in ml.normal_equations(df, ["a", "b"], "y", ml.ols(df, [], ["a", "b"], "y")).collect()}
    assert set(e) == {"1", "a", "b"} and max(map(abs, e.values())) < 1e-10


def test_min_norm_with_constant_and_collinear_columns():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 50))
    x = np.column_stack([a, b, a - b, np.full(50, 3.0)])
    y = 1 + 2 * a + rng.normal(size=50) / 10
    coef, mean, scale, icpt = standardised_ols(x.mean(0), y.mean(), np.cov(x.T, ddof=0), (x - x.mean(0)).T @ (y - y.mean()) / 50)
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))
    want = np.linalg.lstsq(z, y - y.mean(), rcond=1e-10)[0]
    assert np.allclose(coef, want, atol=1e-8) and coef[3] == 0 and math.isclose(icpt, y.mean())


def test_fama_macbeth_skips_thin_periods_and_flags_flat_slopes(spark):
    rng = np.random.default_rng(1)
    rows = [(dt.date(2020, m, 1), float(rng.normal()), float(m), float(rng.normal())) for m in range(1, 7) for _ in range(30 if m < 6 else 5)]
    df = spark.createDataFrame(rows, "t date, x double, macro double, y double")
    slopes, s = ml.fama_macbeth(df, "t", ["x", "macro"], "y")
    got = {r.feature: r for r in s.collect()}
    assert got["x"].n_periods == 5 and got["macro"].mean_coef == 0.0 and got["macro"].t is None
    m = [r for r in rows if r[0].month == 1]
    x, y = np.array([r[1] for r in m]), np.array([r[3] for r in m])
    one = slopes.where((F.col("feature") == "x") & (F.col("t") == dt.date(2020, 1, 1))).first().coef
    assert math.isclose(one, np.cov(x, y, ddof=0)[0, 1] / x.std())


def test_features_are_fitted_on_training_rows_only(spark):
    tr = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, None), (5.0, "a")], "x double, s string")
    te = spark.createDataFrame([(None, "zzz"), (3.0, "b")], "x double, s string")
    f = ml.Features(["x"], "s").fit(tr)
    assert f.median["x"] == 3.0 and f.mode == "a"
    got = [r.v for r in f.transform(te).select(vector_to_array("features").alias("v")).collect()]
    assert got == [[0.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    assert math.isclose(f.scale["x"], np.std([1, 3, 3, 5]))


def labelled(spark, n=300):
    rng = np.random.default_rng(2)
    x = rng.normal(size=n)
    lab = np.where(x + rng.normal(size=n) / 2 > 0.6, "increase", np.where(x + rng.normal(size=n) / 2 < -0.6, "reduce", "hold"))
    return spark.createDataFrame([(float(a), str(b)) for a, b in zip(x, lab)], "x double, label string")


def test_scores_are_probabilities_and_beat_chance(spark):
    df = labelled(spark)
    for make in (lambda n: ml.logistic(n), lambda n: ml.forest(10, 3), lambda n: ml.boosted(3, 2)):
        out = ml.fit_predict(df, df, ["x"], None, make).collect()
        assert all(abs(r.p_increase + r.p_hold + r.p_reduce - 1) < 1e-6 for r in out)
        assert all(math.isclose(r.score, r.p_increase - r.p_reduce, abs_tol=1e-12) for r in out)
        assert np.mean([r.pred == r.label for r in out]) > 0.5


def test_candidates_of_a_fold_share_few_passes(spark):
    """Each candidate was a fit of its own, every iteration a pass; the results are those of the library's fits, carried to the end."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    x[:, 1] = 0.95 * x[:, 0] + 0.3 * x[:, 1]
    z = x[:, 0] + rng.normal(size=400)
    rows = [(dt.date(2020, 1 + i % 8, 1), float(a), float(b), "xyz"[i % 3], "increase" if v > 0.6 else "reduce" if v < -0.6 else "hold")
            for i, ((a, b), v) in enumerate(zip(x, z))]
    df = spark.createDataFrame(rows, "t date, a double, b double, s string, label string")
    fold = {"fold": 1, "train_start": "2020-01-01", "train_end": "2020-05-31", "val_start": "2020-07-01", "val_end": "2020-08-31"}
    grid = [{"candidate": f"{c} {r}", "C": c, "l1_ratio": r} for c in (0.01, 0.1, 1.0, 100.0) for r in (0.0, 0.3, 1.0)]
    sc = spark.sparkContext
    sc.setJobGroup("walk", "walk")
    got = {r.candidate: r for r in ml.walk_forward(df, "t", ["a", "b"], "s", [fold], grid, 3000).collect()}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 12 and len(sc.statusTracker().getJobIdsForGroup("walk")) < 100

    tr, va = ml.between(df, "t", "2020-01-01", "2020-05-31"), ml.between(df, "t", "2020-07-01", "2020-08-31")
    f = ml.Features(["a", "b"], "s").fit(tr)
    ready, n = ml.training(f, tr)
    plain = ready.select(vector_to_array("features").alias("features"), "label_index", "weight")
    coef, v = ml.elastic_grid(plain, n, grid, 3000), f.transform(va).select("label", "features").cache()
    xs = np.array([r.features for r in v.collect()])
    for g, c in list(zip(grid, coef))[1::5]:
        out = ml.score(ml.logistic(n, g["C"], g["l1_ratio"], 200).setTol(1e-9).fit(ready), v).collect()
        e = np.exp(np.column_stack((xs, np.ones(len(xs)))) @ c.T)
        want = np.array([[r.p_increase, r.p_hold, r.p_reduce] for r in out])
        assert np.allclose(e / e.sum(axis=1, keepdims=True), want, atol=1e-3)
        assert math.isclose(got[g["candidate"]].accuracy, np.mean([r.pred == r.label for r in out]), abs_tol=0.01)
        assert got[g["candidate"]].n == len(out)
    assert (coef[2][:, :-1] == 0).any()  # the strongest L1 penalty sets some to zero


def test_passes_end_at_their_number(spark):
    df = labelled(spark).withColumn("s", F.lit("q"))
    ready, n = ml.training(ml.Features(["x"], "s").fit(df), df)
    plain = ready.select(vector_to_array("features").alias("features"), "label_index", "weight")
    grid = [{"candidate": "one", "C": 1.0, "l1_ratio": 0.5}]
    assert (ml.elastic_grid(plain, n, grid, 1) == 0).all() and (ml.elastic_grid(plain, n, grid, 50) != 0).any()


def test_rows_of_a_forest_are_spread(spark):
    """48,000 rows and 500 trees were one task; other models keep their few partitions."""
    ready = spark.range(48_000).coalesce(1)
    parts = lambda model, n: ml.spread(model, ready, n).rdd.getNumPartitions()
    assert [parts(ml.forest(), n) for n in (0, 4_000, 48_000, 288_000, 3_000_000)] == [1, 1, 10, 24, 60]
    assert parts(ml.logistic(48_000), 48_000) == parts(ml.boosted(), 48_000) == 1


def test_trees_of_a_forest_grow_in_common_passes(spark):
    """Each level of a few trees was a job with a dense shuffle of its own; the shares are those of the library's
    forest but for its draws and for its leaves, which it merges where both give the same class."""
    df = labelled(spark, 3000).withColumn("s", F.when(F.col("x") > 1, "q").otherwise("r"))
    f = ml.Features(["x"], "s").fit(df)
    ready, n = ml.training(f, df)
    model = ml.forest(200, 5)
    sc = spark.sparkContext
    sc.setJobGroup("grow", "grow")
    own = ml.fitted(model, ready, n)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert own.feature.shape == (200, 32) and own.shares.shape == (200, 32, 3)
    # a few jobs make the blocks and a few each level, whatever the number of trees
    assert len(sc.statusTracker().getJobIdsForGroup("grow")) < 40
    at = spark.createDataFrame([(i / 10, "q" if i > 10 else "r", "hold") for i in range(-20, 21)], "x double, s string, label string")
    p = [np.array([[r.p_increase, r.p_hold, r.p_reduce] for r in ml.score(m, f.transform(at)).orderBy("x").collect()])
         for m in (own, ml.fitted(model, ready, n), model.fit(ready))]
    assert (p[0] == p[1]).all() and np.allclose(p[0].sum(axis=1), 1)
    assert np.abs(p[0] - p[2]).max() < 0.15 and np.abs(p[0] - p[2]).mean() < 0.06


def test_one_tree_takes_the_best_cuts(spark):
    """Against every cut of the drawn features, counted row by row."""
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 6, (400, 3)).astype(float), rng.integers(0, 3, 400)
    y[x[:, 1] > 2] = 2
    w = np.array([2.0, 0.5, 1.5])
    rows = [(Vectors.dense(a), float(b), float(w[b])) for a, b in zip(x, y)]
    ready = spark.createDataFrame(rows, ["features", "label_index", "weight"]).coalesce(1)
    got = forest.grow(ml.forest(3, 4), ready, 400)
    drawn = [np.array(r.features) for r in ready.select("features").collect()]
    assert (np.array(drawn) == x).all()
    for tree in range(3):
        times = forest.TIMES[np.frombuffer(np.random.default_rng((42, 0, tree, 0)).bytes(800), np.uint16)].astype(int)

        def gini(rows):
            n = np.bincount(y[rows], times[rows], 3) * w
            return n.sum() - (n * n).sum() / n.sum() if n.sum() else 0.0

        def check(node, level, rows):
            n = np.bincount(y[rows], times[rows], 3)
            gains = {}
            if level < 4 and (n > 0).sum() > 1:
                for j in forest.drawn_features(42, tree, np.array([node]), 3, 2)[0]:
                    for b, v in enumerate(got.cuts[j]):
                        l, r = rows[x[rows, j] <= v], rows[x[rows, j] > v]
                        if times[l].sum() and times[r].sum():
                            gains[j, b] = gini(rows) - gini(l) - gini(r)
            best = max(gains.values(), default=0.0)
            if best <= 1e-9:
                want = n * w / (n * w).sum()
                assert np.allclose(got.shares[tree, (node << (4 - level)) - 16], want, atol=1e-6)
                return
            j, b = int(got.feature[tree, node]), int(got.cut[tree, node])
            assert np.isclose(gains[j, b], best)
            v = got.cuts[j][b]
            check(2 * node, level + 1, rows[x[rows, j] <= v])
            check(2 * node + 1, level + 1, rows[x[rows, j] > v])

        check(1, 0, np.arange(400))


def test_boosted_trees_of_a_round_grow_in_common_passes(spark):
    """Each class was a fit of its own with a handful of jobs a round; the margins are those of the library's trees."""
    rng = np.random.default_rng(11)
    x, v = rng.integers(0, 8, (900, 2)).astype(float), rng.normal(size=900)
    z = x[:, 0] - x[:, 1] + 2 * v
    rows = [(float(a), float(b), "increase" if s > 2 else "reduce" if s < -2 else "hold") for (a, b), s in zip(x, z)]
    df = spark.createDataFrame(rows, "a double, b double, label string")
    f = ml.Features(["a", "b"], None).fit(df)
    ready, n = ml.training(f, df)
    model = ml.boosted(25, 3)
    sc = spark.sparkContext
    sc.setJobGroup("boost", "boost")
    own = ml.fitted(model, ready, n)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(own.trees) == 25 and len(sc.statusTracker().getJobIdsForGroup("boost")) < 25 * 3 + 20
    grid = spark.createDataFrame([(float(a), float(b), "hold") for a in range(8) for b in range(8)], "a double, b double, label string")
    got, want = (np.array([list(r.rawPrediction) for r in m.transform(f.transform(grid)).orderBy("a", "b").collect()]) for m in (own, model.fit(ready)))
    assert np.allclose(got, want, atol=1e-6)


def test_boosting_goes_on_where_nothing_is_left_to_cut(spark):
    rows = [(Vectors.dense([3.0]), float(i % 4 == 0), 1.0) for i in range(20)]
    ready = spark.createDataFrame(rows, ["features", "label_index", "weight"])
    got = ml.fitted(ml.boosted(3, 2), ready, 20)
    lib = ml.boosted(3, 2).fit(ready)
    margins = [np.array(m.transform(ready).select("rawPrediction").first()[0]) for m in (got, lib)]
    assert np.allclose(*margins, atol=1e-9)


def test_draws_of_rows_have_mean_and_spread_one():
    t = forest.TIMES.astype(float)
    assert abs(t.mean() - 1) < 1e-3 and abs(t.var() - 1) < 2e-3 and abs((t == 0).mean() - math.exp(-1)) < 1e-4


def test_values_outside_the_cuts_and_constant_columns(spark):
    cuts = [np.array([0.0, 1.0]), np.array([5.0])]
    import pyarrow as pa

    got = forest.binned(pa.array([[-1.0, 5.0], [0.0, 6.0], [0.5, 4.0], [2.0, 5.0]]), cuts)
    assert got.tolist() == [[0, 0], [0, 1], [1, 0], [2, 0]]
    rows = [(Vectors.dense([3.0]), float(i % 2), 1.0) for i in range(20)]
    one = forest.grow(ml.forest(2, 3), spark.createDataFrame(rows, ["features", "label_index", "weight"]), 20)
    assert (one.feature == 0).all() and (one.shares[:, 1:] == 0).all() and np.allclose(one.shares[:, 0].sum(axis=1), 1)


def test_windows_are_compared_one_after_the_other(spark):
    """Fits of all windows at once shared the cores, and one that failed let the others run on."""
    seen = []

    def first(i):
        if i == 3:
            raise KeyError(i)
        seen.append(i)
        return 10 * i

    assert ml.in_turn(first, lambda i, x: (i, x, spark.range(i).count()), [1, 2]) == [(1, 10, 1), (2, 20, 2)]
    try:
        ml.in_turn(first, lambda i, x: None, [3, 4])
    except KeyError:
        pass
    assert seen == [1, 2]


def test_fits_at_once_may_hold_fits_at_once(spark):
    got = ml.at_once(lambda i: ml.at_once(lambda j: spark.range(i + j).count(), [1, 2]), [1, 2])
    assert got == [[2, 3], [3, 4]]


def test_texts_are_read_once_for_their_terms(spark):
    """Every text was cut into terms for the document frequencies, and again for the features."""
    seen = spark.sparkContext.accumulator(0)

    def said(i):
        seen.add(1)
        return ("gain rise growth " if i % 2 else "loss fall decline ") + f"word{'abc'[i % 3]}"

    rows = spark.range(60).select("id", F.when(F.col("id") % 2 == 1, "increase").otherwise("reduce").alias("label"), F.udf(said)("id").alias("text"))
    out = ml.tfidf_baseline(rows, "text", "label", F.col("id") < 40, slots=256)
    assert "text" not in out.columns and all(r.pred == r.label for r in out.collect())
    assert seen.value == 60


def test_ordered_logit_follows_the_order(spark):
    df = labelled(spark)
    out = ml.ordered_logit(df, df, ["x"], None, {"reduce": 0, "hold": 1, "increase": 2}).collect()
    assert all(abs(r.p_increase + r.p_hold + r.p_reduce - 1) < 1e-9 for r in out)
    hi, lo = max(out, key=lambda r: r.x), min(out, key=lambda r: r.x)
    assert (hi.pred, lo.pred) == ("increase", "reduce")


def test_row_count_folds_cover_the_tail(spark):
    df = spark.createDataFrame([(dt.date(2020, 1 + i // 5, 1), i) for i in range(23)], "t date, k bigint")
    got = [r.test_fold for r in ml.row_count_folds(df, "t", "k", 4).orderBy("position").collect()]
    assert got == [None] * 7 + [0] * 4 + [1] * 4 + [2] * 4 + [3] * 4


def test_newey_west_without_lags_is_the_plain_t(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=30) + 0.3
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)], "g string, t date, v double")
    r = stats.newey_west(df, ["g"], "t", "v", 0).first()
    assert math.isclose(r.nw_t, r.plain_t)


def test_consistency_treats_null_as_equal(spark):
    a = spark.createDataFrame([("x", 1.0, "m"), ("y", None, "n")], "k string, v double, s string")
    b = spark.createDataFrame([("x", 1.0 + 1e-12, "m"), ("y", None, "other"), ("z", 1.0, "q")], "k string, v double, s string")
    got = {(r.k, r["item"]): r.consistent for r in ml.consistency(a, b, ["k"], ["v"], ["s"]).collect()}
    assert got == {("x", "v"): True, ("x", "s"): True, ("y", "v"): True, ("y", "s"): False, ("z", "v"): False, ("z", "s"): False}


def test_feature_pipeline_returns_every_split(spark):
    from panelspark.plans import q_ml

    sf = "/root/testdata/sf0.001"
    got = {r["split"]: r["count"] for r in q_ml.m1(spark, sf).groupBy("split").count().collect()}
    want = {r["split"]: r["count"] for r in q_ml.panel(spark, sf).groupBy("split").count().collect()}
    assert got == want and set(got) == {"train", "validation", "test"}
