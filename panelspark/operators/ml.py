"""Model work: train-only preprocessing, MLlib classifiers, walk-forward selection, Gram-matrix regressions.

Fitted state (medians, scales, class weights, categories) has one value per column and lives on the
driver, as in any MLlib model; rows never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, HashingTF, IDF, Normalizer, OneHotEncoder, RegexTokenizer, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import CLASSES, argmax_label, t_p_value
from ..functions.text import letters_only, word_fractions, NEGATIVE_WORDS, UNCERTAIN_WORDS
from ..functions.udfs import ols_from_moments
from ..sources.sinks import settle
from . import evaluate as ev
from .boosting import boost
from .forest import grow
from .prep import long_form
from .ranking import exact_quantiles, rank_in_group
from .sets import best_row

PARALLEL = 8  # fits at a time
FIT_ROWS = 50_000  # rows of a partition of a fit, at least
FOREST_ROWS, FOREST_PARTS = 5_000, 24  # the same for a forest, for up to so many partitions
GRID_ROWS = 200_000  # rows of a partition of a search, at most
GRID_TOL = 1e-8  # of the mean loss: the last step leaves about its square


# ---------------------------------------------------------------- features
@dataclass
class Features:
    """Median impute, population-sd scaling and one-hot (unknown is all zeros), fitted on given rows."""

    numeric: Sequence[str]
    categorical: str | None = None
    median: dict = field(default_factory=dict)
    mean: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)
    mode: str | None = None
    encoder: object = None

    def fit(self, df: DataFrame) -> "Features":
        cols = list(self.numeric)
        q = exact_quantiles(long_form(df, [], cols), ["feature"], "value", {"m": 0.5}).collect()
        self.median = {c: 0.0 for c in cols} | {r["feature"]: r["m"] for r in q}
        full = df.select(*[F.coalesce(F.col(c), F.lit(self.median[c])).alias(c) for c in cols])
        one = full.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
        self.mean = {c: one[f"m_{c}"] for c in cols}
        self.scale = {c: one[f"s_{c}"] or 1.0 for c in cols}
        stages = [VectorAssembler(inputCols=[f"_z_{c}" for c in cols], outputCol="_num")]
        if self.categorical:
            self.mode = df.groupBy(self.categorical).count().orderBy(F.desc("count"), self.categorical).where(F.col(self.categorical).isNotNull()).first()[0]
            # "keep" adds one last slot for unseen values; dropping the last slot turns them into zeros
            stages += [
                StringIndexer(inputCol="_cat", outputCol="_ci", handleInvalid="keep", stringOrderType="alphabetAsc"),
                OneHotEncoder(inputCol="_ci", outputCol="_co", dropLast=True),
            ]
        stages.append(VectorAssembler(inputCols=["_num", "_co"] if self.categorical else ["_num"], outputCol="features"))
        self.encoder = Pipeline(stages=stages).fit(self._scaled(df))
        return self

    def _scaled(self, df: DataFrame) -> DataFrame:
        z = {f"_z_{c}": (F.coalesce(F.col(c), F.lit(self.median[c])) - self.mean[c]) / self.scale[c] for c in self.numeric}
        if self.categorical:
            z["_cat"] = F.coalesce(F.col(self.categorical), F.lit(self.mode))
        return df.withColumns(z)

    def transform(self, df: DataFrame) -> DataFrame:
        drop = [f"_z_{c}" for c in self.numeric] + ["_num", "_cat", "_ci", "_co"]
        return self.encoder.transform(self._scaled(df)).drop(*drop)


def label_index(label: str = "label") -> Column:
    out = F.lit(None).cast("double")
    for i, c in enumerate(CLASSES):
        out = F.when(F.col(label) == c, F.lit(float(i))).otherwise(out)
    return out


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Add the class index and the weight n / (classes present * class size)."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(n.values())
    w = F.lit(1.0)
    for c, k in n.items():
        w = F.when(F.col(label) == c, F.lit(total / (len(n) * k))).otherwise(w)
    return df.withColumn("label_index", label_index(label)).withColumn("weight", w)


def logistic(n_rows: int, C: float = 1.0, l1_ratio: float = 0.0, iterations: int = 100) -> LogisticRegression:
    """Multinomial elastic net; the loss is a mean here, so the penalty is 1 / (C n)."""
    return LogisticRegression(
        featuresCol="features", labelCol="label_index", weightCol="weight", family="multinomial", maxIter=iterations,
        regParam=1.0 / (C * n_rows), elasticNetParam=l1_ratio, standardization=False, tol=1e-5,
    )


def forest(trees: int = 500, depth: int = 10, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label_index", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)


def boosted(rounds: int = 100, depth: int = 3, seed: int = 42) -> OneVsRest:
    """One boosted binary model per class (the library's boosting is binary)."""
    g = GBTClassifier(featuresCol="features", labelCol="label_index", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)
    return OneVsRest(classifier=g, featuresCol="features", labelCol="label_index", weightCol="weight", parallelism=len(CLASSES))


def score(model, df: DataFrame) -> DataFrame:
    """Class probabilities, label (first maximum wins) and p_increase - p_reduce."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")
    else:
        # one-vs-rest gives a margin per class: logistic link, then normalise
        raw = F.transform(vector_to_array("rawPrediction"), lambda v: 1 / (1 + F.exp(-2 * v)))
        p = F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, x: a + x))
    # classes beyond those seen in training have no slot: probability 0
    p = [F.coalesce(F.get(p, i), F.lit(0.0)) for i in range(len(CLASSES))]
    out = out.withColumns({f"p_{c}": x for c, x in zip(CLASSES, p)})
    out = out.withColumn("pred", argmax_label(*[f"p_{c}" for c in CLASSES])).withColumn("score", F.col("p_increase") - F.col("p_reduce"))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def training(f: Features, df: DataFrame) -> tuple[DataFrame, int]:
    """Features, class index and weight of the rows, written once, and their number; FIT_ROWS rows or more a partition, as every
    iteration of a fit is a job of its own."""
    ready = settle(balanced(f.transform(df)).select("features", "label_index", "weight"))
    n = ready.count()
    return ready.coalesce(-(-n // FIT_ROWS) or 1), n


def dealt(ready: DataFrame, n: int) -> DataFrame:
    """The n training rows of trees, few of which keep a task busy. The number of partitions follows from n alone, as the draws
    of a forest depend on it."""
    return ready.repartition(max(-(-n // FIT_ROWS), min(FOREST_PARTS, -(-n // FOREST_ROWS)), 1))


def spread(model, ready: DataFrame, n: int) -> DataFrame:
    """The n training rows as a model takes them: a forest sends each of them through all its trees in every pass."""
    return dealt(ready, n) if isinstance(model, RandomForestClassifier) else ready


def fitted(model, ready: DataFrame, n: int):
    """The library's fit, but trees grow in common passes: there each level of a few trees is a pass with a dense shuffle of its
    own, and each round of each class a handful of jobs."""
    if isinstance(model, RandomForestClassifier):
        return grow(model, spread(model, ready, n), n)
    if isinstance(model, OneVsRest) and isinstance(model.getClassifier(), GBTClassifier):
        return boost(model, dealt(ready, n), n)
    return model.fit(spread(model, ready, n))


def at_once(fit: Callable, items: Sequence) -> list:
    """fit() of each item, PARALLEL at a time: fits that share their rows and don't wait for each other."""
    with ThreadPool(PARALLEL) as pool:
        return pool.map(inheritable_thread_target(SparkSession.builder.getOrCreate())(fit), items)


def in_turn(first: Callable, then: Callable, items: Sequence) -> list:
    """then(item, first(item)) of each item: first() of one after the other, each of which may fill the cluster by itself, while
    then() of those before goes on."""
    with ThreadPool(PARALLEL) as pool:
        run = inheritable_thread_target(SparkSession.builder.getOrCreate())(then)
        return [r.get() for r in [pool.apply_async(run, (i, first(i))) for i in items]]


def fit_predict(train: DataFrame, others: DataFrame, numeric: Sequence[str], categorical: str | None, estimator: Callable) -> DataFrame:
    """Fit preprocessing and a model on `train`, score `others`."""
    f = Features(numeric, categorical).fit(train)
    ready, n = training(f, train)
    return score(fitted(estimator(n), ready, n), f.transform(others))


# ---------------------------------------------------------------- selection
def between(df: DataFrame, t: str, lo: str, hi: str) -> DataFrame:
    return df.where(F.col(t).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def walk_forward(df: DataFrame, t: str, numeric: Sequence[str], categorical: str, folds: Sequence[dict], grid: Sequence[dict], iterations: int = 100) -> DataFrame:
    """Metrics per (candidate, fold) of an expanding, purged walk-forward search.

    A fold names train_start, train_end, val_start, val_end; the gap between train end and validation
    start is purged. Preprocessing is fitted inside each fold. All candidates of a fold are fitted in the same passes
    over its rows and scored in one pass.
    """

    def one(fold: dict) -> DataFrame:
        tr, va = between(df, t, fold["train_start"], fold["train_end"]), between(df, t, fold["val_start"], fold["val_end"])
        f = Features(numeric, categorical).fit(tr)
        n = tr.count()
        parts = max(-(-n // GRID_ROWS), min(FOREST_PARTS, -(-n // FOREST_ROWS)), 1)
        if tr.rdd.getNumPartitions() < parts:
            tr = tr.repartition(parts)
        x = vector_to_array("features").alias("features")
        ready = settle(balanced(f.transform(tr)).select(x, "label_index", "weight"))
        coef = elastic_grid(ready, n, grid, iterations)
        counts = settle(predicted_counts(f.transform(va).select("label", x), coef, [g["candidate"] for g in grid]))
        s = ev.summary(counts, "label", "pred", ["candidate"], times="times")
        rec = ev.per_class(counts, "label", "pred", ["candidate"], times="times").where(F.col("class") == "reduce").select("candidate", F.col("recall").alias("reduce_recall"))
        return s.join(rec, "candidate").withColumn("fold", F.lit(fold["fold"]))

    return reduce(DataFrame.unionByName, at_once(one, folds))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    """Rows of the features of a batch, with a last column of ones."""
    x = b.column("features").flatten().to_numpy().reshape(b.num_rows, -1)
    return np.column_stack((x, np.ones(b.num_rows)))


def grid_sums(ready: DataFrame, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weighted loss, gradient and Hessian of each model (model x class x coefficient, the last one the intercept) and the
    sum of weights, in one pass; a task sends one row of sums."""
    m, k, d = coef.shape
    up, pairs = np.triu_indices(d), list(combinations(range(k), 2))
    sizes = np.cumsum([m, d * m * k, len(up[0]) * m * len(pairs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sizes[-1] + 1)
        for b in batches:
            if b.num_rows == 0:
                continue
            if b.column("label_index").null_count:
                raise ValueError("a training row has no class")
            x, w = _matrix(b), b.column("weight").to_numpy()
            at, y = np.arange(len(w)), b.column("label_index").to_numpy().astype(int)
            z = (x @ coef.reshape(m * k, d).T).reshape(-1, m, k)
            z -= z.max(axis=2, keepdims=True)
            p = np.exp(z)
            s = p.sum(axis=2)
            p /= s[..., None]
            both = np.stack([p[..., i] * p[..., j] for i, j in pairs], axis=2) * w[:, None, None]
            loss = w @ (np.log(s) - z[at, :, y])
            p[at, :, y] -= 1
            p *= w[:, None, None]
            total += np.concatenate((loss, (x.T @ p.reshape(len(w), -1)).ravel(),
                                     ((x[:, up[0]] * x[:, up[1]]).T @ both.reshape(len(w), -1)).ravel(), [w.sum()]))
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    total = sum(np.frombuffer(r.sums) for r in ready.mapInArrow(run, "sums binary").collect())
    loss, grad, both, weight = np.split(total, sizes)
    grad = grad.reshape(d, m, k).transpose(1, 2, 0).reshape(m, k * d)
    cells = np.zeros((m, len(pairs), d, d))
    cells[:, :, up[0], up[1]] = cells[:, :, up[1], up[0]] = both.reshape(-1, m, len(pairs)).transpose(1, 2, 0)
    hess = np.zeros((m, k, d, k, d))
    for q, (i, j) in enumerate(pairs):  # a row of blocks adds up to nothing
        hess[:, i, :, i] += cells[:, q]
        hess[:, j, :, j] += cells[:, q]
        hess[:, i, :, j] -= cells[:, q]
        hess[:, j, :, i] -= cells[:, q]
    return loss, grad, hess.reshape(m, k * d, k * d), float(weight[0])


def _descend(at: np.ndarray, grad: np.ndarray, hess: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Minimum of each quadratic model around `at` plus l1 |u| + l2 u^2 / 2, all models side by side.

    A round goes through the coordinates, then takes Newton's steps of the coordinates that are not zero, with their signs
    held: each goes up to the first that reaches zero, which stays there. These end the slow way along collinear columns.
    """
    u, slope = at.copy(), grad.copy()  # slope: of the quadratic model at u
    eye = np.eye(u.shape[1])
    for _ in range(200):
        won = np.zeros(len(u))
        for j in range(u.shape[1]):
            h = hess[:, j, j]
            bend, free = h + l2[:, j], h * u[:, j] - slope[:, j]
            step = np.sign(free) * np.maximum(np.abs(free) - l1[:, j], 0.0) / np.where(bend > 1e-15, bend, np.inf) - u[:, j]
            u[:, j] += step
            slope += step[:, None] * hess[:, j]
            won += step * step * bend
        for _ in range(u.shape[1]):
            held = (u != 0) | (l1 == 0)
            force = np.where(held, slope + l2 * u + l1 * np.sign(u), 0.0)
            bends = hess * held[:, :, None] * held[:, None, :] + (np.where(held, l2 + 1e-11, 1.0))[:, :, None] * eye
            step = -np.linalg.solve(bends, force[:, :, None])[:, :, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where((l1 > 0) & (u * (u + step) < 0), -u / step, 1.0)
            part = room.min(axis=1, keepdims=True)
            step *= part
            u = np.where((room == part) & (room < 1), 0.0, u + step)
            slope += np.einsum("mij,mj->mi", hess, step)
            won -= (force * step).sum(axis=1)
            if part.min() == 1:
                break
        if won.max() < 1e-12:
            break
    return u


def elastic_grid(ready: DataFrame, n: int, grid: Sequence[dict], iterations: int) -> np.ndarray:
    """Coefficients (candidate x class x feature, then the intercept) of multinomial elastic nets, as `logistic` defines them.

    Every pass over the rows serves all candidates: it adds up gradients and Hessians, and the penalised quadratic
    models, whose size is that of the coefficients, are solved on the driver. So a handful of passes stand for the hundreds
    of first-order iterations of as many single fits. A step that doesn't lower the loss is halved; a candidate is done when its model promises
    no more than GRID_TOL. At most `iterations` passes.
    """
    m, k, d = len(grid), len(CLASSES), len(ready.select("features").first()[0]) + 1
    slopes = np.tile(np.arange(d) < d - 1, k)  # intercepts are free
    strength, ratio = np.array([1.0 / (g["C"] * n) for g in grid]), np.array([g["l1_ratio"] for g in grid])
    l1, l2 = (strength * ratio)[:, None] * slopes, (strength * (1 - ratio))[:, None] * slopes
    at, best = np.zeros((m, k * d)), np.full(m, np.inf)
    trial, promise, size = at.copy(), np.zeros(m), np.ones(m)
    target, open_ = at.copy(), np.arange(m)

    def penalty(u: np.ndarray, i) -> np.ndarray:
        return (l1[i] * np.abs(u) + l2[i] * u * u / 2).sum(axis=1)

    for _ in range(iterations):
        loss, grad, hess, weight = grid_sums(ready, trial[open_].reshape(-1, k, d))
        value = loss / weight + penalty(trial[open_], open_)
        good = value <= best[open_] - 1e-4 * size[open_] * promise[open_]
        i = open_[good]
        at[i], best[i], size[i] = trial[i], value[good], 1.0
        g, h = grad[good] / weight, hess[good] / weight
        if len(i):
            target[i] = _descend(at[i], g, h, l1[i], l2[i])
            step = target[i] - at[i]
            promise[i] = -((g * step).sum(axis=1) + np.einsum("mi,mij,mj->m", step, h, step) / 2 + penalty(target[i], i) - penalty(at[i], i))
        size[open_[~good]] /= 2
        done = np.isin(open_, i[promise[i] < GRID_TOL]) | (size[open_] < 1e-9)
        at[i[promise[i] < GRID_TOL]] = target[i[promise[i] < GRID_TOL]]
        open_ = open_[~done]
        if not len(open_):
            break
        trial[open_] = at[open_] + size[open_, None] * (target[open_] - at[open_])
    return at.reshape(m, k, d)


def predicted_counts(rows: DataFrame, coef: np.ndarray, names: Sequence[str]) -> DataFrame:
    """candidate, label, pred, times: how often each model gives each label (the first of equal scores) to rows of each label."""
    m, k, d = coef.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            got = (_matrix(b) @ coef.reshape(m * k, d).T).reshape(-1, m, k).argmax(axis=2)
            label = b.column("label").to_numpy(zero_copy_only=False)
            for c in set(label):
                own = got[label == c] if c is not None else got[[v is None for v in label]]
                times = np.stack([(own == j).sum(axis=0) for j in range(k)], axis=1)
                yield pa.RecordBatch.from_pydict({
                    "candidate": [a for a in names for _ in range(k)], "label": pa.array([c] * (m * k), pa.string()),
                    "pred": list(CLASSES) * m, "times": times.ravel()})

    return rows.mapInArrow(run, "candidate string, label string, pred string, times long").groupBy("candidate", "label", "pred").agg(
        F.sum("times").alias("times"))


def search_table(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("candidate").agg(
        F.count("*").alias("n_folds"), F.avg("macro_f1").alias("mean_macro_f1"), F.stddev_samp("macro_f1").alias("sd_macro_f1"),
        F.avg("weighted_f1").alias("mean_weighted_f1"), F.avg("reduce_recall").alias("mean_reduce_recall"), F.avg("accuracy").alias("mean_accuracy"))


def best_candidate(search: DataFrame) -> DataFrame:
    """Highest mean macro F1; ties by recall of the event class, weighted F1, lower sd, name."""
    return best_row(search, [F.desc("mean_macro_f1"), F.desc("mean_reduce_recall"), F.desc("mean_weighted_f1"), F.asc("sd_macro_f1"), F.asc("candidate")])


def row_count_folds(df: DataFrame, t: str, key: str, splits: int) -> DataFrame:
    """Fold numbers by position in (t, key) order: equal test blocks at the end, everything before a
    block is its training set. Blocks may cut a period in two. Adds `position` and `test_fold`."""
    n = df.agg(F.count("*").alias("n")).scalar()
    r = rank_in_group(df.withColumn("_d", F.unix_date(t)), [], "_d", key, descending=False, out="_rk").withColumn("_n", n)
    size = F.floor(F.col("_n") / (splits + 1))
    pos = F.col("_rk") - 1
    start = F.col("_n") - splits * size
    return r.withColumn("position", pos).withColumn("test_fold", F.when(pos >= start, F.floor((pos - start) / size))).drop("_rk", "_n", "_d")


def compare_families(train: DataFrame, val: DataFrame, numeric: Sequence[str], categorical: str, models: dict[str, Callable]) -> tuple[DataFrame, Features]:
    """Validation predictions of several model families fitted on the same features: model, label, pred."""
    f = Features(numeric, categorical).fit(train)
    ready, n = training(f, train)
    v = settle(f.transform(val))
    out = None
    for name, model in zip(models, at_once(lambda name: fitted(models[name](n), ready, n), list(models))):
        p = score(model, v).withColumn("model", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out, f


# ---------------------------------------------------------------- linear models
def moments(df: DataFrame, group: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Row count, means and covariances per group, complete rows only, in one aggregate.

    Spark's covariance keeps centred co-moments and merges them pairwise, so large means cost no digits.
    """
    d = df.na.drop(subset=[*xs, y])
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    g = d.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(y).alias("my"), *[F.avg(x).alias(f"s{i}") for i, x in enumerate(xs)],
        *[F.covar_pop(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)], *[F.covar_pop(x, y).alias(f"c{i}") for i, x in enumerate(xs)])
    arr = lambda p, k: F.array(*[F.col(f"{p}{i}") for i in range(k)])
    return g.select(*group, "n", "my", arr("s", len(xs)).alias("mean"), arr("p", len(pairs)).alias("upper"), arr("c", len(xs)).alias("cxy"))


def ols(df: DataFrame, group: Sequence[str], xs: Sequence[str], y: str, min_n: int = 2) -> DataFrame:
    """Minimum-norm least squares on standardised columns per group: n, fit(coef, mean, scale, intercept)."""
    g = moments(df, group, xs, y).where(F.col("n") >= min_n)
    return g.select(*group, "n", ols_from_moments("mean", "my", "upper", "cxy").alias("fit"))


def normal_equations(df: DataFrame, xs: Sequence[str], y: str, fit: DataFrame) -> DataFrame:
    """feature, correlation of each column with the residuals of a fit over these rows: 0 but for rounding. `1`: the mean
    residual in units of its spread."""
    d = predict_ols(df.na.drop(subset=[*xs, y]), fit.select("fit").scalar(), xs).withColumn("_e", F.col(y) - F.col("yhat"))
    spread = F.nullif(F.stddev_pop("_e"), F.lit(0.0))
    cells = [F.struct(F.lit("1").alias("feature"), (F.avg("_e") / spread).alias("value"))] + [
        F.struct(F.lit(x).alias("feature"), (F.covar_pop("_e", x) / spread / F.nullif(F.stddev_pop(x), F.lit(0.0))).alias("value")) for x in xs]
    return d.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def predict_ols(df: DataFrame, fit: Column, xs: Sequence[str]) -> DataFrame:
    d = df.withColumn("_f", fit)
    p = F.col("_f.intercept")
    for i, x in enumerate(xs):
        p = p + F.col("_f.coef")[i] * (F.col(x) - F.col("_f.mean")[i]) / F.col("_f.scale")[i]
    return d.withColumn("yhat", p).drop("_f")


def pooled_ols(df: DataFrame, xs: Sequence[str], y: str, split: str, fit_split: str = "train") -> tuple[DataFrame, DataFrame]:
    """(metrics per split, coefficients): R2 about each split's own mean, RMSE and MAE."""
    d = df.na.drop(subset=[*xs, y])
    f = ols(d.where(F.col(split) == fit_split), [], xs, y)
    e = F.col(y) - F.col("yhat")
    m = predict_ols(d, f.select("fit").scalar(), xs).groupBy(split).agg(
        F.count("*").alias("n"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return m, coefficients(f, [], xs)


def coefficients(fit: DataFrame, group: Sequence[str], xs: Sequence[str]) -> DataFrame:
    cells = F.arrays_zip(F.array(*[F.lit(x) for x in xs]).alias("feature"), F.col("fit.coef").alias("coef"))
    return fit.select(*group, "n", F.explode(cells).alias("_c")).select(*group, "n", "_c.*")


def fama_macbeth(df: DataFrame, t: str, xs: Sequence[str], y: str, min_names: int = 10) -> tuple[DataFrame, DataFrame]:
    """(slopes per period, summary): cross-sectional regressions on within-period standardised columns.

    Each period is one row of sums; the solve runs on those rows. t is NULL where the slope never varies.
    """
    slopes = coefficients(ols(df, [t], xs, y, min_names), [t], xs)
    g = slopes.groupBy("feature").agg(F.count("*").alias("n_periods"), F.avg("coef").alias("mean_coef"), F.stddev_samp("coef").alias("sd_coef"))
    tstat = F.when(F.col("sd_coef") > 1e-12, F.col("mean_coef") / (F.col("sd_coef") / F.sqrt("n_periods")))
    return slopes, g.withColumn("t", tstat)


def with_p_value(df: DataFrame, t: str, dof: Column) -> DataFrame:
    return df.withColumn("p_value", t_p_value(t, dof))


def ordered_logit(train: DataFrame, others: DataFrame, numeric: Sequence[str], categorical: str | None, ordinal: dict[str, int]) -> DataFrame:
    """Proportional odds by stacked cumulative logits: each row once per threshold, one slope for all.

    An approximation of the joint maximum likelihood: the stacked copies are treated as independent.
    """
    levels = sorted(ordinal, key=ordinal.get)
    f = Features(numeric, categorical).fit(train)
    cuts = list(range(len(levels) - 1))

    def stack(d: DataFrame) -> DataFrame:
        y = F.lit(None).cast("int")
        for c, i in ordinal.items():
            y = F.when(F.col("label") == c, F.lit(i)).otherwise(y)
        s = f.transform(d).withColumn("_y", y).withColumn("_cut", F.explode(F.array(*[F.lit(i) for i in cuts])))
        s = s.withColumns({f"_d{i}": (F.col("_cut") == i).cast("double") for i in cuts[1:]})
        s = s.withColumn("label_index", (F.col("_y") > F.col("_cut")).cast("double"))
        return VectorAssembler(inputCols=["features", *[f"_d{i}" for i in cuts[1:]]], outputCol="stacked").transform(s)

    ready = settle(stack(train).select("stacked", "label_index"))
    model = LogisticRegression(featuresCol="stacked", labelCol="label_index", family="binomial", regParam=0.0, standardization=False, maxIter=100, tol=1e-6).fit(ready)
    w = model.coefficients.toArray()
    n_x = len(w) - (len(cuts) - 1)
    theta = [float(model.intercept) + (0.0 if i == 0 else float(w[n_x + i - 1])) for i in cuts]
    v = vector_to_array("features")
    xb = F.aggregate(F.zip_with(v, F.array(*[F.lit(float(b)) for b in w[:n_x]]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    out = f.transform(others).withColumn("_xb", xb).drop("features")
    above = [F.lit(1.0)] + [1 / (1 + F.exp(-(F.col("_xb") + th))) for th in theta] + [F.lit(0.0)]
    out = out.withColumns({f"p_{c}": F.greatest(above[i] - above[i + 1], F.lit(0.0)) for i, c in enumerate(levels)}).drop("_xb")
    return out.withColumn("pred", argmax_label(*[f"p_{c}" for c in CLASSES]))


# ---------------------------------------------------------------- consistency of results
def consistency(a: DataFrame, b: DataFrame, keys: Sequence[str], numbers: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """Compare two result tables item by item: numbers within 1e-10, texts exactly; NULL equals NULL."""
    from ..functions.columns import is_close

    def long(d: DataFrame) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("num"), F.lit(None).cast("string").alias("txt")) for c in numbers]
        cells += [F.struct(F.lit(c).alias("item"), F.lit(None).cast("double").alias("num"), F.col(c).cast("string").alias("txt")) for c in texts]
        return d.select(*keys, F.inline(F.array(*cells)))

    j = long(a).withColumnsRenamed({"num": "a_num", "txt": "a_txt"}).withColumn("_a", F.lit(1)).join(
        long(b).withColumnsRenamed({"num": "b_num", "txt": "b_txt"}).withColumn("_b", F.lit(1)), [*keys, "item"], "full")
    same = F.col("a_txt").eqNullSafe(F.col("b_txt")) & (F.coalesce(is_close("a_num", "b_num"), F.col("a_num").isNull() & F.col("b_num").isNull()))
    return j.withColumn("consistent", F.col("_a").isNotNull() & F.col("_b").isNotNull() & same).drop("_a", "_b")


# ---------------------------------------------------------------- text baselines
def tfidf_baseline(df: DataFrame, text: str, label: str, fit: Column, slots: int = 1 << 18, iterations: int = 50) -> DataFrame:
    """TF-IDF and balanced multinomial logistic regression; scores every row and returns it without its text.

    All terms count: each falls on one of `slots` by its hash, so no vocabulary is gathered. The weight of a term is
    tf * (ln((1 + n) / (1 + df)) + 1), and rows have unit length. Texts are read once, for the counts of their terms.
    """
    d = df.withColumn("_fit", fit).withColumn("_t", letters_only(text, keep_space=True))
    terms = Pipeline(stages=[
        RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\W+", minTokenLength=2), StopWordsRemover(inputCol="_w", outputCol="_k"),
        HashingTF(inputCol="_k", outputCol="_c", numFeatures=slots),
    ]).fit(d).transform(d)
    terms = settle(balanced(terms.drop(text, "_t", "_w", "_k"), label))
    idf = IDF(inputCol="_c", outputCol="_i").fit(terms.where("_fit")).idf.toArray() + 1.0
    weighted = ElementwiseProduct(inputCol="_c", outputCol="_i", scalingVec=Vectors.dense(idf)).transform(terms)
    ready = Normalizer(inputCol="_i", outputCol="features").transform(weighted).drop("_c", "_i")
    tr = ready.where("_fit")
    return score(logistic(tr.count(), iterations=iterations).fit(tr), ready).drop("label_index", "weight", "_fit")


def lexicon_baseline(df: DataFrame, text: str, label: str, fit: Column, iterations: int = 50) -> DataFrame:
    """Negative and uncertain word shares and length as features of the same classifier; rows come back without their text."""
    f = word_fractions(text, {"negative": NEGATIVE_WORDS, "uncertain": UNCERTAIN_WORDS})
    d = settle(df.withColumn("_fit", fit).withColumns({f"_x_{n}": c.cast("double") for n, c in f.items()}).drop(text))
    out = fit_predict(d.where("_fit"), d, [f"_x_{n}" for n in f], None, lambda n: logistic(n, iterations=iterations))
    return out.drop("_fit", *[f"_x_{n}" for n in f])
