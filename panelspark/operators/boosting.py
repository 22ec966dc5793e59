"""Boosted trees, one binary model for each class, whose trees of a round grow in the same passes over the rows.

Rows are packed into blocks of bins as for a forest. A block keeps the margins of its rows; a pass adds up residuals and
weights by class, node, feature and bin, and the driver chooses the cuts from these sums, whose size is that of the trees.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..sources.sinks import new_path
from .forest import binned, class_weights, cuts_of, descended, in_blocks

LEAST = 25_000  # rows of a task, while there are few: a pass is short
KEPT = 20  # rounds after which the margins are written, so that their lineage stays short


@dataclass
class Boosted:
    """Cuts of the features, and for each round its step and, class by class, trees as heaps with the values of their last level."""

    cuts: list[np.ndarray]
    trees: list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `rawPrediction`: the margin of each class."""
        cuts, trees = self.cuts, self.trees

        @F.arrow_udf("array<double>")
        def margins(values: pa.Array) -> pa.Array:
            x = binned(values, cuts).ravel()
            at = np.arange(len(values)) * len(cuts)
            f = sum(added(x, at, *t) for t in trees)
            return pa.FixedSizeListArray.from_arrays(f.T.ravel(), len(f)).cast(pa.list_(pa.float64()))

        return df.withColumn("rawPrediction", array_to_vector(margins(vector_to_array("features"))))


def added(x: np.ndarray, at: np.ndarray, step: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What the trees of a round add to the margins (class x row); `at`: where the bins of each row begin in x."""
    depth = value.shape[1].bit_length() - 1
    return step * np.stack([v[descended(x, at, f, c, depth) - len(v)] for f, c, v in zip(feature, cut, value)])


def residual_sums(blocks: Iterable, first: bool, level: int, feature: np.ndarray, cut: np.ndarray, weights: np.ndarray, d: int, bins: int) -> np.ndarray:
    """Sums of weighted residuals and of weights (the last axis) of the blocks' rows by class, node of a level, feature and bin.

    The residual of a row is its sign (1: of the class) in the first round, then the negative gradient of 2 log(1 + exp(-2 sign margin)).
    """
    size = (d * bins) << level
    out = np.zeros((len(weights), 2, size))
    for x, y, f in blocks:
        at, w = np.arange(len(y)) * d, weights[y]
        cells = np.ascontiguousarray(x.reshape(-1, d).T.astype(np.intp) + np.arange(d)[:, None] * bins)
        for c in range(len(weights)):
            sign = np.where(y == c, 1.0, -1.0)
            r = w * (sign if first else 4 * sign / (1 + np.exp(2 * sign * f[c])))
            node = (descended(x, at, feature[c], cut[c], level) - (1 << level)) * (d * bins)
            for cell in cells:
                i = cell + node if level else cell
                out[c, 0] += np.bincount(i, r, size)
                out[c, 1] += np.bincount(i, w, size)
    return np.moveaxis(out, 1, 2).reshape(len(weights), 1 << level, d, bins, 2)


def boost(model: OneVsRest, ready: DataFrame, n: int) -> Boosted:
    """The boosted trees that the settings of `model`'s classifier name (rounds, depth, bins, step; variance of the residuals, all
    features at each node, the first round with step 1) from n rows of features, label_index and a weight that the class decides."""
    g, spark = model.getClassifier(), ready.sparkSession
    rounds, depth, bins, step = g.getMaxIter(), g.getMaxDepth(), g.getMaxBins(), g.getStepSize()
    weights = class_weights(ready)
    cuts = cuts_of(ready, bins)
    k, d = len(weights), len(cuts)
    rows = in_blocks(ready, cuts, n, LEAST).rdd.map(lambda r: (np.frombuffer(r.x, np.uint8), np.frombuffer(r.y, np.uint8), np.zeros((k, len(r.y)))))
    rows, held = rows.persist(StorageLevel.MEMORY_AND_DISK), []
    out = Boosted(cuts, [])
    for i in range(rounds):
        feature, cut = np.zeros((k, 1 << depth), np.intp), np.full((k, 1 << depth), 255, np.uint8)
        value, open_ = np.zeros((k, 1 << depth)), np.ones((k, 1), bool)
        for level in range(depth):

            def run(blocks: Iterator, first=not i, level=level, feature=feature, cut=cut) -> Iterator[np.ndarray]:
                yield residual_sums(blocks, first, level, feature, cut, weights, d, bins)

            left = sum(rows.mapPartitions(run).collect()).cumsum(axis=3)
            for old in held:  # the rows of this round are at hand now
                old.unpersist()
            held = []
            whole = left[:, :, :1, -1:]
            left = left[:, :, :, :-1]
            right = whole - left
            # weights that are nothing but rounding are none
            some = (left[..., 1] > 1e-9 * whole[..., 1]) & (right[..., 1] > 1e-9 * whole[..., 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                fit = lambda s: s[..., 0] ** 2 / s[..., 1]
                gain = np.where(some, fit(left) + fit(right) - fit(whole), 0.0).reshape(k, 1 << level, -1)
                mean = np.nan_to_num(whole[:, :, 0, 0, 0] / whole[:, :, 0, 0, 1])
                best = gain.argmax(axis=2)
                c, node = np.indices(best.shape)
                sides = [s.reshape(k, 1 << level, -1, 2)[c, node, best] for s in (left, right)]
                means = [s[..., 0] / s[..., 1] for s in sides]
            split = open_ & (gain[c, node, best] > 1e-12 * whole[:, :, 0, 0, 1])
            heap = slice(1 << level, 2 << level)
            feature[:, heap] = np.where(split, best // (bins - 1), 0)
            cut[:, heap] = np.where(split, best % (bins - 1), 255)
            # a leaf sends all rows to the left: its value stands where they arrive
            ends = open_ & ~split
            value[:, :: 1 << (depth - level)][ends] = mean[ends]
            open_ = np.repeat(split, 2, axis=1)
            if level + 1 == depth:
                value[open_] = np.stack(means, axis=2).reshape(k, -1)[open_]
            if not split.any():
                break
        tree = (step if i else 1.0, feature, cut, value)
        out.trees.append(tree)
        if i + 1 < rounds:
            held.append(rows)
            rows = rows.map(lambda b, t=tree: (b[0], b[1], b[2] + added(b[0], np.arange(len(b[1])) * d, *t)))
            if (i + 1) % KEPT == 0:
                path = new_path(spark, "margins")
                rows.saveAsPickleFile(path)
                rows = spark.sparkContext.pickleFile(path)
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    for old in (*held, rows):
        old.unpersist()
    return out
