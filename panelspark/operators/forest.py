"""Random forest whose trees all grow in the same passes over the rows, a pass for each level.

Values are cut into bins and packed into blocks once. A task counts the classes of its rows by tree, node, drawn feature and
bin; counts meet by tree, where the best cuts are chosen, and only these come to the driver, whose state has the size of the
trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..sources.sinks import settle

BLOCK = 50_000  # rows of a block at most: the grain of the draws, and what a task works on at a time
TASK_ROWS = 1_000_000  # rows of a task of a pass, at most
PASS_PARTS = 24  # tasks of a pass below that: each sends the counts of all nodes
LEAST = 5_000  # rows of a task below that number of tasks
EXACT = 1e-3  # of the rows: error of a quantile that is a cut
TIMES = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])), np.arange(65536) / 65536, "right").astype(np.uint8)  # Poisson draws of mean 1


def cuts_of(ready: DataFrame, bins: int) -> list[np.ndarray]:
    """For each feature at most bins - 1 ascending values; bin b holds what is above the b-th least of them at most up to the next."""
    d = len(ready.select(vector_to_array("features")).first()[0])
    cols = [f"x{i}" for i in range(d)]
    x = ready.select(vector_to_array("features").alias("x")).select(*[F.col("x")[i].alias(c) for i, c in enumerate(cols)])
    return [np.unique(q) for q in x.approxQuantile(cols, [i / (bins - 1) for i in range(bins - 1)], EXACT)]


def binned(values: pa.Array, cuts: list[np.ndarray]) -> np.ndarray:
    """The bins of the features (row x feature) of an array of arrays."""
    x = values.flatten().to_numpy().reshape(-1, len(cuts))
    return np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)]).astype(np.uint8)


def packed(ready: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """block, x (bins of the features, row by row) and y (classes) of up to BLOCK rows, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def block(held: list) -> pa.RecordBatch:
            x, y = (np.concatenate(a) for a in zip(*held))
            return pa.RecordBatch.from_pydict({"block": [first], "x": [x.tobytes()], "y": [y.tobytes()]})

        for b in batches:
            if b.column("label_index").null_count:
                raise ValueError("a training row has no class")
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                if rows + part.num_rows > BLOCK:
                    yield block(held)
                    first, held, rows = first + 1, [], 0
                held.append((binned(part.column("x"), cuts), part.column("label_index").to_numpy().astype(np.uint8)))
                rows += part.num_rows
        if rows:
            yield block(held)

    return settle(ready.select(vector_to_array("features").alias("x"), "label_index").mapInArrow(run, "block bigint, x binary, y binary"))


def in_blocks(ready: DataFrame, cuts: list[np.ndarray], n: int, least: int) -> DataFrame:
    """The n packed rows in as many tasks as a pass takes, each of `least` rows or more up to PASS_PARTS tasks."""
    blocks, parts = packed(ready, cuts), max(min(PASS_PARTS, -(-n // least)), -(-n // TASK_ROWS), 1)
    return blocks.coalesce(parts) if blocks.rdd.getNumPartitions() > parts else blocks


def class_weights(ready: DataFrame) -> np.ndarray:
    """The weight of each class's rows; 0 for a class without any."""
    found = {int(r.label_index): r for r in ready.groupBy("label_index").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")).collect()
             if r.label_index is not None}
    if any(r.lo != r.hi for r in found.values()):
        raise ValueError("rows of a class differ in weight")
    return np.array([found[c].lo if c in found else 0.0 for c in range(max(found) + 1)])


def drawn_features(seed: int, tree: int, nodes: np.ndarray, d: int, k: int) -> np.ndarray:
    """k of d features for each of these nodes (numbers as in a heap, the root is 1) of a tree; all nodes lie in one level."""
    level = int(nodes[0]).bit_length() - 1
    return np.random.default_rng((seed, 1, tree, level)).random((1 << level, d)).argsort(axis=1, kind="stable")[nodes - (1 << level), :k]


def descended(x: np.ndarray, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Nodes that rows reach after so many levels; `at`: where their bins begin in x. A node without a cut sends all to the left."""
    node = np.ones(len(at), np.intp)
    for _ in range(levels):
        right = x[at + feature[node]] > cut[node]
        node += node
        node += right
    return node


def class_counts(blocks: DataFrame, grown: "Forest", nodes: list[np.ndarray], level: int, seed: int, k: int, bins: int, classes: int) -> DataFrame:
    """tree, counts: of each task's rows by open node, drawn feature, bin and class, as often as the tree drew them."""
    feature, cut, d = grown.feature, grown.cut, len(grown.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i.as_py(), np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8).astype(np.intp))
                for b in batches for i, x, y in zip(b["block"], b["x"], b["y"])]
        for tree, open_ in enumerate(nodes if rows else []):
            if not len(open_):
                continue
            f, c = feature[tree].astype(np.intp), cut[tree]
            begin = np.full(2 << level, -1, np.intp)  # of a node's counts
            begin[open_] = np.arange(len(open_)) * (k * bins * classes)
            drawn = np.zeros((2 << level, k), np.intp)
            drawn[open_] = drawn_features(seed, tree, open_, d, k)
            drawn = np.ascontiguousarray(drawn.T)
            total = np.zeros(len(open_) * k * bins * classes)
            for block, x, y in rows:
                times = TIMES[np.frombuffer(np.random.default_rng((seed, 0, tree, block)).bytes(2 * len(y)), np.uint16)]
                row = np.flatnonzero(times)
                at = row * d
                node = descended(x, at, f, c, level)
                cell = begin[node]
                if level and (cell < 0).any():
                    on = np.flatnonzero(cell >= 0)
                    row, at, node, cell = row[on], at[on], node[on], cell[on]
                cell += y[row]
                w = times[row].astype(np.float64)
                for j in range(k):
                    total += np.bincount(cell + x[at + drawn[j][node]].astype(np.intp) * classes, w, len(total))
                    cell += bins * classes
            kind = np.min_scalar_type(int(total.max()))
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "width": pa.array([kind.itemsize], pa.int32()),
                                              "counts": [total.astype(kind).tobytes()]})

    return blocks.mapInArrow(run, "tree int, width int, counts binary")


def best_cuts(counts: DataFrame, nodes: list[np.ndarray], seed: int, d: int, k: int, bins: int, weights: np.ndarray) -> DataFrame:
    """tree, and for each of its open nodes the feature (-1: none lowers the impurity), the cut and the class counts of both sides."""
    classes = len(weights)

    def impurity(n: np.ndarray) -> np.ndarray:
        """Gini impurity times weight."""
        w = n * weights
        s = w.sum(axis=-1)
        return s - (w * w).sum(axis=-1) / np.where(s > 0, s, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0.0
        for b in batches:
            tree = b["tree"][0].as_py()
            for width, c in zip(b["width"], b["counts"]):
                n = n + np.frombuffer(c.as_py(), f"u{width.as_py()}")
        n = n.reshape(-1, k, bins, classes)
        left = n.cumsum(axis=2)
        all_ = left[:, :1, -1:]
        left = left[:, :, :-1]
        right = all_ - left
        gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), impurity(all_) - impurity(left) - impurity(right), 0.0)
        at = gain.reshape(len(n), -1).argmax(axis=1)
        i, j, b = np.arange(len(n)), at // (bins - 1), at % (bins - 1)
        # a gain that is nothing but rounding is none
        feature = np.where(gain[i, j, b] > 1e-12 * (all_[:, 0, 0] @ weights), drawn_features(seed, tree, nodes[tree], d, k)[i, j], -1)
        yield pa.RecordBatch.from_pydict({
            "tree": pa.array([tree], pa.int32()), "feature": [feature.astype(np.int16).tobytes()], "cut": [b.astype(np.uint8).tobytes()],
            "sides": [np.stack((left[i, j, b], right[i, j, b]), axis=1).astype(np.int64).tobytes()]})

    return counts.groupBy("tree").applyInArrow(run, "tree int, feature binary, cut binary, sides binary")


@dataclass
class Forest:
    """Trees as heaps (the root is 1): feature and cut of each node, class shares of each node of the last level.

    A leaf above the last level sends all rows to the left, and its shares stand where they arrive.
    """

    cuts: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    shares: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `probability`: the mean of the trees' class shares."""
        cuts, feature, cut, shares = self.cuts, self.feature, self.cut, self.shares
        depth = (shares.shape[1] - 1).bit_length()

        @F.arrow_udf("array<double>")
        def mean(values: pa.Array) -> pa.Array:
            x = binned(values, cuts).ravel()
            at, total = np.arange(len(values)) * len(cuts), np.zeros((len(values), shares.shape[2]))
            for f, c, s in zip(feature, cut, shares):
                total += s[descended(x, at, f.astype(np.intp), c, depth) - (1 << depth)]
            total /= total.sum(axis=1, keepdims=True)
            return pa.FixedSizeListArray.from_arrays(total.ravel(), total.shape[1]).cast(pa.list_(pa.float64()))

        return df.withColumn("probability", array_to_vector(mean(vector_to_array("features"))))


def grow(model: RandomForestClassifier, ready: DataFrame, n: int) -> Forest:
    """The forest that the settings of `model` name (trees, depth, bins, seed; Poisson draws of rows, the root of the number of
    features at each node, Gini impurity) from n rows of features, label_index and a weight that the class decides."""
    trees, depth, bins, seed = model.getNumTrees(), model.getMaxDepth(), model.getMaxBins(), model.getSeed()
    weights = class_weights(ready)
    classes = len(weights)
    cuts = cuts_of(ready, bins)
    d = len(cuts)
    k = int(np.ceil(np.sqrt(d)))
    blocks = in_blocks(ready, cuts, n, LEAST)
    out = Forest(cuts, np.zeros((trees, 1 << depth), np.int8 if d < 128 else np.int16), np.full((trees, 1 << depth), 255, np.uint8),
                 np.zeros((trees, 1 << depth, classes), np.float32))
    nodes = [np.array([1])] * trees

    def leaves(tree: int, at: np.ndarray, level: int, counts: np.ndarray) -> None:
        w = counts * weights
        out.shares[tree, (at << (depth - level)) - (1 << depth)] = w / w.sum(axis=1, keepdims=True)

    for level in range(depth):
        found = best_cuts(class_counts(blocks, out, nodes, level, seed, k, bins, classes), nodes, seed, d, k, bins, weights).collect()
        following = [np.array([], int)] * trees
        for r in found:
            open_, feature = nodes[r.tree], np.frombuffer(r.feature, np.int16)
            cut, sides = np.frombuffer(r.cut, np.uint8), np.frombuffer(r.sides, np.int64).reshape(-1, 2, classes)
            no = feature < 0
            leaves(r.tree, open_[no], level, sides[no].sum(axis=1))
            out.feature[r.tree, open_[~no]], out.cut[r.tree, open_[~no]] = feature[~no], cut[~no]
            below, counts = (2 * open_[~no][:, None] + [0, 1]).ravel(), sides[~no].reshape(-1, classes)
            ends = ((counts > 0).sum(axis=1) == 1) | (level + 1 == depth)
            leaves(r.tree, below[ends], level + 1, counts[ends])
            following[r.tree] = below[~ends]
        nodes = following
        if not any(len(x) for x in nodes):
            break
    return out
