"""Gradient-boosted trees over binned rows, with the definition of Spark ML's ``GBTClassifier``.

The same trees as there (log loss, variance gain, weighted means in the leaves, at most ``BINS`` candidate bins of a feature),
grown from another layout: a row is a byte per feature, its label and its margin, in blocks that stay cached on the executors.
A level of a tree is one job in which every task adds up histograms of its blocks; only those reach the driver, whose
size follows from tree depth and bins and not from the rows. Of two children the histogram of the smaller one is
counted and that of the other is the rest of their parent's. Candidate splits come from a summary of all rows.
"""

from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession

from ..session import run_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
SUMMARY = 1024  # weighted points by which a partition tells the driver about a feature
DEALT, BLOCK = 8_192, 131_072  # rows of what is dealt over the tasks, and of the blocks made of it there
REBASE = 40  # trees after which margins are rebuilt from the rows, so that no lineage is longer
KEPT = StorageLevel(True, True, False, True)  # bytes as they are: nothing to be decoded when they are read again
COUNT = float(1 << 26)  # the number of positive rows counts in these units, next to that of all rows

Block = tuple  # bins (features x rows), labels, margins or None
Sent = tuple  # of a tree what tasks need, in arrays: features, cuts, values


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order: the children of ``i`` are ``2 i + 1`` and ``2 i + 2``; ``feature`` is -1 in a leaf or where no node is."""

    feature: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    value: np.ndarray
    gain: np.ndarray
    weight: np.ndarray
    rows: np.ndarray

    def sent(self) -> Sent:
        return self.feature, self.cut, self.value


# ---- what tasks do --------------------------------------------------------------------

def summary(values: np.ndarray, weights: np.ndarray, points: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights, or of many values the largest of each of ``points`` equal shares of weight."""
    order = np.argsort(values, kind="stable")
    v, w = values[order], weights[order]
    last = np.flatnonzero(np.append(v[1:] != v[:-1], True)) if len(v) else np.zeros(0, np.int64)
    total = np.cumsum(w)[last] if len(v) else np.zeros(0)
    v = v[last]
    if len(v) > points:
        at = np.unique(np.searchsorted(total, total[-1] * np.arange(1, points + 1) / points).clip(max=len(v) - 1))
        v, total = v[at], total[at]
    return v, np.diff(total, prepend=0.0)


def candidates(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between weighted values, in equal shares of the weight; between all of them if they are few."""
    order = np.argsort(values, kind="stable")
    distinct, at = np.unique(values[order], return_inverse=True)
    weight = np.bincount(at, weights=weights[order], minlength=len(distinct))
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(middle) < bins:
        return middle
    total = np.cumsum(weight)
    stride = total[-1] / bins
    goal, found = stride, []
    for k in range(1, len(distinct)):  # of two neighbours the one nearer to the share wins
        if abs(total[k - 1] - goal) < abs(total[k] - goal):
            found.append(middle[k - 1])
            goal += stride
    return np.array(found[:bins - 1])


def places(bins: np.ndarray, tree: Sent, wanted: Sequence[int]) -> np.ndarray:
    """Per row 1 + the position of its node in ``wanted``, or 0. Comparisons of bytes only, no gathering."""
    rank = {node: k + 1 for k, node in enumerate(wanted)}
    above = {0}
    for node in wanted:
        while node:
            above.add(node)
            node = (node - 1) // 2
    feature, cut, _ = tree
    kind = np.uint8 if len(rank) < 256 else np.uint16
    out = np.zeros(bins.shape[1], kind)
    todo = [(0, np.ones(bins.shape[1], bool))]
    while todo:
        node, here = todo.pop()
        if node in rank:
            out |= here.view(np.uint8) * kind(rank[node])
            continue
        right = bins[feature[node]] > cut[node]
        for child, mine in ((2 * node + 1, ~right), (2 * node + 2, right)):
            if child in above:
                todo.append((child, mine & here))
    return out


def predicted(bins: np.ndarray, tree: Sent) -> np.ndarray:
    feature, _, value = tree
    leaves, todo = [], [0]
    while todo:
        node = todo.pop()
        if feature[node] < 0:
            leaves.append(node)
        else:
            todo += [2 * node + 1, 2 * node + 2]
    return np.concatenate([[0.0], value[leaves]])[places(bins, tree, leaves)]


def advanced(block: Block, trees: Sequence[tuple[Sent, float]]) -> Block:
    """The block with the trees added to its margins."""
    bins, label, margin = block
    margin = np.zeros(len(label)) if margin is None else margin.copy()
    for tree, rate in trees:
        margin += rate * predicted(bins, tree)
    return bins, label, margin


def residuals(label: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What a tree is fitted to: the labels -1 and 1 themselves, later the negative gradient of twice the log loss."""
    y = label * 2.0 - 1.0
    return y if margin is None else 4.0 * y / (1.0 + np.exp(2.0 * y * margin))


def pairs(features: int) -> list[tuple[int, ...]]:
    """Features two by two: a joint table of both is counted in one pass, each one's histogram is its margin."""
    return [tuple(range(f, min(f + 2, features))) for f in range(0, features, 2)]


def histograms(blocks: Iterator[Block], tree: Sent, wanted: Sequence[int], weights: tuple[float, float]) -> np.ndarray:
    """Weighted sums of residuals and numbers of negative and positive rows (3, nodes, features, bins) of the wanted nodes over the blocks."""
    tables = None
    of_class = np.array(weights)
    for bins, label, margin in blocks:
        two = pairs(len(bins))
        if tables is None:
            features, tables = len(bins), [np.zeros((2, len(wanted) * BINS ** len(p))) for p in two]
        if wanted[0] == 0:
            at, chosen = np.zeros(len(label), np.int64), bins
        else:
            code = places(bins, tree, wanted)
            rows = np.flatnonzero(code)
            at, chosen = code[rows].astype(np.int64) - 1, bins.take(rows, axis=1)
            label, margin = label[rows], None if margin is None else margin[rows]
        pull = residuals(label, margin) * of_class[label]
        number = 1.0 + COUNT * label
        for p, table in zip(two, tables):
            cell = at
            for f in p:
                cell = cell * BINS + chosen[f]
            for line, amount in zip(table, (pull, number)):
                line += np.bincount(cell, weights=amount, minlength=len(line))
    if tables is None:
        return np.zeros((0,))
    out = np.empty((3, len(wanted), features, BINS))
    for p, table in zip(pairs(features), tables):
        positive = np.floor(table[1] / COUNT)
        for k, full in enumerate((table[0], table[1] - positive * (COUNT + 1.0), positive)):
            full = full.reshape(len(wanted), *[BINS] * len(p))
            for axis, f in enumerate(p):
                out[k, :, f] = full if len(p) == 1 else full.sum(axis=2 - axis)
    return out


# ---- growing ---------------------------------------------------------------------------

def split(sums: np.ndarray, least: int) -> tuple[int, int, float] | None:
    """Feature, last bin on the left and gain of the best split of a node (sums of residuals, weights, rows), if one gains."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    whole = sums[:, :1].sum(axis=2, keepdims=True)
    right = whole - left
    valid = (left[2] >= max(least, 1)) & (right[2] >= max(least, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(valid, left[0] ** 2 / left[1] + right[0] ** 2 / right[1], -np.inf)
    best = int(np.argmax(gain))
    pull, weight = float(whole[0, 0, 0]), float(whole[1, 0, 0])
    gained = (float(gain.flat[best]) - pull * pull / weight) / weight
    if not gained > 1e-12:  # below that it is rounding
        return None
    return best // (BINS - 1), best % (BINS - 1), gained


def grown(count, depth: int, least: int) -> Tree:
    """A tree from ``count(tree, nodes)``, which gives the histograms of nodes of one level."""
    size = 2 ** (depth + 1) - 1
    tree = Tree(np.full(size, -1, np.int8), np.zeros(size, np.uint8), np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size, np.int64))

    def place(node: int, sums: np.ndarray) -> None:
        pull, weight, rows = sums[:, 0].sum(axis=1)
        tree.value[node], tree.weight[node], tree.rows[node] = pull / weight, weight, rows

    known = {0: count(tree, [0])[0]}
    place(0, known[0])
    for level in range(depth):
        parents = []
        for node, sums in known.items():
            best = split(sums, least)
            if best is None:
                continue
            f, at, tree.gain[node] = best
            tree.feature[node], tree.cut[node] = f, at
            parents.append(node)
            left = sums[:, f, :at + 1].sum(axis=1)
            for child, (pull, weight, rows) in ((2 * node + 1, left), (2 * node + 2, sums[:, f].sum(axis=1) - left)):
                tree.value[child], tree.weight[child], tree.rows[child] = pull / weight, weight, rows
        if not parents or level + 1 == depth:
            break
        smaller = [2 * n + 1 if tree.rows[2 * n + 1] <= tree.rows[2 * n + 2] else 2 * n + 2 for n in parents]
        counted = count(tree, smaller)
        below = {}
        for parent, child, sums in zip(parents, smaller, counted):
            below[child] = sums
            other = 4 * parent + 3 - child
            rest = known[parent] - sums
            rest[:2, rest[2] == 0] = 0.0  # no rows: nothing but rounding
            below[other] = rest
        known = dict(sorted(below.items()))
    return tree


class Rows:
    """Binned training rows on the executors, dealt evenly over as many partitions as asked for."""

    def __init__(self, train: DataFrame, features: Sequence[str], shift: np.ndarray, scale: np.ndarray, weights: tuple[float, float], parts: int):
        """``train`` has the features and ``label``; features are taken as ``(x - shift) * scale``, as Spark's scaler does."""
        columns, weights = list(features), tuple(map(float, weights))
        self.weights, self.cores = weights, train.sparkSession.sparkContext.defaultParallelism

        def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            x = np.stack([(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) - a) * b
                          for c, a, b in zip(columns, shift, scale)])
            return x, batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(np.uint8)

        def told(batches):
            seen = [([], []) for _ in columns]
            for batch in batches:
                x, label = arrays(batch)
                w = np.array(weights)[label]
                for (vs, ws), values in zip(seen, x):
                    v, share = summary(values, w, 4 * SUMMARY)
                    vs.append(v)
                    ws.append(share)
            for f, (vs, ws) in enumerate(seen):
                v, share = summary(np.concatenate(vs or [[]]), np.concatenate(ws or [[]]))
                yield pa.RecordBatch.from_pydict({"f": pa.array([f] * len(v), pa.int32()), "v": pa.array(v, pa.float64()), "w": pa.array(share, pa.float64())})

        points = train.select(*columns, "label").mapInArrow(told, "f int, v double, w double").toArrow()
        f, v, w = (points[c].to_numpy() for c in ("f", "v", "w"))
        self.thresholds = [candidates(v[f == k], w[f == k]) for k in range(len(columns))]
        thresholds, n = self.thresholds, len(columns)

        def binned(batches):
            waiting: list[Block] = []
            for batch in batches:
                x, label = arrays(batch)
                waiting.append((np.stack([np.searchsorted(t, row).astype(np.uint8) for t, row in zip(thresholds, x)]), label))
                if sum(len(b[1]) for b in waiting) >= DEALT:
                    bins, label = np.concatenate([b[0] for b in waiting], axis=1), np.concatenate([b[1] for b in waiting])
                    whole = len(label) // DEALT * DEALT
                    for k in range(0, whole, DEALT):
                        yield packed(bins[:, k:k + DEALT], label[k:k + DEALT])
                    waiting = [(bins[:, whole:], label[whole:])]
            if waiting and sum(len(b[1]) for b in waiting):
                yield packed(np.concatenate([b[0] for b in waiting], axis=1), np.concatenate([b[1] for b in waiting]))

        def packed(bins: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([np.ascontiguousarray(bins).tobytes() + label.tobytes()], pa.binary())})

        def dealt(index: int, rows):
            for k, r in enumerate(rows):
                yield index + k, (index, k, bytes(r[0]))

        def blocks(pieces):
            ordered = [p for _, _, p in sorted(p for _, p in pieces)]
            per = max(BLOCK // DEALT, 1)
            for k in range(0, len(ordered), per):
                both = [np.frombuffer(p, np.uint8).reshape(n + 1, -1) for p in ordered[k:k + per]]
                whole = np.concatenate(both, axis=1)
                yield np.ascontiguousarray(whole[:n]), whole[n].copy(), None

        self.code = train.sparkSession.sparkContext.broadcast(cloudpickle.dumps((advanced, histograms)))  # sent once, not with every job
        cut = train.select(*columns, "label").mapInArrow(binned, "block binary").rdd
        self.blocks: RDD = cut.mapPartitionsWithIndex(dealt).partitionBy(parts, lambda k: k).mapPartitions(blocks).persist(KEPT)

    def together(self, rows: RDD) -> RDD:
        """As many tasks as cores, each over several partitions if there are more."""
        return rows.coalesce(self.cores) if rows.getNumPartitions() > self.cores else rows

    def boosted(self, trees: int, depth: int, rate: float, least: int) -> list[tuple[Tree, float]]:
        """The trees with their weights: the first one counts in full, the later ones by ``rate``."""
        made: list[tuple[Tree, float]] = []
        old, now = [], self.blocks
        weights, code = self.weights, self.code
        try:
            while len(made) < trees:
                if made:
                    before, last = (self.blocks, made[:]) if len(made) % REBASE == 0 else (now, made[-1:])
                    old.append(now)
                    now = before.mapPartitions(_advance(self.code, [(t.sent(), r) for t, r in last])).persist(KEPT)
                rows = self.together(now)

                def count(tree: Tree, nodes: list[int], rows: RDD = rows) -> list[np.ndarray]:
                    parts = [p for p in rows.mapPartitions(_count(code, tree.sent(), nodes, weights)).collect() if p.size]
                    pull, negative, positive = sum(parts[1:], parts[0])
                    return list(np.stack([pull, weights[0] * negative + weights[1] * positive, negative + positive], axis=1))

                made.append((grown(count, depth, least), rate if made else 1.0))
                while old:  # the new margins are there
                    gone = old.pop()
                    if gone is not self.blocks:
                        gone.unpersist()
        finally:
            for left in (*old, now):
                if left is not self.blocks:
                    left.unpersist()
        return made

    def release(self) -> None:
        self.blocks.unpersist()
        self.code.unpersist()


def _advance(code, trees: Sequence[tuple[Sent, float]]):
    def run(blocks):
        each = pickle.loads(code.value)[0]
        return (each(b, trees) for b in blocks)
    return run


def _count(code, tree: Sent, nodes: list[int], weights: tuple[float, float]):
    return lambda blocks: [pickle.loads(code.value)[1](blocks, tree, nodes, weights)]


NODES = pa.schema([("treeID", pa.int32()), ("nodeData", pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
    ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
    ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))]))])


def node_rows(number: int, tree: Tree, thresholds: Sequence[np.ndarray]) -> list[dict]:
    """A tree as Spark ML stores it: nodes from the root down, left before right. Impurities of single nodes are not known."""
    order, todo = [], [0]
    while todo:
        node = todo.pop()
        order.append(node)
        if tree.feature[node] >= 0:
            todo += [2 * node + 2, 2 * node + 1]
    at = {node: k for k, node in enumerate(order)}
    rows = []
    for k, node in enumerate(order):
        f, value, weight = int(tree.feature[node]), float(tree.value[node]), float(tree.weight[node])
        leaf = f < 0
        rows.append({"treeID": number, "nodeData": {
            "id": k, "prediction": value, "impurity": float("nan"), "impurityStats": [weight, weight * value, float("nan")], "rawCount": int(tree.rows[node]),
            "gain": -1.0 if leaf else float(tree.gain[node]), "leftChild": -1 if leaf else at[2 * node + 1], "rightChild": -1 if leaf else at[2 * node + 2],
            "split": {"featureIndex": f, "leftCategoriesOrThreshold": [] if leaf else [float(thresholds[f][tree.cut[node]])], "numCategories": -1}}})
    return rows


def spark_model(spark: SparkSession, trees: Sequence[tuple[Tree, float]], thresholds: Sequence[np.ndarray], uid: str) -> GBTClassificationModel:
    """These trees as a model of Spark ML, read from its own file format: objects made one by one from here would take minutes."""
    jvm, ml, new = spark._jvm, spark._jvm.org.apache.spark.ml, spark.sparkContext._gateway.new_array
    leaf = ml.tree.LeafNode(0.0, 0.0, jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(new(jvm.double, 3), 0))
    made, rates = new(ml.regression.DecisionTreeRegressionModel, len(trees)), new(jvm.double, len(trees))
    for k, (_, rate) in enumerate(trees):
        made[k], rates[k] = ml.regression.DecisionTreeRegressionModel(f"{uid}_{k}", leaf, len(thresholds)), rate
    path = f"{run_folder(spark)}/model-{uuid.uuid4().hex}"
    ml.classification.GBTClassificationModel(uid, made, rates, len(thresholds), 2).write().save(path)
    nodes = pa.Table.from_pylist([r for k, (t, _) in enumerate(trees) for r in node_rows(k, t, thresholds)], NODES)
    spark.createDataFrame(nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
