"""Gradient-boosted trees on Spark: histograms of binned rows in tasks, splits on the driver.

The model is that of Spark's own boosted trees: bins at weighted quantiles of a sample,
trees of least squares on the loss's negative gradient, the first on the labels
themselves, rows drawn per tree and features per node. Without draws the scores equal
Spark's. What differs is the cost of a pass: rows are held as numpy blocks of packed bins
rather than as one object each, so a pass takes a fraction of the time.

A pass adds up, per node and bin, the rows, weights and gradients; a task sends one row
of these sums, whose size depends on features and bins alone. Sums are added in a fixed
order and draws follow the block, so a fit of the same input gives the same trees.
"""

from __future__ import annotations

import json
import math
import pickle
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.runtime import cut_lineage

# Tasks ship this module by value, so executors need not have it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of Spark's trees: bins of a feature, least rows of the sample that sets them.
MAX_BINS, SAMPLE_ROWS = 32, 10_000
# Rows of a block, and of a task at least and at most; joint cells of features counted at once.
BLOCK_ROWS, LEAST_ROWS, TASK_ROWS, CELLS = 16_384, 50_000, 4_000_000, 2_048
# Trees that passes apply anew before the scores so far are stored; splits one word holds.
PENDING, WORD = 8, 63


@dataclass
class Tree:
    """Nodes in heap order: feature (-1: leaf), last bin to the left, its threshold, value."""

    feature: list[int]
    cut: list[int]
    threshold: list[float]
    value: list[float]

    @classmethod
    def of(cls, depth: int) -> Tree:
        nodes = 2 ** (depth + 1) - 1
        return cls([-1] * nodes, [0] * nodes, [0.0] * nodes, [0.0] * nodes)

    def walk(self, n: int, goes_right) -> np.ndarray:
        """Node of each row; ``goes_right(node)`` says for every row whether it would."""
        node, first = np.zeros(n, np.int32), 0
        while first < len(self.feature):
            step = np.zeros(n, np.int32)
            splits = [i for i in range(first, 2 * first + 1) if self.feature[i] >= 0]
            for i in splits:
                step += (node == i) * (goes_right(i) + np.int32(i + 1))
            if not splits:
                break
            node += step
            first = 2 * first + 1
        return node


class Layout:
    """Joint cells of several features: their histogram gives that of each feature."""

    def __init__(self, thresholds: list[np.ndarray]):
        self.thresholds = thresholds
        self.sizes = [len(t) + 1 for t in thresholds]
        self.groups, self.place = [], {}
        for j in sorted(range(len(self.sizes)), key=lambda j: (-self.sizes[j], j)):
            if self.sizes[j] == 1:
                continue
            g = next((g for g, size in enumerate(self.groups) if size * self.sizes[j] <= CELLS), None)
            if g is None:
                g = len(self.groups)
                self.groups.append(1)
            self.place[j] = (g, self.groups[g])
            self.groups[g] *= self.sizes[j]
        self.features = sorted(self.place)
        self.starts = np.cumsum([0] + [self.sizes[j] for j in self.features])

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.groups), len(x)), np.uint16)
        for j, (g, stride) in self.place.items():
            out[g] += (np.searchsorted(self.thresholds[j], x[:, j]) * stride).astype(np.uint16)
        return out

    def right(self, tree: Tree, i: int) -> tuple[int, np.ndarray]:
        """Group and, per cell, whether node ``i`` sends it to the right."""
        j = tree.feature[i]
        g, stride = self.place[j]
        return g, np.arange(self.groups[g]) // stride % self.sizes[j] > tree.cut[i]

    def by_feature(self, g: int, sums: np.ndarray, out: np.ndarray) -> None:
        """Adds a group's sums (slots, cells) to those of its features (slots, bins)."""
        for at, j in enumerate(self.features):
            if self.place[j][0] == g:
                shape = (len(sums), -1, self.sizes[j], self.place[j][1])
                out[:, self.starts[at] : self.starts[at + 1]] += sums.reshape(shape).sum(axis=(1, 3))


class Walks:
    """Nodes that rows reach in some trees.

    A group's table gives per cell a bit for each split on one of its features, so one look-up
    a group serves all trees of a word; a tree's bits then give the node.
    """

    def __init__(self, layout: Layout, trees: list[Tree]):
        self.trees, self.words, self.deep = trees, [], {}
        for t, tree in enumerate(trees):
            splits = [i for i, j in enumerate(tree.feature) if j >= 0]
            if len(splits) > 12:  # too many for a table of all outcomes
                self.deep[t] = {i: layout.right(tree, i) for i in splits}
                continue
            if not self.words or self.words[-1][0] + len(splits) > WORD:
                self.words.append([0, {}, []])
            word = self.words[-1]
            for bit, i in enumerate(splits):
                g, right = layout.right(tree, i)
                word[1].setdefault(g, np.zeros(layout.groups[g], np.int64))
                word[1][g] |= right.astype(np.int64) << (word[0] + bit)
            outcome = np.arange(1 << len(splits))
            node = tree.walk(len(outcome), lambda i: (outcome >> splits.index(i) & 1).astype(np.int32))  # noqa: B023
            word[2].append((t, word[0], node))
            word[0] += len(splits)

    def each(self, cells: np.ndarray):
        """(tree, table, index): row r reaches node ``table[index[r]]``."""
        n = cells.shape[1]
        for _, tables, members in self.words:
            bits = np.zeros(n, np.int64)
            for g, table in tables.items():
                bits |= table.take(cells[g])
            for t, at, node in members:
                yield t, node, (bits >> at if at else bits) & (len(node) - 1)
        for t, tables in self.deep.items():
            tree = self.trees[t]
            yield t, np.arange(len(tree.feature)), tree.walk(n, lambda i: tables[i][1].take(cells[tables[i][0]]).astype(np.int32))  # noqa: B023


def _small(values: np.ndarray) -> np.ndarray:
    """The same numbers in a byte each where that holds them exactly."""
    with np.errstate(invalid="ignore"):
        byte = values.astype(np.int8)
    return byte if (byte == values).all() else values


def _scores(block, walks: Walks, weights: list[float]) -> np.ndarray:
    """Scores so far: those stored and the trees since, each with its weight."""
    f = block[5]
    added = dict.fromkeys(range(len(weights)))
    for t, node, index in walks.each(block[2]):
        added[t] = (weights[t] * np.asarray(walks.trees[t].value).take(node)).take(index)
    for values in added.values():  # in the order of the trees
        f = f + values
    return f


def _drawn(block, seed: int, round_: int, share: float) -> np.ndarray:
    draw = np.random.Generator(np.random.SFC64([seed & 0xFFFFFFFF, round_, block[0], block[1]]))
    return draw.integers(0, 1 << 32, len(block[5]), dtype=np.uint32) < share * (1 << 32)


def residual(loss: str, y: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Negative gradient of log loss on labels -1 and 1, or of squared error."""
    if loss == "log":
        with np.errstate(over="ignore"):
            return 4.0 * y / (1.0 + np.exp(2.0 * y * f))
    return 2.0 * (y - f)


def _packed(layout: Layout, loss: str, weighted: bool):
    """Task that turns rows (label, weight, values) into blocks, each an Arrow row."""

    def run(stream):
        pid, k, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def block(parts):
            x, y, w = (np.concatenate(p) for p in zip(*parts))
            parts = [layout.cells(x), _small(2.0 * y - 1.0 if loss == "log" else y), _small(w) if weighted else None]
            values = [pid, k, pickle.dumps(parts, 5), len(y)]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["pid", "k", "rows", "n"])

        for batch in stream:
            if not batch.num_rows:
                continue
            if any(batch.column(i).null_count for i in range(3)):
                raise ValueError("a label, a weight or the features of a row are null")
            y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(layout.sizes))
            if not (np.isfinite(y).all() and np.isfinite(x).all()):
                raise ValueError("a label or a feature is not a finite number")
            if loss == "log" and not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("the label of a classifier is 0 or 1")
            for at in range(0, len(y), BLOCK_ROWS):
                part = slice(at, at + BLOCK_ROWS)
                if rows and rows + len(y[part]) > BLOCK_ROWS:
                    yield block(held)
                    k, held, rows = k + 1, [], 0
                held.append((x[part], y[part], w[part]))
                rows += len(y[part])
        if rows:
            yield block(held)

    return run


def _opened(stream):
    """Task that reads blocks: (pid, number, cells, labels, weights or none, scores)."""
    for pid, k, rows, n in stream:
        yield (pid, k, *pickle.loads(rows), np.zeros(n))


def _advanced(layout: Layout, trees: list):
    """Task that stores the scores with ``trees`` applied."""

    def run(stream):
        walks = Walks(layout, [tree for tree, _ in trees])
        for block in stream:
            yield (*block[:5], _scores(block, walks, [weight for _, weight in trees]))

    return run


def _level_sums(layout: Layout, loss: str, seed: int, share: float, trees: list, tree: Tree, wanted: list[int], round_: int):
    """Task that adds up rows, weights and gradients per wanted node and bin."""

    def run(part, stream):
        walks, here = Walks(layout, [t for t, _ in trees]), Walks(layout, [tree])
        slots = len(wanted)
        slot_of = np.full(len(tree.feature), slots)  # one more slot for rows that are not wanted
        slot_of[wanted] = np.arange(slots)
        sums = [[np.zeros(slots * size) for size in layout.groups] for _ in range(3)]
        whole = np.zeros((3, slots))
        for block in stream:
            cells, y, w = block[2:5]
            [(_, node, index)] = here.each(cells)
            slot = slot_of.take(node).take(index)
            if share < 1.0:
                slot[~_drawn(block, seed, round_, share)] = slots
            r = y.astype(np.float64) if round_ == 0 else residual(loss, y, _scores(block, walks, [weight for _, weight in trees]))
            wr = r if w is None else w * r
            kept = np.flatnonzero(slot < slots)
            slot, wr, w = slot[kept], wr[kept], None if w is None else w[kept].astype(np.float64)
            for what, values in enumerate((None, w, wr)):
                whole[what] += np.bincount(slot, values, slots)
            for g, size in enumerate(layout.groups):
                at = cells[g].take(kept).astype(np.int64)
                if slots > 1:
                    at += slot * size
                count = np.bincount(at, minlength=slots * size)
                sums[0][g] += count
                sums[1][g] += count if w is None else np.bincount(at, w, slots * size)
                sums[2][g] += np.bincount(at, wr, slots * size)
        out = np.zeros((3, slots, layout.starts[-1]))
        for what in range(3):
            for g, size in enumerate(layout.groups):
                layout.by_feature(g, sums[what][g].reshape(slots, size), out[what])
        yield part, np.concatenate([whole.ravel(), out.ravel()])

    return run


def thresholds_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` cuts at weighted quantiles, half-way between values."""
    value, place = np.unique(values, return_inverse=True)
    if len(value) <= bins:
        return (value[:-1] + value[1:]) / 2.0
    weight = np.bincount(place, weights)
    stride = weight.sum() / bins
    cuts, so_far, target = [], weight[0], stride
    for i in range(1, len(value)):
        before, so_far = so_far, so_far + weight[i]
        if abs(before - target) < abs(so_far - target):
            cuts.append((value[i - 1] + value[i]) / 2.0)
            target += stride
    return np.array(cuts)


def best_split(layout: Layout, count: np.ndarray, weight: np.ndarray, total: np.ndarray, features, min_rows: int, min_gain: float):
    """(feature, last bin to the left, values of both sides, whether the left has no more rows) of one node, or none."""
    best, found = 0.0, None
    for j in features:
        if j not in layout.place:
            continue
        at = layout.features.index(j)
        part = slice(layout.starts[at], layout.starts[at + 1])
        n, w, s = (np.cumsum(v[part]) for v in (count, weight, total))
        nl, wl, sl = n[:-1], w[:-1], s[:-1]
        nr, wr, sr = n[-1] - nl, w[-1] - wl, s[-1] - sl
        ok = (nl >= max(1, min_rows)) & (nr >= max(1, min_rows))
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, (sl**2 / wl + sr**2 / wr - s[-1] ** 2 / w[-1]) / w[-1], -np.inf)
        i = int(np.argmax(gain))
        if gain[i] >= min_gain and gain[i] > max(best, 1e-14 * (s[-1] / w[-1]) ** 2):
            best, found = gain[i], (j, i, sl[i] / wl[i], sr[i] / wr[i], nl[i] <= nr[i])
    return found


class BoostedTrees(Estimator):
    """Fits on columns ``label`` and ``features`` (an array or a vector) and, if named, ``weight``."""

    def __init__(self, label: str, loss: str, rounds: int, depth: int, rate: float, subsample: float = 1.0, columns: float = 1.0, min_gain: float = 0.0, min_rows: int = 1, seed: int = 0, weight: str | None = None):
        super().__init__()
        self.label, self.loss, self.rounds, self.depth, self.rate = label, loss, rounds, depth, rate
        self.subsample, self.columns, self.min_gain, self.min_rows = subsample, columns, min_gain, min_rows
        self.seed, self.weight = seed, weight

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = dataset.select(F.col(self.label).cast("double").alias("y"), weight.alias("w"), _array(dataset).alias("x"))
        n = rows.count()
        if not n:
            raise ValueError("no rows to fit trees on")
        layout = Layout(self._thresholds(rows, n))
        state, stored = self._state(rows, layout, n), []
        trees, pending = [], []
        draw = np.random.default_rng(self.seed)
        for round_ in range(self.rounds):
            tree = self._tree(state, layout, pending, round_, draw)
            for old in stored:
                old.unpersist()  # its successor is held now
            stored = []
            trees.append((tree, self.rate if round_ else 1.0))
            pending.append(trees[-1])
            if len(pending) == PENDING and round_ + 1 < self.rounds:
                stored = [state]
                state, pending = state.mapPartitions(_advanced(layout, pending)).persist(StorageLevel.MEMORY_AND_DISK), []
        for old in [*stored, state]:
            old.unpersist()
        packed = [[t.feature, t.threshold, t.value, weight] for t, weight in trees]
        return BoostedModel()._set(trees=json.dumps(packed), loss=self.loss)

    def _thresholds(self, rows: DataFrame, n: int) -> list[np.ndarray]:
        """Bins from a sample that is bounded as Spark's is; every row is binned."""
        bins = min(MAX_BINS, n)
        share = min(1.0, max(bins**2, SAMPLE_ROWS) / n)
        table = (rows.sample(False, share, self.seed) if share < 1.0 else rows).select("w", "x").toArrow()
        if not table.num_rows:
            table = rows.select("w", "x").limit(SAMPLE_ROWS).toArrow()
        x = np.array(table.column("x").to_pylist(), np.float64)
        w = table.column("w").to_numpy()
        return [thresholds_of(x[:, j], w, bins) for j in range(x.shape[1])]

    def _state(self, rows: DataFrame, layout: Layout, n: int) -> RDD:
        """Blocks dealt evenly to a task a core, fewer for few rows, more when a task would get many."""
        packed = rows.mapInArrow(_packed(layout, self.loss, self.weight is not None), "pid long, k long, rows binary, n long")
        blocks = cut_lineage(packed)
        counts = {r["pid"]: r["n"] for r in blocks.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}
        last = max(counts)
        offset = np.cumsum([0] + [counts.get(p, 0) for p in range(last)]).tolist()
        cores = blocks.sparkSession.sparkContext.defaultParallelism
        parts = min(max(min(cores, -(-n // LEAST_ROWS)), -(-n // TASK_ROWS)), sum(counts.values()))
        rank = F.element_at(F.lit(offset), (F.col("pid") + 1).cast("int")) + F.col("k")
        dealt = blocks.repartitionById(parts, (rank % parts).cast("int")).sortWithinPartitions("pid", "k")
        return dealt.rdd.mapPartitions(_opened).persist(StorageLevel.MEMORY_AND_DISK)

    def _tree(self, state: RDD, layout: Layout, pending: list, round_: int, draw) -> Tree:
        """One tree, a pass a level. Of two children only the one of fewer rows is added up; the other is the rest."""
        tree, level, known = Tree.of(self.depth), [(0, None, None)], {}
        width, bins = len(layout.sizes), layout.starts[-1]
        while level:
            wanted = [i for i, _, _ in level]
            task = _level_sums(layout, self.loss, self.seed, self.subsample, pending, tree, wanted, round_)
            sent = sorted(state.mapPartitionsWithIndex(task).collect(), key=lambda r: r[0])
            whole, sums = np.split(np.sum([r[1] for r in sent], axis=0), [3 * len(wanted)])
            sums = sums.reshape(3, len(wanted), bins)
            if not known:
                whole = whole.reshape(3, 1)[:, 0]
                tree.value[0] = float(whole[2] / whole[1]) if whole[1] else 0.0
            found = {}
            for slot, (i, parent, sibling) in enumerate(level):
                found[i] = sums[:, slot]
                if sibling is not None:
                    found[sibling] = known[parent] - sums[:, slot]
            known, level = found, []
            for i in sorted(known) if self.depth else []:
                take = math.ceil(self.columns * width)
                features = sorted(draw.choice(width, take, replace=False).tolist()) if take < width else range(width)
                split = best_split(layout, *known[i], features, self.min_rows, self.min_gain)
                if not split:
                    continue
                j, cut, left, right, few = split
                tree.feature[i], tree.cut[i], tree.threshold[i] = j, cut, float(layout.thresholds[j][cut])
                tree.value[2 * i + 1], tree.value[2 * i + 2] = float(left), float(right)
                if 4 * i + 3 < len(tree.feature):  # its children may split
                    level.append((2 * i + 1, i, 2 * i + 2) if few else (2 * i + 2, i, 2 * i + 1))
        return tree


def _array(df: DataFrame) -> Column:
    return F.col("features") if isinstance(df.schema["features"].dataType, T.ArrayType) else vector_to_array("features")


class BoostedModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction``: the value, or the probability of label 1."""

    trees = Param(Params._dummy(), "trees", "features, thresholds, values and weight of each tree")
    loss = Param(Params._dummy(), "loss", "log or squared")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = [(Tree(f, [], t, v), w) for f, t, v, w in json.loads(self.getOrDefault("trees"))]
        log = self.getOrDefault("loss") == "log"

        def predict(features: pa.Array) -> pa.Array:
            n = len(features)
            x = np.ascontiguousarray(features.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T)
            out = np.zeros(n)
            for tree, weight in trees:
                node = tree.walk(n, lambda i: ~(x[tree.feature[i]] <= tree.threshold[i]))  # noqa: B023
                out += weight * np.asarray(tree.value).take(node)
            with np.errstate(over="ignore"):
                return pa.array(1.0 / (1.0 + np.exp(-2.0 * out)) if log else out)

        return dataset.withColumn("prediction", F.arrow_udf(predict, "double")(_array(dataset)))
