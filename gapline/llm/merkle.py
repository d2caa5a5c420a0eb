"""Merkle manifest of a dataset: subtrees in a van Emde Boas layout, a tree per source, a root.

A leaf is the hash of a row's fields. The leaves of a source, in the order of their ids,
are hashed in runs of three until one node remains, the subroot; the subroots, in the
order of their sources, are hashed alike to the root. Every row gets its path: the
siblings left and right of it on every level.

Trees are cut into aligned subtrees of ``HEIGHT`` levels of runs. A subtree is one row and
one array of digests in a van Emde Boas layout: its levels are split at half height, the
top half comes first, then each subtree below it, each laid out in the same way. Where a
node is follows from its depth and index alone (``address``), and both building a subtree
and reading siblings go through it. The roots of the subtrees are the leaves of the next
trees, until each tree is one subtree. So a source of any size is spread over all tasks,
and no task holds more than some subtrees of 3 ** HEIGHT leaves.

Defined results: a null field is hashed as ``-``; empty texts are fields of size 0; rows
without an id come first in their source and rows without a source are one source, before
all others; ties of an id are ordered by leaf, and repeated rows are leaves of their own.
A text is hashed as a whole by Spark, however long. Columns that are not asked for take no
part, and asked for ones may have any name. An empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gapline.llm.tables import partitions
from gapline.runtime import cut_lineage

FAN = 3
HEIGHT = 6  # levels of runs in a subtree: 729 leaves
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as it is hashed: its size in bytes and its text, or a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path as one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "")


def nodes_in(levels: int) -> int:
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes of a depth in the van Emde Boas layout of a complete tree."""
    at = np.zeros(len(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        levels, depth = levels - top, depth - top
        span = FAN**depth
        at += nodes_in(top) + index // span * nodes_in(levels)
        index = index % span
    return at


def height_of(leaves: int) -> int:
    """Levels of runs until one node remains."""
    height = 0
    while FAN**height < leaves:
        height += 1
    return height


class Subtree:
    """An aligned subtree; its last leaves may be missing."""

    def __init__(self, leaves: list, height: int):
        self.height, self.count = height, [0] * height + [len(leaves)]
        self.store = np.zeros(nodes_in(height + 1), "S64")
        self.store[address(height + 1, height, np.arange(len(leaves)))] = leaves
        for depth in range(height, 0, -1):
            below = self.level(depth)
            up = [hashlib.sha256(b"".join(below[i : i + FAN])).hexdigest() for i in range(0, len(below), FAN)]
            self.count[depth - 1] = len(up)
            self.store[address(height + 1, depth - 1, np.arange(len(up)))] = up

    def level(self, depth: int) -> list:
        return self.store[address(self.height + 1, depth, np.arange(self.count[depth]))].tolist()

    def root(self) -> str:
        return self.store[0].decode()

    def beside(self, depth: int) -> tuple[list, list]:
        """What is left and right of each node of a depth within its run."""
        nodes = self.level(depth)
        left = [b"".join(nodes[i - i % FAN : i]) for i in range(len(nodes))]
        right = [b"".join(nodes[i + 1 : i - i % FAN + FAN]) for i in range(len(nodes))]
        return left, right

    def paths(self, above: list) -> pa.Array:
        """The path of every leaf, with the levels above the subtree's root behind it."""
        n, sides, first = self.count[self.height], ([], []), [0]
        for depth in range(self.height, 0, -1):
            for side, found in zip(sides, self.beside(depth)):
                side.extend(found)
            first.append(first[-1] + self.count[depth])
        sides[0].extend(level["left"].encode() for level in above)
        sides[1].extend(level["right"].encode() for level in above)
        leaf, levels = np.arange(n), self.height + len(above)
        at = np.empty((n, levels), np.int64)
        for up in range(self.height):
            at[:, up] = first[up] + leaf // FAN**up
        at[:, self.height :] = first[-1] + np.arange(len(above))
        pick = pa.array(at.ravel())
        values = pa.StructArray.from_arrays([pa.array(s, pa.binary()).cast(pa.string()).take(pick) for s in sides], ["left", "right"])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * levels, pa.int32()), values)


def _subtree(block: int, leaves: list, height: int) -> Subtree:
    """Only a tree's single subtree can be lower than the others: a full one is as high either way."""
    return Subtree(leaves, height if block or len(leaves) == FAN**height else height_of(len(leaves)))


def _block_roots(height: int):
    def run(stream):
        for batch in stream:
            roots = []
            for block, items in zip(batch.column("block").to_pylist(), batch.column("items")):
                roots.append(_subtree(block, items.values.field("digest").to_pylist(), height).root())
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(roots, pa.string())], ["tree", "rank", "digest"])

    return run


def _block_paths(height: int, names: list[str], given: list[str]):
    """A row per node of a block: its own columns, those given for the block, its path."""

    def run(stream):
        for batch in stream:
            for i in range(batch.num_rows):
                block, items = batch.column("block")[i].as_py(), batch.column("items")[i].values
                tree = _subtree(block, items.field("digest").to_pylist(), height)
                paths = tree.paths(batch.column("above")[i].as_py())
                own = [items.field(name) for name in names]
                of_block = [pa.repeat(batch.column(name)[i], len(items)) for name in given]
                yield pa.RecordBatch.from_arrays([*own, *of_block, paths], [*names, *given, "path"])

    return run


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """One row per subtree: tree, block, items (the nodes in order with all their columns)."""
    more = [c for c in nodes.columns if c not in ("tree", "rank")]
    return nodes.groupBy("tree", F.floor(F.col("rank") / FAN**height).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("rank", *more))).alias("items")
    )


def _with_paths(blocks: DataFrame, above: DataFrame, height: int, given: list[str]) -> DataFrame:
    """Every node with its path. above: tree, block, columns given, and the path of the block's root."""
    item = blocks.schema["items"].dataType.elementType
    out = T.StructType([*item.fields, *[T.StructField(g, above.schema[g].dataType) for g in ["tree", *given]]]).add("path", T.DataType.fromDDL(PATH))
    joined = blocks.join(above.withColumnRenamed("path", "above"), ["tree", "block"])
    return joined.mapInArrow(_block_paths(height, item.names, ["tree", *given]), out)


def _above(roots: DataFrame, height: int) -> DataFrame:
    """tree, block, top (the tree's root) and path of every block, from the blocks' roots."""
    if roots.where("rank > 0").isEmpty():
        return roots.select("tree", F.col("rank").alias("block"), F.col("digest").alias("top"), F.array().cast(PATH).alias("path"))
    return climb(roots, height).select("tree", F.col("rank").alias("block"), "top", "path")


def climb(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Each node (tree, rank from 0, digest) with its tree's root ``top`` and its path."""
    blocks = cut_lineage(_blocks(nodes, height))
    roots = cut_lineage(blocks.select("tree", "block", "items").mapInArrow(_block_roots(height), "tree string, rank long, digest string"))
    return cut_lineage(_with_paths(blocks, _above(roots, height), height, ["top"]))


def ranked(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their rank from 0 in their tree; a large tree is spread over the tasks.

    Rows are range partitioned and sorted; a partition's rows of a tree are numbered from
    the count of those before it. Rows that tie in everything are spread by a number.
    """
    spark = nodes.sparkSession
    spread = nodes.withColumn("_spread", F.monotonically_increasing_id())
    keys = [F.col("tree").asc(), *order, F.col("_spread").asc()]
    placed = spread.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop("_spread")
    placed = cut_lineage(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = placed.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    rank = F.col("_before") + F.col("_at") - F.col("_first")
    return placed.join(offsets, ["tree", "_part"]).withColumn("rank", rank).drop("_part", "_at", "_first", "_before")


def manifest(leaves: DataFrame, tree_col: str, order_col: str, leaf_col: str = "leaf", height: int = HEIGHT) -> DataFrame:
    """All columns of the leaves (one row each), with subroot, root and path."""
    names = leaves.columns
    rows = leaves.select(
        F.coalesce(F.concat(F.lit("s"), F.col(tree_col).cast("string")), F.lit("n")).alias("tree"),  # a null tree sorts first
        F.col(leaf_col).alias("digest"),
        F.struct(*names).alias("row"),
    )
    placed = ranked(rows, [F.col("row")[order_col].asc_nulls_first(), F.col("digest").asc()])
    blocks = cut_lineage(_blocks(placed.select("tree", "rank", "digest", "row"), height))
    roots = cut_lineage(blocks.select("tree", "block", "items").mapInArrow(_block_roots(height), "tree string, rank long, digest string"))
    above = cut_lineage(_above(roots, height))
    trees = above.groupBy("tree").agg(F.first("top").alias("digest"))
    tops = ranked(trees.select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "digest"), [F.col("name").asc()])
    tops = climb(tops, height).select(F.col("name").alias("tree"), F.col("top").alias("root"), F.col("path").alias("top_path"))
    above = above.join(tops, "tree").select("tree", "block", F.col("top").alias("subroot"), "root", F.concat("path", "top_path").alias("path"))
    return _with_paths(blocks, above, height, ["subroot", "root"]).select("row.*", "subroot", "root", "path")
