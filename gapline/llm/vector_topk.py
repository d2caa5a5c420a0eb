"""Exact top-k inner products by a vector-approximation file.

Every vector has a small approximation: one byte per component, the cell it falls in.
Cells are cut per dimension at quantiles of a bounded sample, finer towards both ends, so
a few large values do not widen the others' cells; the true least and greatest value of
every cell, over all vectors, gives the bounds. For a block of queries the cells are
scanned first: each pair has an upper and a lower bound of its score, and pairs that k
others surely beat are out. Then exact vectors are read in the order of their upper
bounds, in growing rounds, until the k-th exact result is certain.

A pair is cut by (bound, id), not by the bound alone, so where all scores are equal (a
zero query) only the smallest ids are read. Queries are taken in blocks of bounded size; a
block is broadcast, and so are the cells' ranges (256 per dimension). Every ranking keeps
k rows per query, which Spark prunes before its shuffle. Of equal vectors only those with
the 2k smallest ids can be among the best k, so the rest leave before the scan.

Scores are exact whole numbers of any size: sums that might pass 2^62 are taken with
Python's integers, and ranked by them.

Defined results: a vector that is null, empty, or holds a null or non-finite component
takes no part, nor does a row without an id; vectors of different lengths are not
compared. Rows are candidates each for themselves, also those that repeat an id, but not
those with the query's own id; a query id that repeats is a query for each of its rows.
Ties go to the smaller id. With fewer than k candidates all are returned. A score that a
long cannot hold is ranked right and returned as null. Other columns of the input take no
part. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gapline.runtime import cut_lineage

CELLS = 256
TAIL = 16  # cells at each end that hold 1, 2, 4 ... of the sample
SAMPLE_VALUES = 1_000_000  # values the cells are fitted on: the rows of the sample times the longest vector
QUERY_BLOCK = 2048
FIRST_ROUND = 4
CHUNK = 4096
SLACK = 1e-12  # rounding of a sum of doubles, relative to the sum of its terms' sizes
KEY_BYTES = 272  # of a score as a sortable binary; sums of squares of any doubles fit


def scaled(col: str, by: int = 1024) -> Column:
    """floor(by * x) of each component as a whole double, or null where the vector takes no part."""
    x = F.col(col)

    def wider(v: Column) -> Column:
        return F.lit(float(by)) * v.cast("double")

    fine = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(wider(v)) == math.inf))

    def floor(v: Column) -> Column:
        wide = wider(v)
        return F.when(F.abs(wide) < 2.0**52, F.floor(wide).cast("double")).otherwise(wide)  # larger doubles are whole

    return F.when(x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(fine, F.lit(True)), F.transform(x, floor))


def usable_rows(vectors: DataFrame) -> DataFrame:
    whole = vectors.select("vec_id", F.col("vec").cast("array<double>").alias("vec"))
    return whole.where(F.col("vec").isNotNull() & F.col("vec_id").isNotNull())


def distinct_candidates(vectors: DataFrame, k: int) -> DataFrame:
    """Rows that can be among the best k of any query: vec_id, vec, row (a number of its own).

    A query leaves out the rows of one id, at most k of which are kept here per vector.
    """
    own = F.row_number().over(Window.partitionBy("vec", "vec_id").orderBy("vec_id"))
    few = usable_rows(vectors).withColumn("rank", own).where(F.col("rank") <= k).drop("rank")
    order = Window.partitionBy("vec").orderBy("vec_id")
    kept = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * k).drop("rank")
    return cut_lineage(kept.withColumn("row", F.monotonically_increasing_id()))


def cell_edges(vectors: DataFrame) -> list[np.ndarray]:
    """Inner edges of the cells of each dimension, from a sample of bounded size chosen by a hash."""
    most = vectors.agg(F.max(F.size("vec"))).first()[0]
    if most is None:
        return []
    rows = max(CELLS, SAMPLE_VALUES // most)
    drawn = vectors.select("vec", F.xxhash64("row").alias("h")).orderBy("h").limit(rows).collect()
    edges = []
    for d in range(most):
        value = np.sort(np.array([r["vec"][d] for r in drawn if len(r["vec"]) > d] or [0.0]))
        n = len(value)
        tail = [2**i for i in range(TAIL) if 2 ** (i + 1) < n]
        ranks = np.unique(np.concatenate([tail, np.linspace(0, n, CELLS - 2 * TAIL)[1:-1].astype(np.int64), n - np.array(tail, np.int64)]).astype(np.int64))
        edges.append(np.unique(value[ranks[(ranks > 0) & (ranks < n)]])[: CELLS - 1])
    return edges


def _matrices(vec: pa.Array):
    """Rows of equal length as (row numbers in the batch, matrix)."""
    sizes = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        pick = np.flatnonzero(sizes == n)
        yield pick, vec.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False).reshape(len(pick), n)


def approximate(vectors: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """The approximation file: row, vec_id and one cell byte per component."""

    def cells(batches):
        for batch in batches:
            codes: list = [None] * batch.num_rows
            for pick, matrix in _matrices(batch.column("vec")):
                code = np.stack([np.searchsorted(edges[d], matrix[:, d], "right") for d in range(matrix.shape[1])], axis=1).astype(np.uint8)
                for i, c in zip(pick.tolist(), code):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(codes, pa.binary())], ["row", "vec_id", "cells"])

    return vectors.select("row", "vec_id", "vec").mapInArrow(cells, "row long, vec_id long, cells binary")


def cell_ranges(vectors: DataFrame, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each cell over all vectors (dimensions x cells)."""

    def ranges(batches):
        low, high = np.full((len(edges), CELLS), np.inf), np.full((len(edges), CELLS), -np.inf)
        for batch in batches:
            for _, matrix in _matrices(batch.column("vec")):
                for d in range(matrix.shape[1]):
                    code = np.searchsorted(edges[d], matrix[:, d], "right")
                    np.minimum.at(low[d], code, matrix[:, d])
                    np.maximum.at(high[d], code, matrix[:, d])
        d, c = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(c, pa.int32()), pa.array(low[d, c]), pa.array(high[d, c])], ["d", "c", "low", "high"])

    found = vectors.select("vec").mapInArrow(ranges, "d int, c int, low double, high double").groupBy("d", "c").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = np.zeros((len(edges), CELLS)), np.zeros((len(edges), CELLS))
    for r in found.collect():  # at most 256 rows a dimension
        low[r["d"], r["c"]], high[r["d"], r["c"]] = r["low"], r["high"]
    return low, high


def _best(lower: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by (lower, smaller id)."""
    if lower.shape[1] <= k:
        return lower, ids
    bar = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
    maybe = lower >= bar[:, None]
    out_lower, out_ids = np.empty((len(lower), k)), np.empty((len(lower), k), np.int64)
    plain = maybe.sum(axis=1) == k
    out_lower[plain], out_ids[plain] = lower[plain][maybe[plain]].reshape(-1, k), ids[plain][maybe[plain]].reshape(-1, k)
    for i in np.flatnonzero(~plain):  # ties at the bar
        at = np.flatnonzero(maybe[i])
        at = at[np.lexsort((ids[i, at], -lower[i, at]))[:k]]
        out_lower[i], out_ids[i] = lower[i, at], ids[i, at]
    return out_lower, out_ids


def _bar(lower: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th of each row: its bound, and the largest id among those of that bound."""
    if lower.shape[1] < k:
        return np.full(len(lower), -np.inf), np.full(len(lower), np.iinfo(np.int64).max)
    bar = lower.min(axis=1)
    return bar, np.where(lower == bar[:, None], ids, np.iinfo(np.int64).min).max(axis=1)


def _scan(queries, k: int, ranges):
    """Task of the cell scan. queries: length -> (numbers, ids, exact vectors)."""

    def scan(batches):
        np.seterr(over="ignore", invalid="ignore")
        low, high = ranges.value
        mid = low / 2 + high / 2
        # Halves are rounded up, so that both ends stay inside.
        half = np.where(high > low, np.nextafter(np.maximum(high - mid, mid - low), np.inf), 0)
        best = {n: (np.empty((len(q[0]), 0)), np.empty((len(q[0]), 0), np.int64)) for n, q in queries.value.items()}
        for batch in batches:
            rows, ids, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = pc.binary_length(cells).to_numpy()
            for n, (numbers, qids, q) in queries.value.items():
                pick = np.flatnonzero(sizes == n)
                for at in range(0, len(pick), CHUNK):
                    part = pick[at : at + CHUNK]
                    code = np.frombuffer(b"".join(cells.take(pa.array(part)).to_pylist()), np.uint8).reshape(len(part), n)
                    there = np.arange(n)[None, :]
                    m, h = mid[there, code], half[there, code]
                    centre, spread = q @ m.T, np.abs(q) @ h.T
                    slack = SLACK * (np.abs(q) @ np.abs(m).T + spread)
                    upper, lower = np.floor(centre + spread + slack), np.ceil(centre - spread - slack)
                    upper[np.isnan(upper)], lower[np.isnan(lower)] = np.inf, -np.inf  # beyond doubles nothing is known
                    here = np.broadcast_to(ids[part], upper.shape)
                    other = qids[:, None] != here
                    lower[~other] = -np.inf
                    best[n] = _best(np.concatenate([best[n][0], lower], axis=1), np.concatenate([best[n][1], here], axis=1), k)
                    bar, last = _bar(*best[n], k)
                    a, b = np.nonzero(other & ((upper > bar[:, None]) | ((upper == bar[:, None]) & (here <= last[:, None]))))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (numbers[a], rows[part][b], ids[part][b], upper[a, b], lower[a, b])], ["query", "row", "vec_id", "upper", "lower"])

    return scan


def whole_dot(a: np.ndarray, b: np.ndarray) -> int:
    """Exact inner product of two vectors of whole doubles."""
    if np.abs(a) @ np.abs(b) < 2.0**52:
        return int(a @ b)
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))


def floor_double(s: int) -> float:
    """The largest double not above a whole number."""
    try:
        near = float(s)
    except OverflowError:
        return -math.inf if s < 0 else np.finfo(np.float64).max.item()
    return near if int(near) <= s else math.nextafter(near, -math.inf)


def _exact(queries):
    """Scores of pairs: a sortable key, the score as a long if it is one, and a double not above it."""

    def score(batches):
        np.seterr(over="ignore", invalid="ignore")
        held = {int(number): vec for numbers, _, q in queries.value.values() for number, vec in zip(numbers, q)}
        middle = 1 << (8 * KEY_BYTES - 1)
        for batch in batches:
            keys, scores, floors, exact = [], [], [], []
            for number, vec in zip(batch.column("query").to_pylist(), batch.column("vec")):
                s = whole_dot(held[number], vec.values.to_numpy())
                low = floor_double(s)
                keys.append((s + middle).to_bytes(KEY_BYTES, "big"))
                scores.append(s if -(1 << 63) <= s < 1 << 63 else None)
                floors.append(low)
                exact.append(math.isfinite(low) and int(low) == s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), batch.column("row"), batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(scores, pa.int64()), pa.array(floors, pa.float64()), pa.array(exact, pa.bool_())],
                ["query", "row", "vec_id", "key", "score", "low", "exact"],
            )

    return score


def _within(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs that their query's bar (bound, last id) does not cut; a query without a bar keeps all."""
    beaten = (F.col("upper") < F.col("bar")) | ((F.col("upper") == F.col("bar")) & (F.col("vec_id") > F.col("last")))
    return pairs.join(F.broadcast(bars), "query", "left").where(~F.coalesce(beaten, F.lit(False))).drop("bar", "last")


def _search_block(vectors: DataFrame, cells: DataFrame, block: list, k: int, ranges) -> DataFrame:
    spark = vectors.sparkSession
    by_length: dict[int, list] = {}
    for number, row in enumerate(block):
        by_length.setdefault(len(row["vec"]), []).append((number, row["vec_id"], row["vec"]))
    sent = spark.sparkContext.broadcast(
        {n: (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64)) for n, rows in by_length.items()}
    )
    pairs = cut_lineage(cells.mapInArrow(_scan(sent, k, ranges), "query long, row long, vec_id long, upper double, lower double"))
    # Spark prunes a ranking with a limit in each task, so a query's pairs never meet in one.
    first = Window.partitionBy("query").orderBy(F.desc("lower"), "vec_id", "row")
    best = pairs.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    bars = best.where(F.col("n") == k).select("query", F.col("lower").alias("bar"), F.col("vec_id").alias("last"))  # a row per query of the block
    left = cut_lineage(_within(cut_lineage(bars), pairs).drop("lower"))
    top = Window.partitionBy("query").orderBy(F.desc("key"), "vec_id", "row")
    done, reach = None, FIRST_ROUND * k
    while True:
        turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("upper"), "vec_id", "row"))
        now = cut_lineage(left.withColumn("n", turn).where(F.col("n") <= reach))
        read = now.select("query", "row", "vec_id").join(vectors.select("row", "vec"), "row").select("query", "row", "vec_id", "vec")
        scored = read.mapInArrow(_exact(sent), "query long, row long, vec_id long, key binary, score long, low double, exact boolean")
        scored = scored if done is None else done.unionByName(scored)
        done = cut_lineage(scored.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k).drop("n"))
        last = done.withColumn("n", F.row_number().over(top)).where(F.col("n") == k)
        bars = cut_lineage(last.select("query", F.col("low").alias("bar"), F.when(F.col("exact"), F.col("vec_id")).otherwise(F.lit(2**63 - 1)).alias("last")))
        rest = left.join(now.select("query", "row"), ["query", "row"], "left_anti")
        left = cut_lineage(_within(bars, rest))
        if left.isEmpty():
            names = F.broadcast(spark.createDataFrame([(i, r["vec_id"]) for i, r in enumerate(block)], "query long, query_id long"))
            ranked = done.withColumn("rank", F.row_number().over(top))
            return cut_lineage(ranked.join(names, "query").select("query_id", "rank", "vec_id", "score"))
        reach *= 8


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. Both frames have vec_id long and vec, an array of whole numbers.

    A query never finds rows with its own id.
    """
    spark = vectors.sparkSession
    usable = distinct_candidates(vectors, k)
    edges = cell_edges(usable)
    asked = cut_lineage(usable_rows(queries).withColumn("row", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil(asked.count() / query_block)) if edges else 0
    found = None
    if blocks:
        ranges = spark.sparkContext.broadcast(cell_ranges(usable, edges))
        cells = cut_lineage(approximate(usable, edges))
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).collect()  # about query_block rows
        if block:
            part = _search_block(usable, cells, block, k, ranges)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], T.StructType.fromDDL("query_id long, rank int, vec_id long, score long"))
    return found
