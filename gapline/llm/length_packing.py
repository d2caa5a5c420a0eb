"""Packing by optimal length buckets and token-budget batches.

Texts longer than the largest length are cut into pieces of that length; nothing is
lost. The histogram of piece lengths over all rows has at most ``max_len`` entries. A
dynamic programme over it chooses the bucket bounds that minimise padding. Inside a
bucket pieces are numbered globally, in the order of a seeded hash, and every
``budget // bound`` pieces make a batch, so all batches but the last of a bucket are full.

Numbering is by shard: the hash deals pieces to shards, a window numbers a shard, and
the shard's offset comes from counts per (bucket, shard). No bucket meets in one task.

Defined results: null and empty texts are one piece of length 0, padded to the smallest
bound; equal rows are pieces of their own, spread by a number; rows without an id are packed
like others; texts of any length are cut whole into pieces; other columns take no part,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapline.llm.tables import WORDS, partitions, spread_repeats
from gapline.runtime import cut_lineage

MAX_LEN, BUCKETS, BUDGET, SEED = 2048, 16, 65_536, 17


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding.

    lengths ascend and are distinct. Cost of a bucket: its bound times its rows, less
    its tokens; the tokens are the same for any choice, so padded sizes are compared.
    """
    n = len(lengths)
    if n == 0:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    size = lengths.astype(np.float64)
    best = size * rows[1:]  # one bucket over the first i + 1 lengths
    cuts = []
    for _ in range(1, min(buckets, n)):
        # The last bucket holds lengths j + 1 .. i; best[j] pays for those before.
        cost = best[:, None] + size[None, :] * (rows[None, 1:] - rows[1:, None])
        cost[np.tri(n, dtype=bool)] = np.inf  # needs j < i
        j = np.argmin(cost, axis=0)
        new = cost[j, np.arange(n)]
        better = new < best
        cuts.append(np.where(better, j, -1))
        best = np.where(better, new, best)
    out, i = [], n - 1
    for cut in reversed(cuts):
        if i >= 0 and cut[i] >= 0:
            out.append(int(lengths[i]))
            i = int(cut[i])
    out.append(int(lengths[i]))
    return sorted(set(out))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, row_key, piece, start, n_tokens: each text in pieces of at most max_len words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("row_key"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    last = F.greatest(F.ceil(F.col("words") / max_len), F.lit(1)) - 1
    rows = rows.select("doc_id", "row_key", "words", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * max_len
    return rows.select("doc_id", "row_key", "piece", start.alias("start"), F.least(F.col("words") - start, F.lit(max_len).cast("long")).alias("n_tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket (bound), batch, slot, padding."""
    if budget < max_len:
        raise ValueError("the budget of a batch is smaller than its longest piece")
    spark = docs.sparkSession
    all_pieces = cut_lineage(pieces(docs, id_col, text_col, max_len))
    # At most max_len + 1 rows come back.
    histogram = sorted((r["n_tokens"], r["count"]) for r in all_pieces.groupBy("n_tokens").count().collect())
    bounds = optimal_bounds(np.array([n for n, _ in histogram], np.int64), np.array([c for _, c in histogram], np.int64), buckets) or [max_len]
    bucket = F.element_at(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b >= F.col("n_tokens")), 1)
    shards = 4 * partitions(spark)
    # Rows alike in id and text differ by a number, or they would all have one place.
    order = F.xxhash64(F.lit(seed), "row_key", "piece", "spread")
    dealt = spread_repeats(all_pieces.withColumn("key", F.xxhash64("row_key", "piece")), "key").drop("key").select("*", bucket.alias("bucket"), order.alias("place")).withColumn("shard", F.pmod(F.shiftrightunsigned("place", 17), F.lit(shards)))
    counts = dealt.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))  # buckets x shards rows
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("place", "doc_id", "piece")) - 1
    numbered = dealt.withColumn("inside", inside).join(F.broadcast(offsets), ["bucket", "shard"])
    rank = F.col("before") + F.col("inside")
    per_batch = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1))), F.lit(1))
    return numbered.select(
        F.col("doc_id").alias(id_col),
        "piece",
        "start",
        "n_tokens",
        "bucket",
        F.floor(rank / per_batch).alias("batch"),
        F.pmod(rank, per_batch).alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
