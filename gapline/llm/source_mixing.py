"""Mixing sources to temperature weights under a token budget, by Spark expressions alone.

A source's weight is its token share to the power alpha, normalised. Alpha is bisected:
to a target entropy of the weights (a part of the largest possible), or to the smallest
alpha (the most even mix) at which no source is repeated more often than a limit. A
round evaluates a grid of alphas over the source totals in one aggregate; the driver
sees one number per alpha.

Realisation: a source's documents are dealt into blocks of about ``block_tokens``
by a seeded hash. Each epoch of a source orders its blocks by a hash of its own and the
block's documents by another. Blocks are taken whole until the quota ends inside one;
there, documents are taken while the tokens before them are below the quota. So a quota
is overrun by less than one document, and nothing sorts a whole source by document.

Defined results: a null source is a source of its own; null and empty texts count as one
token so that they keep a place; equal rows are drawn each for itself; one source alone has
weight 1; words of a text of any length are counted whole; other columns keep their names and
values, whatever the names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapline.llm.tables import WORDS, partitions, spread_repeats
from gapline.runtime import cut_lineage

BLOCK_TOKENS, SEED, MAX_EPOCHS = 250_000, 29, 2.0
GRID, ROUNDS = 32, 6


def tokens_of(text_col: str = "text") -> Column:
    return F.greatest(F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)), F.lit(1)).cast("long")


def source_totals(rows: DataFrame) -> DataFrame:
    """source, tokens, documents, share of rows (source, tokens)."""
    totals = cut_lineage(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")))
    whole = totals.agg(F.sum("tokens").alias("whole"))
    return cut_lineage(totals.join(F.broadcast(whole)).select("source", "tokens", "documents", (F.col("tokens") / F.col("whole")).alias("share")))


def _measured(totals: DataFrame, alphas: DataFrame, budget: float | None) -> DataFrame:
    """alpha, entropy (part of the largest), epochs (most of any source), cover.

    cover is the budget that just draws every document once.
    """
    powered = totals.join(F.broadcast(alphas)).select("alpha", "tokens", F.pow("share", "alpha").alias("p"))
    norm = powered.groupBy("alpha").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("plogp"), F.max(F.col("p") / F.col("tokens")).alias("most"), F.min(F.col("p") / F.col("tokens")).alias("least"), F.count(F.lit(1)).alias("k"))
    entropy = F.log("z") - F.col("plogp") / F.col("z")
    even = F.when(F.col("k") > 1, entropy / F.log("k")).otherwise(1.0)
    cover = F.col("z") / F.col("least")
    epochs = (cover if budget is None else F.lit(float(budget))) * F.col("most") / F.col("z")
    return norm.select("alpha", "z", even.alias("entropy"), epochs.alias("epochs"), cover.alias("cover"))


def find_alpha(totals: DataFrame, budget: float | None = None, entropy: float | None = None, max_epochs: float | None = MAX_EPOCHS) -> float:
    """Alpha in [0, 1]: that of the target entropy, or the smallest that keeps the epochs' limit.

    Without a budget the mix is as large as it takes to draw every document. Both fall as alpha rises. Where even alpha = 1 repeats a source too often, 1 is taken.
    """
    if (entropy is None) == (max_epochs is None):
        raise ValueError("give a target entropy or a limit of epochs")
    low, high = 0.0, 1.0
    spark = totals.sparkSession
    for _ in range(ROUNDS):
        step = (high - low) / GRID
        alphas = spark.range(GRID + 1).select((F.lit(low) + F.col("id") * step).alias("alpha"))
        fits = F.col("epochs") <= max_epochs if entropy is None else F.col("entropy") <= entropy
        first = _measured(totals, alphas, budget).where(fits).agg(F.min("alpha")).first()[0]
        if first is None:
            return high
        if first <= low:
            return low
        low, high = max(low, first - step), first
    return high


def counted(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, row_key, tokens."""
    return cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), tokens_of(text_col).alias("tokens")))


def draw(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per drawn document and epoch: doc_id, source, tokens, row_key, epoch, block_place, place. See ``draw_counted``."""
    return draw_counted(counted(docs, source_col, id_col, text_col), **how)


def draw_counted(rows: DataFrame, budget: int | None = None, entropy: float | None = None, max_epochs: float | None = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """``draw`` from the rows of ``counted``.

    budget: tokens of the mix; by default the fewest with which every document is drawn.
    """
    spark, totals = rows.sparkSession, source_totals(rows)
    whole = totals.agg(F.sum("tokens")).first()[0]
    if not whole:
        return rows.select("*", F.lit(0).alias("epoch"), F.lit(0).alias("block_place"), F.lit(0).alias("place"))
    alpha = find_alpha(totals, budget, entropy, max_epochs)
    one = spark.range(1).select(F.lit(alpha).alias("alpha"))
    at = _measured(totals, one, budget).first()
    quota = F.round(F.lit(float(at["cover"] if budget is None else budget)) * F.pow("share", F.lit(alpha)) / F.lit(at["z"]))
    plan = cut_lineage(totals.select(F.col("source").alias("of"), quota.alias("quota"), F.ceil(F.col("tokens") / block_tokens).alias("blocks"), F.col("tokens").alias("total")))

    # The plan has a row per source; Spark broadcasts it only if its written size is small.
    # Rows alike in id and text differ by a number, or they would all be in one block.
    dealt = spread_repeats(rows, "row_key").join(plan, F.col("source").eqNullSafe(F.col("of")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row_key", "spread"), F.col("blocks"))).drop("of")
    dealt = cut_lineage(dealt.select("doc_id", "source", "row_key", "spread", "tokens", "block"))
    sizes = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    sizes = sizes.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    epochs = F.ceil(F.col("quota") / F.col("total"))
    turns = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(epochs, F.lit(1)) - 1)))
    # A source's blocks are ordered by hash in shards, which are numbered from the shards before them.
    turns = turns.withColumn("h", F.xxhash64(F.lit(seed), "epoch", "block"))
    turns = cut_lineage(turns.withColumn("shard", F.pmod(F.shiftrightunsigned("h", 17), F.lit(4 * partitions(spark)))))
    shards = turns.groupBy("source", "epoch", "shard").agg(F.sum("block_tokens").alias("shard_tokens"), F.count(F.lit(1)).alias("shard_blocks"))
    earlier = Window.partitionBy("source", "epoch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select(
        F.col("source").alias("of"), F.col("epoch").alias("in_epoch"), F.col("shard").alias("in_shard"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("shard_tokens", "shard_blocks")],
    )
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("epoch") == F.col("in_epoch")) & (F.col("shard") == F.col("in_shard"))
    order = Window.partitionBy("source", "epoch", "shard").orderBy("h", "block")
    inside = F.coalesce(F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumns({"inside": inside, "nth": F.row_number().over(order)}).join(offsets, same)
    before = F.col("shard_tokens") + F.col("inside") + F.col("epoch") * F.col("total")
    turns = turns.select("source", "block", "epoch", "block_tokens", before.alias("before"), "quota", (F.col("shard_blocks") + F.col("nth")).alias("block_place")).where("before < quota")
    turns = cut_lineage(turns)
    keys = [F.col("source").eqNullSafe(F.col("of")), F.col("block") == F.col("in_block")]
    taken = dealt.join(turns.withColumnRenamed("source", "of").withColumnRenamed("block", "in_block"), keys[0] & keys[1])
    whole_blocks = F.col("before") + F.col("block_tokens") <= F.col("quota")
    inside = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64(F.lit(seed + 1), "epoch", "row_key", "spread"), "row_key", "spread", "doc_id")
    sofar = F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = taken.select("doc_id", "spread", "source", "tokens", "row_key", "epoch", "block", "block_place", F.row_number().over(inside).alias("place"), (whole_blocks | (F.col("before") + sofar < F.col("quota"))).alias("in"))
    return placed.where("in").select("doc_id", "source", "tokens", "row_key", "epoch", "block_place", "place")


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it was drawn.

    Rows alike in id and text share their draws evenly.
    """
    known = counted(docs, source_col, id_col, text_col)
    drawn = draw_counted(known, **how)
    times = drawn.groupBy("row_key").agg(F.count(F.lit(1)).alias("times"))
    times = cut_lineage(known.groupBy("row_key").agg(F.count(F.lit(1)).alias("rows")).join(times, "row_key"))
    every = docs.select(
        F.struct("*").alias("row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
    )
    single = every.join(times.where("rows = 1"), "row_key").select("row", F.col("times").alias("own"))
    # Rows alike are numbered by the partition they come from, so that a hot row is not dealt to one task.
    alike = cut_lineage(every.join(times.where("rows > 1"), "row_key"))
    parts = alike.groupBy("row_key", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("row_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("row_key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("row_key", "part").orderBy("at"))
    shared = alike.join(parts, ["row_key", "part"]).select("row", "times", "rows", nth.alias("nth"))
    own = F.floor(F.col("times") / F.col("rows")) + (F.col("nth") <= F.col("times") % F.col("rows")).cast("long")
    shared = single.unionByName(shared.select("row", own.alias("own")))
    return shared.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))).alias("turn")).where("turn > 0").select("row.*")
