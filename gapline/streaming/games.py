"""Game streams: incremental ingest and session totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.operators.manifests import first_per_key

DAY = "created_day"


def game_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """NDJSON files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    key: str = "id",
    created: str = "createdAt",
    created_is_fixed: bool = False,
    once: bool = True,
):
    """Append each game once, however often batches overlap and however late it comes.

    The table is stored by creation day. A batch keeps its first row per key and
    drops keys the table has. Replaying a batch after a failure finds its rows
    already there, so the result is the same. Where copies of a game always carry
    the same creation time, ``created_is_fixed`` limits the look-up to the days of
    the batch, which prunes the table's partitions.
    """
    spark = stream.sparkSession
    match = [DAY, key] if created_is_fixed else [key]

    def append(batch: DataFrame, _batch_id: int) -> None:
        day = F.to_date(F.timestamp_millis(F.coalesce(F.col(created), F.lit(0))))
        fresh = first_per_key(batch.withColumn(DAY, day), key, [created])
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            known = spark.read.schema(fresh.schema).parquet(table).select(*match)
            fresh = fresh.join(known, match, "left_anti")
        fresh.write.mode("append").partitionBy(DAY).parquet(table)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()


def distinct_games(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Continuous form: state is kept for ``delay``, within which copies are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def session_totals(
    games: DataFrame, player: str, time: str, delta: str, gap: str = "60 minutes", delay: str | None = None
) -> DataFrame:
    """Games and P/L per player session, for a stream (with ``delay``) or a batch."""
    if delay is not None:
        games = games.withWatermark(time, delay)
    return (
        games.groupBy(player, F.session_window(time, gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n_games"), F.sum(delta).alias("session_pl"), F.max(time).alias("last_start"))
        .select(player, F.col("session.start").alias("session_start"), "last_start", "n_games", "session_pl")
    )


def open_sessions(spark: SparkSession, checkpoint: str, player: str) -> DataFrame:
    """Sessions that a stream of ``session_totals`` still holds, read from its state.

    The state is that of the last finished batch, so with the stream's output it is
    every session once.
    """
    state = spark.read.format("statestore").load(checkpoint).select("value.*")
    return state.select(
        player,
        F.col("session_window.start").alias("session_start"),
        F.col("max").alias("last_start"),
        F.col("count").alias("n_games"),
        F.col("sum").alias("session_pl"),
    )
