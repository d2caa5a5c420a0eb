"""Reading the given tables, and small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sizes them for its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def spread_repeats(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``spread``: 0, or a number of its own for a row whose key others share.

    Takes a written table, whose rows keep their numbers. Keys alone are counted, combined
    in each task; a hot key's rows can be split in the join, as they only look up a flag.
    """
    several = rows.groupBy(key).agg(F.count(F.lit(1)).alias("spread")).where("spread > 1").select(key, F.lit(1).alias("spread"))
    numbered = rows.withColumn("_number", F.monotonically_increasing_id())
    own = F.when(F.col("spread").isNotNull(), F.col("_number")).otherwise(F.lit(0).cast("long"))
    return numbered.join(several, key, "left").withColumn("spread", own).drop("_number")
