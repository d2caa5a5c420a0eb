"""One player's games from a JSON file to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import manifests as M
from gapline.operators import sessions as SE
from gapline.runtime import use_utc
from gapline.sources import scan, sinks


def collect_games(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Delivered NDJSON batches as distinct games, oldest first, with an optional cap."""
    games = M.first_per_key(scan.read_ndjson(use_utc(spark), path), "id", ["createdAt"])
    return M.oldest_first(games, "createdAt", "id", limit)


def build_features(
    spark: SparkSession,
    path: str,
    player: str,
    out: str,
    zone: str = "UTC",
    gap_minutes: float = SE.DEFAULT_GAP_MINUTES,
) -> DataFrame:
    """Enriched game documents to a feature parquet; returns the table read back."""
    games = scan.read_json_array(use_utc(spark), path)
    rows = SE.feature_rows(games, F.lit(player), zone)
    sinks.write_parquet(SE.feature_table(rows, gap_minutes).drop("player"), out)
    return spark.read.parquet(out)
