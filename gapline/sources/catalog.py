"""Raw game shards to the game catalog."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.functions import scalars as S
from gapline.schemas import CATALOG_ALIASES, CATALOG_TYPES
from gapline.sources.scan import SOURCE_FILE


def resolve_aliases(raw: DataFrame) -> DataFrame:
    """Logical columns, each from the first source name present, absent ones as typed nulls.

    Resolved from the schema on the driver, so it costs no job. Adds the length of
    the move text where there is one.
    """
    have = set(raw.columns)
    cols = [F.col(SOURCE_FILE).alias("source_file")]
    for name, candidates in CATALOG_ALIASES.items():
        source = next((c for c in candidates if c in have), None)
        if source is None:
            cols.append(F.lit(None).cast(CATALOG_TYPES.get(name, "string")).alias(name))
        else:
            cols.append(F.col(f"`{source}`").alias(name))
    out = raw.select(*cols)
    return out.withColumn("moves_text_len", S.text_length(F.col("moves")))


def games_catalog(raw: DataFrame) -> DataFrame:
    """One row per game of a raw shard: content key, winner, both timestamps.

    Also resolves the four columns the player selection reads, as nulls when the
    shard lacks them, so catalog and selection compose.
    """
    c = F.col
    key = S.content_key(
        [c(SOURCE_FILE), c("Event"), c("Site"), c("White"), c("Black"), c("UTCDate"), c("UTCTime"), c("movetext")]
    )
    have = set(raw.columns)

    def optional(name: str, dtype: str):
        source = next((s for s in CATALOG_ALIASES[name] if s in have), None)
        return (c(source) if source else F.lit(None)).cast(dtype).alias(name)

    return raw.select(
        key.alias("game_id"),
        c("White").alias("white_player"),
        c("Black").alias("black_player"),
        c("WhiteElo").cast("double").alias("white_elo"),
        c("BlackElo").cast("double").alias("black_elo"),
        c("Result").alias("result"),
        S.winner_from_result(c("Result")).alias("winner"),
        c("UTCDate").alias("utc_date"),
        c("UTCTime").cast("string").alias("utc_time_text"),
        S.zoned_timestamp(c("UTCDate"), c("UTCTime")).alias("game_ts_tz"),
        S.local_timestamp(c("UTCDate"), c("UTCTime")).alias("game_ts"),
        c("ECO").alias("eco"),
        c("Opening").alias("opening"),
        c("Termination").alias("victory_status"),
        c("TimeControl").alias("time_control"),
        c("movetext").alias("moves"),
        c(SOURCE_FILE).alias("source_file"),
        optional("created_at", "string"),
        optional("last_move_at", "string"),
        optional("rated", "boolean"),
        optional("speed", "string"),
    )


def provenance(raw: DataFrame) -> DataFrame:
    """Build time, source files (sorted, as JSON) and rows of a scanned frame.

    Files come from the plan's own listing, so empty ones count too; the row count
    reads no column.
    """
    files = sorted(set(raw.inputFiles()))
    return raw.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("built_at_utc"),
        F.lit(len(files)).cast("long").alias("parquet_file_count"),
        F.lit(json.dumps(files)).alias("parquet_files_json"),
        "n_rows",
    )
