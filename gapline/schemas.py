"""Declared schemas. Nothing here is inferred from data."""

from pyspark.sql import types as T

_SIDE_ANALYSIS = T.StructType(
    [
        T.StructField("acpl", T.DoubleType()),
        T.StructField("blunder", T.IntegerType()),
        T.StructField("blunders", T.IntegerType()),
        T.StructField("mistake", T.IntegerType()),
        T.StructField("mistakes", T.IntegerType()),
        T.StructField("inaccuracy", T.IntegerType()),
        T.StructField("inaccuracies", T.IntegerType()),
    ]
)
_SIDE = T.StructType(
    [
        T.StructField("user", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("ratingDiff", T.IntegerType()),
        T.StructField("analysis", _SIDE_ANALYSIS),
    ]
)
ENGINE = T.StructType(
    [
        T.StructField("eval_timeline_cp", T.ArrayType(T.IntegerType())),
        T.StructField("my_acpl", T.DoubleType()),
        T.StructField("my_blunder_count", T.IntegerType()),
        T.StructField("my_mistake_count", T.IntegerType()),
        T.StructField("my_inaccuracy_count", T.IntegerType()),
        T.StructField("largest_eval_drop_cp", T.DoubleType()),
        T.StructField("avg_eval_drop_cp", T.DoubleType()),
        T.StructField("eval_volatility", T.DoubleType()),
        T.StructField("threw_winning_position", T.IntegerType()),
        T.StructField("engine_source", T.StringType()),
    ]
)

# Nested game document, raw or enriched.
GAME = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("createdAt", T.LongType()),
        T.StructField("lastMoveAt", T.LongType()),
        T.StructField("winner", T.StringType()),
        T.StructField("moves", T.StringType()),
        # Only its presence is read, so an element stays an opaque map.
        T.StructField("analysis", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("players", T.StructType([T.StructField("white", _SIDE), T.StructField("black", _SIDE)])),
        T.StructField("cq_engine", ENGINE),
    ]
)

# Logical catalog columns and the source names each resolves from,
# first existing name wins.
CATALOG_ALIASES = {
    "game_id": ["id", "game_id", "gameId"],
    "white_player": ["white", "white_player", "whiteName", "white_name"],
    "black_player": ["black", "black_player", "blackName", "black_name"],
    "white_elo": ["whiteElo", "white_elo", "white_rating"],
    "black_elo": ["blackElo", "black_elo", "black_rating"],
    "winner": ["winner"],
    "victory_status": ["victory_status", "status", "termination"],
    "rated": ["rated"],
    "speed": ["speed"],
    "opening": ["opening", "opening_name"],
    "moves": ["moves", "pgn_moves"],
    "utc_date": ["UTCDate", "utc_date", "utcDate", "date"],
    "created_at": ["createdAt", "created_at", "created_at_ms"],
    "last_move_at": ["lastMoveAt", "last_move_at", "last_move_at_ms"],
}
# Type of a logical column that no source name provides.
CATALOG_TYPES = {
    "white_elo": "double",
    "black_elo": "double",
    "rated": "boolean",
    "utc_date": "date",
    "created_at": "bigint",
    "last_move_at": "bigint",
}

# Model feature contract.
CORE_FEATURES = [
    "my_acpl",
    "my_blunder_count",
    "my_avg_secs_per_move",
    "result",
    "games_played",
    "speed_vs_start",
    "session_pl",
    "loss_streak",
    "roll_5_acpl_mean",
    "roll_5_time_per_move",
    "log_break_time",
    "tod_morning",
    "tod_midday",
    "tod_evening",
    "tod_night",
]
OPTIONAL_FEATURES = [
    "my_mistake_count",
    "my_inaccuracy_count",
    "largest_eval_drop_cp",
    "avg_eval_drop_cp",
    "eval_volatility",
    "threw_winning_position",
]
# Columns that give the label away.
LEAKY_COLUMNS = ["target", "session_max", "is_max", "first_max_game"]
# Columns an experiment leaves out of its features.
EXPERIMENT_DROPS = [
    "game_id",
    "user_color",
    "session_id",
    "created_at_ms",
    "last_move_at_ms",
    "is_max",
    "first_max_game",
    "session_max",
    "target",
]
# Features a report shows first.
REPORT_PREFERRED = [
    "my_acpl",
    "my_blunder_count",
    "largest_eval_drop_cp",
    "avg_eval_drop_cp",
    "eval_volatility",
    "rating_diff",
    "result",
    "my_avg_secs_per_move",
    "games_played",
    "session_pl",
    "speed_vs_start",
    "break_time_sec",
    "loss_streak",
    "roll_5_acpl_mean",
    "roll_5_time_per_move",
    "log_break_time",
]
