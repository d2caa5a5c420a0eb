"""Game documents to feature rows, gap sessions and session features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.functions import scalars as S
from gapline.operators.ordered import MAX_GROUP_ROWS, Ordered, arrange

DEFAULT_GAP_MINUTES = 60


def feature_rows(games: DataFrame, player: Column, zone: str = "UTC") -> DataFrame:
    """Flat row per game document for ``player`` (a literal or a column).

    Keeps a ``player`` column, so one frame can hold many players.
    """
    g = F.col
    white, black = g("players.white"), g("players.black")
    side = S.player_side(white["user"]["name"], player)
    created, last = F.coalesce(g("createdAt"), F.lit(0)), S.last_or_created(g("lastMoveAt"), g("createdAt"))
    engine = S.engine_defaults(g("cq_engine"))
    hour = S.local_hour(created, zone)
    return games.select(
        player.alias("player"),
        F.coalesce(g("id"), F.lit("")).alias("game_id"),
        created.alias("created_at_ms"),
        last.alias("last_move_at_ms"),
        side.alias("user_color"),
        *[c.alias(name) for name, c in engine.items()],
        S.rating_change(white["ratingDiff"], black["ratingDiff"], side).alias("rating_diff"),
        S.player_result(g("winner"), side).alias("result"),
        S.seconds_per_move(created, last, S.move_count(g("moves"))).alias("my_avg_secs_per_move"),
        S.time_of_day(hour).alias("tod_label"),
    )


def enrich(games: DataFrame, player: Column, timeline: str) -> DataFrame:
    """Fill ``cq_engine`` from supplied analysis or from the timeline column."""
    side = S.player_side(F.col("players.white.user.name"), player)
    summary = S.engine_summary(
        F.col("analysis"), F.col("players.white.analysis"), F.col("players.black.analysis"), side, F.col(timeline)
    )
    fields = [F.col("_engine")[f].alias(f) for f in S.ENGINE_FIELDS + ["engine_source"]]
    used = F.when(F.col("_engine.engine_source") == S.SOURCE_COMPUTED, F.col(timeline))
    return (
        games.withColumn("_engine", summary)
        .withColumn("cq_engine", F.struct(used.alias("eval_timeline_cp"), *fields))
        .drop("_engine")
    )


def gap_sessions(
    df: DataFrame,
    time_col: str,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
    by=(),
    tie=(),
    session_col: str = "session_id",
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Labelled sessions, ``session_00001`` on: new when the gap is strictly longer.

    Text times are parsed as UTC, numbers are epoch milliseconds. A time that cannot be
    parsed becomes null, sorts last, and each such row starts its own session.
    """
    if isinstance(df.schema[time_col].dataType, T.NumericType):
        parsed = F.timestamp_millis(F.col(time_col).try_cast("bigint"))
    else:
        parsed = F.col(time_col).cast("string").try_cast("timestamp")
    work = df.withColumn(time_col, parsed).withColumn("_late", F.col(time_col).isNull().cast("int"))
    line = arrange(work, by, ["_late", time_col, *tie], max_rows).scan({"_prev": ("lag", time_col)})
    gap = (F.unix_micros(F.col(time_col)) - F.unix_micros(F.col("_prev"))) / 60_000_000
    line = line.with_columns({"_new": F.when(gap.isNull() | (gap > gap_minutes), 1).otherwise(0)})
    line = line.scan({"_no": ("sum", "_new")})
    label = F.format_string("session_%05d", F.col("_no"))
    return line.result().withColumn(session_col, label).drop("_late", "_prev", "_new", "_no")


def start_gap_sessions(
    rows: DataFrame,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
    by: str = "player",
    max_rows: int = MAX_GROUP_ROWS,
    streaks: bool = False,
) -> Ordered:
    """Gap between starts in ms and the integer session id, both per player.

    With ``streaks`` the same two scans also find the last non-loss before each row.
    """
    line = arrange(rows, [by], ["created_at_ms", "game_id"], max_rows)
    first = {"_prev": ("lag", "created_at_ms")}
    if streaks:
        first["_rn"] = ("count",)
    line = line.scan(first)
    line = line.with_columns({"time_gap_ms": F.col("created_at_ms") - F.col("_prev")})
    opens = F.col("time_gap_ms").isNull() | (F.col("time_gap_ms") > int(gap_minutes * 60_000))
    line = line.with_columns({"_new": F.when(opens, 1).otherwise(0)})
    second = {"session_id": ("sum", "_new")}
    if streaks:
        line = line.with_columns({"_safe": F.when(F.col("result") != 0.0, F.col("_rn"))})
        second["_last_safe"] = ("max", "_safe")
    line = line.scan(second)
    return line.with_df(line.df.drop("_prev", "_new", "_safe"))


def session_totals(line: Ordered) -> DataFrame:
    """First and last start, games and P/L per session of an ordered frame.

    Plain merging aggregates, so a hot player or session is no burden.
    """
    return line.df.groupBy(*line.by, "session_id").agg(
        F.min("created_at_ms").alias("session_start_ms"),
        F.max("created_at_ms").alias("last_start_ms"),
        F.count(F.lit(1)).alias("n_games"),
        F.sum("rating_diff").alias("session_pl"),
    )


def session_features(line: Ordered, per_session_streak: bool = False) -> Ordered:
    """Position, running P/L, pace, breaks, streaks, rolling means and one-hot times.

    Takes a line made with ``streaks=True``. The streak length is the distance to
    the last non-loss, so a running maximum replaces a second grouping. By default
    it keeps a known quirk: streaks run across sessions, and losses before a
    player's first non-loss count from 0. ``per_session_streak`` restarts in every
    session and counts those from 1.
    """
    by = [*line.by, "session_id"]
    line = line.scan(
        {
            "games_played": ("count",),
            "session_pl": ("sum", "rating_diff"),
            "first_speed": ("first", "my_avg_secs_per_move"),
            "prev_game_end_ms": ("lag", "last_move_at_ms"),
        },
        by=by,
    )
    pause = F.coalesce(F.col("created_at_ms") - F.col("prev_game_end_ms"), F.lit(0)) / 1000.0
    lost = F.col("result") == 0.0
    start = F.coalesce(F.col("_last_safe"), F.lit(1))
    if per_session_streak:
        # The row before the session's first is the earliest a streak can start after.
        start = F.greatest(F.coalesce(F.col("_last_safe"), F.lit(0)), F.col("_rn") - F.col("games_played"))
    line = line.with_columns(
        {
            "is_loss": lost.cast("long"),
            "speed_vs_start": F.col("my_avg_secs_per_move") / (F.col("first_speed") + 0.001),
            "break_time_sec": F.greatest(pause, F.lit(0.0)),
            "loss_streak": F.when(lost, F.col("_rn") - start).otherwise(F.lit(0).cast("long")),
        }
    )
    line = line.with_df(line.df.drop("_rn", "_last_safe")).rolling_mean(
        {"roll_5_acpl_mean": "my_acpl", "roll_5_time_per_move": "my_avg_secs_per_move"}, 5, by=by
    )
    return line.with_columns(
        {"log_break_time": F.log1p("break_time_sec"), **S.one_hot_time_of_day(F.col("tod_label"))}
    )


def attach_peak(line: Ordered) -> Ordered:
    """Session maximum, whether a row is at it, and the first such position."""
    entry = F.struct((-F.col("session_pl")).alias("neg"), F.col("games_played").alias("pos"))
    line = line.with_columns({"_entry": F.when(F.col("session_pl").isNotNull(), entry)})
    line = line.scan({"_top": ("total_min", "_entry")}, by=[*line.by, "session_id"])
    line = line.with_columns({"session_max": -F.col("_top.neg"), "first_max_game": F.col("_top.pos")})
    line = line.with_columns(
        {
            "is_max": F.col("session_pl") == F.col("session_max"),
            "target": (F.col("games_played") == F.col("first_max_game")).cast("tinyint"),
        }
    )
    return line.with_df(line.df.drop("_entry", "_top"))


def feature_line(
    rows: DataFrame,
    gap_minutes: float = DEFAULT_GAP_MINUTES,
    max_rows: int = MAX_GROUP_ROWS,
    per_session_streak: bool = False,
) -> Ordered:
    """Feature rows to the full feature table with its label block, still ordered."""
    line = start_gap_sessions(rows, gap_minutes, max_rows=max_rows, streaks=True)
    return attach_peak(session_features(line, per_session_streak))


def feature_table(rows: DataFrame, gap_minutes: float = DEFAULT_GAP_MINUTES, **kw) -> DataFrame:
    return feature_line(rows, gap_minutes, **kw).result()
