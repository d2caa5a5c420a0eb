"""Gap sessions, session features and their known quirks."""

from pyspark.sql import functions as F

from gapline.operators import sessions as SE
from gapline.operators.ordered import arrange


def rows(spark, items, schema):
    return spark.createDataFrame(items, schema)


HISTORY = (
    "player string, game_id long, created_at_ms long, last_move_at_ms long, my_acpl double, "
    "my_avg_secs_per_move double, result double, rating_diff double, tod_label string"
)


def history(spark, games):
    """games: (player, created minute, result, delta)."""
    data = [
        (p, i, m * 60_000, m * 60_000 + 30_000, float(i), 2.0 + i, r, d, "morning")
        for i, (p, m, r, d) in enumerate(games)
    ]
    return rows(spark, data, HISTORY)


def test_three_times_two_sessions(spark):
    df = rows(
        spark,
        [("2026-01-01T10:00:00Z",), ("2026-01-01T10:30:00Z",), ("2026-01-01T12:15:00Z",)],
        "created_at string",
    )
    out = SE.gap_sessions(df, "created_at", 60)
    assert out.select("session_id").distinct().count() == 2
    assert {r.session_id for r in out.collect()} == {"session_00001", "session_00002"}


def test_gap_equal_to_the_limit_stays_together(spark):
    ms = 3_600_000
    df = rows(spark, [(1, 0), (2, ms), (3, 2 * ms + 1)], "game_id long, created_at_ms long")
    df = df.withColumn("player", F.lit("p"))
    out = SE.start_gap_sessions(df, 60).df.orderBy("game_id").collect()
    assert [r.session_id for r in out] == [1, 1, 2]
    assert [r.time_gap_ms for r in out] == [None, ms, ms + 1]
    text = df.withColumn("at", F.timestamp_millis("created_at_ms").cast("string"))
    labelled = SE.gap_sessions(text, "at", 60).orderBy("game_id").collect()
    assert [r.session_id for r in labelled] == ["session_00001", "session_00001", "session_00002"]


def test_unreadable_times_sort_last_and_stand_alone(spark):
    df = rows(spark, [(1, "x"), (2, "2026-01-01 10:00:00"), (3, None)], "i long, at string")
    out = SE.gap_sessions(df, "at", 60, tie=["i"]).orderBy("i").collect()
    assert [r.session_id for r in out] == ["session_00002", "session_00001", "session_00003"]


def test_streak_crosses_sessions_and_leading_losses_start_at_zero(spark):
    results = [0.0, 0.0, 1.0, 0.0, 0.0, 0.5, 0.0, 0.0]
    minutes = [0, 1, 2, 3, 4, 5, 6, 1000]
    df = history(spark, [("p", m, r, 1.0) for m, r in zip(minutes, results)])
    quirk = SE.feature_table(df, 60).orderBy("game_id").collect()
    assert [r.loss_streak for r in quirk] == [0, 1, 0, 1, 2, 0, 1, 2]
    fixed = SE.feature_table(df, 60, per_session_streak=True).orderBy("game_id").collect()
    assert [r.loss_streak for r in fixed] == [1, 2, 0, 1, 2, 0, 1, 1]


def test_players_do_not_mix(spark):
    df = history(spark, [("a", 0, 1.0, 3.0), ("b", 1, 0.0, -4.0), ("a", 2, 0.0, -1.0), ("b", 3, 0.0, -2.0)])
    out = SE.feature_table(df, 60).orderBy("game_id").collect()
    assert [r.session_pl for r in out] == [3.0, -4.0, 2.0, -6.0]
    assert [r.games_played for r in out] == [1, 1, 2, 2]
    assert [r.target for r in out] == [1, 1, 0, 0]
    assert [r.is_max for r in out] == [True, True, False, False]


def test_breaks_and_pace(spark):
    df = history(spark, [("p", 0, 1.0, 1.0), ("p", 10, 1.0, 1.0)])
    out = SE.feature_table(df, 60).orderBy("game_id").collect()
    assert out[0].break_time_sec == 0.0 and out[1].break_time_sec == 570.0
    assert abs(out[1].speed_vs_start - 3.0 / 2.001) < 1e-12
    assert out[1].roll_5_time_per_move == 2.5
    assert (out[0].tod_morning, out[0].tod_night) == (1, 0)


def test_empty_history(spark):
    assert SE.feature_table(spark.createDataFrame([], HISTORY), 60).count() == 0


def test_one_player_is_the_single_partition_case(spark):
    df = history(spark, [("p", 7 * i, float(i % 2), float(i % 5 - 2)) for i in range(60)])
    plain = SE.feature_table(df, 6).orderBy("game_id").toPandas()
    split = SE.feature_table(df, 6, max_rows=7).orderBy("game_id").toPandas()
    assert plain[sorted(plain)].equals(split[sorted(plain)])


def test_arrange_reports_parts(spark):
    df = history(spark, [("p", i, 1.0, 1.0) for i in range(50)])
    assert not arrange(df, ["player"], ["created_at_ms"], 50).split
    assert arrange(df, ["player"], ["created_at_ms"], 49).split
