"""Column expressions on hand-made values."""

from pyspark.sql import functions as F

from gapline.functions import scalars as S


def one(spark, col, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(col.alias("x")).first()[0]


def timeline(spark, evals, side):
    df = spark.createDataFrame([(evals, side)], "tl array<int>, side string")
    return df.select(S.timeline_summary(F.col("tl"), F.col("side")).alias("s")).first().s


def test_timeline_by_hand(spark):
    # White plies 1 and 3: 0 -> -60 loses 60, 400 -> 50 loses 350 and throws a win.
    s = timeline(spark, [0, -60, 400, 50, 30], "white")
    assert (s.my_inaccuracy_count, s.my_mistake_count, s.my_blunder_count) == (2, 1, 1)
    assert s.my_acpl == 205.0 and s.largest_eval_drop_cp == 350.0 and s.threw_winning_position == 1
    # Black plies 2 and 4, signs turned: 60 -> -400 loses 460, -50 -> -30 gains.
    s = timeline(spark, [0, -60, 400, 50, 30], "black")
    assert (s.my_inaccuracy_count, s.my_mistake_count, s.my_blunder_count) == (1, 1, 1)
    assert s.my_acpl == 230.0 and s.threw_winning_position == 0


def test_timeline_deviation_and_edges(spark):
    assert abs(timeline(spark, [0, 2, 4], "white").eval_volatility - (8 / 3) ** 0.5) < 1e-12
    short = timeline(spark, [5], "white")
    assert (short.my_acpl, short.largest_eval_drop_cp, short.eval_volatility) == (0.0, 0.0, 0.0)
    empty = timeline(spark, [], "white")
    assert (empty.my_acpl, empty.eval_volatility, empty.threw_winning_position) == (0.0, 0.0, 0)


def test_engine_source_choice(spark):
    from gapline.schemas import GAME

    side = lambda a: {"user": {"name": "Me"}, "ratingDiff": 1, "analysis": a}
    base = {"createdAt": 1, "lastMoveAt": 2, "winner": None, "moves": "", "analysis": None, "cq_engine": None}
    games = [
        {**base, "id": "reuse", "players": {"white": side({"acpl": 12.5, "blunders": 3}), "black": side(None)}},
        {**base, "id": "other-side", "players": {"white": side(None), "black": side({"acpl": 9.0})}},
        {**base, "id": "computed", "players": {"white": side(None), "black": side(None)}},
        {**base, "id": "skipped", "players": {"white": side(None), "black": side(None)}},
    ]
    df = spark.createDataFrame(games, GAME).withColumn(
        "tl", F.when(F.col("id") != "skipped", F.array(F.lit(0), F.lit(-100)))
    )
    from gapline.operators.sessions import enrich, feature_rows

    out = enrich(df, F.lit("me"), "tl")
    e = {r.id: r.cq_engine for r in out.collect()}
    assert e["reuse"].my_acpl == 12.5 and e["reuse"].my_blunder_count == 3 and e["reuse"].eval_volatility is None
    assert e["reuse"].engine_source == e["other-side"].engine_source == S.SOURCE_REUSED
    assert e["other-side"].my_acpl == 0.0
    assert e["computed"].engine_source == S.SOURCE_COMPUTED and e["computed"].my_mistake_count == 1
    assert e["skipped"].engine_source is None
    flat = {r.game_id: r for r in feature_rows(out, F.lit("ME")).collect()}
    assert flat["reuse"].eval_volatility == 0.0 and flat["skipped"].engine_source == "unknown"
    assert flat["reuse"].user_color == "white" and flat["reuse"].result == 0.5


def test_time_of_day_edges(spark):
    df = spark.createDataFrame([(h,) for h in (4, 5, 8, 9, 17, 18, 22, 23, None)], "h int")
    got = [r[0] for r in df.select(S.time_of_day(F.col("h"))).collect()]
    assert got == [
        "night", "morning", "morning", "midday", "midday", "evening", "evening", "night", "unknown",
    ]


def test_local_hour_follows_daylight_saving(spark):
    winter, summer = 1_704_085_200_000, 1_719_810_000_000  # 05:00 UTC both
    assert one(spark, S.local_hour(F.col("ms"), "America/New_York"), ms=winter) == 0
    assert one(spark, S.local_hour(F.col("ms"), "America/New_York"), ms=summer) == 1


def test_event_time_rules(spark):
    def pick(a, b, c, kind="string"):
        df = spark.createDataFrame([(a, b, c)], f"a {kind}, b {kind}, c string")
        return df.select(F.unix_millis(S.event_time(df, "a", "b", "c"))).first()[0]

    assert pick("1704067200123", None, None) == 1704067200123
    assert pick("junk", "2024-01-01 00:00:01", None) == 1704067201000
    assert pick("12345", "2024", "2024-01-02") == 1704153600000
    assert pick(None, None, "never") is None
    assert pick(1704067200123, 5, None, "bigint") == 1704067200123
    assert pick(7, 5, "2024-01-02", "bigint") == 1704153600000


def test_numbers_and_moves(spark):
    for value, kind in [("n/a", "string"), ("NaN", "string"), (float("nan"), "double"), (None, "int")]:
        df = spark.createDataFrame([(value,)], f"v {kind}")
        assert df.select(S.number_or_zero(df, "v")).first()[0] == 0.0
    df = spark.createDataFrame([(True, " 2.5 ")], "b boolean, t string")
    assert tuple(df.select(S.as_number(df, "b"), S.as_number(df, "t")).first()) == (1.0, 2.5)
    assert one(spark, S.move_count(F.col("m")), m="  e4 e5\n Nf3 ") == 3
    assert one(spark, S.move_count(F.col("m")), m="") == 1
    assert one(spark, S.seconds_per_move(F.lit(10_000), F.lit(4_000), F.lit(9))) == 0.0
    assert one(spark, S.seconds_per_move(F.lit(0), F.lit(8_000), F.lit(9))) == 2.0


def test_content_key_counts_null_as_empty(spark):
    import hashlib

    got = one(spark, S.content_key([F.lit("a"), F.lit(None).cast("string"), F.lit("c")]))
    assert got == hashlib.md5(b"a||c").hexdigest()
