"""Game-like views over the given tables, as frames and as the same view in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.runtime import use_utc
from gapline.sources.scan import file_name

GAP_MINUTES = 720
GAP_HOURS = 12
MARGIN = -15.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column, places: int = 6) -> Column:
    """Six places; adding zero turns a negative zero into zero."""
    return F.round(c.cast("double"), places) + F.lit(0.0)


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def _last_ms() -> Column:
    return _ms() + F.floor(F.col("value") * 1000)


def _name(c: Column) -> Column:
    return F.concat(F.lit("u"), c.cast("string"))


def _opponent() -> Column:
    return F.col("user_id") + F.col("event_id") % 13 + 1


def raw_shard(spark, sf) -> DataFrame:
    """A raw population shard."""
    c = F.col
    e = table(spark, sf, "events").withColumn("filename", file_name(F.col("_metadata.file_path")))
    i = c("event_id")
    clock = F.date_format("ts", "HH:mm:ss")
    return e.select(
        F.when(i % 17 != 0, c("event_type")).alias("Event"),
        c("props").alias("Site"),
        _name(c("user_id")).alias("White"),
        F.when(i % 19 != 0, _name(_opponent())).alias("Black"),
        (1000 + (c("user_id") * 37) % 900 + i % 61).cast("string").alias("WhiteElo"),
        (1000 + (_opponent() * 37) % 900 + i % 53).cast("string").alias("BlackElo"),
        F.when(c("event_type") == "purchase", "1-0").when(c("event_type") == "error", "0-1").otherwise("1/2-1/2").alias(
            "Result"
        ),
        F.date_format("ts", "yyyy-MM-dd").alias("UTCDate"),
        F.when(i % 11 == 0, "n/a").when(i % 7 == 0, F.concat(clock, F.lit("+02"))).otherwise(clock).alias("UTCTime"),
        F.lit("A00").alias("ECO"),
        F.get_json_object("props", "$.k").alias("Opening"),
        F.lit("Normal").alias("Termination"),
        F.lit("180+0").alias("TimeControl"),
        F.concat_ws(" ", c("event_type"), c("props")).alias("movetext"),
        "filename",
    )


RAW_SQL = """raw AS (
  SELECT CASE WHEN event_id % 17 <> 0 THEN event_type END AS "Event", props AS "Site", 'u' || user_id AS "White",
    CASE WHEN event_id % 19 <> 0 THEN 'u' || (user_id + event_id % 13 + 1) END AS "Black",
    CAST(1000 + (user_id * 37) % 900 + event_id % 61 AS VARCHAR) AS "WhiteElo",
    CAST(1000 + ((user_id + event_id % 13 + 1) * 37) % 900 + event_id % 53 AS VARCHAR) AS "BlackElo",
    CASE event_type WHEN 'purchase' THEN '1-0' WHEN 'error' THEN '0-1' ELSE '1/2-1/2' END AS "Result",
    strftime(ts, '%Y-%m-%d') AS "UTCDate",
    CASE WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN strftime(ts, '%H:%M:%S') || '+02'
      ELSE strftime(ts, '%H:%M:%S') END AS "UTCTime",
    'A00' AS "ECO", json_extract_string(props, '$.k') AS "Opening", 'Normal' AS "Termination",
    '180+0' AS "TimeControl", event_type || ' ' || props AS movetext, 'events.parquet' AS filename
  FROM events)"""


def catalog(spark, sf) -> DataFrame:
    """Catalog as the player selection reads it."""
    c = F.col
    i = c("event_id")
    winner = F.when(c("event_type") == "purchase", "white").when(c("event_type") == "error", "black")
    return table(spark, sf, "events").select(
        i.cast("string").alias("game_id"),
        _name(c("user_id")).alias("white_player"),
        _name(_opponent()).alias("black_player"),
        (1000 + (c("user_id") * 37) % 900 + i % 61).cast("double").alias("white_elo"),
        (1000 + (_opponent() * 37) % 900 + i % 53).cast("double").alias("black_elo"),
        F.coalesce(winner, F.lit("draw_or_other")).alias("winner"),
        F.lit("normal").alias("victory_status"),
        (i % 10 != 0).alias("rated"),
        c("event_type").alias("speed"),
        F.get_json_object("props", "$.k").alias("opening"),
        F.lit("events").alias("source_file"),
        _ms().alias("created_at"),
        F.when(i % 23 != 0, _last_ms()).alias("last_move_at"),
        F.date_format("ts", "yyyy-MM-dd").alias("utc_date"),
    )


CATALOG_SQL = """catalog AS (
  SELECT CAST(event_id AS VARCHAR) AS game_id, 'u' || user_id AS white_player,
    'u' || (user_id + event_id % 13 + 1) AS black_player,
    CAST(1000 + (user_id * 37) % 900 + event_id % 61 AS DOUBLE) AS white_elo,
    CAST(1000 + ((user_id + event_id % 13 + 1) * 37) % 900 + event_id % 53 AS DOUBLE) AS black_elo,
    CASE event_type WHEN 'purchase' THEN 'white' WHEN 'error' THEN 'black' ELSE 'draw_or_other' END AS winner,
    'normal' AS victory_status, event_id % 10 <> 0 AS rated, event_type AS speed,
    json_extract_string(props, '$.k') AS opening, 'events' AS source_file, (epoch_us(ts) // 1000) AS created_at,
    CASE WHEN event_id % 23 <> 0 THEN (epoch_us(ts) // 1000) + CAST(floor(value * 1000) AS BIGINT) END AS last_move_at,
    strftime(ts, '%Y-%m-%d') AS utc_date
  FROM events),
norm AS (
  SELECT game_id, 'white' AS side, white_player AS player_name, white_elo AS player_elo, black_elo AS opponent_elo,
    CASE winner WHEN 'white' THEN 'win' WHEN 'black' THEN 'loss' ELSE 'draw_or_other' END AS outcome,
    victory_status, rated, speed, opening, source_file, coalesce(last_move_at, created_at) AS game_ms FROM catalog
  UNION ALL
  SELECT game_id, 'black', black_player, black_elo, white_elo,
    CASE winner WHEN 'black' THEN 'win' WHEN 'white' THEN 'loss' ELSE 'draw_or_other' END,
    victory_status, rated, speed, opening, source_file, coalesce(last_move_at, created_at) FROM catalog),
ordered AS (
  SELECT *, lag(game_ms) OVER w AS prev_ms, lag(player_elo) OVER w AS prev_elo FROM norm
  WINDOW w AS (PARTITION BY player_name ORDER BY game_ms, game_id)),
flagged AS (
  SELECT *, CASE WHEN prev_ms IS NULL OR game_ms > prev_ms + {gap_ms} THEN 1 ELSE 0 END AS new_session_flag,
    player_elo - prev_elo AS elo_delta FROM ordered),
sess AS (
  SELECT *, CAST(sum(new_session_flag) OVER (PARTITION BY player_name ORDER BY game_ms, game_id
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM flagged),
profile AS (
  SELECT player_name, count(*) AS n_games, count(DISTINCT session_id) AS n_sessions, min(game_ms) AS first_ms,
    max(game_ms) AS last_ms,
    date_diff('day', CAST(epoch_ms(min(game_ms)) AS DATE), CAST(epoch_ms(max(game_ms)) AS DATE)) AS coverage_days,
    count(DISTINCT strftime(epoch_ms(game_ms), '%Y-%m')) AS active_months, avg(player_elo) AS mean_elo,
    min(player_elo) AS min_elo_obs, max(player_elo) AS max_elo_obs, stddev_samp(player_elo) AS rating_stddev,
    stddev_samp(opponent_elo) AS opponent_elo_stddev, count(DISTINCT speed) AS speed_diversity,
    count(DISTINCT opening) AS opening_diversity, count(DISTINCT outcome) AS outcome_diversity,
    count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses,
    count(*) FILTER (outcome = 'draw_or_other') AS draws_or_other,
    count(*) FILTER (elo_delta < 0) AS elo_drop_steps, count(*) FILTER (elo_delta > 0) AS elo_up_steps
  FROM sess GROUP BY player_name),
eligible AS (
  SELECT *, CAST(floor((mean_elo - 1000) / 200) AS INTEGER) AS elo_bin_idx,
    CAST(1000 + floor((mean_elo - 1000) / 200) * 200 AS INTEGER) AS elo_bin_lo,
    CAST(1000 + (floor((mean_elo - 1000) / 200) + 1) * 200 AS INTEGER) AS elo_bin_hi,
    ln(1 + n_games) * 1.5 + ln(1 + n_sessions) * 2.0 + ln(1 + greatest(coverage_days, 0)) * 1.2 + active_months
      + speed_diversity * 0.8 + ln(1 + opening_diversity) * 0.7 + coalesce(opponent_elo_stddev, 0) / 150.0
      + coalesce(rating_stddev, 0) / 75.0 + elo_drop_steps * 0.35
      + CASE WHEN outcome_diversity >= 3 THEN 0.5 ELSE 0 END AS selection_score
  FROM profile WHERE n_games > 50 AND n_sessions > 4 AND mean_elo >= 1000 AND mean_elo <= 2700
    AND active_months >= 1 AND coverage_days >= 14 AND elo_drop_steps >= 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY elo_bin_lo, elo_bin_hi
    ORDER BY selection_score DESC, n_sessions DESC, n_games DESC, player_name) AS bin_rank FROM eligible),
selected AS (SELECT * FROM ranked WHERE bin_rank <= 20)""".replace("{gap_ms}", str(GAP_HOURS * 3_600_000))


def documents(spark, sf) -> DataFrame:
    """Nested game documents, one per event, with a hero name and a timeline column."""
    c = F.col
    i = c("event_id")
    hero_white = i % 2 == 0
    hero, other = F.upper(_name(c("user_id"))), _name(_opponent() + 100000)
    diff = F.when(i % 29 != 0, (i % 13 - 6).cast("int"))
    none = F.lit(None).cast("int")

    def analysis(shift: int) -> Column:
        one = ((i + shift) % 4).cast("int")
        single = i % 6 == 0
        filled = F.struct(
            ((i + shift) % 90 * 1.5).cast("double").alias("acpl"),
            F.when(single, one).alias("blunder"),
            F.when(~single, one).alias("blunders"),
            F.when(single, one + 1).alias("mistake"),
            F.when(~single, one + 1).alias("mistakes"),
            F.when(single, one + 2).alias("inaccuracy"),
            F.when(~single, one + 2).alias("inaccuracies"),
        )
        return F.when(i % 3 == 0, filled)

    def side(name: Column, rating: Column, shift: int) -> Column:
        return F.struct(
            F.struct(name.alias("name")).alias("user"), rating.alias("ratingDiff"), analysis(shift).alias("analysis")
        )

    plies = F.sequence(F.lit(1), F.greatest(F.lit(1), (i % 40).cast("int")))
    evals = F.transform(plies, lambda p: ((i * 31 + p * p * 17) % 1201 - 600).cast("int"))
    winner = F.when(c("event_type") == "purchase", "white").when(c("event_type") == "error", "black")
    return table(spark, sf, "events").select(
        i.cast("string").alias("id"),
        _ms().alias("createdAt"),
        F.when(i % 31 != 0, _last_ms()).alias("lastMoveAt"),
        winner.alias("winner"),
        F.repeat(F.lit("e4 "), (i % 40).cast("int")).alias("moves"),
        F.lit(None).cast("array<map<string,string>>").alias("analysis"),
        F.struct(
            side(F.when(hero_white, hero).otherwise(other), F.when(hero_white, diff).otherwise(none), 0).alias("white"),
            side(F.when(hero_white, other).otherwise(hero), F.when(hero_white, none).otherwise(diff), 1).alias("black"),
        ).alias("players"),
        _name(c("user_id")).alias("hero"),
        F.when(i % 40 != 0, F.concat(F.array(F.lit(0)), evals)).alias("timeline"),
    )


DOCS_SQL = """docs AS (
  SELECT CAST(event_id AS VARCHAR) AS game_id, 'u' || user_id AS player, event_id,
    CASE WHEN event_id % 2 = 0 THEN 'white' ELSE 'black' END AS user_color,
    (epoch_us(ts) // 1000) AS created_at_ms,
    CASE WHEN event_id % 31 <> 0 THEN (epoch_us(ts) // 1000) + CAST(floor(value * 1000) AS BIGINT) ELSE (epoch_us(ts) // 1000) END
      AS last_move_at_ms,
    CASE event_type WHEN 'purchase' THEN 'white' WHEN 'error' THEN 'black' END AS winner,
    CAST(CASE WHEN event_id % 29 <> 0 THEN event_id % 13 - 6 ELSE 0 END AS DOUBLE) AS rating_diff,
    greatest(1, event_id % 40) AS n_moves, event_id % 3 = 0 AS supplied,
    CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS shift,
    CASE WHEN event_id % 40 <> 0 THEN list_concat([0], list_transform(range(1, event_id % 40 + 1),
      lambda p: CAST((event_id * 31 + p * p * 17) % 1201 - 600 AS INTEGER))) END AS timeline
  FROM events),
plies AS (
  SELECT event_id, i - 1 AS ply, timeline[i] * CASE WHEN user_color = 'white' THEN 1 ELSE -1 END AS cp,
    CASE WHEN i > 1 THEN timeline[i - 1] * CASE WHEN user_color = 'white' THEN 1 ELSE -1 END END AS before,
    (i - 1) % 2 = CASE WHEN user_color = 'white' THEN 1 ELSE 0 END AND i > 1 AS own
  FROM (SELECT *, unnest(range(1, len(timeline) + 1)) AS i FROM docs WHERE timeline IS NOT NULL)),
derived AS (
  SELECT event_id, coalesce(avg(greatest(0, before - cp)) FILTER (own), 0) AS acpl,
    count(*) FILTER (own AND before - cp >= 300) AS blunders, count(*) FILTER (own AND before - cp >= 100) AS mistakes,
    count(*) FILTER (own AND before - cp >= 50) AS inaccuracies,
    coalesce(max(greatest(0, before - cp)) FILTER (own), 0) AS largest, stddev_pop(cp) AS volatility,
    coalesce(max(CASE WHEN own AND before >= 300 AND cp < 100 THEN 1 ELSE 0 END), 0) AS thrown
  FROM plies GROUP BY event_id),
engine AS (
  SELECT d.*,
    CASE WHEN supplied THEN (d.event_id + shift) % 90 * 1.5 ELSE acpl END AS e_acpl,
    CASE WHEN supplied THEN (d.event_id + shift) % 4 ELSE blunders END AS e_blunder,
    CASE WHEN supplied THEN (d.event_id + shift) % 4 + 1 ELSE mistakes END AS e_mistake,
    CASE WHEN supplied THEN (d.event_id + shift) % 4 + 2 ELSE inaccuracies END AS e_inaccuracy,
    CASE WHEN NOT supplied THEN largest END AS e_largest, CASE WHEN NOT supplied THEN acpl END AS e_avg,
    CASE WHEN NOT supplied THEN volatility END AS e_volatility, CASE WHEN NOT supplied THEN thrown END AS e_thrown,
    CASE WHEN supplied THEN 'lichess' WHEN timeline IS NOT NULL THEN 'local_stockfish' END AS e_source
  FROM docs d LEFT JOIN derived USING (event_id)),
frows AS (
  SELECT player, game_id, created_at_ms, last_move_at_ms, user_color, coalesce(e_acpl, 0) AS my_acpl,
    CAST(coalesce(e_blunder, 0) AS DOUBLE) AS my_blunder_count, CAST(coalesce(e_mistake, 0) AS DOUBLE) AS my_mistake_count,
    CAST(coalesce(e_inaccuracy, 0) AS DOUBLE) AS my_inaccuracy_count,
    CAST(coalesce(e_largest, 0) AS DOUBLE) AS largest_eval_drop_cp, coalesce(e_avg, 0) AS avg_eval_drop_cp,
    coalesce(e_volatility, 0) AS eval_volatility, coalesce(e_thrown, 0) AS threw_winning_position,
    coalesce(e_source, 'unknown') AS engine_source, rating_diff,
    CASE WHEN winner = user_color THEN 1.0 WHEN winner IS NULL THEN 0.5 ELSE 0.0 END AS result,
    greatest(0, (last_move_at_ms - created_at_ms) / 1000.0) / greatest(1, n_moves // 2) AS my_avg_secs_per_move,
    CASE WHEN hour(epoch_ms(created_at_ms)) BETWEEN 5 AND 8 THEN 'morning'
      WHEN hour(epoch_ms(created_at_ms)) BETWEEN 9 AND 17 THEN 'midday'
      WHEN hour(epoch_ms(created_at_ms)) BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS tod_label
  FROM engine)"""


def history(spark, sf) -> DataFrame:
    """Flat feature rows, one timeline per player."""
    c = F.col
    i = c("event_id")
    result = F.when(c("event_type") == "purchase", 1.0).when(c("event_type") == "error", 0.0).otherwise(0.5)
    hour = F.hour(c("ts").cast("timestamp"))
    tod = F.when(hour.between(5, 8), "morning").when(hour.between(9, 17), "midday")
    score = ((i * 7919) % 1000) / 1000.0
    return table(spark, sf, "events").select(
        _name(c("user_id")).alias("player"),
        i.alias("game_id"),
        _ms().alias("created_at_ms"),
        _last_ms().alias("last_move_at_ms"),
        ((i * 7) % 200 + 0.5).cast("double").alias("my_acpl"),
        (F.floor(c("value") * 100) / (i % 40 + 1)).cast("double").alias("my_avg_secs_per_move"),
        result.alias("result"),
        (i % 13 - 6).cast("double").alias("rating_diff"),
        tod.when(hour.between(18, 22), "evening").otherwise("night").alias("tod_label"),
        F.when(i % 97 == 0, F.lit(float("nan"))).when(i % 101 != 0, score).alias("score"),
    )


HISTORY_SQL = """hist AS (
  SELECT 'u' || user_id AS player, event_id AS game_id, (epoch_us(ts) // 1000) AS created_at_ms,
    (epoch_us(ts) // 1000) + CAST(floor(value * 1000) AS BIGINT) AS last_move_at_ms,
    CAST((event_id * 7) % 200 + 0.5 AS DOUBLE) AS my_acpl,
    floor(value * 100) / (event_id % 40 + 1) AS my_avg_secs_per_move,
    CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN 0.0 ELSE 0.5 END AS result,
    CAST(event_id % 13 - 6 AS DOUBLE) AS rating_diff,
    CASE WHEN hour(ts) BETWEEN 5 AND 8 THEN 'morning' WHEN hour(ts) BETWEEN 9 AND 17 THEN 'midday'
      WHEN hour(ts) BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS tod_label,
    CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE)
      WHEN event_id % 101 <> 0 THEN ((event_id * 7919) % 1000) / 1000.0 END AS score
  FROM events)"""

# Session chain over any feature rows named {rows}.
FEATURE_SQL = """f_gap AS (
  SELECT *, created_at_ms - lag(created_at_ms) OVER (PARTITION BY player ORDER BY created_at_ms, game_id) AS time_gap_ms
  FROM {rows}),
f_sess AS (
  SELECT *, CAST(sum(CASE WHEN time_gap_ms IS NULL OR time_gap_ms > {gap_ms} THEN 1 ELSE 0 END) OVER
    (PARTITION BY player ORDER BY created_at_ms, game_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM f_gap),
f_run AS (
  SELECT *, row_number() OVER s AS games_played,
    sum(rating_diff) OVER (s ROWS UNBOUNDED PRECEDING) AS session_pl,
    first_value(my_avg_secs_per_move) OVER s AS first_speed, lag(last_move_at_ms) OVER s AS prev_game_end_ms,
    avg(my_acpl) OVER (s ROWS 4 PRECEDING) AS roll_5_acpl_mean,
    avg(my_avg_secs_per_move) OVER (s ROWS 4 PRECEDING) AS roll_5_time_per_move,
    sum(CASE WHEN result <> 0 THEN 1 ELSE 0 END) OVER
      (PARTITION BY player ORDER BY created_at_ms, game_id ROWS UNBOUNDED PRECEDING) AS streak_key
  FROM f_sess WINDOW s AS (PARTITION BY player, session_id ORDER BY created_at_ms, game_id)),
f_feat AS (
  SELECT *, CAST(result = 0 AS BIGINT) AS is_loss, my_avg_secs_per_move / (first_speed + 0.001) AS speed_vs_start,
    greatest(coalesce(created_at_ms - prev_game_end_ms, 0) / 1000.0, 0) AS break_time_sec,
    ln(greatest(coalesce(created_at_ms - prev_game_end_ms, 0) / 1000.0, 0) + 1) AS log_break_time,
    CASE WHEN result = 0 THEN row_number() OVER
      (PARTITION BY player, streak_key ORDER BY created_at_ms, game_id) - 1 ELSE 0 END AS loss_streak
  FROM f_run),
f_max AS (SELECT *, max(session_pl) OVER (PARTITION BY player, session_id) AS session_max FROM f_feat),
f_first AS (
  SELECT *, min(CASE WHEN session_pl = session_max THEN games_played END) OVER (PARTITION BY player, session_id)
    AS first_max_game FROM f_max),
feat AS (
  SELECT *, CAST(session_pl = session_max AS INTEGER) AS is_max, CAST(games_played = first_max_game AS INTEGER) AS target,
    max(session_pl) OVER (PARTITION BY player, session_id ORDER BY created_at_ms, game_id
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix_max,
    min(session_pl) OVER (PARTITION BY player, session_id ORDER BY created_at_ms, game_id
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix_min
  FROM f_first)""".replace("{gap_ms}", str(GAP_MINUTES * 60_000))


def with_history(body: str) -> str:
    return f"WITH {HISTORY_SQL},\n{FEATURE_SQL.replace('{rows}', 'hist')}\n{body}"


def with_documents(body: str) -> str:
    return f"WITH {DOCS_SQL},\n{FEATURE_SQL.replace('{rows}', 'frows')}\n{body}"


def with_catalog(body: str) -> str:
    return f"WITH {CATALOG_SQL}\n{body}"


def with_raw(body: str) -> str:
    return f"WITH {RAW_SQL}\n{body}"


def scored_labels(spark, sf) -> DataFrame:
    """Labels with a score and a fold."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return (
        table(spark, sf, "labels")
        .join(docs, "doc_id")
        .select(
            "doc_id",
            F.col("quality").alias("label"),
            ((F.col("n_chars") % 1000) / 1000.0).alias("score"),
            (F.col("doc_id") % 5 + 1).cast("int").alias("fold"),
        )
    )


SCORED_SQL = """scored AS (
  SELECT doc_id, quality AS label, (n_chars % 1000) / 1000.0 AS score, CAST(doc_id % 5 + 1 AS INTEGER) AS fold
  FROM labels JOIN documents USING (doc_id))"""


def shards(spark, sf) -> DataFrame:
    """Pages as a shard manifest: repeated file names, repeated URLs, sizes."""
    c = F.col
    tail = F.regexp_extract("url", r"/([^/?#]*)[^/]*$", 1)
    return table(spark, sf, "pages").select(
        c("page_id").alias("seq"),
        F.concat(F.lit("g"), (c("page_id") % 4).cast("string")).alias("config"),
        F.concat(F.when(tail == "", "index").otherwise(tail), F.lit(".parquet")).alias("filename"),
        c("url"),
        F.length("html").cast("long").alias("size"),
    )


SHARDS_SQL = """shards AS (
  SELECT page_id AS seq, 'g' || (page_id % 4) AS config,
    CASE WHEN regexp_extract(url, '/([^/?#]*)[^/]*$', 1) = '' THEN 'index'
      ELSE regexp_extract(url, '/([^/?#]*)[^/]*$', 1) END || '.parquet' AS filename,
    url, CAST(length(html) AS BIGINT) AS size FROM pages)"""
