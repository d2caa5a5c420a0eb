"""Registered queries of the single-player side: features, targets, splits, policy, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.functions import scalars as S
from gapline.operators import backtest as B
from gapline.operators import metrics as K
from gapline.operators import models as ML
from gapline.operators import policy as P
from gapline.operators import reports as R
from gapline.operators import sessions as SE
from gapline.operators import splits as SP
from gapline.operators import targets as TG
from gapline.operators.ordered import arrange
from gapline.plans import fixtures as X
from gapline.plans.fixtures import r6, table
from gapline.plans.population import q
from gapline.runtime import cut_lineage
from gapline.schemas import CORE_FEATURES, EXPERIMENT_DROPS, OPTIONAL_FEATURES

QUERIES: dict = {}
SQL: dict[str, str] = {}

# A limit far below the default, so the given tables have hot groups to cut.
SMALL_GROUP = 25
SESSION = ["player", "session_id"]
ORDER = ["created_at_ms", "game_id"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def sel(df: DataFrame, plain: str, doubles: str = "", places: int = 6) -> DataFrame:
    cols = [F.col(c) for c in plain.split()] + [r6(F.col(c), places).alias(c) for c in doubles.split()]
    return df.select(*cols)


def sqlsel(plain: str, doubles: str = "", places: int = 6) -> str:
    parts = [p for p in plain.split()]
    return ", ".join(parts + ([q(*doubles.split(), places=places)] if doubles else []))


# Milliseconds over powers of two have seven places often, whose last five the two
# engines round apart. Nine places are past those ties.
FINE = 9


# ------------------------------------------------------- documents to features
def _enriched(spark, sf) -> DataFrame:
    return SE.enrich(X.documents(spark, sf), F.col("hero"), "timeline")


def _feature_rows(spark, sf, zone: str = "UTC") -> DataFrame:
    return SE.feature_rows(_enriched(spark, sf), F.col("hero"), zone)


def _frows(name: str, plain: str, doubles: str = "") -> None:
    @query(name, X.with_documents(f"SELECT game_id, player, {sqlsel(plain, doubles)} FROM frows"))
    def run(spark, sf) -> DataFrame:
        return sel(_feature_rows(spark, sf), f"game_id player {plain}", doubles)


_frows("B6_side_and_result", "user_color", "result")
_frows("B7_rating_change", "user_color", "rating_diff")
_frows("B9_pace", "created_at_ms last_move_at_ms", "my_avg_secs_per_move")
_frows(
    "B12_engine_defaults",
    "threw_winning_position engine_source",
    "my_acpl my_blunder_count my_mistake_count my_inaccuracy_count largest_eval_drop_cp avg_eval_drop_cp eval_volatility",
)


@query(
    "B8_move_count",
    """SELECT doc_id, CAST(greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT)
       AS n_moves, CAST(length(text) AS BIGINT) AS text_len FROM documents""",
)
def b8(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        S.move_count(F.col("text")).cast("long").alias("n_moves"),
        S.text_length(F.col("text")).alias("text_len"),
    )


@query(
    "B8_move_count_conversations",
    """SELECT conv_id, turn, CAST(greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))
       AS BIGINT) AS n_moves, CAST(length(text) AS BIGINT) AS text_len FROM conversations""",
)
def b8_conv(spark, sf) -> DataFrame:
    d = table(spark, sf, "conversations")
    return d.select(
        "conv_id",
        "turn",
        S.move_count(F.col("text")).cast("long").alias("n_moves"),
        S.text_length(F.col("text")).alias("text_len"),
    )


@query(
    "B10_timeline_summary",
    f"""WITH t AS (SELECT vec_id, label % 2 = 0 AS white,
          list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1500) AS INTEGER)) AS tl FROM embeddings),
        u AS (SELECT vec_id, white, i - 1 AS ply, tl[i] * CASE WHEN white THEN 1 ELSE -1 END AS cp,
          CASE WHEN i > 1 THEN tl[i - 1] * CASE WHEN white THEN 1 ELSE -1 END END AS before
          FROM (SELECT *, unnest(range(1, len(tl) + 1)) AS i FROM t)),
        o AS (SELECT *, ply > 0 AND ply % 2 = CASE WHEN white THEN 1 ELSE 0 END AS own FROM u)
        SELECT vec_id, count(*) FILTER (own AND before - cp >= 300) AS my_blunder_count,
          count(*) FILTER (own AND before - cp >= 100) AS my_mistake_count,
          count(*) FILTER (own AND before - cp >= 50) AS my_inaccuracy_count,
          max(CASE WHEN own AND before >= 300 AND cp < 100 THEN 1 ELSE 0 END) AS threw_winning_position,
          {q('avg(greatest(0, before - cp)) FILTER (own) AS my_acpl',
             'max(greatest(0, before - cp)) FILTER (own) AS largest_eval_drop_cp',
             'stddev_pop(cp) AS eval_volatility')} FROM o GROUP BY vec_id""",
)
def b10(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    evals = F.transform("embedding", lambda x: F.round(x.cast("double") * 1500).cast("int"))
    side = F.when(F.col("label") % 2 == 0, "white").otherwise("black")
    out = e.select("vec_id", S.timeline_summary(evals, side).alias("s")).select("vec_id", "s.*")
    return sel(
        out,
        "vec_id my_blunder_count my_mistake_count my_inaccuracy_count threw_winning_position",
        "my_acpl largest_eval_drop_cp eval_volatility",
    )


@query(
    "B11_analysis_source",
    X.with_documents(
        f"""SELECT game_id, e_source AS engine_source, CAST(e_blunder AS INTEGER) AS my_blunder_count,
            CAST(e_mistake AS INTEGER) AS my_mistake_count, CAST(e_inaccuracy AS INTEGER) AS my_inaccuracy_count,
            CAST(e_thrown AS INTEGER) AS threw_winning_position,
            CASE WHEN e_source = 'local_stockfish' THEN len(timeline) END AS n_evals,
            {q('e_acpl AS my_acpl', 'e_largest AS largest_eval_drop_cp', 'e_avg AS avg_eval_drop_cp',
               'e_volatility AS eval_volatility')} FROM engine"""
    ),
)
def b11(spark, sf) -> DataFrame:
    out = _enriched(spark, sf).select(F.col("id").alias("game_id"), "cq_engine.*")
    n = F.when(F.col("eval_timeline_cp").isNotNull(), F.size("eval_timeline_cp")).cast("long")
    return sel(
        out.withColumn("n_evals", n),
        "game_id engine_source my_blunder_count my_mistake_count my_inaccuracy_count threw_winning_position n_evals",
        "my_acpl largest_eval_drop_cp avg_eval_drop_cp eval_volatility",
    )


@query(
    "B13_time_of_day",
    """WITH h AS (SELECT event_id, CAST(hour(timezone('America/New_York', timezone('UTC', ts))) AS INTEGER) AS hour FROM events),
       l AS (SELECT *, CASE WHEN hour BETWEEN 5 AND 8 THEN 'morning' WHEN hour BETWEEN 9 AND 17 THEN 'midday'
         WHEN hour BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS tod_label FROM h)
       SELECT event_id, hour, tod_label, CAST(tod_label = 'morning' AS INTEGER) AS tod_morning,
         CAST(tod_label = 'midday' AS INTEGER) AS tod_midday, CAST(tod_label = 'evening' AS INTEGER) AS tod_evening,
         CAST(tod_label = 'night' AS INTEGER) AS tod_night FROM l""",
)
def b13(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    hour = S.local_hour(F.unix_millis(F.col("ts").cast("timestamp")), "America/New_York")
    out = e.select("event_id", hour.alias("hour")).withColumn("tod_label", S.time_of_day(F.col("hour")))
    hot = {n: c.cast("int") for n, c in S.one_hot_time_of_day(F.col("tod_label")).items()}
    return out.withColumns(hot)


@query(
    "B15_feature_selection",
    X.with_history(
        f"""SELECT {q('my_acpl', 'my_avg_secs_per_move', 'result', 'rating_diff', 'score')} FROM hist"""
    ),
)
def b15(spark, sf) -> DataFrame:
    h = X.history(spark, sf)
    chosen = R.choose_features(h, EXPERIMENT_DROPS, "none")
    return h.select(*[r6(F.col(c)).alias(c) for c in chosen])


@query(
    "B16_numeric_fill",
    """SELECT event_id, round(coalesce(CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE NULL END, 0), 6)
       + 0.0 AS filled, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""",
)
def b16(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    i = F.col("event_id")
    text = F.when(i % 4 == 0, F.col("value").cast("string")).when(i % 4 == 1, "n/a").when(i % 4 == 2, "NaN")
    e = e.select("event_id", text.alias("text"), F.get_json_object("props", "$.k").alias("k"))
    return e.select("event_id", r6(S.number_or_zero(e, "text")).alias("filled"), S.as_number(e, "k").alias("k"))


# ------------------------------------------------------------------ sessions
def _line(spark, sf, **kw):
    return SE.feature_line(X.history(spark, sf), X.GAP_MINUTES, **kw)


def _gap_line(spark, sf, **kw):
    return SE.start_gap_sessions(X.history(spark, sf), X.GAP_MINUTES, **kw)


_LABEL_SQL = """WITH e AS (SELECT event_id, 'u' || user_id AS player, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts FROM events),
  g AS (SELECT *, lag(ts) OVER w AS prev FROM e
    WINDOW w AS (PARTITION BY player ORDER BY ts ASC NULLS LAST, event_id)),
  f AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts IS NULL OR epoch_us(ts) - epoch_us(prev) > 43200000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY player ORDER BY ts ASC NULLS LAST, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT event_id, player, printf('session_%05d', CAST(n AS BIGINT)) AS session_id FROM f"""


@query("F3_labelled_gap_sessions", _LABEL_SQL)
def f3(spark, sf) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("player"),
        F.when(i % 50 != 0, F.col("ts").cast("string")).otherwise("unknown").alias("at"),
    )
    out = SE.gap_sessions(e, "at", X.GAP_MINUTES, by=["player"], tie=["event_id"])
    return out.select("event_id", "player", "session_id")


_GLOBAL_SQL = """WITH g AS (SELECT event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) <= 900000000
    THEN 0 ELSE 1 END AS opens, ts FROM events)
  SELECT event_id, printf('session_%05d', CAST(sum(opens) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT))
    AS session_id FROM g"""


@query("F3_one_timeline_hot_split", _GLOBAL_SQL)
def f3_global(spark, sf) -> DataFrame:
    # One timeline over the whole table, cut into parts of a few hundred rows.
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias("at"))
    out = SE.gap_sessions(e, "at", 15, tie=["event_id"], max_rows=2_000)
    return out.select("event_id", "session_id")


# Orders that equal widths could not cut: growing, text, with infinities, with NaN.
_ORDERS = {
    "geometric": (lambda i: F.pow(F.lit(1.001), i), "pow(1.001, event_id)"),
    "text": (lambda i: F.concat(F.lit("event "), i.cast("string")), "'event ' || event_id"),
    "infinite": (
        lambda i: F.when(i % 500 == 7, float("inf")).when(i % 500 == 8, float("-inf")).otherwise(-i.cast("double")),
        "CASE WHEN event_id % 500 = 7 THEN CAST('inf' AS DOUBLE) WHEN event_id % 500 = 8 THEN CAST('-inf' AS DOUBLE) ELSE -event_id END",
    ),
    "nan": (
        lambda i: F.when(i % 3 == 0, float("nan")).when(i % 3 == 1, i.cast("double")),
        "CASE WHEN event_id % 3 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 3 = 1 THEN event_id END",
    ),
}


def _order_query(kind: str) -> None:
    view, sql = _ORDERS[kind]

    @query(
        f"F_any_order_hot_split_{kind}",
        f"""WITH e AS (SELECT event_id, event_type, {sql} AS pos FROM events)
          SELECT event_id, row_number() OVER w AS n, lag(event_id) OVER w AS before,
            CAST(sum(event_id % 13) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
          FROM e WINDOW w AS (PARTITION BY event_type ORDER BY pos NULLS FIRST, event_id)""",
    )
    def run(spark, sf) -> DataFrame:
        e = table(spark, sf, "events").select("event_id", "event_type", view(F.col("event_id")).alias("at"))
        line = arrange(e.withColumn("v", F.col("event_id") % 13), ["event_type"], ["at", "event_id"], max_rows=500)
        line = line.scan({"n": ("count",), "before": ("lag", "event_id"), "upto": ("sum", "v")})
        return line.result().select("event_id", "n", "before", "upto")


for _kind in _ORDERS:
    _order_query(_kind)


def _hist_query(name: str, plain: str, doubles: str = "") -> None:
    """A plain and a cut form of a session feature against one oracle."""
    sql = X.with_history(f"SELECT game_id, {sqlsel(plain, doubles)} FROM feat")

    @query(name, sql)
    def run(spark, sf) -> DataFrame:
        return sel(_cast(_line(spark, sf).df), f"game_id {plain}", doubles)


def _cast(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in ("is_max", "target")})


_hist_query("F4_start_gap_sessions", "time_gap_ms session_id")
_hist_query("F5_position_in_session", "session_id games_played")
_hist_query("F6_running_pl", "session_id", "session_pl")
_hist_query("F7_relative_pace", "session_id", "first_speed speed_vs_start")
_hist_query("F8_break_time", "prev_game_end_ms", "break_time_sec log_break_time")
_hist_query("F9_loss_streak", "is_loss loss_streak")
_hist_query("F10_rolling_means", "session_id", "roll_5_acpl_mean roll_5_time_per_move")
_hist_query("F12_peak_flags", "is_max first_max_game target", "session_max")

_FEATURE_PLAIN = (
    "session_id time_gap_ms games_played prev_game_end_ms is_loss loss_streak is_max first_max_game target"
)
_FEATURE_DOUBLES = (
    "session_pl first_speed speed_vs_start break_time_sec log_break_time roll_5_acpl_mean roll_5_time_per_move session_max"
)


@query(
    "F_feature_table_hot_split",
    X.with_history(f"SELECT game_id, player, {sqlsel(_FEATURE_PLAIN, _FEATURE_DOUBLES)} FROM feat"),
)
def f_hot(spark, sf) -> DataFrame:
    return sel(_cast(_line(spark, sf, max_rows=SMALL_GROUP).df), f"game_id player {_FEATURE_PLAIN}", _FEATURE_DOUBLES)


@query(
    "F_feature_table_from_documents",
    X.with_documents(
        f"""SELECT game_id, player, user_color, engine_source,
            {sqlsel(_FEATURE_PLAIN, _FEATURE_DOUBLES + ' my_acpl my_avg_secs_per_move rating_diff result', FINE)} FROM feat"""
    ),
)
def f_docs(spark, sf) -> DataFrame:
    line = SE.feature_line(_feature_rows(spark, sf), X.GAP_MINUTES)
    return sel(
        _cast(line.df),
        f"game_id player user_color engine_source {_FEATURE_PLAIN}",
        _FEATURE_DOUBLES + " my_acpl my_avg_secs_per_move rating_diff result",
        FINE,
    )


@query("D2_session_max_join", X.with_history(f"SELECT game_id, first_max_game, {q('session_max')} FROM feat"))
def d2(spark, sf) -> DataFrame:
    return sel(_line(spark, sf).df, "game_id first_max_game", "session_max")


@query(
    "M2_session_totals",
    X.with_history(
        """SELECT player, session_id, min(created_at_ms) AS session_start_ms, max(created_at_ms) AS last_start_ms,
           count(*) AS n_games, sum(rating_diff) AS session_pl FROM f_sess GROUP BY player, session_id"""
    ),
)
def m2(spark, sf) -> DataFrame:
    return SE.session_totals(_gap_line(spark, sf))


# ------------------------------------------------------------------- targets
_ALL_KINDS = list(TG.TASKS)


def _targets(spark, sf, kinds=_ALL_KINDS, **kw) -> DataFrame:
    return TG.add_targets(_line(spark, sf, **kw), kinds, SESSION, ORDER, "session_pl", position="games_played")


_SUFFIX_SQL = X.with_history(f"SELECT game_id, {q('suffix_max', 'suffix_min')} FROM feat")


@query("F13_suffix_extremes", _SUFFIX_SQL)
def f13(spark, sf) -> DataFrame:
    line = TG.extremes(_line(spark, sf).finer(SESSION), "session_pl", "games_played")
    return sel(line.df, "game_id", "suffix_max suffix_min")


_DIST_SQL = """SELECT a.game_id, CAST((SELECT min(b.games_played) FROM feat b WHERE b.player = a.player
    AND b.session_id = a.session_id AND b.games_played >= a.games_played AND b.session_pl = a.suffix_max)
    - a.games_played AS DOUBLE) AS games_to_peak FROM feat a"""


@query("F14_distance_to_peak", X.with_history(_DIST_SQL))
def f14(spark, sf) -> DataFrame:
    line = TG.extremes(_line(spark, sf).finer(SESSION), "session_pl", "games_played")
    return sel(line.df, "game_id games_to_peak")


def _target_query(name: str, kind: str, expr: str) -> None:
    @query(name, X.with_history(f"SELECT game_id, {q(expr + ' AS target_value')} FROM feat"))
    def run(spark, sf) -> DataFrame:
        out, col, _ = TG.add_target(_line(spark, sf), kind, SESSION, ORDER, "session_pl", position="games_played")
        return out.select("game_id", r6(F.col(col)).alias("target_value"))


_target_query("I1_peak_binary", "peak_binary", "target")
_target_query("I2_meaningful_upside", "meaningful_upside_binary", "CASE WHEN suffix_max - session_pl >= 8 THEN 1 ELSE 0 END")
_target_query("I3_future_upside", "future_upside_regression", "suffix_max - session_pl")
_target_query("I4_future_drawdown", "future_drawdown_regression", "session_pl - suffix_min")


@query("I5_games_to_peak", X.with_history(f"SELECT game_id, {q('games_to_peak AS target_value')} FROM ({_DIST_SQL}) z"))
def i5(spark, sf) -> DataFrame:
    out, col, _ = TG.add_target(_line(spark, sf), "games_to_peak_regression", SESSION, ORDER, "session_pl")
    return out.select("game_id", r6(F.col(col)).alias("target_value"))


@query(
    "I_all_targets_hot_split",
    X.with_history(
        f"""SELECT game_id, {q('target AS peak', 'suffix_max - session_pl AS upside', 'session_pl - suffix_min AS drawdown')},
            CASE WHEN suffix_max - session_pl >= 8 THEN 1 ELSE 0 END AS meaningful, games_to_peak AS distance
            FROM feat JOIN ({_DIST_SQL}) z USING (game_id)"""
    ),
)
def i_hot(spark, sf) -> DataFrame:
    t = _targets(spark, sf, max_rows=SMALL_GROUP)
    return t.select(
        "game_id",
        r6(F.col("target__peak_binary")).alias("peak"),
        r6(F.col("target__future_upside_regression")).alias("upside"),
        r6(F.col("target__future_drawdown_regression")).alias("drawdown"),
        F.col("target__meaningful_upside_binary").alias("meaningful"),
        F.col("target__games_to_peak_regression").alias("distance"),
    )


# -------------------------------------------------------------------- splits
def _grouped(spark, sf) -> DataFrame:
    """Feature rows with one session key over all players."""
    df = _gap_line(spark, sf).result()
    return df.withColumn("sid", F.concat_ws("/", "player", "session_id"))


_GROUP_SQL = """grouped AS (SELECT *, player || '/' || session_id AS sid FROM f_sess),
starts AS (SELECT sid, min(created_at_ms) AS group_start FROM grouped GROUP BY sid),
ranked AS (SELECT *, row_number() OVER (ORDER BY group_start, sid) - 1 AS r, count(*) OVER () AS g FROM starts),
bounds AS (SELECT k AS fold, greatest(1, g * k // 6) AS s, greatest(greatest(1, g * k // 6) + 1, g * (k + 1) // 6) AS e
  FROM (SELECT DISTINCT g FROM ranked), (SELECT unnest(range(1, 6)) AS k)),
folds AS (SELECT sid, CAST(fold AS INTEGER) AS fold,
    CASE WHEN r >= s AND r < e THEN 'valid' WHEN r < greatest(0, s - {gap}) THEN 'train' END AS role
  FROM ranked, bounds WHERE (r >= s AND r < e) OR r < greatest(0, s - {gap}))"""


def _with_groups(body: str, gap: int = 1) -> str:
    return X.with_history(", " + _GROUP_SQL.replace("{gap}", str(gap)) + "\n" + body)


_FOLDS_SQL = _with_groups("SELECT sid, fold, role FROM folds")


@query("I6_chronological_folds", _FOLDS_SQL)
def i6(spark, sf) -> DataFrame:
    return SP.chronological_folds(_grouped(spark, sf), "sid", "created_at_ms", 5, 1)


@query("I6_chronological_folds_hot_split", _FOLDS_SQL)
def i6_hot(spark, sf) -> DataFrame:
    return SP.chronological_folds(_grouped(spark, sf), "sid", "created_at_ms", 5, 1, max_rows=300)


@query("I7_stratified_group_folds")
def i7(spark, sf) -> DataFrame:
    df = _grouped(spark, sf).withColumn("lost", (F.col("result") == 0).cast("int"))
    return SP.stratified_group_folds(df, "sid", "lost")


@query(
    "I7_fold_balance",
    _with_groups(
        """SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows,
           CAST(sum(p) AS BIGINT) AS n_positive FROM (
             SELECT n, p, CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END + 1 AS fold FROM (
               SELECT n, p, row_number() OVER (ORDER BY p DESC, n DESC, sid) - 1 AS i FROM (
                 SELECT sid, count(*) AS n, sum(CASE WHEN result = 0 THEN 1 ELSE 0 END) AS p FROM grouped GROUP BY sid)))
           GROUP BY fold"""
    ),
)
def i7_balance(spark, sf) -> DataFrame:
    """Sizes and classes per fold do not depend on how equals are shuffled."""
    return (
        i7(spark, sf)
        .groupBy("fold")
        .agg(
            F.count(F.lit(1)).alias("n_groups"),
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_positive").alias("n_positive"),
        )
    )


@query(
    "D3_rows_of_folds",
    _with_groups("SELECT game_id, sid, fold, role FROM grouped JOIN folds USING (sid) WHERE role = 'valid'"),
)
def d3(spark, sf) -> DataFrame:
    df = _grouped(spark, sf)
    folds = SP.chronological_folds(df, "sid", "created_at_ms", 5, 1)
    return SP.rows_in_folds(df, folds, "sid", "valid").select("game_id", "sid", "fold", "role")


@query(
    "E4_class_counts",
    _with_groups(
        "SELECT sid, count(*) AS n_rows, CAST(sum(CASE WHEN result = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive "
        "FROM grouped GROUP BY sid"
    ),
)
def e4(spark, sf) -> DataFrame:
    df = _grouped(spark, sf).withColumn("lost", (F.col("result") == 0).cast("int"))
    return SP.class_counts(df, "sid", "lost")


@query(
    "E5_leakage_report",
    _with_groups(
        """SELECT fold, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'valid') AS valid_rows,
           count(DISTINCT CASE WHEN role = 'train' THEN sid END) AS train_groups,
           count(DISTINCT CASE WHEN role = 'valid' THEN sid END) AS valid_groups, CAST(0 AS BIGINT) AS group_overlap_count,
           '' AS examples, max(CASE WHEN role = 'train' THEN created_at_ms END) AS max_train_time,
           min(CASE WHEN role = 'valid' THEN created_at_ms END) AS min_valid_time
           FROM grouped JOIN folds USING (sid) GROUP BY fold"""
    ),
)
def e5(spark, sf) -> DataFrame:
    df = _grouped(spark, sf)
    folds = SP.chronological_folds(df, "sid", "created_at_ms", 5, 1)
    out = SP.leakage_report(df, folds, "sid", "created_at_ms")
    return out.withColumn("examples", F.array_join("group_overlap_examples", ",")).drop("group_overlap_examples")


_LEAK_SQL = """WITH f AS (SELECT DISTINCT CAST(event_id % 3 + 1 AS INTEGER) AS fold, user_id,
    CASE WHEN event_id % 4 = 0 THEN 'valid' ELSE 'train' END AS role FROM events)
  SELECT fold, user_id FROM f GROUP BY fold, user_id HAVING count(DISTINCT role) = 2"""


@query("H3_group_overlap", _LEAK_SQL)
def h3(spark, sf) -> DataFrame:
    i = F.col("event_id")
    folds = table(spark, sf, "events").select(
        (i % 3 + 1).cast("int").alias("fold"), "user_id", F.when(i % 4 == 0, "valid").otherwise("train").alias("role")
    )
    return SP.group_overlap(folds, "user_id")


@query(
    "E7_groups_without_time",
    """SELECT user_id FROM (SELECT user_id, count(CASE WHEN user_id % 9 <> 0 THEN ts END) AS n FROM events GROUP BY user_id)
       WHERE n = 0 ORDER BY user_id LIMIT 5""",
)
def e7(spark, sf) -> DataFrame:
    text = F.when(F.col("user_id") % 9 != 0, F.col("ts").cast("string")).otherwise("missing")
    e = table(spark, sf, "events").select("user_id", text.alias("at"))
    return SP.groups_without_time(SP.group_starts(e, "user_id", "at"), "user_id")


# ------------------------------------------------------------------- metrics
def _with_scored(body: str) -> str:
    return f"WITH {X.SCORED_SQL}\n{body}"


@query(
    "C3_validation_rows",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS policy_score FROM events WHERE event_type <> 'view'""",
)
def c3(spark, sf) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf, "events").select(
        "event_id",
        F.when(i % 5 != 0, F.col("value").cast("string")).otherwise("none").alias("oof_score"),
        (F.col("event_type") != "view").cast("int").alias("oof_is_validation"),
    )
    return ML.validation_rows(e).select("event_id", "policy_score")


@query(
    "K7_f1",
    _with_scored(
        f"""SELECT fold, {q('''coalesce(2.0 * count(*) FILTER (score >= 0.5 AND label = 1) / nullif(
            2 * count(*) FILTER (score >= 0.5 AND label = 1) + count(*) FILTER (score >= 0.5 AND label = 0)
            + count(*) FILTER (score < 0.5 AND label = 1), 0), 0) AS f1''')} FROM scored GROUP BY fold"""
    ),
)
def k7(spark, sf) -> DataFrame:
    return sel(K.f1_scores(X.scored_labels(spark, sf), "label", "score", ["fold"]), "fold", "f1")


_AUC_SQL = _with_scored(
    f"""SELECT a.fold, {q('''sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)
        / count(*) AS roc_auc''')} FROM scored a JOIN scored b USING (fold)
        WHERE a.label = 1 AND b.label = 0 GROUP BY a.fold"""
)


@query("K8_roc_auc", _AUC_SQL)
def k8(spark, sf) -> DataFrame:
    return sel(K.ranking_scores(X.scored_labels(spark, sf), "label", "score", ["fold"]), "fold", "roc_auc")


@query("K8_roc_auc_hot_split", _AUC_SQL)
def k8_hot(spark, sf) -> DataFrame:
    scored = X.scored_labels(spark, sf)
    return sel(K.ranking_scores(scored, "label", "score", ["fold"], max_rows=10), "fold", "roc_auc")


@query(
    "K9_average_precision",
    _with_scored(
        f"""SELECT fold, {q('sum(p * tp / (tp + fp)) / max(np) AS pr_auc')} FROM (
            SELECT fold, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY fold) AS np FROM (
              SELECT fold, score, CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS n FROM scored
              GROUP BY fold, score)
            WINDOW w AS (PARTITION BY fold ORDER BY score DESC)) GROUP BY fold"""
    ),
)
def k9(spark, sf) -> DataFrame:
    return sel(K.ranking_scores(X.scored_labels(spark, sf), "label", "score", ["fold"]), "fold", "pr_auc")


_REG_SQL = """reg AS (SELECT CAST(event_id % 5 + 1 AS INTEGER) AS fold, value AS y, value * 0.5 + event_id % 7 AS p FROM events)"""
_REG_AGG = f"""SELECT fold, {q('avg(abs(y - p)) AS mae', 'sqrt(avg((y - p) * (y - p))) AS rmse',
  '1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2')} FROM reg GROUP BY fold"""


def _regression(spark, sf) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf, "events").select(
        (i % 5 + 1).cast("int").alias("fold"), F.col("value").alias("y"), (F.col("value") * 0.5 + i % 7).alias("p")
    )
    return K.regression_scores(e, "y", "p", ["fold"])


@query("K10_regression_metrics", f"WITH {_REG_SQL} {_REG_AGG}")
def k10(spark, sf) -> DataFrame:
    return sel(_regression(spark, sf), "fold", "mae rmse r2")


@query(
    "K11_fold_summary",
    f"""WITH {_REG_SQL}, m AS (SELECT fold, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
          1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM reg GROUP BY fold),
        l AS (SELECT 'mae' AS metric, mae AS v FROM m UNION ALL SELECT 'rmse', rmse FROM m UNION ALL SELECT 'r2', r2 FROM m)
        SELECT metric, {q('avg(v) AS mean', 'stddev_pop(v) AS std')} FROM l GROUP BY metric""",
)
def k11(spark, sf) -> DataFrame:
    return sel(K.fold_summary(_regression(spark, sf), ["mae", "rmse", "r2"]), "metric", "mean std")


# -------------------------------------------------------------------- models
MODEL_FEATURES = [*CORE_FEATURES, *OPTIONAL_FEATURES]
FITS = {
    "classification": ML.ModelSpec("logistic_regression"),
    "regression": ML.ModelSpec("linear_regression"),
}
TREES = {k: v for k, v in ML.PRODUCTION_PARAMS.items() if k != "scale_pos_weight"}


def _full_training(spark, sf, kinds) -> DataFrame:
    """Rows with every feature of the contract, from documents, and what folds and policies need.

    Whoever reads them twice writes them once; the fold steps do so themselves.
    """
    line = SE.feature_line(_feature_rows(spark, sf), X.GAP_MINUTES)
    df = TG.add_targets(line, kinds, SESSION, ORDER, "session_pl", position="games_played")
    df = df.withColumn("sid", F.concat_ws("/", "player", "session_id"))
    return df.select(*ORDER, "sid", "rating_diff", *MODEL_FEATURES, *[f"target__{kind}" for kind in kinds])


def _training(spark, sf) -> DataFrame:
    df = _targets(spark, sf, ["peak_binary", "future_upside_regression"])
    return df.withColumn("sid", F.concat_ws("/", "player", "session_id"))


_TOD_SQL = ", ".join(f"CAST(tod_label = '{t}' AS INTEGER) AS tod_{t}" for t in S.TOD_LABELS)


@query(
    "K1_feature_vector",
    X.with_documents(f"SELECT game_id, {q(*CORE_FEATURES, places=FINE)} FROM (SELECT *, {_TOD_SQL} FROM feat)"),
)
def k1(spark, sf) -> DataFrame:
    """The assembled vector, taken apart again in contract order."""
    from pyspark.ml.functions import vector_to_array

    df = SE.feature_table(_feature_rows(spark, sf), X.GAP_MINUTES)
    data = ML.model_input(df, CORE_FEATURES, "target")
    out = ML.assembler(CORE_FEATURES).transform(data).select("game_id", vector_to_array("features").alias("v"))
    return out.select("game_id", *[r6(F.col("v")[i], FINE).alias(c) for i, c in enumerate(CORE_FEATURES)])


def _model_query(name: str, kind: str, params: dict, target: str) -> None:
    @query(name)
    def run(spark, sf) -> DataFrame:
        spec = ML.ModelSpec(kind, params)
        df = cut_lineage(_full_training(spark, sf, [target.removeprefix("target__")]))
        _, out = ML.final_scores(df, MODEL_FEATURES, target, spec)
        return out.select("game_id", F.col(target).alias("label"), r6(F.col("policy_score")).alias("policy_score"))


_model_query("K2_boosted_classifier", "xgb_classifier", ML.PRODUCTION_PARAMS, "target__peak_binary")
_model_query("K3_boosted_regressor", "xgb_regressor", TREES, "target__future_upside_regression")
_model_query("K4_logistic_regression", "logistic_regression", {}, "target__peak_binary")
_model_query("K4_linear_regression", "linear_regression", {}, "target__future_upside_regression")


def _oof(df: DataFrame, kind: str) -> DataFrame:
    rows, folds = ML.fix_folds(df, "sid", "created_at_ms", 5, 1)
    return ML.out_of_fold(rows, folds, MODEL_FEATURES, f"target__{kind}", kind, FITS[TG.TASKS[kind]], "sid", ["game_id"])


@query("K5_out_of_fold_scores")
def k5(spark, sf) -> DataFrame:
    out = _oof(_full_training(spark, sf, ["peak_binary"]), "peak_binary")
    return out.select("game_id", "sid", "oof_score", "oof_fold", "oof_is_validation", "objective_kind")


def _with_document_groups(body: str) -> str:
    return X.with_documents(", " + _GROUP_SQL.replace("{gap}", "1") + "\n" + body)


@query(
    "K5_out_of_fold_coverage",
    _with_document_groups(
        """SELECT game_id, CAST(fold AS DOUBLE) AS oof_fold, CASE WHEN fold IS NULL THEN 0 ELSE 1 END AS oof_is_validation,
           'regression' AS task_type FROM grouped LEFT JOIN (SELECT * FROM folds WHERE role = 'valid') v USING (sid)"""
    ),
)
def k5_coverage(spark, sf) -> DataFrame:
    kind = "future_upside_regression"
    return _oof(_full_training(spark, sf, [kind]), kind).select("game_id", "oof_fold", "oof_is_validation", "task_type")


@query(
    "K4_linear_regression_one_feature",
    X.with_history(
        f"""SELECT game_id, {q('a + b * session_pl AS policy_score')} FROM feat,
            (SELECT regr_intercept(suffix_max - session_pl, session_pl) AS a,
              regr_slope(suffix_max - session_pl, session_pl) AS b FROM feat) f"""
    ),
)
def k4_one(spark, sf) -> DataFrame:
    df = _targets(spark, sf, ["future_upside_regression"])
    spec = ML.ModelSpec("linear_regression")
    _, out = ML.final_scores(df, ["session_pl"], "target__future_upside_regression", spec)
    return out.select("game_id", r6(F.col("policy_score")).alias("policy_score"))


def _two_groups(spark, sf, kind: str, model: str, params: dict) -> DataFrame:
    """Scores of a model that sees one 0/1 feature, whether the session is ahead."""
    df = _targets(spark, sf, [kind]).withColumn("ahead", F.when(F.col("session_pl") > 0, 1.0).otherwise(0.0))
    _, out = ML.final_scores(df, ["ahead"], f"target__{kind}", ML.ModelSpec(model, params))
    return out.select("game_id", F.col("policy_score").alias("policy_score"))


_ONE_SPLIT = {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0}
_GROUP = "OVER (PARTITION BY session_pl > 0)"


@query(
    "K2_boosted_classifier_one_split",
    X.with_history(f"SELECT game_id, round(1 / (1 + exp(-2 * (2 * avg(CAST(target AS DOUBLE)) {_GROUP} - 1))), 6) + 0.0 AS policy_score FROM feat"),
)
def k2_one(spark, sf) -> DataFrame:
    """A tree of one split on a 0/1 feature gives the log-odds form of two class means."""
    return sel(_two_groups(spark, sf, "peak_binary", "xgb_classifier", _ONE_SPLIT), "game_id", "policy_score")


@query(
    "K3_boosted_regressor_one_split",
    X.with_history(f"SELECT game_id, round(avg(suffix_max - session_pl) {_GROUP}, 6) + 0.0 AS policy_score FROM feat"),
)
def k3_one(spark, sf) -> DataFrame:
    return sel(_two_groups(spark, sf, "future_upside_regression", "xgb_regressor", _ONE_SPLIT), "game_id", "policy_score")


@query(
    "K4_logistic_regression_two_rates",
    X.with_history(f"SELECT game_id, round(avg(CAST(target AS DOUBLE)) {_GROUP}, 6) + 0.0 AS policy_score FROM feat"),
)
def k4_rates(spark, sf) -> DataFrame:
    """Without a penalty and with one 0/1 feature, the scores are two class rates."""
    out = _two_groups(spark, sf, "peak_binary", "logistic_regression", {"C": 1e12, "tol": 1e-10})
    return sel(out, "game_id", "policy_score")


@query(
    "K6_final_fit_saved_and_reloaded",
    X.with_history(
        f"""SELECT game_id, {q('a + b * session_pl AS policy_score')}, 'in_sample_fallback' AS score_source FROM feat,
            (SELECT regr_intercept(suffix_max - session_pl, session_pl) AS a,
              regr_slope(suffix_max - session_pl, session_pl) AS b FROM feat) f"""
    ),
)
def k6_closed(spark, sf) -> DataFrame:
    df = _targets(spark, sf, ["future_upside_regression"])
    spec = ML.ModelSpec("linear_regression")

    def in_sample() -> DataFrame:
        model = ML.save_and_reload(ML.fit(df, ["session_pl"], "target__future_upside_regression", spec), spark)
        return ML.score(model, df, ["session_pl"], spec, "policy_score")

    rows, source = ML.scoring_frame(None, in_sample)
    return sel(rows, "game_id", "policy_score").withColumn("score_source", F.lit(source))


@query("K6_final_fit_fallback")
def k6(spark, sf) -> DataFrame:
    spec = FITS["classification"]
    df = cut_lineage(_full_training(spark, sf, ["peak_binary"]))

    def in_sample() -> DataFrame:
        model = ML.save_and_reload(ML.fit(df, MODEL_FEATURES, "target__peak_binary", spec), spark)
        return ML.score(model, df, MODEL_FEATURES, spec, "policy_score")

    rows, source = ML.scoring_frame(None, in_sample)
    return rows.select("game_id", r6(F.col("policy_score")).alias("policy_score"), F.lit(source).alias("score_source"))


# -------------------------------------------------------------------- policy
@query(
    "J1_continue_score",
    X.with_history(f"SELECT game_id, {q('(suffix_max - session_pl) - 2.0 * (session_pl - suffix_min) - 3.0 AS score')} FROM feat"),
)
def j1(spark, sf) -> DataFrame:
    cfg = P.POLICIES["conservative"]
    t = _targets(spark, sf, ["future_upside_regression", "future_drawdown_regression"])
    up, down = F.col("target__future_upside_regression"), F.col("target__future_drawdown_regression")
    return t.select("game_id", r6(P.continue_score(up, down, cfg["lambda"], cfg["friction_cost"])).alias("score"))


def _test(op: str, t: float) -> str:
    return f"(score IS NOT NULL AND NOT isnan(score) AND score {op} {t})"


@query(
    "J2_simple_actions",
    X.with_history(
        f"""SELECT game_id, CASE WHEN {_test('>=', 0.42)} THEN 'continue' ELSE 'stop' END AS by_probability,
            CASE WHEN {_test('>', 0.3)} THEN 'continue' ELSE 'stop' END AS by_score FROM hist"""
    ),
)
def j2(spark, sf) -> DataFrame:
    return X.history(spark, sf).select(
        "game_id",
        P.action_from_probability(F.col("score"), 0.42).alias("by_probability"),
        P.action_from_score(F.col("score"), 0.3).alias("by_score"),
    )


# What each policy resolves to, in the order of the objectives.
_RESOLVED = {
    "aggressive": [0.60, 0.42, 0.0, 6.0, 0.0],
    "balanced": [0.60, 0.50, 0.0, 6.0, 0.0],
    "conservative": [0.60, 0.60, 0.0, 6.0, 0.0],
}
_RESOLVED_SQL = ", ".join(
    f"('{p}', '{k}', CAST({t} AS DOUBLE))" for p, ts in _RESOLVED.items() for k, t in zip(P.OBJECTIVES, ts)
)


@query(
    "J3_threshold_resolution",
    X.with_history(
        f"""SELECT policy, objective, threshold,
            count(*) FILTER (score IS NOT NULL AND NOT isnan(score) AND score >= threshold) AS n
            FROM hist, (VALUES {_RESOLVED_SQL}) r(policy, objective, threshold) GROUP BY ALL"""
    ),
)
def j3(spark, sf) -> DataFrame:
    """Thresholds of every policy and objective, with how many given scores reach each."""
    pairs = [(p, k, P.resolve_threshold(c, k)) for p, c in P.POLICIES.items() for k in P.OBJECTIVES]
    h = X.history(spark, sf)
    hits = [F.sum(P.holds(F.col("score"), ">=", t).cast("long")).alias(f"_{i}") for i, (_, _, t) in enumerate(pairs)]
    rows = [
        F.struct(F.lit(p).alias("policy"), F.lit(k).alias("objective"), F.lit(t).alias("threshold"), F.col(f"_{i}").alias("n"))
        for i, (p, k, t) in enumerate(pairs)
    ]
    return h.agg(*hits).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(
    "J4_objective_actions",
    X.with_history(
        f"""SELECT game_id, CASE WHEN {_test('>=', 0.6)} THEN 'stop' ELSE 'continue' END AS peak_binary,
            CASE WHEN {_test('>=', 0.5)} THEN 'continue' ELSE 'stop' END AS meaningful_upside_binary,
            CASE WHEN {_test('>=', 0.0)} THEN 'continue' ELSE 'stop' END AS future_upside_regression,
            CASE WHEN {_test('>=', 0.7)} THEN 'stop' ELSE 'continue' END AS future_drawdown_regression,
            CASE WHEN {_test('<=', 0.2)} THEN 'stop' ELSE 'continue' END AS games_to_peak_regression FROM hist"""
    ),
)
def j4(spark, sf) -> DataFrame:
    cfg = P.POLICIES["balanced"]
    own = {"future_drawdown_regression": 0.7, "games_to_peak_regression": 0.2}
    acts = [P.action_from_objective(F.col("score"), k, cfg, own.get(k)).alias(k) for k in P.OBJECTIVES]
    return X.history(spark, sf).select("game_id", *acts)


# ------------------------------------------------------------------ backtest
_BT_SQL = """bt_grid AS (SELECT unnest({grid}) AS t),
bt_hit AS (SELECT f.player, f.session_id, g.t,
    min(CASE WHEN {hit} THEN games_played END) AS a_pos,
    min(CASE WHEN session_pl <= {margin} THEN games_played END) AS m_pos,
    max(games_played) AS n, max(session_pl) AS peak_pl
  FROM feat f, bt_grid g GROUP BY f.player, f.session_id, g.t),
bt_end AS (SELECT *, least(coalesce(a_pos, n), coalesce(m_pos, n)) AS stop_pos FROM bt_hit),
bt AS (SELECT e.*, coalesce(m_pos = stop_pos, FALSE) AS margin_triggered,
    coalesce(a_pos = stop_pos, FALSE) AND NOT coalesce(m_pos = stop_pos, FALSE) AS stop_triggered,
    s.session_pl AS stop_pl, l.session_pl AS final_pl, s.first_max_game AS peak_pos,
    CASE WHEN s.session_pl >= 0 THEN s.session_pl ELSE s.session_pl * 2.5 END AS tapl,
    CASE WHEN peak_pl <> 0 THEN s.session_pl / peak_pl END AS capture
  FROM bt_end e JOIN feat s ON s.player = e.player AND s.session_id = e.session_id AND s.games_played = e.stop_pos
  JOIN feat l ON l.player = e.player AND l.session_id = e.session_id AND l.games_played = e.n)"""


def _with_backtest(body: str, grid: list[float], hit: str, margin: float = X.MARGIN) -> str:
    values = "[" + ", ".join(f"CAST('{t!r}' AS DOUBLE)" for t in grid) + "]"
    return X.with_history(
        ", " + _BT_SQL.replace("{grid}", values).replace("{hit}", hit).replace("{margin}", str(margin)) + "\n" + body
    )


def _hit(op: str) -> str:
    return f"score IS NOT NULL AND NOT isnan(score) AND score {op} g.t"


_RECORD_SQL = f"""SELECT player, session_id, n AS n_games, CAST(stop_triggered AS INTEGER) AS stop_triggered,
  CAST(margin_triggered AS INTEGER) AS margin_triggered, stop_pos AS stop_game_index, n AS actual_final_game_index,
  peak_pos AS peak_game_index, {q('stop_pl', 'tapl', 'final_pl AS actual_final_pl', 'peak_pl',
  'stop_pl - final_pl AS elo_delta_vs_actual', 'peak_pl - stop_pl AS elo_left_vs_peak', 'capture AS capture_ratio')} FROM bt"""
_SUMMARY_PARTS = f"""count(*) AS n_sessions, count(*) FILTER (stop_triggered) AS n_stop_sessions,
  count(*) FILTER (margin_triggered) AS n_margin_calls,
  {q('sum(final_pl) AS total_actual_final_pl', 'sum(stop_pl) AS total_stop_pl', 'sum(peak_pl) AS total_peak_pl',
     'sum(tapl) AS total_tapl', 'sum(stop_pl - final_pl) AS total_elo_delta_vs_actual',
     'sum(peak_pl - stop_pl) AS total_elo_left_vs_peak', 'avg(stop_pl) AS mean_realized_pl',
     'avg(final_pl) AS mean_actual_final_pl', 'avg(peak_pl) AS mean_peak_pl', 'avg(tapl) AS mean_tapl',
     'coalesce(avg(capture), 0) AS mean_capture_ratio', 'avg(stop_pos) AS mean_stop_game_index')}"""


def _record_view(records: DataFrame) -> DataFrame:
    records = records.withColumns({c: F.col(c).cast("int") for c in ("stop_triggered", "margin_triggered")})
    return sel(
        records,
        "player session_id n_games stop_triggered margin_triggered stop_game_index actual_final_game_index peak_game_index",
        "stop_pl tapl actual_final_pl peak_pl elo_delta_vs_actual elo_left_vs_peak capture_ratio",
    )


def _summary_view(summary: DataFrame, *keys: str) -> DataFrame:
    counts = ["n_sessions", "n_stop_sessions", "n_margin_calls"]
    return sel(summary, " ".join([*keys, *counts]), " ".join(c for c in B.SUMMARY_COLUMNS if c not in counts))


def _records(spark, sf, **kw) -> DataFrame:
    line = _line(spark, sf, **kw)
    act = P.action_from_objective(F.col("score"), "peak_binary", P.POLICIES["balanced"])
    return B.backtest_sessions(
        line.with_columns({"action": act}), SESSION, ORDER, "session_pl", "action", max_drawdown=X.MARGIN
    )


_J5_SQL = _with_backtest(_RECORD_SQL, [0.6], _hit(">="))


@query("J5_session_backtest", _J5_SQL)
def j5(spark, sf) -> DataFrame:
    return _record_view(_records(spark, sf))


@query("J5_session_backtest_hot_split", _J5_SQL)
def j5_hot(spark, sf) -> DataFrame:
    return _record_view(_records(spark, sf, max_rows=SMALL_GROUP))


@query("J7_backtest_summary", _with_backtest(f"SELECT {_SUMMARY_PARTS} FROM bt", [0.6], _hit(">=")))
def j7(spark, sf) -> DataFrame:
    return _summary_view(B.summarize(_records(spark, sf)))


def _sweep(spark, sf, kind: str = "peak_binary", start=None, stop=None, **kw) -> DataFrame:
    return B.threshold_sweep(
        _line(spark, sf, **kw), SESSION, ORDER, "session_pl", "score", kind, P.POLICIES["balanced"],
        start, stop, max_drawdown=X.MARGIN,
    )


def _sweep_sql(hit: str, grid: list[float]) -> str:
    return _with_backtest(f"SELECT {q('t AS threshold_value')}, {_SUMMARY_PARTS} FROM bt GROUP BY t", grid, hit)


def _sweep_view(df: DataFrame) -> DataFrame:
    return _summary_view(df.withColumn("threshold_value", r6(F.col("threshold_value"))), "threshold_value")


_PEAK_GRID = B.sweep_grid(0.6)
_UNIT_GRID = B.linspace(0.05, 0.95, 21)


@query("J6_threshold_sweep", _sweep_sql(_hit(">="), _PEAK_GRID))
def j6(spark, sf) -> DataFrame:
    return _sweep_view(_sweep(spark, sf))


@query("J6_threshold_sweep_hot_split", _sweep_sql(_hit(">="), _PEAK_GRID))
def j6_hot(spark, sf) -> DataFrame:
    return _sweep_view(_sweep(spark, sf, max_rows=SMALL_GROUP))


@query("J6_sweep_continue_rule", _sweep_sql(f"NOT ({_hit('>=')})", _UNIT_GRID))
def j6_continue(spark, sf) -> DataFrame:
    return _sweep_view(_sweep(spark, sf, "meaningful_upside_binary", 0.05, 0.95))


@query("J6_sweep_low_stop_rule", _sweep_sql(_hit("<="), _UNIT_GRID))
def j6_low(spark, sf) -> DataFrame:
    return _sweep_view(_sweep(spark, sf, "games_to_peak_regression", 0.05, 0.95))


_BEST_SQL = _with_backtest(
    f"""SELECT {q('t AS threshold_value')}, {q('d AS total_elo_delta_vs_actual')} FROM (
        SELECT t, sum(stop_pl - final_pl) AS d FROM bt GROUP BY t) ORDER BY d DESC, t LIMIT 1""",
    _PEAK_GRID,
    _hit(">="),
)


@query("J6_best_threshold", _BEST_SQL)
def j6_best(spark, sf) -> DataFrame:
    return sel(B.best_threshold(_sweep(spark, sf)), "", "threshold_value total_elo_delta_vs_actual")


_D4_SQL = _with_backtest(
    f"""SELECT player, session_id, {q('t AS threshold_value')}, stop_pos AS stop_game_index, {q('stop_pl')} FROM bt""",
    _PEAK_GRID,
    _hit(">="),
)


@query("D4_thresholds_by_sessions", _D4_SQL)
def d4(spark, sf) -> DataFrame:
    records = B.sweep_sessions(
        _line(spark, sf), SESSION, ORDER, "session_pl", "score", _PEAK_GRID, ">=", max_drawdown=X.MARGIN
    )
    return sel(records, "player session_id stop_game_index", "threshold_value stop_pl")


_J8_SQL = _with_backtest(
    f"""SELECT {q('t AS threshold_value')}, {q('sum(stop_pl) AS simulated_pl', 'sum(final_pl) AS baseline_pl')}
        FROM bt GROUP BY t""",
    B.production_thresholds(),
    _hit(">"),
    -1e18,
)


def _search(spark, sf) -> DataFrame:
    return B.production_search(_gap_line(spark, sf), SESSION, ORDER, "rating_diff", "score")


@query("J8_production_search", _J8_SQL)
def j8(spark, sf) -> DataFrame:
    return sel(_search(spark, sf), "", "threshold_value simulated_pl baseline_pl")


@query(
    "J8_production_choice",
    _with_backtest(
        f"""SELECT {q('t AS threshold', 'b AS baseline_rating_diff_sum', 's AS optimized_rating_diff_sum',
            's - b AS estimated_gain')} FROM (SELECT t, sum(stop_pl) AS s, sum(final_pl) AS b FROM bt GROUP BY t)
            ORDER BY s DESC, t LIMIT 1""",
        B.production_thresholds(),
        _hit(">"),
        -1e18,
    ),
)
def j8_choice(spark, sf) -> DataFrame:
    return sel(
        B.production_choice(_search(spark, sf)),
        "",
        "threshold baseline_rating_diff_sum optimized_rating_diff_sum estimated_gain",
    )


@query("J8_production_run")
def j8_run(spark, sf) -> DataFrame:
    """Group-checked classifier and its threshold, from features to summary."""
    from gapline.plans.lab import production_run

    spec = ML.ModelSpec("xgb_classifier", ML.PRODUCTION_PARAMS)
    summary, _, _ = production_run(
        _full_training(spark, sf, ["peak_binary"]), MODEL_FEATURES, "target__peak_binary", "sid", ORDER, "rating_diff", ["game_id"], spec
    )
    return summary


@query(
    "J8_production_run_invariants",
    X.with_documents(
        f"""SELECT count(*) AS n_rows, {len(MODEL_FEATURES)} AS n_features, 5 AS n_folds, TRUE AS mean_agrees,
            TRUE AS std_agrees, TRUE AS aucs_in_range FROM feat"""
    ),
)
def j8_invariants(spark, sf) -> DataFrame:
    """What holds for the summary whatever the trees: its sizes, and figures that follow from others."""
    aucs = F.col("cv_auc_scores")
    mean = F.aggregate(aucs, F.lit(0.0), lambda a, x: a + x) / F.size(aucs)
    square = F.aggregate(aucs, F.lit(0.0), lambda a, x: a + (x - F.col("cv_auc_mean")) ** 2) / F.size(aucs)
    return j8_run(spark, sf).select(
        F.col("rows").alias("n_rows"),
        F.size("features").alias("n_features"),
        F.size(aucs).alias("n_folds"),
        (F.abs(mean - F.col("cv_auc_mean")) < 1e-9).alias("mean_agrees"),
        (F.abs(F.sqrt(square) - F.col("cv_auc_std")) < 1e-9).alias("std_agrees"),
        F.forall(aucs, lambda x: x.between(0, 1)).alias("aucs_in_range"),
    )


# ------------------------------------------------------------------- reports
REPORT_COLUMNS = ["my_acpl", "my_avg_secs_per_move", "result", "rating_diff", "time_gap_ms"]


def _long_sql(cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM f_gap" for c in cols)


_DESCRIBE_SQL = X.with_history(
    f"""SELECT "column", count(v) AS count, {q('avg(v) AS mean', 'stddev_samp(v) AS std', 'min(v) AS min',
        'quantile_cont(v, 0.25) AS p25', 'quantile_cont(v, 0.5) AS p50', 'quantile_cont(v, 0.75) AS p75',
        'max(v) AS max', 'avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) AS missing_frac')}
        FROM ({_long_sql(REPORT_COLUMNS)}) GROUP BY "column\""""
)
_DESCRIBE_COLUMNS = "mean std min p25 p50 p75 max missing_frac"


@query("E8_describe", _DESCRIBE_SQL)
def e8(spark, sf) -> DataFrame:
    return sel(R.describe(_gap_line(spark, sf).result(), REPORT_COLUMNS), "column count", _DESCRIBE_COLUMNS)


@query("E8_describe_hot_split", _DESCRIBE_SQL)
def e8_hot(spark, sf) -> DataFrame:
    df = _gap_line(spark, sf).result()
    return sel(R.describe(df, REPORT_COLUMNS, max_rows=100), "column count", _DESCRIBE_COLUMNS)


@query(
    "E9_correlations",
    X.with_history(
        "SELECT x, y, round(coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0), 6) + 0.0 AS corr FROM ("
        + " UNION ALL ".join(
            f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS c FROM f_gap"
            for a in REPORT_COLUMNS
            for b in REPORT_COLUMNS
        )
        + ")"
    ),
)
def e9(spark, sf) -> DataFrame:
    return sel(R.correlations(_gap_line(spark, sf).result(), REPORT_COLUMNS), "x y", "corr")


@query(
    "G2_largest_sessions",
    X.with_history(
        """SELECT player, session_id, count(*) AS n_rows FROM f_sess GROUP BY player, session_id
           ORDER BY n_rows DESC, player, session_id LIMIT 16"""
    ),
)
def g2(spark, sf) -> DataFrame:
    return R.largest_sessions(_gap_line(spark, sf).df, SESSION, 16)


@query(
    "G4_feature_sample",
    X.with_history(
        """SELECT CAST(my_acpl AS FLOAT) AS my_acpl, CAST(games_played AS FLOAT) AS games_played,
           CAST(session_pl AS FLOAT) AS session_pl, CAST(loss_streak AS FLOAT) AS loss_streak FROM feat
           ORDER BY created_at_ms, game_id LIMIT 32"""
    ),
)
def g4(spark, sf) -> DataFrame:
    cols = ["my_acpl", "games_played", "session_pl", "loss_streak"]
    return R.feature_sample(_line(spark, sf).df, cols, ORDER)


_HIST_SQL = """h AS (SELECT {cls} AS class, "column", v FROM (
    SELECT result, 'my_acpl' AS "column", my_acpl AS v FROM hist
    UNION ALL SELECT result, 'my_avg_secs_per_move', my_avg_secs_per_move FROM hist
    UNION ALL SELECT result, 'constant', 1.0 FROM hist) WHERE v IS NOT NULL),
r AS (SELECT class, "column", CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
    CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM h GROUP BY class, "column"),
b AS (SELECT class, "column", lo, hi, CAST(least(floor((v - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin
  FROM h JOIN r USING (class, "column"))
SELECT class, "column", round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi, bin, count(*) AS n,
  round(lo + bin * (hi - lo) / 30, 6) + 0.0 AS bin_from FROM b GROUP BY class, "column", lo, hi, bin"""


def _histogram_frame(spark, sf) -> DataFrame:
    return X.history(spark, sf).withColumn("constant", F.lit(1.0))


_HIST_COLUMNS = ["my_acpl", "my_avg_secs_per_move", "constant"]


@query(
    "L1_histograms_by_class",
    X.with_history(", " + _HIST_SQL.replace("{cls}", "CASE result WHEN 1.0 THEN '1.0' WHEN 0.0 THEN '0.0' ELSE '0.5' END")),
)
def l1(spark, sf) -> DataFrame:
    out = R.histograms(_histogram_frame(spark, sf), _HIST_COLUMNS, "result")
    return sel(out, "class column bin n", "lo hi bin_from")


@query("L1_histograms", X.with_history(", " + _HIST_SQL.replace("{cls}", "'all'")))
def l1_all(spark, sf) -> DataFrame:
    # More than eight values, so the target is ignored.
    out = R.histograms(_histogram_frame(spark, sf), _HIST_COLUMNS, "rating_diff")
    return sel(out, "class column bin n", "lo hi bin_from")


@query(
    "L2_session_traces",
    X.with_history(
        f"""SELECT f.player, f.session_id, games_played AS game_in_session, {q('session_pl AS value')} FROM feat f
            JOIN (SELECT player, session_id FROM f_sess GROUP BY ALL ORDER BY count(*) DESC, player, session_id LIMIT 16) t
            USING (player, session_id)"""
    ),
)
def l2(spark, sf) -> DataFrame:
    line = _line(spark, sf)
    out = R.session_traces(line.result(), SESSION, ORDER, "session_pl")
    return sel(out, "player session_id game_in_session", "value")


@query(
    "L3_policy_traces",
    X.with_history(
        f"""SELECT player, session_id, games_played AS game_in_session, {q('session_pl AS value')},
            CAST(hit AS INTEGER) AS is_stop, target AS is_peak,
            min(CASE WHEN hit THEN games_played END) OVER (PARTITION BY player, session_id) AS first_stop_game
            FROM (SELECT *, {_test('>=', 0.6)} AS hit FROM feat)"""
    ),
)
def l3(spark, sf) -> DataFrame:
    act = P.action_from_objective(F.col("score"), "peak_binary", P.POLICIES["balanced"])
    df = _line(spark, sf).result().withColumn("action", act)
    out = R.policy_traces(df, SESSION, ORDER, "session_pl", "action", "score")
    return sel(out, "player session_id game_in_session is_stop is_peak first_stop_game", "value")


def _run_rows(spark, sf) -> dict[str, DataFrame]:
    scored = X.scored_labels(spark, sf)
    ranking = K.ranking_scores(scored, "label", "score")
    f1 = K.f1_scores(scored, "label", "score")
    return {
        "classifier": ranking.withColumn("one", F.lit(1)).join(f1.withColumn("one", F.lit(1)), "one").drop("one"),
        "regressor": K.regression_scores(
            table(spark, sf, "events").select(F.col("value").alias("y"), (F.col("value") * 0.5).alias("p")), "y", "p"
        ),
    }


_RUNS_SQL = f"""WITH {X.SCORED_SQL}, m AS (SELECT avg(abs(value * 0.5)) AS mae, sqrt(avg(value * value * 0.25)) AS rmse,
          1 - sum(value * value * 0.25) / (var_pop(value) * count(*)) AS r2 FROM events),
        a AS (SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS roc_auc
          FROM scored a, scored b WHERE a.label = 1 AND b.label = 0),
        f AS (SELECT 2.0 * count(*) FILTER (score >= 0.5 AND label = 1) / (2 * count(*) FILTER (score >= 0.5 AND label = 1)
          + count(*) FILTER (score >= 0.5 AND label = 0) + count(*) FILTER (score < 0.5 AND label = 1)) AS f1 FROM scored)
        SELECT 'classifier' AS run, {q('roc_auc', 'f1')}, NULL AS mae, NULL AS rmse, NULL AS r2 FROM a, f
        UNION ALL SELECT 'regressor', NULL, NULL, {q('mae', 'rmse', 'r2')} FROM m"""


@query("L4_runs_from_folders", _RUNS_SQL)
def l4_folders(spark, sf) -> DataFrame:
    """The metrics of two run folders, written as runs write them, compared from the files."""
    from gapline.plans.lab import read_runs
    from gapline.runtime import scratch_path
    from gapline.sources import sinks

    base = scratch_path(spark, "runs")
    for name, row in _run_rows(spark, sf).items():
        metrics = K.fold_summary(row.withColumn("fold", F.lit(1)), [c for c in row.columns if c != "fold"])
        sinks.write_manifest(metrics, f"{base}/{name}/metrics")
    runs = {name: f"{base}/{name}" for name in ("classifier", "regressor")}
    return sel(read_runs(spark, runs), "run", "roc_auc f1 mae rmse r2")


@query("L4_run_comparison", _RUNS_SQL)
def l4(spark, sf) -> DataFrame:
    return sel(R.compare_runs(_run_rows(spark, sf)), "run", "roc_auc f1 mae rmse r2")


@query(
    "L5_metric_flattening",
    f"""WITH {_REG_SQL}, m AS ({_REG_AGG})
        SELECT fold, 'run_mae' AS metric, mae AS value FROM m UNION ALL SELECT fold, 'run_rmse', rmse FROM m
        UNION ALL SELECT fold, 'run_r2', r2 FROM m""",
)
def l5(spark, sf) -> DataFrame:
    return sel(R.flatten_metrics(_regression(spark, sf), ["fold"], "run_"), "fold metric", "value")


@query("L6_objective_matrix")
def l6(spark, sf) -> DataFrame:
    """Four experiments over one set of targets, metrics keyed by objective."""
    from gapline.plans.lab import objective_matrix

    kinds = _ALL_KINDS[:4]
    df = _full_training(spark, sf, kinds)
    specs = {k: FITS[TG.TASKS[k]] for k in kinds}
    return objective_matrix(df, kinds, MODEL_FEATURES, "sid", "created_at_ms", ["game_id"], specs)


_LINEAR_SQL = """long AS (
  SELECT kind, player || '/' || session_id AS sid, session_pl AS x,
    CASE kind WHEN 'future_upside_regression' THEN suffix_max - session_pl ELSE session_pl - suffix_min END AS y
  FROM feat, (SELECT unnest(['future_upside_regression', 'future_drawdown_regression']) AS kind)),
fits AS (
  SELECT kind, fold, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM long JOIN folds USING (sid) WHERE role = 'train' GROUP BY kind, fold),
errors AS (
  SELECT kind, fold, avg(abs(y - a - b * x)) AS mae, avg((y - a - b * x) * (y - a - b * x)) AS mse, var_pop(y) AS spread
  FROM long JOIN folds USING (sid) JOIN fits USING (kind, fold) WHERE role = 'valid' GROUP BY kind, fold),
scores AS (
  SELECT kind, fold, 'mae' AS metric, mae AS v FROM errors UNION ALL SELECT kind, fold, 'rmse', sqrt(mse) FROM errors
  UNION ALL SELECT kind, fold, 'r2', 1 - mse / spread FROM errors)"""


@query(
    "L6_objective_matrix_one_feature",
    X.with_history(
        ", " + _GROUP_SQL.replace("{gap}", "1") + ", " + _LINEAR_SQL
        + f" SELECT kind AS objective_kind, metric, {q('avg(v) AS mean', 'stddev_pop(v) AS std')} FROM scores GROUP BY kind, metric"
    ),
)
def l6_one(spark, sf) -> DataFrame:
    """Two linear objectives of one feature, whose fits and fold metrics have closed forms."""
    from gapline.plans.lab import objective_matrix

    kinds = ["future_upside_regression", "future_drawdown_regression"]
    df = _targets(spark, sf, kinds).withColumn("sid", F.concat_ws("/", "player", "session_id"))
    out = objective_matrix(df, kinds, ["session_pl"], "sid", "created_at_ms", ["game_id"])
    return sel(out, "objective_kind metric", "mean std")
