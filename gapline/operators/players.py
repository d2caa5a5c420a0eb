"""Population side: player games, sessions, profiles and a stratified selection."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.functions import scalars as S
from gapline.operators.ordered import MAX_GROUP_ROWS, Ordered, arrange
from gapline.runtime import broadcast_if_small, cut_lineage

BIN = ["elo_bin_lo", "elo_bin_hi"]
# Rows a group may keep for Spark to prune before the shuffle, its own default.
PRUNED_ROWS = 1000
# Size of a quantile sketch, and a few of its errors in ranks.
SKETCH_K, SKETCH_SLACK, HALVINGS = 2048, 0.005, 9

CATALOG_SHARED = [
    "result",
    "winner",
    "utc_date",
    "utc_time_text",
    "game_ts",
    "opening",
    "eco",
    "victory_status",
    "time_control",
    "source_file",
]


@dataclass(frozen=True)
class SelectionFilters:
    """Limits of the player selection, defaults as fixed values."""

    min_games: int = 50
    min_sessions: int = 5
    session_gap_hours: int = 24
    min_elo: int = 1000
    max_elo: int = 2700
    elo_bin_size: int = 200
    per_bin: int = 20
    min_active_months: int = 2
    min_coverage_days: int = 14
    rated_only: bool = False

    def as_dict(self) -> dict:
        return asdict(self)


def _both_sides(games: DataFrame, white: list[Column], black: list[Column]) -> DataFrame:
    """Two rows per game from one scan: explode of both side structs."""
    return games.select(F.explode(F.array(F.struct(*white), F.struct(*black))).alias("g")).select("g.*")


def catalog_player_games(catalog: DataFrame) -> DataFrame:
    """Catalog form, 15 columns, rows without a player name dropped."""

    def side(name: str, other: str) -> list[Column]:
        return [
            F.col("game_id"),
            F.col(f"{name}_player").alias("player_name"),
            F.lit(name).alias("side"),
            F.col(f"{name}_elo").alias("player_elo"),
            F.col(f"{other}_elo").alias("opponent_elo"),
            *[F.col(c) for c in CATALOG_SHARED],
        ]

    return _both_sides(catalog, side("white", "black"), side("black", "white")).filter(
        F.col("player_name").isNotNull()
    )


def player_games(catalog: DataFrame, rated_only: bool = False) -> DataFrame:
    """Normalised form, 12 columns: usable time, numeric ratings, side outcome.

    Rows without player, time or rating are dropped; ``rated_only`` also drops
    games not marked as rated.
    """
    when = S.event_time(catalog, "last_move_at", "created_at", "utc_date")
    base = catalog.select(
        "game_id",
        "white_player",
        "black_player",
        S.as_number(catalog, "white_elo").alias("white_elo"),
        S.as_number(catalog, "black_elo").alias("black_elo"),
        "winner",
        "victory_status",
        "rated",
        "speed",
        "opening",
        "source_file",
        when.alias("game_ts"),
    )
    # Tested before the rows double, so the scan can drop what no side can use.
    base = base.filter(F.col("game_ts").isNotNull())
    if rated_only:
        base = base.filter(F.coalesce(F.col("rated"), F.lit(False)))

    def side(name: str, other: str) -> list[Column]:
        return [
            F.col("game_id"),
            F.lit(name).alias("side"),
            F.col(f"{name}_player").alias("player_name"),
            F.col(f"{name}_elo").alias("player_elo"),
            F.col(f"{other}_elo").alias("opponent_elo"),
            S.side_outcome(F.col("winner"), name).alias("outcome"),
            F.col("victory_status"),
            F.col("rated"),
            F.col("speed"),
            F.col("opening"),
            F.col("source_file"),
            F.col("game_ts"),
        ]

    both = _both_sides(base, side("white", "black"), side("black", "white"))
    return both.filter(F.col("player_name").isNotNull() & F.col("player_elo").isNotNull())


def with_sessions(games: DataFrame, gap_hours: int = 24, max_rows: int = MAX_GROUP_ROWS) -> Ordered:
    """Previous time and rating, rating step, and gap sessions numbered per player."""
    timeline = arrange(games, ["player_name"], ["game_ts", "game_id"], max_rows)
    timeline = timeline.scan({"prev_game_ts": ("lag", "game_ts"), "prev_player_elo": ("lag", "player_elo")})
    limit = F.col("prev_game_ts") + F.make_interval(hours=F.lit(gap_hours))
    timeline = timeline.with_columns(
        {
            "new_session_flag": F.when(F.col("prev_game_ts").isNull() | (F.col("game_ts") > limit), 1).otherwise(0),
            "elo_delta": F.col("player_elo") - F.col("prev_player_elo"),
        }
    )
    return timeline.scan({"session_id": ("sum", "new_session_flag")})


def player_profiles(sessions: Ordered) -> DataFrame:
    """One row per player, 20 columns.

    Sessions are numbered without gaps, so their count is the sum of the start flags and
    needs no distinct set. Months are bounded by the calendar. Speeds and openings are
    counted in two levels: distinct pairs of player and value, combined in each task
    before the shuffle, then their count. So no set of a player is ever held.
    """

    def distinct(name: str) -> DataFrame:
        pairs = sessions.df.filter(F.col(name).isNotNull()).select("player_name", name).distinct()
        return pairs.groupBy("player_name").agg(F.count(F.lit(1)).alias(f"_{name}"))

    def tally(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    outcome = F.col("outcome")
    has = lambda value: F.max((outcome == value).cast("int"))
    found = (
        sessions.df.groupBy("player_name")
        .agg(
            F.count(F.lit(1)).alias("n_games"),
            F.sum("new_session_flag").alias("n_sessions"),
            F.min("game_ts").alias("first_game_ts"),
            F.max("game_ts").alias("last_game_ts"),
            F.datediff(F.to_date(F.max("game_ts")), F.to_date(F.min("game_ts"))).cast("long").alias("coverage_days"),
            F.size(F.collect_set(F.date_format("game_ts", "yyyy-MM"))).cast("long").alias("active_months"),
            F.avg("player_elo").alias("mean_elo"),
            F.min("player_elo").alias("min_elo_obs"),
            F.max("player_elo").alias("max_elo_obs"),
            F.stddev_samp("player_elo").alias("rating_stddev"),
            F.stddev_samp("opponent_elo").alias("opponent_elo_stddev"),
            (has("win") + has("loss") + has("draw_or_other")).cast("long").alias("outcome_diversity"),
            tally(outcome == "win").alias("wins"),
            tally(outcome == "loss").alias("losses"),
            tally(outcome == "draw_or_other").alias("draws_or_other"),
            tally(F.col("elo_delta") < 0).alias("elo_drop_steps"),
            tally(F.col("elo_delta") > 0).alias("elo_up_steps"),
        )
    )
    for name in ("speed", "opening"):
        found = found.join(distinct(name), "player_name", "left")
    columns = found.columns[: found.columns.index("outcome_diversity")]
    return found.select(
        *columns,
        F.coalesce("_speed", F.lit(0)).alias("speed_diversity"),
        F.coalesce("_opening", F.lit(0)).alias("opening_diversity"),
        *found.columns[len(columns) : -2],
    )


def eligible_players(profiles: DataFrame, f: SelectionFilters = SelectionFilters()) -> DataFrame:
    """Profiles within the limits, with rating bin and score."""
    kept = profiles.filter(
        (F.col("n_games") > f.min_games)
        & (F.col("n_sessions") > f.min_sessions - 1)
        & F.col("mean_elo").between(f.min_elo, f.max_elo)
        & (F.col("active_months") >= f.min_active_months)
        & (F.col("coverage_days") >= f.min_coverage_days)
        & (F.col("elo_drop_steps") >= 1)
    )
    return (
        kept.withColumns(S.width_bins(F.col("mean_elo"), f.min_elo, f.elo_bin_size))
        .withColumn("selection_score", S.selection_score())
        .filter(F.col("elo_bin_idx") >= 0)
    )


def rank_in_bins(eligible: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Rank by score (null last), sessions, games, all descending, name as the last key.

    The full ranking of a hot bin is cut by score like any other ordered group.
    """
    keyed = eligible.withColumns(
        {"_s": F.coalesce(-F.col("selection_score"), F.lit(math.inf)), "_n": -F.col("n_sessions"), "_g": -F.col("n_games")}
    )
    ranked = arrange(keyed, ["elo_bin_lo", "elo_bin_hi"], ["_s", "_n", "_g", "player_name"], max_rows)
    return ranked.scan({"bin_rank": ("count",)}).result().drop("_s", "_n", "_g")


def select_players(eligible: DataFrame, per_bin: int = 20, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Best ``per_bin`` players of each bin.

    Up to ``PRUNED_ROWS`` Spark prunes to the best ``per_bin`` rows per bin before the
    shuffle, so a hot bin sends only those of each input task. For a larger ``per_bin`` a
    mergeable sketch of each bin's scores gives a bound that at least ``per_bin`` players
    reach, which a count confirms (else the bin has no bound). Only those at or above it
    are ranked, and a bin that is still hot is cut by score.
    """
    if per_bin <= PRUNED_ROWS:
        order = [F.desc("selection_score"), F.desc("n_sessions"), F.desc("n_games"), F.asc("player_name")]
        rank = F.row_number().over(Window.partitionBy(*BIN).orderBy(*order))
        ranked = eligible.withColumn("bin_rank", rank)
    else:
        fixed = cut_lineage(eligible)
        sketch = F.kll_sketch_agg_double("selection_score", SKETCH_K)
        # Quantiles at shares of 1/2, 1/4 ... from above, and the smallest share that holds enough.
        at = F.array(*[F.kll_sketch_get_quantile_double(sketch, F.lit(1 - 0.5**k)) for k in range(HALVINGS)])
        share = F.greatest(F.lit(float(per_bin)) / F.count(F.lit(1)) + SKETCH_SLACK, F.lit(0.5 ** (HALVINGS - 1)))
        bound = F.when(F.count("selection_score") > 0, F.get(at, F.greatest(F.lit(0), F.floor(-F.log2(share))).cast("int")))
        bounds = broadcast_if_small(fixed.groupBy(*BIN).agg(bound.alias("_bound")))
        bounded = cut_lineage(fixed.join(bounds, BIN).withColumn("_high", F.coalesce(F.col("selection_score") >= F.col("_bound"), F.lit(False))))
        few = bounded.groupBy(*BIN).agg((F.count_if("_high") < per_bin).alias("_few"))
        # A bin whose bound proved too high, or that has fewer players, is ranked as a whole.
        near = bounded.join(broadcast_if_small(few), BIN).filter("_high OR _few")
        whole = near.select(*eligible.columns)
        ranked = rank_in_bins(whole, max_rows)
    return ranked.filter(F.col("bin_rank") <= per_bin).orderBy("elo_bin_lo", "bin_rank", "player_name")


def selected_games(games: DataFrame, selected: DataFrame) -> DataFrame:
    """Games of selected players, once per selected player in the game.

    The two-key OR condition would plan as a nested loop, so the game offers its
    distinct names and joins on equality.
    """
    names = broadcast_if_small(selected.select(F.col("player_name").alias("_name")))
    offered = F.explode(F.array_distinct(F.array("white_player", "black_player")))
    return games.withColumn("_name", offered).join(names, "_name").drop("_name")


def bin_summary(selected: DataFrame) -> DataFrame:
    two = lambda c: F.round(F.avg(c), 2)
    return (
        selected.groupBy("elo_bin_lo", "elo_bin_hi")
        .agg(
            F.count(F.lit(1)).alias("n_selected"),
            two("mean_elo").alias("avg_mean_elo"),
            two("n_games").alias("avg_games"),
            two("n_sessions").alias("avg_sessions"),
            two("selection_score").alias("avg_selection_score"),
        )
        .orderBy("elo_bin_lo")
        .select(
            F.concat_ws("-", "elo_bin_lo", "elo_bin_hi").alias("elo_bin"),
            "n_selected",
            "avg_mean_elo",
            "avg_games",
            "avg_sessions",
            "avg_selection_score",
        )
    )


def selection_counts(eligible: DataFrame, per_bin: int) -> DataFrame:
    """Eligible and selected counts per bin and in total (null bounds), in one pass.

    A bin keeps ``per_bin`` players at most, so counts need no ranking.
    """
    bins = eligible.groupBy("elo_bin_lo", "elo_bin_hi").agg(F.count(F.lit(1)).alias("n_eligible"))
    bins = bins.withColumn("n_selected", F.least(F.col("n_eligible"), F.lit(per_bin).cast("long")))
    return bins.groupingSets(
        [("elo_bin_lo", "elo_bin_hi"), ()], "elo_bin_lo", "elo_bin_hi"
    ).agg(F.sum("n_eligible").alias("n_eligible"), F.sum("n_selected").alias("n_selected"))
