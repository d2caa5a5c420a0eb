"""Population runs end to end: catalog build, player selection and its exports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import players as P
from gapline.operators.ordered import MAX_GROUP_ROWS
from gapline.runtime import cut_lineage, use_utc
from gapline.sources import catalog as C
from gapline.sources import scan, sinks


def build_catalog(spark: SparkSession, out: str, dirs: Iterable[str] = (), globs: Iterable[str] = ()) -> DataFrame:
    """Raw shards to the catalog table and its provenance; returns the table read back.

    The move text is hashed and stored once here, so later reads can leave it out.
    """
    raw = scan.scan_parquet(use_utc(spark), dirs, globs)
    sinks.write_parquet(C.games_catalog(raw), f"{out}/games_catalog")
    sinks.write_manifest(C.provenance(raw), f"{out}/build_metadata")
    return spark.read.parquet(f"{out}/games_catalog")


def run_selection(
    catalog: DataFrame,
    out: str,
    filters: P.SelectionFilters = P.SelectionFilters(),
    source: str = "games_catalog",
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Eligible and selected players, their games, the bin summary and the manifest.

    The long chain from games to eligible players runs once; every export starts
    from its written result.
    """
    games = P.player_games(catalog, filters.rated_only)
    profiles = P.player_profiles(P.with_sessions(games, filters.session_gap_hours, max_rows))
    eligible = cut_lineage(P.eligible_players(profiles, filters))
    selected = cut_lineage(P.select_players(eligible, filters.per_bin))
    paths = {
        "selected_players_parquet": f"{out}/selected_players.parquet",
        "selected_players_csv": f"{out}/selected_players.csv",
        "eligible_players_parquet": f"{out}/eligible_players.parquet",
        "eligible_players_csv": f"{out}/eligible_players.csv",
        "selected_games_parquet": f"{out}/selected_games.parquet",
        "selected_players_by_bin_csv": f"{out}/selected_players_by_bin.csv",
    }
    ranked = selected.orderBy("elo_bin_lo", "bin_rank", "player_name")
    sinks.write_parquet(ranked, paths["selected_players_parquet"])
    sinks.write_csv(ranked, paths["selected_players_csv"])
    sinks.write_parquet(eligible, paths["eligible_players_parquet"])
    sinks.write_csv(eligible, paths["eligible_players_csv"])
    sinks.write_parquet(P.selected_games(catalog, selected), paths["selected_games_parquet"])
    sinks.write_csv(P.bin_summary(selected), paths["selected_players_by_bin_csv"])
    manifest = sinks.selection_manifest(eligible, filters.per_bin, filters.as_dict(), paths, source)
    sinks.write_manifest(manifest, f"{out}/selection_summary.json")
    return manifest.withColumn("n_bins", F.size("selected_bins"))
