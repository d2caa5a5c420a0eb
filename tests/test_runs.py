"""End-to-end runs on small inputs."""

from pyspark.sql import functions as F

from gapline.operators import models as ML
from gapline.operators import players as P
from gapline.plans import lab
from gapline.plans.selection import build_catalog, run_selection


def shard(spark, path, n, offset):
    i = F.col("id") + offset
    clock = F.timestamp_seconds(F.lit(1_704_067_200) + i * 40_000)
    spark.range(n).select(
        F.lit("E").alias("Event"),
        i.cast("string").alias("Site"),
        F.concat(F.lit("p"), (i % 3).cast("string")).alias("White"),
        F.lit("rival").alias("Black"),
        (1500 + i % 7).cast("string").alias("WhiteElo"),
        F.lit("1400").alias("BlackElo"),
        F.when(i % 2 == 0, "1-0").otherwise("0-1").alias("Result"),
        F.date_format(clock, "yyyy-MM-dd").alias("UTCDate"),
        F.date_format(clock, "HH:mm:ss").alias("UTCTime"),
        F.lit("A00").alias("ECO"),
        F.lit("Open").alias("Opening"),
        F.lit("Normal").alias("Termination"),
        F.lit("60+0").alias("TimeControl"),
        F.lit("e4 e5").alias("movetext"),
    ).coalesce(1).write.parquet(path)


def test_shards_to_selected_players(spark, tmp_path):
    shard(spark, f"{tmp_path}/in/one", 120, 0)
    shard(spark, f"{tmp_path}/in/deep/two", 120, 120)
    catalog = build_catalog(spark, f"{tmp_path}/db", dirs=[f"{tmp_path}/in"])
    assert catalog.count() == 240 and catalog.select("game_id").distinct().count() == 240
    assert spark.read.json(f"{tmp_path}/db/build_metadata").first().parquet_file_count == 2
    limits = P.SelectionFilters(session_gap_hours=12, per_bin=2)
    row = run_selection(catalog, f"{tmp_path}/out", limits).first()
    # The rival's constant rating never drops, so only the three others qualify.
    assert (row.n_eligible_players, row.n_selected_players, row.n_bins) == (3, 2, 1)
    assert row.filters.per_bin == 2 and row.source_table == "games_catalog"
    games = spark.read.parquet(f"{tmp_path}/out/selected_games.parquet")
    assert games.count() == 160
    assert spark.read.json(f"{tmp_path}/out/selection_summary.json").count() == 1


def test_production_run(spark):
    i = F.col("id")
    df = spark.range(300).select(
        i.alias("game_id"),
        (F.floor(i / 6)).cast("string").alias("sid"),
        (i * 1000).alias("created_at_ms"),
        ((i * 37) % 100).cast("double").alias("x"),
        ((i * 37) % 100 > 70).cast("int").alias("y"),
        F.when((i * 37) % 100 > 70, -3.0).otherwise(1.0).alias("delta"),
    )
    spec = ML.ModelSpec("xgb_classifier", {"n_estimators": 3, "max_depth": 2, "scale_pos_weight": 5, "random_state": 42})
    summary, aucs, _ = lab.production_run(df, ["x"], "y", "sid", ["created_at_ms"], "delta", ["game_id"], spec)
    r = summary.first()
    assert len(r.cv_auc_scores) == 5 and aucs.count() == 5 and r.cv_auc_mean > 0.9
    assert r.optimized_rating_diff_sum - r.baseline_rating_diff_sum == r.estimated_gain


def test_json_to_features(spark, tmp_path):
    import json

    from gapline.plans.features import build_features, collect_games

    side = lambda name, diff: {"user": {"name": name}, "ratingDiff": diff}
    game = lambda i, minute, white, winner, diff: {
        "id": i,
        "createdAt": minute * 60_000,
        "lastMoveAt": minute * 60_000 + 60_000,
        "winner": winner,
        "moves": "e4 e5 Nf3 Nc6",
        "players": {
            "white": side("Me" if white else "x", diff if white else -diff),
            "black": side("x" if white else "Me", -diff if white else diff),
        },
        "cq_engine": {"my_acpl": 20.0, "engine_source": "local_stockfish"},
    }
    games = [game("a", 0, True, "white", 5), game("b", 10, False, "white", -7), game("c", 200, False, None, 0)]
    (tmp_path / "batch").mkdir()
    for name, part in [("1", games[:2]), ("2", games[1:])]:
        (tmp_path / "batch" / f"{name}.json").write_text("\n".join(json.dumps(g) for g in part))
    assert [r.id for r in collect_games(spark, f"{tmp_path}/batch").collect()] == ["a", "b", "c"]
    assert [r.id for r in collect_games(spark, f"{tmp_path}/batch", 2).collect()] == ["a", "b"]
    (tmp_path / "games.json").write_text(json.dumps(games))
    out = build_features(spark, f"{tmp_path}/games.json", "me", f"{tmp_path}/features", "Europe/Vienna")
    got = out.orderBy("created_at_ms").collect()
    assert [r.session_id for r in got] == [1, 1, 2] and [r.session_pl for r in got] == [5.0, -2.0, 0.0]
    assert [r.user_color for r in got] == ["white", "black", "black"] and [r.result for r in got] == [1.0, 0.0, 0.5]
    assert [r.target for r in got] == [1, 0, 1] and got[0].my_avg_secs_per_move == 30.0
    assert got[0].tod_label == "night" and "player" not in out.columns


def test_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
