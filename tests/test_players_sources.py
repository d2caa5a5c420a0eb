"""Selection, sources and manifests."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gapline.operators import manifests as M
from gapline.operators import players as P
from gapline.sources import catalog as C
from gapline.sources import scan, sinks


def test_selected_games_twice_once(spark):
    games = spark.createDataFrame(
        [("both", "a", "b"), ("one", "a", "x"), ("same", "a", "a"), ("none", "x", "y"), ("null", None, "b")],
        "game_id string, white_player string, black_player string",
    )
    chosen = spark.createDataFrame([("a",), ("b",)], "player_name string")
    got = sorted(r.game_id for r in P.selected_games(games, chosen).collect())
    assert got == ["both", "both", "null", "one", "same"]


def games(spark, hours, player="p"):
    rows = [(f"{i:03d}", "white", player, 1500.0 + i % 3, 1400.0, "win", "blitz", "e4", h * 3600.0) for i, h in enumerate(hours)]
    df = spark.createDataFrame(
        rows, "game_id string, side string, player_name string, player_elo double, opponent_elo double, "
        "outcome string, speed string, opening string, s double"
    )
    return df.withColumn("game_ts", F.timestamp_seconds("s")).drop("s")


def test_gap_of_exactly_a_day(spark):
    out = P.with_sessions(games(spark, [0, 24, 48.001]), 24).df.orderBy("game_id").collect()
    assert [r.session_id for r in out] == [1, 1, 2]
    assert [r.elo_delta for r in out] == [None, 1.0, 1.0]


def test_profile_and_eligibility(spark):
    line = P.with_sessions(games(spark, [30 * i for i in range(60)]))
    r = P.player_profiles(line).first()
    assert (r.n_games, r.n_sessions, r.coverage_days, r.active_months) == (60, 60, 73, 3)
    assert (r.wins, r.outcome_diversity, r.elo_drop_steps, r.elo_up_steps) == (60, 1, 19, 40)
    kept = P.eligible_players(P.player_profiles(line)).first()
    assert (kept.elo_bin_idx, kept.elo_bin_lo, kept.elo_bin_hi) == (2, 1400, 1600)
    strict = P.SelectionFilters(min_games=60)
    assert P.eligible_players(P.player_profiles(line), strict).count() == 0


def test_rank_and_top_k_agree(spark):
    rng = random.Random(1)
    rows = [(f"p{i}", rng.choice([1000, 1200]), 0, float(rng.randint(1, 5)), rng.randint(1, 3), 9) for i in range(80)]
    df = spark.createDataFrame(
        rows, "player_name string, elo_bin_lo int, elo_bin_hi int, selection_score double, n_sessions int, n_games int"
    )
    top = {(r.player_name, r.bin_rank) for r in P.select_players(df, 7).collect()}
    for cap in (1000, 6):
        full = P.rank_in_bins(df, cap).filter("bin_rank <= 7").collect()
        assert {(r.player_name, r.bin_rank) for r in full} == top
    counts = {r.elo_bin_lo: (r.n_eligible, r.n_selected) for r in P.selection_counts(df, 7).collect()}
    assert counts[None] == (80, 14) and counts[1000][1] == 7


def test_scan_unites_alternating_schemas_and_nested_columns(spark, tmp_path, monkeypatch):
    """Files of two schemas in turn: the schemas decide the number of merges, not the files."""
    one = "named_struct('a', int(id), 'same', 'x') AS s, array(named_struct('n', int(id))) AS l, map('k', int(id)) AS m"
    two = "named_struct('a', id, 'b', 1.5D) AS s, array(named_struct('n', id, 'o', true)) AS l, map('k', id) AS m"
    for i in range(8):
        spark.sql(f"SELECT {one if i % 2 else two} FROM range({i}, {i + 1})").coalesce(1).write.parquet(f"{tmp_path}/deep/{i}")
    tried, real = [], scan._mergeable
    monkeypatch.setattr(scan, "_mergeable", lambda s, files: tried.append(len(files)) or real(s, files))
    df = scan.scan_parquet(spark, dirs=[f"{tmp_path}/deep"])
    assert tried[0] == 2
    got = sorted((r.s.a, r.s.b, r.s.same, r.l[0].n, r.l[0].o, r.m["k"]) for r in df.collect())
    assert got == [(i, None, "x", i, None, i) if i % 2 else (i, 1.5, None, i, True, i) for i in range(8)]


def test_scan_widens_and_unites(spark, tmp_path):
    spark.range(3).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("only_a")).write.parquet(f"{tmp_path}/a")
    spark.range(2).select(F.col("id").alias("k"), F.lit(1.5).alias("only_b")).write.parquet(f"{tmp_path}/deep/b")
    spark.range(1).select(F.col("id").cast("int").alias("k"), F.lit(True).alias("only_c")).write.parquet(f"{tmp_path}/c")
    df = scan.scan_parquet(spark, dirs=[str(tmp_path)], globs=[f"{tmp_path}/a/*.parquet"])
    assert df.count() == 6 and dict(df.dtypes)["k"] == "bigint"
    assert df.filter("only_a IS NULL AND only_b IS NULL AND only_c IS NULL").count() == 0
    assert df.filter("filename LIKE '%.parquet'").count() == 6
    made = C.provenance(df).first()
    files = json.loads(made.parquet_files_json)
    assert files == sorted(files) and len(files) == made.parquet_file_count and made.n_rows == 6
    assert len(files) == len(scan.list_parquet(spark, dirs=[str(tmp_path)]))
    with pytest.raises(RuntimeError, match="no parquet file"):
        scan.list_parquet(spark, globs=[f"{tmp_path}/none/*.parquet"])
    with pytest.raises(FileNotFoundError):
        scan.list_parquet(spark, dirs=[f"{tmp_path}/absent"])


GAMES = [
    {"id": "g1", "createdAt": 1, "players": {"white": {"user": {"name": "A"}, "ratingDiff": 4}}},
    {"id": "g2", "createdAt": 2, "winner": "white", "analysis": [{"eval": 3}], "cq_engine": {"eval_timeline_cp": [0, 5]}},
]


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "games.json").write_text(json.dumps(GAMES))
    (tmp_path / "games.ndjson").write_text("\n\n".join(json.dumps(g) for g in GAMES) + "\n")
    for df in (
        scan.read_json_array(spark, str(tmp_path / "games.json")),
        scan.read_ndjson(spark, str(tmp_path / "games.ndjson")),
    ):
        a, b = df.orderBy("id").collect()
        assert a.players.white.user.name == "A" and a.players.white.ratingDiff == 4 and a.lastMoveAt is None
        assert b.cq_engine.eval_timeline_cp == [0, 5] and len(b.analysis) == 1
    (tmp_path / "bad.ndjson").write_text('[Event "x"]\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        scan.read_ndjson(spark, str(tmp_path / "bad.ndjson")).collect()


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sinks.write_parquet(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    names = [p.name for p in (tmp_path / "p").iterdir()]
    assert any(".zstd.parquet" in n for n in names)
    sinks.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["k", "v"]
    run = sinks.run_manifest(spark, {"rows": 2, "name": "x"})
    sinks.write_manifest(run, f"{tmp_path}/m")
    assert json.loads(spark.read.json(f"{tmp_path}/m").first().manifest) == {"rows": 2, "name": "x"}


def test_aliases_take_the_first_name_and_fill_gaps(spark):
    raw = spark.createDataFrame([("i", "g", "w", "e4 e5", "f")], "gameId string, id string, whiteName string, moves string, filename string")
    r = C.resolve_aliases(raw).first()
    assert (r.game_id, r.white_player, r.moves_text_len, r.rated, r.source_file) == ("g", "w", 5, None, "f")
    assert dict(C.resolve_aliases(raw).dtypes)["created_at"] == "bigint"


def test_catalog_feeds_the_selection(spark):
    raw = spark.createDataFrame(
        [("E", "S", "a", "b", "1500", "1510", "1-0", "2024-01-01", "10:00:00+02", "A00", "Open", "Normal", "60+0", "e4", "f")],
        "Event string, Site string, White string, Black string, WhiteElo string, BlackElo string, Result string, "
        "UTCDate string, UTCTime string, ECO string, Opening string, Termination string, TimeControl string, movetext string, filename string",
    )
    cat = C.games_catalog(raw)
    r = cat.select(F.unix_seconds("game_ts_tz").alias("z"), F.unix_seconds(F.col("game_ts").cast("timestamp")).alias("l")).first()
    assert r.l - r.z == 7200
    assert {x.outcome for x in P.player_games(cat).collect()} == {"win", "loss"}


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("", 1, "x"), (None, 1, "y"), ("b", 5, None)], "k string, s int, v string")
    assert sorted((r.k, r.v) for r in M.first_per_key(df, "k", ["s"]).collect()) == [("a", "early"), ("b", None)]


def test_unique_names(spark):
    import hashlib

    df = spark.createDataFrame(
        [("x.parquet", "u1"), ("x.parquet", "u2"), ("y.tar.gz", "u3"), ("y.tar.gz", "u4"), ("z", "u5")], "f string, u string"
    )
    got = {r.u: r.local_filename for r in M.assert_unique(M.unique_names(df, "f", "u")).collect()}
    tag = lambda u: hashlib.sha1(u.encode()).hexdigest()[:8]
    assert got == {
        "u1": f"x__{tag('u1')}.parquet",
        "u2": f"x__{tag('u2')}.parquet",
        "u3": f"y.tar__{tag('u3')}.gz",
        "u4": f"y.tar__{tag('u4')}.gz",
        "u5": "z",
    }
    with pytest.raises(RuntimeError, match="two files"):
        M.assert_unique(M.unique_names(df.union(df), "f", "u"))


def greedy(items, budget, cap):
    total, picked = 0, []
    for seq, size in sorted(items, reverse=True):
        if total + size > budget:
            continue
        picked.append(seq)
        total += size
        if cap is not None and len(picked) >= cap:
            break
    return sorted(picked)


@pytest.mark.parametrize("cap", [None, 4])
@pytest.mark.parametrize("max_group", [10, 1000])
def test_budget_pick_equals_the_walk(spark, cap, max_group):
    rng = random.Random(11)
    groups = {g: [(i, rng.choice([1, 5, 20, 60, 200])) for i in range(n)] for g, n in [("hot", 40), ("small", 5), ("tiny", 1)]}
    df = spark.createDataFrame([(g, i, s) for g, items in groups.items() for i, s in items], "g string, seq long, size long")
    out = M.pick_under_budget(df, ["g"], "seq", "size", 150, cap, max_group=max_group)
    got = {}
    for r in out.collect():
        got.setdefault(r.g, []).append(r.seq)
    for g, items in groups.items():
        assert sorted(got.get(g, [])) == greedy(items, 150, cap), g


def test_budget_pick_rounds_are_bounded_by_bits(spark, monkeypatch):
    """Sizes that each just miss the room left: a round per taken file would be 60 rounds."""
    sizes = [x for i in range(60) for x in (1, 200 - i)] + [0, 0, 64, 30, 1]
    df = spark.createDataFrame([("g", len(sizes) - i, s) for i, s in enumerate(sizes)], "g string, seq long, size long")
    writes = []
    cut = M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda frame: writes.append(1) or cut(frame))
    for budget in (199, 130):
        writes.clear()
        got = sorted(r.seq for r in M.pick_under_budget(df, ["g"], "seq", "size", budget).collect())
        assert got == greedy([(len(sizes) - i, s) for i, s in enumerate(sizes)], budget, None)
        assert len(writes) <= 1 + 2 * (budget.bit_length() + 1)


@pytest.mark.parametrize("slack", [None, -0.1])
def test_large_top_k_of_a_hot_bin(spark, monkeypatch, slack):
    """Above Spark's pruning limit: by a sketched bound, also where the bound is too high."""
    if slack is not None:
        monkeypatch.setattr(P, "SKETCH_SLACK", slack)
    rng = random.Random(2)
    rows = [(f"p{i:05}", 1000 if i % 8 else 1200, 0, rng.choice([rng.random(), 0.5, None]), 1, i % 3) for i in range(9_000)]
    df = spark.createDataFrame(rows, "player_name string, elo_bin_lo int, elo_bin_hi int, selection_score double, n_sessions int, n_games int")
    want = {}
    for r in sorted(rows, key=lambda r: (-(r[3] if r[3] is not None else -1), -r[5], r[0])):
        mine = want.setdefault(r[1], [])
        if len(mine) < 1_500:
            mine.append(r[0])
    got = P.select_players(df, 1_500, max_rows=700)
    assert got.columns == [*df.columns, "bin_rank"]
    ranked = {}
    for r in sorted(got.collect(), key=lambda r: r.bin_rank):
        ranked.setdefault(r.elo_bin_lo, []).append(r.player_name)
    assert ranked == want
