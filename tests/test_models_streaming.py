"""Models and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.operators import metrics as K
from gapline.operators import models as ML
from gapline.operators import sessions as SE
from gapline.plans import lab
from gapline.streaming import games as G


def learnable(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("game_id"),
        (F.floor(i / 8)).cast("string").alias("sid"),
        (i * 1000).alias("created_at_ms"),
        ((i * 37) % 100).cast("double").alias("x"),
        F.when(i % 9 == 0, F.lit(None)).otherwise((i * 13) % 50).cast("double").alias("z"),
        ((i * 37) % 100 > 60).cast("int").alias("target__peak_binary"),
        ((i * 37) % 100 * 2.0 + 1).alias("target__future_upside_regression"),
    )


def test_out_of_fold_is_complete_and_learns(spark):
    rows, folds = ML.fix_folds(learnable(spark), "sid", "created_at_ms", 3, 1)
    spec = ML.ModelSpec("logistic_regression", {"max_iter": 20})
    oof = ML.out_of_fold(rows, folds, ["x", "z"], "target__peak_binary", "peak_binary", spec, "sid", ["game_id"]).cache()
    assert oof.count() == 400 and oof.select("game_id").distinct().count() == 400
    flags = oof.groupBy("oof_is_validation").agg(F.count("oof_score").alias("n"), F.count(F.lit(1)).alias("all")).collect()
    by = {r.oof_is_validation: r for r in flags}
    assert by[0].n == 0 and by[1].n == by[1]["all"]
    want = folds.filter("role = 'valid'").join(rows, "sid").count()
    assert by[1].n == want
    aucs = [r.roc_auc for r in ML.fold_metrics(oof, "target__peak_binary", "peak_binary").collect()]
    assert len(aucs) == 3 and min(aucs) > 0.9
    records, summary = lab.evaluate_policy(
        oof.withColumn("pl", F.col("x") - 50), "peak_binary", {"name": "t"}, ["sid"], ["created_at_ms"], "pl"
    )
    s = summary.first()
    assert s.n_sessions == records.count() == folds.filter("role = 'valid'").count()
    assert s.score_source == "oof_validation" and s.threshold_value == 0.6


def test_objectives_share_one_table_of_vectors(spark, monkeypatch):
    """Four objectives write the rows, the folds and the vectors once, and each its scores."""
    written, cut = [], ML.cut_lineage
    monkeypatch.setattr(ML, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    df = learnable(spark).withColumn("target__meaningful_upside_binary", F.col("target__peak_binary"))
    kinds = ["peak_binary", "meaningful_upside_binary", "future_upside_regression"]
    out = lab.objective_matrix(df, kinds, ["x", "z"], "sid", "created_at_ms", ["game_id"], n_splits=3)
    got = {(r.objective_kind, r.metric): r["mean"] for r in out.collect()}
    assert len(written) == 3 + len(kinds) and sum("_x" in names for names in written) == 1
    rows, folds = ML.fix_folds(df, "sid", "created_at_ms", 3, 1)
    for kind in kinds:
        alone = lab.experiment(rows, folds, kind, ["x", "z"], lab.default_spec(kind), "sid", ["game_id"])[2]
        for r in alone.collect():
            assert got[kind, r.metric] == pytest.approx(r["mean"], rel=1e-9)


@pytest.mark.parametrize(
    "kind, params, target",
    [
        ("xgb_classifier", {"n_estimators": 3, "max_depth": 2, "scale_pos_weight": 5, "random_state": 1}, "target__peak_binary"),
        ("xgb_regressor", {"n_estimators": 3, "max_depth": 3, "random_state": 1}, "target__future_upside_regression"),
        ("linear_regression", {}, "target__future_upside_regression"),
    ],
)
def test_final_scores_are_repeatable(spark, kind, params, target):
    df = learnable(spark, 200)
    spec = ML.ModelSpec(kind, params)
    runs = []
    for _ in range(2):
        model, out = ML.final_scores(df, ["x", "z"], target, spec)
        runs.append([r.policy_score for r in out.orderBy("game_id").collect()])
    assert runs[0] == runs[1] and len(runs[0]) == 200
    if spec.classifies:
        assert K.ranking_scores(out, target, "policy_score").first().roc_auc > 0.9
        again = ML.score(ML.save_and_reload(model, spark), df, ["x", "z"], spec, "policy_score")
        assert [r.policy_score for r in again.orderBy("game_id").collect()] == runs[0]
    else:
        assert K.regression_scores(out, target, "policy_score").first().r2 > 0.8


def test_logistic_regression_has_the_usual_penalty(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)) * [1.0, 4.0]
    y = (x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=300) > 0.5).astype(int)
    a, w = np.c_[x, np.ones(300)], np.zeros(3)
    ridge = np.diag([1.0, 1.0, 0.0])
    for _ in range(30):  # Newton steps on half squared weights plus summed loss
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
    want = 1 / (1 + np.exp(-a @ w))
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "i long, a double, b double, y int")
    _, out = ML.final_scores(df, ["a", "b"], "y", ML.ModelSpec("logistic_regression"))
    got = [r.policy_score for r in out.orderBy("i").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-4


def test_run_folder(spark, tmp_path):
    rows, folds = ML.fix_folds(learnable(spark, 120), "sid", "created_at_ms", 2, 0)
    kind = "future_upside_regression"
    spec = ML.ModelSpec("linear_regression")
    oof, per_fold, summary = lab.experiment(rows, folds, kind, ["x", "z"], spec, "sid", ["game_id"])
    lab.write_run(str(tmp_path / "run"), oof, per_fold, summary, rows, folds, kind, ["x", "z"], "sid", "created_at_ms")
    read = lambda name: spark.read.json(str(tmp_path / "run" / name))
    assert {r.metric for r in read("metrics").collect()} == {"mae", "rmse", "r2"}
    assert read("leakage").filter("group_overlap_count > 0").count() == 0
    manifest = json.loads(read("manifest").first().manifest)
    assert manifest["feature_order"] == ["x", "z"] and manifest["task_type"] == "regression"
    assert spark.read.parquet(manifest["oof_predictions_path"]).count() == 120


def test_unknown_model(spark):
    with pytest.raises(ValueError, match="unknown kind of model"):
        ML.ModelSpec("svm").estimator("y")


SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("createdAt", T.LongType()), T.StructField("v", T.LongType())])


def deliver(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_ingest_takes_each_game_once_even_when_late(spark, tmp_path):
    (tmp_path / "in").mkdir()
    day = 86_400_000
    game = lambda i, v=0: {"id": f"g{i}", "createdAt": i * day, "v": v}
    run = lambda: G.ingest(
        G.game_stream(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "t"), str(tmp_path / "cp")
    ).awaitTermination()
    deliver(tmp_path / "in" / "1.json", [game(5), game(6), game(6)])
    run()
    # Overlap, a game far older than anything seen, and an empty id.
    deliver(tmp_path / "in" / "2.json", [game(6), game(7), game(1), {"id": "", "createdAt": 1, "v": 0}])
    deliver(tmp_path / "in" / "3.json", [game(7), game(5)])
    run()
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert got == ["g1", "g5", "g6", "g7"]


def test_distinct_games_within_the_delay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    deliver(tmp_path / "in" / "1.json", [{"id": "a", "createdAt": 1000, "v": 1}, {"id": "b", "createdAt": 2000, "v": 1}])
    deliver(tmp_path / "in" / "2.json", [{"id": "a", "createdAt": 1000, "v": 1}, {"id": "c", "createdAt": 3000, "v": 1}])
    stream = G.game_stream(spark, str(tmp_path / "in"), SCHEMA).withColumn("at", F.timestamp_millis("createdAt"))
    query = (
        G.distinct_games(stream, "id", "at", "1 day")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_batch_session_window_equals_gap_sessions(spark):
    gaps = [0, 3_600_000, 3_600_001, 10, 7_200_000, 3_600_000]
    rows, at = [], 0
    for i, g in enumerate(gaps):
        at += g
        rows.append(("p", i, at, 1.0))
    df = spark.createDataFrame(rows, "player string, game_id long, created_at_ms long, rating_diff double")
    ours = SE.session_totals(SE.start_gap_sessions(df, 60)).orderBy("session_start_ms").collect()
    timed = df.withColumn("at", F.timestamp_millis("created_at_ms"))
    spark_way = G.session_totals(timed, "player", "at", "rating_diff").orderBy("session_start").collect()
    assert [r.n_games for r in ours] == [r.n_games for r in spark_way] == [2, 2, 2]
    assert [r.session_pl for r in ours] == [r.session_pl for r in spark_way]
