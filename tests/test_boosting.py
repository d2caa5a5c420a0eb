"""Boosted trees: equal to Spark's own where nothing is drawn, whatever the blocks and tasks."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from gapline.operators import boosting as BT
from gapline.operators import metrics as K
from gapline.operators import models as ML


def noisy(spark, n=3000):
    """Ties, many values, few values, a constant, repeats of zero, and a label that follows some of them."""
    i = F.col("id")
    u = lambda k: (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(10_007)) / 10_007.0)
    x = [u(1), F.floor(u(2) * 5).cast("double"), F.greatest(u(3) - 0.7, F.lit(0.0)), F.lit(1.5), (u(4) > 0.5).cast("double"), F.round(u(5) * 100)]
    rows = spark.range(0, n, 1, 3).select(i.alias("game_id"), *[c.alias(f"x{j}") for j, c in enumerate(x)], u(6).alias("e"))
    signal = F.col("x0") * 3 + F.col("x1") * F.col("x4") - F.col("x2") * 5 + F.col("x5") / 50
    return rows.withColumns({"value": signal + F.col("e"), "label": (signal + F.col("e") * 2 > 4).cast("int")})


NAMES = [f"x{j}" for j in range(6)]
PARAMS = {"n_estimators": 7, "max_depth": 3, "learning_rate": 0.3, "min_child_weight": 20, "min_info_gain": 1e-3}
SAME = {"maxIter": 7, "maxDepth": 3, "stepSize": 0.3, "minInstancesPerNode": 20, "minInfoGain": 1e-3}


def ours(df, kind, label, params):
    _, out = ML.final_scores(df, NAMES, label, ML.ModelSpec(kind, params))
    return np.array([r.policy_score for r in out.orderBy("game_id").collect()])


def sparks(df, model, label, classifies):
    weight = F.when(F.col("label") == 1, 5.0).otherwise(1.0)
    data = df.select("game_id", F.col(label).cast("double").alias("y"), weight.alias("w"), array_to_vector(F.array(*NAMES)).alias("features"))
    out = model.fit(data).transform(data)
    value = vector_to_array("probability")[1] if classifies else F.col("prediction")
    return np.array([r[0] for r in out.orderBy("game_id").select(value).collect()])


@pytest.mark.parametrize("block", [BT.BLOCK_ROWS, 70])
def test_scores_are_those_of_sparks_trees(spark, monkeypatch, block):
    monkeypatch.setattr(BT, "BLOCK_ROWS", block)
    monkeypatch.setattr(BT, "LEAST_ROWS", 10 * block)
    df = noisy(spark).localCheckpoint()
    got = ours(df, "xgb_classifier", "label", PARAMS | {"scale_pos_weight": 5})
    want = sparks(df, GBTClassifier(labelCol="y", weightCol="w", **SAME), "label", True)
    assert np.abs(got - want).max() < 1e-9 and len(set(got)) > 50
    got = ours(df, "xgb_regressor", "value", PARAMS)
    want = sparks(df, GBTRegressor(labelCol="y", **SAME), "value", False)
    assert np.abs(got - want).max() < 1e-9 and len(set(got)) > 50


def test_drawn_rows_and_features_rank_as_well(spark):
    df = noisy(spark, 6000).localCheckpoint()
    train, held = df.filter("game_id % 3 > 0"), df.filter("game_id % 3 = 0")
    params = {"n_estimators": 20, "subsample": 0.8, "colsample_bytree": 0.8, "random_state": 3, "learning_rate": 0.2}
    spec = ML.ModelSpec("xgb_classifier", params | {"max_depth": 3})
    model = ML.fit(train, NAMES, "label", spec)
    auc = K.ranking_scores(ML.score(model, held, NAMES, spec, "p"), "label", "p").first().roc_auc
    data = lambda d: d.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(*NAMES)).alias("features"))
    other = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=3).fit(data(train))
    scored = other.transform(data(held)).withColumn("p", vector_to_array("probability")[1])
    want = K.ranking_scores(scored, "label", "p").first().roc_auc
    assert auc > 0.85 and abs(auc - want) < 0.01


def test_a_pass_sends_a_row_a_task_and_holds_rows_as_packed_bytes(spark):
    """What a pass collects follows the tasks, and a row takes some bytes a feature, not an object."""
    sizes = []
    for n in (2_000, 40_000):
        fit = BT.BoostedTrees("label", "log", 1, 2, 0.1)
        rows = noisy(spark, n).select(F.col("label").cast("double").alias("y"), F.lit(1.0).alias("w"), F.array(*NAMES).alias("x"))
        layout = BT.Layout(fit._thresholds(rows, n))
        state = fit._state(rows, layout, n)
        sent = state.mapPartitionsWithIndex(BT._level_sums(layout, "log", 0, 1.0, [], BT.Tree.of(2), [0], 0)).collect()
        assert len(sent) <= spark.sparkContext.defaultParallelism
        sizes.append(max(len(sums) for _, sums in sent))
        held = state.map(lambda b: (len(b[5]), b[2].nbytes + b[3].nbytes + b[5].nbytes)).collect()
        assert sum(rows for rows, _ in held) == n and sum(size for _, size in held) <= n * (9 + 2 * len(NAMES))
        state.unpersist()
    assert sizes[0] == sizes[1]


@pytest.mark.parametrize("label", ["NULL", "2", "double('nan')"])
def test_labels_that_no_class_has_are_errors(spark, label):
    df = spark.range(5).selectExpr("id", "double(id) AS x0", f"{label} AS y")
    with pytest.raises(Exception, match="label"):
        ML.fit(df, ["x0"], "y", ML.ModelSpec("xgb_classifier", {"n_estimators": 1}))
