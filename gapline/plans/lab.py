"""Experiments end to end: targets, folds, scores, metrics, policy, manifest."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.operators import backtest as B
from gapline.operators import metrics as K
from gapline.operators import models as ML
from gapline.operators import policy as P
from gapline.operators import reports as R
from gapline.operators import splits as SP
from gapline.operators.targets import TASKS
from gapline.runtime import cut_lineage
from gapline.sources import sinks


def default_spec(kind: str) -> ML.ModelSpec:
    return ML.ModelSpec("logistic_regression" if TASKS[kind] == "classification" else "linear_regression")


def experiment(
    rows: DataFrame,
    folds: DataFrame,
    kind: str,
    features: list[str],
    spec: ML.ModelSpec,
    group: str,
    key: list[str],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Out-of-fold frame, fold metrics, and their mean and deviation."""
    target = f"target__{kind}"
    scored = ML.fold_scores(ML.fold_data(rows, folds, features, [target], group, key), target, spec, key)
    return ML.with_scores(rows, scored, target, kind, key), *_metrics(scored, target, kind)


def _metrics(scored: DataFrame, target: str, kind: str) -> tuple[DataFrame, DataFrame]:
    per_fold = ML.fold_metrics(scored, target, kind)
    return per_fold, K.fold_summary(per_fold, [c for c in per_fold.columns if c != "fold"])


def objective_matrix(
    df: DataFrame,
    kinds,
    features: list[str],
    group: str,
    time: str,
    key: list[str],
    specs: Mapping | None = None,
    n_splits: int = 5,
    group_gap: int = 1,
) -> DataFrame:
    """Fold summaries of several objectives side by side, over the same rows and folds.

    Objectives are fitted two at a time, the folds of each at once. All read one table of
    vectors, and their metrics the scores alone.
    """
    kinds = list(kinds)
    rows, folds = ML.fix_folds(df, group, time, n_splits, group_gap)
    stored = ML.fold_data(rows, folds, features, [f"target__{kind}" for kind in kinds], group, key)

    def one(kind: str) -> DataFrame:
        spec = (specs or {}).get(kind) or default_spec(kind)
        scored = ML.fold_scores(stored, f"target__{kind}", spec, key)
        summary = _metrics(scored, f"target__{kind}", kind)[1]
        return summary.select(F.lit(kind).alias("objective_kind"), "metric", "mean", "std")

    return reduce(DataFrame.unionByName, ML.side_by_side(df.sparkSession, one, kinds, 2))


def write_run(
    out: str,
    oof: DataFrame,
    per_fold: DataFrame,
    summary: DataFrame,
    rows: DataFrame,
    folds: DataFrame,
    kind: str,
    features: list[str],
    group: str,
    time: str,
    spec: ML.ModelSpec | None = None,
) -> DataFrame:
    """Run folder: out-of-fold parquet, final model, metrics, leakage report and manifest."""
    spark = rows.sparkSession
    model = ML.fit(rows, features, f"target__{kind}", spec or default_spec(kind))
    model.write().overwrite().save(f"{out}/model")
    sinks.write_parquet(oof, f"{out}/oof_predictions")
    sinks.write_manifest(per_fold, f"{out}/fold_metrics")
    sinks.write_manifest(summary, f"{out}/metrics")
    sinks.write_manifest(SP.leakage_report(rows, folds, group, time), f"{out}/leakage")
    manifest = sinks.run_manifest(
        spark,
        {
            "run_dir": out,
            "oof_predictions_path": f"{out}/oof_predictions",
            "model_path": f"{out}/model",
            "feature_order": features,
            "task_type": TASKS[kind],
            "target_col": f"target__{kind}",
            "objective": {"kind": kind},
        },
    )
    sinks.write_manifest(manifest, f"{out}/manifest")
    return manifest


def evaluate_policy(
    oof: DataFrame | None,
    kind: str,
    policy: Mapping,
    group,
    order,
    pl: str,
    threshold: float | None = None,
    fallback: Callable[[], DataFrame] | None = None,
    out: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Session records and summary of a policy.

    Scores are those of validated rows; without an out-of-fold frame those that
    ``fallback`` gives, such as ``saved_scores`` of a run. ``out`` is a folder to write both to.
    """
    rows, source = ML.scoring_frame(oof, fallback)
    limit = P.resolve_threshold(policy, kind) if threshold is None else threshold
    act = P.action_from_objective(F.col("policy_score"), kind, policy, limit)
    records = B.backtest_sessions(rows.withColumn("policy_action", act), group, order, pl, "policy_action")
    summary = B.summarize(records).select(
        F.lit(policy.get("name")).alias("policy"),
        F.lit(kind).alias("objective_kind"),
        F.lit(P.threshold_name(kind)).alias("threshold_name"),
        F.lit(float(limit)).alias("threshold_value"),
        "*",
        F.lit(source).alias("score_source"),
    )
    if out:
        sinks.write_csv(records, f"{out}/session_policy_summary")
        sinks.write_manifest(summary, f"{out}/policy_summary")
    return records, summary


def saved_scores(run: str, rows: DataFrame, features: list[str], spec: ML.ModelSpec) -> DataFrame:
    """The rows scored by the model of a run folder."""
    model = ML.PipelineModel.load(f"{run}/model")
    return ML.score(model, rows, features, spec, "policy_score")


def write_sweep(sweep: DataFrame, out: str) -> DataFrame:
    """The table of a threshold sweep and its best row; the latter is returned."""
    fixed = cut_lineage(sweep)
    best = B.best_threshold(fixed)
    sinks.write_csv(fixed, f"{out}/threshold_sweep")
    sinks.write_manifest(best, f"{out}/threshold_sweep_summary")
    return best


def read_runs(spark: SparkSession, runs: Mapping[str, str]) -> DataFrame:
    """Mean metrics of run folders, one row per name."""
    rows = {}
    for name, folder in runs.items():
        means = spark.read.json(f"{folder}/metrics").select("metric", "mean")
        found = [r["metric"] for r in means.select("metric").distinct().orderBy("metric").collect()]
        rows[name] = means.groupBy().pivot("metric", found).agg(F.first("mean"))
    return R.compare_runs(rows)


def production_run(
    df: DataFrame,
    features: list[str],
    target: str,
    group: str,
    order: list[str],
    delta: str,
    key: list[str],
    spec: ML.ModelSpec = ML.ModelSpec("xgb_classifier", ML.PRODUCTION_PARAMS),
    n_splits: int = 5,
    seed: int = 42,
    out: str | None = None,
) -> tuple[DataFrame, DataFrame, ML.PipelineModel]:
    """Stratified group check, final fit on all rows, threshold search: summary, AUCs, model.

    ``out`` is a folder for the model and the summary.

    The threshold is chosen on the rows the model was fitted on, as in the original
    recipe, so its gain is an optimistic figure.
    """
    rows = cut_lineage(df)
    dealt = SP.stratified_group_folds(rows, group, target, n_splits, seed)
    every = F.array(*[F.lit(k) for k in range(1, n_splits + 1)])
    folds = cut_lineage(
        dealt.select(group, F.col("fold").alias("_own"), F.explode(every).alias("fold")).select(
            group, "fold", F.when(F.col("fold") == F.col("_own"), "valid").otherwise("train").alias("role")
        )
    )
    scored = ML.fold_scores(ML.fold_data(rows, folds, features, [target], group, key), target, spec, key)
    scored = scored.withColumn("fold", F.col("oof_fold").cast("int"))
    aucs = K.ranking_scores(scored, target, "oof_score", ["fold"]).select("fold", "roc_auc")
    model, fitted = ML.final_scores(rows, features, target, spec, "tilt_prob")
    choice = B.production_choice(B.production_search(fitted, [group], order, delta, "tilt_prob"))
    cv = aucs.agg(
        F.sort_array(F.collect_list(F.struct("fold", "roc_auc")))["roc_auc"].alias("cv_auc_scores"),
        F.avg("roc_auc").alias("cv_auc_mean"),
        F.stddev_pop("roc_auc").alias("cv_auc_std"),
    )
    # Two one-row frames side by side.
    one = F.lit(1)
    summary = cv.withColumn("_one", one).join(choice.withColumn("_one", one), "_one").drop("_one")
    summary = summary.withColumns({"rows": F.lit(rows.count()), "features": F.array(*[F.lit(c) for c in features])})
    if out:
        summary = cut_lineage(summary)
        model.write().overwrite().save(f"{out}/model")
        sinks.write_manifest(summary, f"{out}/training_summary")
    return summary, aucs, model
