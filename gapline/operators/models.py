"""Models on Spark ML: feature vectors, out-of-fold scores, final scores."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.functions import scalars as S
from gapline.operators import metrics as M
from gapline.operators import splits as SP
from gapline.operators.boosting import BoostedTrees
from gapline.runtime import broadcast_if_small, cut_lineage, scratch_path

# Models fitted at a time.
PARALLEL_FITS = 5

# Parameters of the production classifier.
PRODUCTION_PARAMS = {
    "n_estimators": 150,
    "max_depth": 3,
    "learning_rate": 0.05,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
    "gamma": 1.0,
    "min_child_weight": 5,
    "scale_pos_weight": 5,
    "random_state": 42,
}


_TREE_PARAMS = set(PRODUCTION_PARAMS) | {"min_info_gain"}
# Parameters each kind understands; any other is an error rather than ignored.
KNOWN_PARAMS = {
    "xgb_classifier": _TREE_PARAMS,
    "xgb_regressor": _TREE_PARAMS - {"scale_pos_weight"},
    "logistic_regression": {"C", "max_iter", "tol"},
    "linear_regression": set(),
}


@dataclass(frozen=True)
class ModelSpec:
    """Model kind and its parameters, named as in an experiment file."""

    kind: str
    params: Mapping = field(default_factory=dict)

    def estimator(self, label: str, n_rows: int = 1):
        """The estimator. ``n_rows`` turns a penalty per data set into one per row.

        ``gamma`` is the least gain of a split summed over all rows, ``min_gain``
        that of a mean row, so it is divided by the rows.
        """
        p = dict(self.params)
        if self.kind not in KNOWN_PARAMS:
            raise ValueError(f"unknown kind of model: {self.kind}")
        if unknown := sorted(set(p) - KNOWN_PARAMS[self.kind]):
            raise ValueError(f"{self.kind} takes no {', '.join(unknown)}")
        if self.boosted:
            return BoostedTrees(
                label,
                "log" if self.classifies else "squared",
                rounds=p.get("n_estimators", 100),
                depth=p.get("max_depth", 6),
                rate=p.get("learning_rate", 0.3),
                subsample=p.get("subsample", 1.0),
                columns=float(p.get("colsample_bytree", 1.0)),
                min_gain=float(p.get("min_info_gain", p.get("gamma", 0.0) / n_rows)),
                min_rows=int(p.get("min_child_weight", 1)),
                seed=p.get("random_state", 0),
                weight="_weight" if "scale_pos_weight" in p else None,
            )
        if self.kind == "logistic_regression":
            # The usual objective is half the squared weights plus C times the summed
            # loss, on raw features; Spark's is the mean loss plus the penalty.
            penalty = 1.0 / (float(p.get("C", 1.0)) * n_rows)
            return LogisticRegression(
                labelCol=label, maxIter=p.get("max_iter", 100), tol=p.get("tol", 1e-6), regParam=penalty, standardization=False
            )
        return LinearRegression(labelCol=label, regParam=0.0)

    @property
    def classifies(self) -> bool:
        return self.kind in ("xgb_classifier", "logistic_regression")

    @property
    def boosted(self) -> bool:
        return self.kind in ("xgb_classifier", "xgb_regressor")

    @property
    def value(self) -> Column:
        """Probability of the positive class, or the predicted value, of a transformed frame."""
        return vector_to_array("probability")[1] if self.classifies and not self.boosted else F.col("prediction")


def model_input(df: DataFrame, features: list[str], label: str, pos_weight: float = 1.0) -> DataFrame:
    """Features as doubles with gaps filled by 0, label as double, class weight."""
    filled = {c: S.number_or_zero(df, c) for c in features}
    out = df.withColumns({f"_x_{c}": v for c, v in filled.items()})
    return out.withColumns(
        {
            "_label": F.col(label).cast("double"),
            "_weight": F.when(F.col(label) == 1, float(pos_weight)).otherwise(1.0),
        }
    )


def assembler(features: list[str]) -> VectorAssembler:
    """Vector in contract order."""
    return VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="features", handleInvalid="keep")


def arrays(features: list[str]) -> SQLTransformer:
    """Array in contract order, which trees take as it is."""
    return SQLTransformer(statement=f"SELECT *, array({', '.join(f'`_x_{c}`' for c in features)}) AS features FROM __THIS__")


def fit(df: DataFrame, features: list[str], label: str, spec: ModelSpec) -> PipelineModel:
    weight = float(spec.params.get("scale_pos_weight", 1.0))
    data = model_input(df, features, label, weight).select("_label", "_weight", *[f"_x_{c}" for c in features])
    n_rows = max(1, data.count()) if spec.kind == "logistic_regression" or "gamma" in spec.params else 1
    return Pipeline(stages=[arrays(features) if spec.boosted else assembler(features), spec.estimator("_label", n_rows)]).fit(data)


def score(model: PipelineModel, df: DataFrame, features: list[str], spec: ModelSpec, out: str) -> DataFrame:
    """Probability of the positive class, or the predicted value."""
    filled = df.withColumns({f"_x_{c}": S.number_or_zero(df, c) for c in features})
    return model.transform(filled).withColumn(out, spec.value).select(*df.columns, out)


def fix_folds(
    df: DataFrame, group: str, time: str, n_splits: int = 5, group_gap: int = 0
) -> tuple[DataFrame, DataFrame]:
    """The rows and their fold map, both written once, so that all fits see the same."""
    rows = cut_lineage(df)
    return rows, cut_lineage(SP.chronological_folds(rows, group, time, n_splits, group_gap))


def fold_data(rows: DataFrame, folds: DataFrame, features: list[str], targets: list[str], group: str, key: list[str]) -> DataFrame:
    """Key, targets and vector of every row of a fold, with the folds it trains and validates.

    Assembled and written once for all fits of all targets. A group has one row of fold
    numbers, so the join adds no rows.
    """
    if missing := [c for c in features if c not in rows.columns]:
        raise ValueError(f"features that the rows lack: {', '.join(missing)}")
    roles = folds.groupBy(group).agg(*[F.collect_set(F.when(F.col("role") == r, F.col("fold"))).alias(f"_{r}") for r in ("train", "valid")])
    values = F.array(*[S.number_or_zero(rows, c) for c in features]).alias("_x")
    labels = [F.col(t).cast("double").alias(f"_y_{t}") for t in targets]
    data = rows.select(*dict.fromkeys([group, *key]), *labels, values)
    return cut_lineage(data.join(broadcast_if_small(roles), group).select(*key, *[f"_y_{t}" for t in targets], "_x", "_train", "_valid"))


def fold_scores(
    stored: DataFrame, target: str, spec: ModelSpec, key: list[str], parallel: int = PARALLEL_FITS
) -> DataFrame:
    """Key, target, out-of-fold score and fold of every row that a fold validates, written once.

    Takes what ``fold_data`` made. Folds are fitted side by side, ``parallel`` at a time, as
    most of a fit's jobs are too short to keep a cluster busy; each is distributed.
    """
    weight = F.when(F.col(f"_y_{target}") == 1, float(spec.params.get("scale_pos_weight", 1.0))).otherwise(1.0)
    data = stored.select(
        *key, F.col(f"_y_{target}").alias("_label"), weight.alias("_weight"), (F.col("_x") if spec.boosted else array_to_vector("_x")).alias("features"), "_train", "_valid"
    )
    # A row per fold and side.
    count = lambda side: data.select(F.explode(side).alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["fold"]: r["n"] for r in count("_train").collect()}
    numbers = sorted({r["fold"] for r in count("_valid").select("fold").collect()} | set(sizes))

    def one(fold: int) -> DataFrame:
        train = data.filter(F.array_contains("_train", F.lit(fold)))
        model = spec.estimator("_label", max(1, sizes.get(fold, 0))).fit(train)
        scored = model.transform(data.filter(F.array_contains("_valid", F.lit(fold))))
        return scored.select(
            *key,
            F.col("_label").alias(target),
            spec.value.alias("oof_score"),
            F.lit(float(fold)).alias("oof_fold"),
            F.lit(1).alias("oof_is_validation"),
        )

    parts = side_by_side(stored.sparkSession, one, numbers, parallel)
    return cut_lineage(reduce(DataFrame.unionByName, parts))  # read several times; each fold is scored once


def with_scores(rows: DataFrame, scored: DataFrame, target: str, kind: str, key: list[str]) -> DataFrame:
    """Every row with its score, fold and validity flag; null and flag 0 where no fold validates it."""
    from gapline.operators.targets import TASKS

    return rows.join(scored.drop(target), key, "left").withColumns(
        {
            "oof_is_validation": F.coalesce("oof_is_validation", F.lit(0)),
            "task_type": F.lit(TASKS[kind]),
            "objective_kind": F.lit(kind),
        }
    )


def out_of_fold(
    rows: DataFrame,
    folds: DataFrame,
    features: list[str],
    target: str,
    kind: str,
    spec: ModelSpec,
    group: str,
    key: list[str],
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """Every row with its out-of-fold score, fold and validity flag.

    Takes the frames that ``fix_folds`` made.
    """
    stored = fold_data(rows, folds, features, [target], group, key)
    return with_scores(rows, fold_scores(stored, target, spec, key, parallel), target, kind, key)


def side_by_side(spark, work, items: list, parallel: int) -> list:
    """``work`` of each item in threads that keep the session's job properties, in the order of the items."""
    if not items:
        raise ValueError("no folds to fit")
    with ThreadPoolExecutor(max(1, min(parallel, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def validation_rows(oof: DataFrame) -> DataFrame:
    """Rows a fold validated, scores as numbers; an error when there are none."""
    rows = oof.filter(F.col("oof_is_validation") == 1).withColumn("policy_score", S.as_number(oof, "oof_score"))
    if rows.isEmpty():
        raise ValueError("no row was validated, so there is no score to use")
    return rows


def scoring_frame(oof: DataFrame | None, fallback) -> tuple[DataFrame, str]:
    """Out-of-fold rows when they exist, else ``fallback()`` scores of the training rows."""
    if oof is not None:
        return validation_rows(oof), "oof_validation"
    return fallback(), "in_sample_fallback"


def final_scores(df: DataFrame, features: list[str], target: str, spec: ModelSpec, out: str = "policy_score"):
    """Fit on all rows and score them: the model and the frame."""
    model = fit(df, features, target, spec)
    return model, score(model, df, features, spec, out)


def save_and_reload(model: PipelineModel, spark) -> PipelineModel:
    """Through the shared folder with Spark's own writer."""
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def fold_metrics(oof: DataFrame, target: str, kind: str) -> DataFrame:
    """Per fold, the metrics of the objective's task."""
    from gapline.operators.targets import TASKS

    rows = oof.filter("oof_is_validation = 1").withColumn("fold", F.col("oof_fold"))
    if TASKS[kind] == "classification":
        f1 = M.f1_scores(rows, target, "oof_score", ["fold"])
        return f1.join(M.ranking_scores(rows, target, "oof_score", ["fold"]), "fold", "left")
    return M.regression_scores(rows, target, "oof_score", ["fold"])
