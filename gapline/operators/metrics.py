"""Exact model metrics as aggregates. ``by`` lists the columns of a run or fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.operators.ordered import MAX_GROUP_ROWS, arrange
from gapline.runtime import cut_lineage


def _by(df: DataFrame, by):
    return (df, list(by)) if by else (df.withColumn("_run", F.lit(1)), ["_run"])


def f1_scores(df: DataFrame, label: str, score: str, by=(), cut: float = 0.5) -> DataFrame:
    """F1 of ``score >= cut``; 0 when undefined. A null or NaN score counts as negative."""
    df, keys = _by(df, by)
    yes = F.coalesce((F.col(score) >= cut) & ~F.isnan(F.col(score).cast("double")), F.lit(False))
    pos = F.col(label) == 1
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    tp, fp, fn = n(yes & pos), n(yes & ~pos), n(~yes & pos)
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return df.groupBy(*keys).agg(f1.alias("f1")).drop("_run")


def ranking_scores(df: DataFrame, label: str, score: str, by=(), max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """ROC AUC (ties count half) and average precision (step sum), null for one class.

    A null or NaN score ranks below all others; rows without a label are left out. Rows collapse to distinct scores first; a run with many distinct scores is
    cut by score, so no task has to hold them all.
    """
    df, keys = _by(df.filter(F.col(label).isNotNull()), by)
    number = F.col(score).cast("double")
    df = df.withColumn(score, F.when(number.isNull() | F.isnan(number), F.lit(float("-inf"))).otherwise(number))
    pos = F.col(label).cast("int")
    steps = df.groupBy(*keys, score).agg(
        F.sum(pos).cast("long").alias("_p"), F.sum(1 - pos).cast("long").alias("_n")
    )
    steps = cut_lineage(steps)  # the group check and the scan read it
    line = arrange(steps, keys, [score], max_rows).scan(
        {"_np": ("sum", "_n"), "_tp": ("rev_sum", "_p"), "_fp": ("rev_sum", "_n")}
    )
    p, n = F.sum("_p"), F.sum("_n")
    below = F.col("_np") - F.col("_n")
    wins = F.sum(F.col("_p") * (below + F.col("_n") / 2.0))
    precision = F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    area = F.sum(F.col("_p") * precision)
    both = (p > 0) & (n > 0)
    return (
        line.df.groupBy(*keys)
        .agg(
            F.when(both, F.try_divide(wins, p * n)).alias("roc_auc"),
            F.when(both, F.try_divide(area, p)).alias("pr_auc"),
        )
        .drop("_run")
    )


def regression_scores(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """MAE, RMSE and R²; with a constant label R² is 1 for a perfect fit, else 0.

    Rows that lack the label or the score (null or NaN) are left out.
    """
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (label, score)]
    df, keys = _by(df.filter(known[0] & known[1]), by)
    err = F.col(label) - F.col(score)
    n, sse = F.count(F.lit(1)), F.sum(err * err)
    sst = F.var_pop(F.col(label).cast("double")) * n
    r2 = F.when(sst > 0, 1 - F.try_divide(sse, sst)).when(sse == 0, 1.0).otherwise(0.0)
    return (
        df.groupBy(*keys)
        .agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(sse / n).alias("rmse"), r2.alias("r2"))
        .drop("_run")
    )


def fold_summary(metrics: DataFrame, names, fold: str = "fold") -> DataFrame:
    """Mean and population deviation of each metric over folds, long form.

    A metric the first fold lacks stays null; otherwise folds without it are skipped.
    """
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    long = metrics.select(fold, F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)"))
    in_first = F.min_by(F.col("value").isNotNull(), F.col(fold))
    return long.groupBy("metric").agg(
        F.when(in_first, F.avg("value")).alias("mean"), F.when(in_first, F.stddev_pop("value")).alias("std")
    )
