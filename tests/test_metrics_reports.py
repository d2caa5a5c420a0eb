"""Metrics by hand, report tables against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapline.operators import metrics as K
from gapline.operators import models as ML
from gapline.operators import reports as R


def scored(spark, pairs):
    return spark.createDataFrame([(y, float(s)) for y, s in pairs], "y int, s double")


@pytest.mark.parametrize("cap", [1000, 2])
def test_ties_count_half_and_step_once(spark, cap):
    df = scored(spark, [(1, 0.8), (0, 0.8), (1, 0.4), (0, 0.2), (0, 0.4)])
    r = K.ranking_scores(df, "y", "s", max_rows=cap).first()
    # Pairs: 0.8 beats .2 .4, ties .8; 0.4 loses .8, beats .2, ties .4.
    assert r.roc_auc == pytest.approx((2.5 + 1.5) / 6)
    assert r.pr_auc == pytest.approx(0.5 * (1 / 2) + 0.5 * (2 / 4))


def test_one_class_is_null(spark):
    r = K.ranking_scores(scored(spark, [(1, 0.1), (1, 0.2)]), "y", "s").first()
    assert r.roc_auc is None and r.pr_auc is None


def test_f1_undefined_is_zero(spark):
    assert K.f1_scores(scored(spark, [(0, 0.1)]), "y", "s").first().f1 == 0.0
    assert K.f1_scores(scored(spark, [(1, 0.5), (0, 0.9), (1, 0.1)]), "y", "s").first().f1 == 0.5
    assert K.f1_scores(scored(spark, [(1, float("nan"))]), "y", "s").first().f1 == 0.0


def test_regression_constant_label(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, s double")
    r = K.regression_scores(df, "y", "s").first()
    assert (r.mae, r.r2) == (0.5, 0.0) and r.rmse == pytest.approx(0.5**0.5)
    assert K.regression_scores(df.filter("s = 2"), "y", "s").first().r2 == 1.0


# Fold metrics of a published run and their summary.
FOLDS = [
    (1, 0.9230769230769231, 0.9285714285714286, 0.9571428571428571),
    (2, 0.42857142857142855, 0.6842105263157895, 0.4002267573696145),
    (3, 0.5, 0.7534562211981567, 0.5128612605193401),
    (4, 0.0, 0.7197802197802198, 0.3294348508634223),
    (5, 0.5, 0.7880184331797235, 0.4982444590739522),
]
FOLD_SUMMARY = {
    "f1": (0.4703296703296703, 0.29315336646296014),
    "roc_auc": (0.7748073658090636, 0.084272848297309),
    "pr_auc": (0.5395820369938373, 0.21925399315172406),
}


def test_fold_summary_of_published_run(spark):
    df = spark.createDataFrame(FOLDS, "fold int, f1 double, roc_auc double, pr_auc double")
    for r in K.fold_summary(df, list(FOLD_SUMMARY)).collect():
        assert (r["mean"], r["std"]) == pytest.approx(FOLD_SUMMARY[r.metric], rel=1e-12)


def test_fold_summary_gaps(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 5.0, None), (3, 5.0, 4.0)], "fold int, a double, b double")
    got = {r.metric: r["mean"] for r in K.fold_summary(df, ["a", "b"]).collect()}
    assert got == {"a": None, "b": 3.0}


def numbers(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(1e6, 3, 200).round(3), "b": rng.integers(0, 4, 200).astype(float), "c": 1.0})
    pdf.loc[::7, "a"] = np.nan
    pdf["d"] = pdf.b > 1
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("cap", [100_000, 15])
def test_describe_equals_pandas(spark, cap):
    pdf, df = numbers(spark)
    got = {r["column"]: r for r in R.describe(df, ["a", "b", "c", "d"], max_rows=cap).collect()}
    want = pdf.astype({"d": float}).describe().T
    for c in want.index:
        for mine, theirs in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert got[c][mine] == pytest.approx(want.loc[c, theirs], rel=1e-9), (c, mine)
    assert got["a"]["missing_frac"] == pytest.approx(pdf.a.isna().mean())


def test_correlations_equal_pandas(spark):
    pdf, df = numbers(spark)
    want = pdf.astype({"d": float}).corr().fillna(0.0)
    got = R.correlations(df, ["a", "b", "c", "d"]).collect()
    assert len(got) == 16
    for r in got:
        assert r["corr"] == pytest.approx(want.loc[r.x, r.y], abs=1e-9)
    lonely = df.select(F.lit(None).cast("double").alias("n"), "b")
    assert {r["corr"] for r in R.correlations(lonely, ["n", "b"]).filter("x = 'n'").collect()} == {0.0}


def test_histogram_equals_numpy(spark):
    pdf, df = numbers(spark)
    counts, edges = np.histogram(pdf.a.dropna(), bins=30)
    got = {r.bin: r for r in R.histograms(df, ["a"]).collect()}
    assert [got[i].n if i in got else 0 for i in range(30)] == counts.tolist()
    assert all(got[i].bin_from == pytest.approx(edges[i]) for i in got)
    flat = R.histograms(df, ["c"]).collect()
    assert [(r.bin, r.lo, r.hi, r.n) for r in flat] == [(15, 0.5, 1.5, 200)]
    assert {r["class"] for r in R.histograms(df, ["a"], "b").collect()} == {"0.0", "1.0", "2.0", "3.0"}


def test_column_choice(spark):
    df = spark.createDataFrame([(1, "t", 2.0, True, 3.0)], "game_id int, name string, my_acpl double, rated boolean, target double")
    assert R.choose_features(df, ["game_id"], "y") == ["my_acpl", "rated"]
    assert R.choose_report_features(df, 2) == ["my_acpl", "game_id"]
    with pytest.raises(ValueError):
        R.choose_features(df.select("name"), [], "y")


def test_run_comparison_leaves_gaps(spark):
    a = spark.createDataFrame([(200, 0.41, "x")], "n_rows long, mean_f1 double, note string")
    b = spark.createDataFrame([(200, 6.43)], "n_rows long, mean_mae double")
    out = {r.run: r for r in R.compare_runs({"one": a, "two": b}).collect()}
    assert out["one"].mean_mae is None and out["two"].mean_f1 is None
    assert out["one"].mean_f1 == 0.41 and out["two"].mean_mae == 6.43 and "note" not in out["one"].asDict()
    flat = {r.metric: r.value for r in R.flatten_metrics(a, prefix="p_").collect()}
    assert flat == {"p_n_rows": 200.0, "p_mean_f1": 0.41}


def test_validation_rows_must_exist(spark):
    df = spark.createDataFrame([("0.5", 0)], "oof_score string, oof_is_validation int")
    with pytest.raises(ValueError):
        ML.validation_rows(df)
    frame, source = ML.scoring_frame(None, lambda: df)
    assert source == "in_sample_fallback" and frame is df


@pytest.mark.parametrize("bracket", [None, -0.2])
def test_quartiles_of_many_values(spark, monkeypatch, bracket):
    """Far more values than a sketch holds; a bracket that misses its rank falls back to the whole range."""
    if bracket is not None:
        monkeypatch.setattr(R, "BRACKET", bracket)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(size=60_000), "b": rng.integers(0, 3, 60_000) * 1.0, "c": np.arange(60_000) ** 2.0})
    pdf.loc[::7, "a"] = np.nan
    got = {r["column"]: r for r in R.describe(spark.createDataFrame(pdf), ["a", "b", "c"]).collect()}
    for c in pdf:
        for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            assert got[c][name] == pytest.approx(pdf[c].quantile(q), rel=1e-12)


def test_correlations_of_many_columns_with_gaps(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3_000, 1))
    pdf = pd.DataFrame(1e6 + base * rng.normal(size=(1, 29)) + rng.normal(size=(3_000, 29)), columns=[f"x{i}" for i in range(29)])
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    want = pdf.corr()
    got = R.correlations(spark.createDataFrame(pdf), list(pdf)).collect()
    assert len(got) == 29 * 29
    for r in got:
        assert r["corr"] == pytest.approx(want.loc[r["x"], r["y"]], abs=1e-9)


def test_histogram_class_limit(spark):
    df = spark.createDataFrame([(float(i % 12), float(i)) for i in range(120)] + [(None, 1.0), (3.0, float("inf"))], "k double, v double")
    assert {r["class"] for r in R.histograms(df, ["v"], "k").collect()} == {"all"}
    by_class = R.histograms(df, ["v"], "k", class_limit=12).groupBy("class").agg({"n": "sum"}).collect()
    assert len(by_class) == 12 and {r[1] for r in by_class} == {10}
