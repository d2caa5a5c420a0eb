"""Actions, backtests and sweeps against brute force and published results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gapline.operators import backtest as B
from gapline.operators import policy as P

NAN = float("nan")

# Published session records as
# (stopped by model, stop index, stop P/L, final P/L, peak P/L).
SESSIONS = [
    (1, 1, 5, 5, 5), (0, 4, 1, 1, 6), (1, 1, 6, 1, 6), (0, 1, 5, 5, 5), (0, 3, -17, -17, -5),
    (0, 1, 5, 5, 5), (0, 1, -6, -6, -6), (1, 1, 5, 11, 11), (1, 1, -4, -4, -4), (1, 1, 5, 5, 5),
    (1, 1, 7, 25, 29), (1, 1, -5, -5, -5), (1, 1, 5, 4, 11), (1, 1, 6, 23, 28), (1, 1, -5, 22, 37),
    (1, 1, 0, -13, 0), (1, 5, 17, 0, 17), (1, 1, -5, -5, -5), (0, 6, 10, 10, 10), (0, 11, 3, 3, 9),
    (1, 1, 26, 3, 26), (0, 6, -26, -26, -6), (0, 3, 5, 5, 12), (1, 6, 9, 10, 15), (1, 1, 6, -1, 11),
    (0, 2, -12, -12, -5), (0, 4, 2, 2, 12), (0, 2, -11, -11, -5), (0, 9, 19, 19, 30), (0, 7, -27, -27, -4),
    (0, 1, 6, 6, 6), (0, 3, 0, 0, 0), (0, 3, 0, 0, 0), (1, 2, 29, 27, 32), (0, 9, 0, 0, 10),
]
# The published summary of those sessions.
SUMMARY = {
    "n_sessions": 35,
    "n_stop_sessions": 17,
    "n_margin_calls": 0,
    "total_actual_final_pl": 65.0,
    "total_stop_pl": 64.0,
    "total_peak_pl": 293.0,
    "total_tapl": -113.0,
    "total_elo_delta_vs_actual": -1.0,
    "total_elo_left_vs_peak": 229.0,
    "mean_realized_pl": 1.8285714285714285,
    "mean_actual_final_pl": 1.8571428571428572,
    "mean_peak_pl": 8.371428571428572,
    "mean_capture_ratio": 1.158791417001277,
    "mean_stop_game_index": 2.942857142857143,
}
# Published sweep as (threshold, total delta).
SWEEP = [
    (0.35, -14), (0.375, -14), (0.4, -14), (0.425, -14), (0.45, -18), (0.475, -18), (0.5, -21), (0.525, 4),
    (0.55, -1), (0.575, -1), (0.6, -1), (0.625, -1), (0.65, 0), (0.675, -13), (0.7, -13), (0.725, -11),
    (0.75, -11), (0.775, -28), (0.8, -28), (0.825, -28), (0.85, -28),
]


def test_summary_of_published_sessions(spark):
    schema = "stop_triggered boolean, stop_game_index long, stop_pl double, actual_final_pl double, peak_pl double"
    data = [(bool(a), b, float(c), float(d), float(e)) for a, b, c, d, e in SESSIONS]
    r = spark.createDataFrame(data, schema).withColumns(
        {
            "margin_triggered": F.lit(False),
            "tapl": F.when(F.col("stop_pl") < 0, F.col("stop_pl") * 2.5).otherwise(F.col("stop_pl")),
            "elo_delta_vs_actual": F.col("stop_pl") - F.col("actual_final_pl"),
            "elo_left_vs_peak": F.col("peak_pl") - F.col("stop_pl"),
            "capture_ratio": F.when(F.col("peak_pl") != 0, F.try_divide("stop_pl", "peak_pl")),
        }
    )
    got = B.summarize(r).first()
    for key, value in SUMMARY.items():
        assert got[key] == pytest.approx(value, rel=1e-12), key


def test_best_of_published_sweep(spark):
    grid = B.sweep_grid(P.resolve_threshold(P.POLICIES["balanced"], "peak_binary"))
    assert grid == pytest.approx([t for t, _ in SWEEP])
    df = spark.createDataFrame([(t, float(d)) for t, d in SWEEP], "threshold_value double, total_elo_delta_vs_actual double")
    best = B.best_threshold(df).first()
    assert (best.threshold_value, best.total_elo_delta_vs_actual) == (0.525, 4.0)
    with pytest.raises(ValueError, match="not available"):
        B.best_threshold(df, "nothing")


def test_threshold_resolution():
    assert P.resolve_threshold({}, "future_drawdown_regression") == 6.0
    assert P.resolve_threshold({"regression_stop_threshold": 3}, "games_to_peak_regression") == 3.0
    assert P.resolve_threshold({"continue_threshold": 2}, "games_to_peak_regression") == 2.0
    both = {"continue_threshold": 2, "future_upside_continue_threshold": 5}
    assert P.resolve_threshold(both, "future_upside_regression") == 2.0
    assert P.resolve_threshold({"classification_stop_threshold": 0.7}, "peak_binary") == 0.7
    with pytest.raises(ValueError):
        P.resolve_threshold({}, "nope")


def test_missing_scores_fail_every_test(spark):
    df = spark.createDataFrame([(NAN,), (None,), (100.0,), (-100.0,)], "s double")
    acts = {k: P.action_from_objective(F.col("s"), k, {}) for k in P.OBJECTIVES}
    rows = df.select(*[c.alias(k) for k, c in acts.items()]).collect()
    fail = {
        "peak_binary": "continue",
        "meaningful_upside_binary": "stop",
        "future_upside_regression": "stop",
        "future_drawdown_regression": "continue",
        "games_to_peak_regression": "continue",
    }
    for kind, action in fail.items():
        other = "stop" if action == "continue" else "continue"
        high, low = (action, other) if kind == "games_to_peak_regression" else (other, action)
        assert [r[kind] for r in rows] == [action, action, high, low]


SCHEMA = "g string, i long, pl double, action string"


def records(spark, games, **kw):
    df = spark.createDataFrame([("s", i, pl, a) for i, (pl, a) in enumerate(games)], SCHEMA)
    return B.backtest_sessions(df, ["g"], ["i"], "pl", "action", **kw).first()


def test_margin_wins_a_tie(spark):
    r = records(spark, [(1.0, "go"), (-60.0, "stop"), (5.0, "go")])
    assert (r.margin_triggered, r.stop_triggered, r.stop_game_index, r.tapl) == (True, False, 2, -150.0)
    r = records(spark, [(1.0, "stop"), (-60.0, "go")])
    assert (r.margin_triggered, r.stop_triggered, r.stop_pl) == (False, True, 1.0)


def test_no_stop_and_zero_peak(spark):
    r = records(spark, [(-5.0, "go"), (0.0, "go"), (0.0, "go")])
    assert (r.stop_game_index, r.peak_game_index, r.peak_pl, r.capture_ratio) == (3, 2, 0.0, None)
    assert not r.stop_triggered and not r.margin_triggered


def test_empty_input_gives_zeros(spark):
    empty = spark.createDataFrame([], SCHEMA)
    got = B.summarize(B.backtest_sessions(empty, ["g"], ["i"], "pl", "action")).first().asDict()
    assert set(got) == set(B.SUMMARY_COLUMNS) and all(v == 0 for v in got.values())


def brute(sessions, stop, limit):
    """Row by row: stop and final P/L totals and stop count."""
    total, final, stopped, margins = 0.0, 0.0, 0, 0
    for rows in sessions:
        model = next((k for k, (_, s) in enumerate(rows) if stop(s)), None)
        margin = next((k for k, (p, _) in enumerate(rows) if p <= limit), None)
        end = min(x for x in (model, margin, len(rows) - 1) if x is not None)
        total, final = total + rows[end][0], final + rows[-1][0]
        margins += margin == end
        stopped += model == end and margin != end
    return total, final, stopped, margins


@pytest.mark.parametrize("kind", list(P.OBJECTIVES))
@pytest.mark.parametrize("cap", [100_000, 4])
def test_sweep_equals_row_by_row(spark, kind, cap):
    rng = random.Random(7)
    sessions = []
    for _ in range(25):
        pl, rows = 0.0, []
        for _ in range(rng.randint(1, 12)):
            pl += rng.randint(-9, 9)
            score = rng.choice([NAN, None, round(rng.random(), 2), round(rng.random(), 2), round(rng.random(), 2)])
            rows.append((pl, score))
        sessions.append(rows)
    data = [(str(g), i, pl, s) for g, rows in enumerate(sessions) for i, (pl, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, i long, pl double, score double")
    out = B.threshold_sweep(
        df, ["g"], ["i"], "pl", "score", kind, {"name": "t"}, 0.1, 0.9, 9, max_drawdown=-12.0, max_rows=cap
    ).collect()
    assert len(out) == 9
    test, action = P.OBJECTIVES[kind][3:]
    for r in out:
        t = r.threshold_value

        def stop(s):
            hit = s is not None and not math.isnan(s) and (s >= t if test == ">=" else s <= t)
            return hit == (action == "stop")

        want = brute(sessions, stop, -12.0)
        got = (r.total_stop_pl, r.total_actual_final_pl, r.n_stop_sessions, r.n_margin_calls)
        assert got == want, t


def test_production_search(spark):
    rng = random.Random(3)
    sessions = [[(rng.randint(-5, 6), rng.choice([0.3, 0.32, 0.5, 0.61, 0.88])) for _ in range(6)] for _ in range(10)]
    data = [(str(g), i, float(d), p) for g, rows in enumerate(sessions) for i, (d, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, i long, d double, p double")
    search = B.production_search(df, ["g"], ["i"], "d", "p")
    got = {r.threshold_value: r.simulated_pl for r in search.collect()}
    assert len(got) == len(B.production_thresholds()) == 31
    for t, value in got.items():
        want = 0
        for rows in sessions:
            end = next((k for k, (_, p) in enumerate(rows) if p > t), len(rows) - 1)
            want += sum(d for d, _ in rows[: end + 1])
        assert value == want
    best = B.production_choice(search).first()
    assert best.optimized_rating_diff_sum == max(got.values())
    assert best.threshold == min(t for t, v in got.items() if v == max(got.values()))
    assert best.estimated_gain == best.optimized_rating_diff_sum - best.baseline_rating_diff_sum


def test_continue_score(spark):
    row = spark.range(1).select(P.continue_score(F.lit(10.0), F.lit(2.0), 2.0, 3.0).alias("x")).first()
    assert row.x == 3.0
