"""Stop and continue decisions from scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Per objective the threshold's policy key, the keys tried after it
# in order, the default, and the test of (score, threshold) with its action.
OBJECTIVES = {
    "peak_binary": ("peak_stop_threshold", ["classification_stop_threshold"], 0.60, ">=", "stop"),
    "meaningful_upside_binary": ("classification_continue_threshold", [], 0.50, ">=", "continue"),
    "future_upside_regression": (
        "continue_threshold",
        ["future_upside_continue_threshold"],
        0.0,
        ">=",
        "continue",
    ),
    "future_drawdown_regression": (
        "future_drawdown_stop_threshold",
        ["regression_stop_threshold"],
        6.0,
        ">=",
        "stop",
    ),
    "games_to_peak_regression": (
        "games_to_peak_continue_threshold",
        ["regression_stop_threshold", "continue_threshold"],
        1.0,
        "<=",
        "stop",
    ),
}
# Shipped policies.
POLICIES = {
    "aggressive": {
        "name": "aggressive",
        "lambda": 0.5,
        "continue_threshold": 0.0,
        "friction_cost": 1.0,
        "classification_continue_threshold": 0.42,
    },
    "balanced": {
        "name": "balanced",
        "lambda": 1.0,
        "continue_threshold": 0.0,
        "friction_cost": 2.0,
        "classification_continue_threshold": 0.50,
    },
    "conservative": {
        "name": "conservative",
        "lambda": 2.0,
        "continue_threshold": 0.0,
        "friction_cost": 3.0,
        "classification_continue_threshold": 0.60,
    },
}


def _objective(kind: str):
    if kind not in OBJECTIVES:
        raise ValueError(f"no objective has the name {kind}")
    return OBJECTIVES[kind]


def threshold_name(kind: str) -> str:
    return _objective(kind)[0]


def resolve_threshold(policy: Mapping, kind: str) -> float:
    """First key present in the policy, else the objective's default."""
    primary, fallbacks, default, _, _ = _objective(kind)
    for key in [primary, *fallbacks]:
        if key in policy:
            return float(policy[key])
    return default


def continue_score(upside: Column, downside: Column, risk_lambda: float, friction: float) -> Column:
    return upside - F.lit(float(risk_lambda)) * downside - F.lit(float(friction))


def holds(score: Column, test: str, threshold) -> Column:
    """Comparison that a null or NaN score always fails (Spark orders NaN above all)."""
    number = score.cast("double")
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    compare = {">=": number >= limit, ">": number > limit, "<=": number <= limit}[test]
    return F.coalesce(~F.isnan(number) & compare, F.lit(False))


def action_from_probability(prob: Column, threshold: float) -> Column:
    return F.when(holds(prob, ">=", threshold), "continue").otherwise("stop")


def action_from_score(score: Column, threshold: float = 0.0) -> Column:
    return F.when(holds(score, ">", threshold), "continue").otherwise("stop")


def stops(score: Column, kind: str, threshold) -> Column:
    """Whether the objective's rule says stop."""
    _, _, _, test, action = _objective(kind)
    hit = holds(score, test, threshold)
    return hit if action == "stop" else ~hit


def action_from_objective(score: Column, kind: str, policy: Mapping, threshold: float | None = None) -> Column:
    limit = resolve_threshold(policy, kind) if threshold is None else float(threshold)
    return F.when(stops(score, kind, limit), "stop").otherwise("continue")
