"""Additive bot-likelihood score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (column, comparison, bound, points); within one column the first hit counts.
SCORE_RULES = {
    "requests_per_minute": [(">", 120.0, 2.0), (">", 60.0, 1.0)],
    "clicks_per_minute": [(">", 120.0, 0.8)],
    "interval_std": [("<", 0.35, 1.4), ("<", 1.0, 0.6)],
    "coordinate_entropy": [("<", 1.6, 1.6), ("<", 2.6, 0.8)],
    "device_entropy": [("<", 0.2, 0.6)],
    "click_interval_entropy": [("<", 0.4, 0.9)],
    "movement_curvature": [("<", 0.02, 0.5)],
}
IDLE_RULE = (0.02, 80.0, 0.7)
PROXY_POINTS = 1.0


def bot_score(df: DataFrame) -> Column:
    """Score from the columns ``df`` has; an absent column counts as 0, a NULL earns nothing.

    The interval deviation is request_interval_std, and click_interval_std only when the
    former column is absent.
    """
    present = set(df.columns)

    def value(name: str) -> Column:
        if name == "interval_std":
            name = "request_interval_std" if "request_interval_std" in present else "click_interval_std"
        return F.col(name).cast("double") if name in present else F.lit(0.0)

    total = F.lit(0.0)
    for name, rules in SCORE_RULES.items():
        x, points = value(name), None
        for op, bound, worth in rules:
            hit = (x > bound) if op == ">" else (x < bound)
            points = F.when(hit, worth) if points is None else points.when(hit, worth)
        total = total + points.otherwise(0.0)
    idle, rate, worth = IDLE_RULE
    total = total + F.when((value("session_idle_ratio") < idle) & (value("requests_per_minute") > rate), worth).otherwise(0.0)
    total = total + F.when(value("is_proxy") != 0, PROXY_POINTS).otherwise(0.0)
    return F.bround(total, 4)
