"""Label expressions (P14-P18) as ``CASE WHEN`` chains, never row-wise Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Versatility labels by standard deviation of per-category engagement.
VERSATILITY_LABELS = ("HIGHLY VERSATILE", "VERSATILE", "GAME-DEPENDENT")
VERSATILITY_CUTS = (0.5, 1.0)

# Score tiers and recommended actions, lower bound inclusive.
TIER_CUTS = (0.8, 0.6, 0.4, 0.2)
TIER_LABELS = (
    "🌟 Very High Potential",
    "⭐ High Potential",
    "✓ Moderate Potential",
    "→ Low Potential",
    "· Very Low Potential",
)
ACTION_LABELS = (
    "Priority target - immediate outreach and evaluation.",
    "Strong candidate - monitor closely and engage.",
    "Worth watching - periodic check-ins.",
    "Keep on radar - revisit in 3-6 months.",
    "Unlikely candidate - deprioritize.",
)

# Model assessment by class-1 precision and recall.
ASSESSMENT_LABELS = ("EXCELLENT", "GOOD", "MODERATE", "POOR")

# Tune-in ratio bands.
RATIO_BANDS = ("high", "medium", "low")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def versatility_rating(stddev) -> Column:
    """NULL stddev (one category row) falls to the last label like SQL ELSE."""
    sd = _c(stddev)
    return (
        F.when(sd < VERSATILITY_CUTS[0], VERSATILITY_LABELS[0])
        .when(sd < VERSATILITY_CUTS[1], VERSATILITY_LABELS[1])
        .otherwise(VERSATILITY_LABELS[2])
    )


def _banded(p: Column, labels) -> Column:
    expr = F.when(p >= TIER_CUTS[0], labels[0])
    for cut, label in zip(TIER_CUTS[1:], labels[1:-1]):
        expr = expr.when(p >= cut, label)
    return expr.otherwise(labels[-1])


def score_tier(prob) -> Column:
    """P15 probability -> tier label."""
    return _banded(_c(prob), TIER_LABELS)


def recommended_action(prob) -> Column:
    """P16 probability -> suggested action."""
    return _banded(_c(prob), ACTION_LABELS)


def assess_model(precision, recall) -> Column:
    """P17; the third level needs precision OR recall (as the code does)."""
    p, r = _c(precision), _c(recall)
    return (
        F.when((p >= 0.6) & (r >= 0.5), ASSESSMENT_LABELS[0])
        .when((p >= 0.5) & (r >= 0.4), ASSESSMENT_LABELS[1])
        .when((p >= 0.3) | (r >= 0.3), ASSESSMENT_LABELS[2])
        .otherwise(ASSESSMENT_LABELS[3])
    )


def ratio_band(ratio) -> Column:
    """P18 tune-in ratio: high > 0.5, medium 0.1..0.5, low < 0.1."""
    r = _c(ratio)
    return F.when(r > 0.5, RATIO_BANDS[0]).when(r >= 0.1, RATIO_BANDS[1]).when(r < 0.1, RATIO_BANDS[2])
