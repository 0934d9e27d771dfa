"""Label columns derived from a number."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lower ends of |r| and their names, strongest first: fixed values.
CORRELATION_BANDS = (
    (0.9, "Very Strong"),
    (0.7, "Strong"),
    (0.5, "Moderate"),
    (0.3, "Weak"),
)


def correlation_strength(r: Column) -> Column:
    """"Strong Negative" and the like; null for an undefined correlation."""
    band = None
    for lower, name in CORRELATION_BANDS:
        reached = F.abs(r) >= lower
        band = F.when(reached, name) if band is None else band.when(reached, name)
    band = band.otherwise("Very Weak")
    sign = F.when(r >= 0, "Positive").otherwise("Negative")
    return F.when(r.isNotNull(), F.concat_ws(" ", band, sign))


def pricing_tier(margin: Column) -> Column:
    """Four tiers by average margin."""
    return (
        F.when(margin < -50, "high risk")
        .when(margin < 0, "moderate risk")
        .when(margin <= 20, "standard")
        .when(margin > 20, "low risk")
    )


def loss_ratio_light(ratio: Column) -> Column:
    return F.when(ratio > 1.0, "red").when(ratio >= 0.9, "yellow").when(ratio < 0.9, "green")
