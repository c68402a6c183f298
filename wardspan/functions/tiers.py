"""Tiers, severities, directions and reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of High and Medium by kind of score.
LIVE, RARITY = (0.7, 0.4), (0.6, 0.4)
NEUTRAL = "No significant anomaly detected. Behaviour is within normal peer-group ranges."
NO_DRIVER = "No significant risk-increasing features identified."


def tier(score: Column, high, medium) -> Column:
    return F.when(score >= high, "High").when(score >= medium, "Medium").otherwise("Low")


def tier_rank(name: Column) -> Column:
    return F.when(name == "High", 0).when(name == "Medium", 1).otherwise(2)


def direction(value: Column) -> Column:
    return F.when(value > 0, "increases_risk").otherwise("decreases_risk")


def reason(features: Column, level: Column, top: int = 3) -> Column:
    """A sentence of (feature, value) structs in order: neutral for Low, else the largest raising ones and their shares."""
    total = F.aggregate(features, F.lit(0.0), lambda t, f: t + F.abs(f.value))
    total = F.when(total == 0, 1.0).otherwise(total)
    raising = F.slice(F.filter(features, lambda f: f.value > 0), 1, top)
    parts = F.transform(raising, lambda f: F.format_string("%s (%.1f%%)", f.feature, F.abs(f.value) / total * 100))
    prefix = F.when(level == "High", "Flagged: ").otherwise("Elevated activity: ")
    return F.when(level == "Low", NEUTRAL).when(F.size(raising) == 0, NO_DRIVER).otherwise(F.concat(prefix, F.array_join(parts, "; ")))
