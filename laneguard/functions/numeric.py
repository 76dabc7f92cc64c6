"""Numeric column helpers: rounding, distances, risk bands, probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shared with every published score.
KNOTS = 14.0
EARTH_RADIUS_NM = 3440.065
MEDIUM_RISK, HIGH_RISK = 0.3, 0.6
COLOR_STEPS = 5
PROBABILITY_FLOOR = 1e-6
PRIOR_STRENGTH = 20.0


def stable_round(x: Column, digits: int) -> Column:
    """Round half up, where a value within 1e-7 of a tie counts as the tie.

    Products and sums of doubles differ in the last bit with the order in which tasks finish; the small
    slack keeps the rounded result the same in every run and on every cluster size.
    """
    scale = float(10**digits)
    return F.floor(x * scale + 0.5000001) / scale


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in nautical miles."""
    half_dlat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_dlat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_dlon), 2.0
    )
    return F.asin(F.sqrt(a)) * (2 * EARTH_RADIUS_NM)


def sailing_days(distance_nm: Column) -> Column:
    return stable_round(distance_nm / KNOTS / 24.0, 1)


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= HIGH_RISK, "high")
        .when(score >= MEDIUM_RISK, "medium")
        .when(score > 0, "low")
        .otherwise("none")
    )


def color_bucket(score: Column) -> Column:
    """Step 0..4 of the exposure colour ramp; NULL means not exposed."""
    step = F.least(F.floor(score * COLOR_STEPS), F.lit(COLOR_STEPS - 1).cast("bigint"))
    return F.when(score > 0, step)


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def clip_probability(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - PROBABILITY_FLOOR)), F.lit(PROBABILITY_FLOOR))


def smoothed_rate(late: Column, n: Column, prior: Column) -> Column:
    """Group rate shrunk to the prior when the group has little history."""
    return (late + prior * PRIOR_STRENGTH) / (n + PRIOR_STRENGTH)


def survival(weight: Column) -> Column:
    """Aggregate: probability that none of the independent disruptions hits."""
    return F.product(F.lit(1.0) - weight)
