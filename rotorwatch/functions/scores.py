"""Health, risk and remaining-life rules as Column expressions."""

from pyspark.sql import Column, functions as F

from rotorwatch import schemas as S


def banded(value: Column, bands, above: str, missing: str | None = None) -> Column:
    """Label of the first band whose (exclusive) upper bound lies over ``value``."""
    label = F.when(value.isNull(), F.lit(missing))
    for bound, name in bands:
        label = label.when(value < bound, name)
    return label.otherwise(above)


def health_score(vibration: Column, rated: Column, strict_compat: bool = False) -> Column:
    """Percent of the vibration rating still unused, between 0 and 100, unrounded.

    An asset without a rating has no score; ``strict_compat`` gives it 100, as skipping
    NULL in the clamp would.
    """
    score = (
        F.when(vibration >= rated, 0.0)
        .when((vibration <= 0) & rated.isNotNull(), 100.0)
        .otherwise(100.0 - vibration / rated * 100.0)
    )
    return F.coalesce(score, F.lit(100.0)) if strict_compat else score


def risk_level(score: Column) -> Column:
    """Risk label of an unrounded score."""
    return banded(score, S.RISK_BANDS, S.RISK_ABOVE, S.RISK_UNKNOWN)


def rul_hours(
    vibration: Column, rated: Column, slope_per_sec: Column, strict_compat: bool = False
) -> Column:
    """Hours until the rating is reached at the present slope; NULL without a rising trend."""
    hours = F.when(vibration >= rated, 0.0).otherwise((rated - vibration) / (slope_per_sec * 3600.0))
    if strict_compat:
        hours = F.coalesce(hours, F.lit(0.0))
    return F.when(slope_per_sec > 0, hours)


def iso_zone(vibration: Column) -> Column:
    """Vibration severity zone A to D; the limit between C and D belongs to C."""
    zone = banded(vibration, S.ISO_ZONES, "C")
    return F.when(vibration > S.ISO_ZONE_C_LIMIT, "D").otherwise(zone)


def severity_rank(risk: Column) -> Column:
    """1 for the most severe label, rising; unknown labels last."""
    known = F.array(*[F.lit(name) for name in S.SEVERITY_ORDER])
    position = F.array_position(known, risk).cast("int")
    return F.when(position > 0, position).otherwise(len(S.SEVERITY_ORDER) + 1)


def is_at_risk(risk: Column) -> Column:
    return risk.isin(*S.AT_RISK)
