"""Money rules as Column expressions."""

from pyspark.sql import Column, functions as F

from rotorwatch import schemas as S


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def unplanned_cost(rul: Column, hourly_output: Column, avg_repair: Column) -> Column:
    """Lost output over the remaining life plus the repair at the emergency premium."""
    return F.round(_or_zero(rul) * hourly_output + S.EMERGENCY_PREMIUM * avg_repair, 2)


def net_recommendation(risk: Column) -> Column:
    return (
        F.when(risk.isin(*S.AT_RISK), S.ACTION_IMMEDIATE)
        .when(risk == "MEDIUM", S.ACTION_PLANNED)
        .otherwise(S.ACTION_MONITOR)
    )


def planned_cost(hours: Column, avg_repair: Column) -> Column:
    """Labour for the hours plus the parts share of the average repair, unrounded."""
    return S.LABOUR_RATE * hours + S.PARTS_SHARE * avg_repair


def alert_downtime_cost(rul: Column, unplanned: Column) -> Column:
    """Cost figure put on an alert. It multiplies by a cost that already holds the remaining
    life, so it overstates: `outage_cost` is the figure to plan with."""
    return F.round(_or_zero(rul) * _or_zero(unplanned), 2)


def outage_cost(
    hourly_output: Column, hours_down: Column, repair: Column,
    premium: float = S.EMERGENCY_PREMIUM, collateral: Column | None = None,
) -> Column:
    """Unplanned outage: lost output, repair at a premium, collateral damage."""
    return hourly_output * hours_down + repair * premium + _or_zero(
        F.lit(0.0) if collateral is None else collateral
    )


def planned_outage_cost(
    hourly_output: Column, hours_down: Column, repair: Column, off_shift: Column
) -> Column:
    """Planned stop: off shift no output is lost."""
    return F.when(off_shift, repair).otherwise(hourly_output * hours_down + repair)


def failure_probability(rul: Column, window_hours: float) -> Column:
    """Chance of failing within the window: certain once the remaining life is inside it,
    else the share of the remaining life that the window covers; 0 without a rising trend."""
    return (
        F.when(rul.isNull(), 0.0)
        .when(rul <= window_hours, 1.0)
        .otherwise(F.lit(float(window_hours)) / rul)
    )
