"""Column expressions of the panel: calendar, stagnation, alert classes, the hybrid rule."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class limits in micrograms, labels, heating months, sentinels, stagnation limits and floors.
THRESHOLDS = (20.0, 35.0, 50.0)
LABELS = ("verde", "giallo", "arancio", "rosso")
HEATING_MONTHS = (10, 11, 12, 1, 2, 3)
SENTINELS = (-9999.0, -999.0, 9999.0)
HIGH_PRESSURE, LOW_WIND, LOW_MIXING = 1013.25, 1.5, 500.0
LEAST_WIND, LEAST_MIXING = 0.1, 10.0


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def alert_class(value: str | Column, thresholds: Sequence[float] = THRESHOLDS) -> Column:
    """Class id by left-closed bins from zero; null for null, NaN and negative values."""
    value = _col(value)
    level = reduce(lambda a, t: a + (value >= t).cast("int"), thresholds, F.lit(0))
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")) & (value >= 0), level)


def class_of_prediction(value: str | Column, thresholds: Sequence[float] = THRESHOLDS) -> Column:
    """Class id of a predicted value: below zero is class 0, null stays null."""
    value = _col(value)
    return F.when(value.isNotNull(), reduce(lambda a, t: a + (value >= t).cast("int"), thresholds, F.lit(0)))


def label_of(class_id: str | Column, labels: Sequence[str] = LABELS) -> Column:
    return F.get(F.array(*map(F.lit, labels)), _col(class_id))


def class_id_of(label: str | Column, labels: Sequence[str] = LABELS) -> Column:
    """Class id of a label, null for others."""
    at = F.array_position(F.array(*map(F.lit, labels)), _col(label)).cast("int")
    return F.when(at > 0, at - 1)


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("autumn")


def calendar(day: str | Column) -> dict[str, Column]:
    """month, season, weekday (Monday 0), is_weekend, heating_season and the circular coordinates of month and weekday."""
    day = _col(day)
    month, weekday = F.month(day), F.weekday(day)
    turn = lambda c, n: c * (2 * math.pi / n)
    return {
        "month": month, "season": season(month), "weekday": weekday, "is_weekend": (weekday >= 5).cast("int"), "heating_season": month.isin(*HEATING_MONTHS).cast("int"),
        "month_sin": F.sin(turn(month, 12)), "month_cos": F.cos(turn(month, 12)), "weekday_sin": F.sin(turn(weekday, 7)), "weekday_cos": F.cos(turn(weekday, 7)),
    }


def stagnation_flag(pressure: Column, wind: Column, mixing: Column, limits: tuple[float, float, float] = (HIGH_PRESSURE, LOW_WIND, LOW_MIXING)) -> Column:
    """1 for high pressure, little wind and a low mixing layer; null if any is missing.

    Means are compared to six places: further ones depend on the order in which their values were added up.
    """
    known = pressure.isNotNull() & wind.isNotNull() & mixing.isNotNull()
    return F.when(known, ((F.round(pressure, 6) > limits[0]) & (F.round(wind, 6) < limits[1]) & (F.round(mixing, 6) < limits[2])).cast("int"))


def stagnation_index(wind: Column, mixing: Column, rain: Column) -> Column:
    """Inverse of mean wind, lowest mixing height and rain, each kept from zero; null without wind or mixing height."""
    value = 1 / (F.greatest(wind, F.lit(LEAST_WIND)) * F.greatest(mixing, F.lit(LEAST_MIXING)) * (1 + F.coalesce(rain, F.lit(0.0))))
    return F.when(wind.isNotNull() & mixing.isNotNull(), value)


def threshold_distance(value: str | Column, thresholds: Sequence[float] = THRESHOLDS) -> Column:
    return F.least(*(F.abs(_col(value) - t) for t in thresholds))


def argmax(probabilities: str | Column) -> Column:
    """Place of the largest entry, the first of equals."""
    p = _col(probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def ordered_probabilities(probabilities: Column, classes: Column, n: int = 4) -> Column:
    """Probabilities by class id 0..n-1, 0 for classes that the model never saw."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.get(probabilities, F.array_position(classes, k).cast("int") - 1), F.lit(0.0)))


def hybrid_decision(predicted: str | Column, probabilities: str | Column, delta: float | Column, least: float | Column) -> dict[str, Column]:
    """The threshold-aware rule: near a class limit, a more severe class of the classifier overrides the regression.

    Only escalations are made, and only where the severe class has at least the probability `least`. `prudential` marks where the
    rule takes the severe class, `escalated` where that changes the class. `source` tells who decided: outside the zone the
    regression, inside it an agreement, an override (a sure severe class, even if it is the regression's own), or none.
    """
    predicted, p = _col(predicted), _col(probabilities)
    by_value, by_class, distance = class_of_prediction(predicted), argmax(p), threshold_distance(predicted)
    severe = F.greatest(by_value, by_class)
    near, differ, sure = distance <= delta, by_value != by_class, F.get(p, severe) >= least
    prudential = near & differ & sure
    up = prudential & (severe > by_value)
    return {
        "class_by_value": by_value, "class_by_model": by_class, "distance": distance, "near": near, "differ": differ, "severe_class": severe,
        "severe_probability": F.get(p, severe), "prudential": prudential, "escalated": up, "class_final": F.when(up, severe).otherwise(by_value),
        "source": F.when(~near, "regression").when(~differ, "hybrid_agreement").when(sure, "hybrid_override").otherwise("hybrid_no_override"),
    }


def frank_hall(exceed: Sequence[Column]) -> Column:
    """Class probabilities from P(y > k): differences, kept in [0, 1], scaled to sum 1 (rows of sum 0 stay)."""
    edges = [F.lit(1.0), *exceed, F.lit(0.0)]
    raw = F.array(*(F.least(F.greatest(a - b, F.lit(0.0)), F.lit(1.0)) for a, b in zip(edges, edges[1:])))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(raw, lambda x: x / total)).otherwise(raw)
