"""Time before the anchor, hours of the day and recency weights."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.spec import FeatureSpec

# Name suffix of the four-hour bucket starting at 0, 4, 8, 12, 16, 20 o'clock.
HOUR_BUCKETS = ("06", "05", "01", "02", "03", "04")
BUCKET_NAMES = tuple(sorted(HOUR_BUCKETS))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_of(t: Column | str) -> Column:
    return F.month(_col(t))


def hour_of(t: Column | str) -> Column:
    return F.hour(_col(t))


def hour_bucket(t: Column | str) -> Column:
    """Two-digit name of the four-hour bucket an event falls in."""
    names = F.array(*[F.lit(name) for name in HOUR_BUCKETS])
    return F.get(names, F.floor(hour_of(t) / 4).cast("int"))


def age_days(t: Column | str, anchor: date) -> Column:
    """Whole days from a timestamp to the anchor: elapsed seconds, floored.

    ``datediff`` would count calendar boundaries and be one day too high for any
    time of day past midnight.
    """
    elapsed = F.unix_timestamp(F.lit(anchor).cast("timestamp")) - F.unix_timestamp(_col(t))
    return F.floor(elapsed / F.lit(86400.0))


def age_days_of_date(d: Column | str, anchor: date) -> Column:
    """Whole days from a date to the anchor."""
    return F.datediff(F.lit(anchor), _col(d)).cast("bigint")


def weeks_of(days: Column | str) -> Column:
    """Days rounded to weeks. Seven does not halve, so there are no ties."""
    return F.rint(_col(days) / F.lit(7.0)).cast("bigint")


def fractional_weeks(days: Column | str) -> Column:
    return _col(days) / F.lit(7.0)


def weekly_weight(weeks: Column | str) -> Column:
    """Recency weight 1 / (1 + weeks)."""
    return F.lit(1.0) / (_col(weeks) + F.lit(1.0))


def hyperbolic_weight(
    days: Column | str, scale: float = 1.0, numerator: float = 1.0, epsilon: float = 1e-6
) -> Column:
    """Recency weight numerator / (epsilon + days / scale)."""
    return F.lit(numerator) / (F.lit(epsilon) + _col(days) / F.lit(scale))


def month_slot(t: Column | str, spec: FeatureSpec) -> Column:
    """Position of the observation month an event falls in; NULL outside the window."""
    t = _col(t)
    starts = spec.month_starts
    slot = F.when(t < F.lit(starts[0]), None)
    for k, end in zip(spec.slots, starts[1:]):
        slot = slot.when(t < F.lit(end), k)
    return slot


def between(t: Column | str, start: date, end: date) -> Column:
    t = _col(t)
    return (t >= F.lit(start)) & (t < F.lit(end))
