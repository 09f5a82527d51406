"""How long ago, and how regularly, a user acted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.rowwise import total
from creditloom.operators.fused import KEY, Measures
from creditloom.spec import FeatureSpec


WORD = 64  # weeks in one long


def _words(spec: FeatureSpec) -> dict[str, int]:
    """The longs that hold the weeks of a window, and the first week of each.

    Their number follows from that of the months, so it is the same for every anchor. Ages round up, hence one week more.
    """
    last = spec.n_months * 31 // 7 + 1
    return {f"_w_bits{k or ''}": k * WORD for k in range(last // WORD + 1)}


def week_bits(spec: FeatureSpec) -> dict[str, Column]:
    """Which weeks before the anchor have events, one bit each: a long of 64 weeks, and as many longs as the window needs."""
    weeks, words = F.col("weeks").cast("int"), _words(spec)
    aggs = {}
    for name, first in words.items():
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), weeks - first)
        # A shift wraps around at 64, so with several longs each takes only its own weeks.
        here = bit if len(words) == 1 else F.when(weeks.between(first, first + WORD - 1), bit)
        aggs[name] = F.bit_or(here)
    return aggs


def distinct_weeks(spec: FeatureSpec) -> Column:
    """Number of weeks with events, from the merged bits."""
    return total([F.coalesce(F.bit_count(F.col(name)), F.lit(0)) for name in _words(spec)])


def gap_measures(action: str, spec: FeatureSpec, per_event: bool) -> Measures:
    """Weeks since the last event, mean gap between events, and how far it is exceeded.

    ``per_event`` divides by the number of events; otherwise by distinct weeks.
    Distinct weeks are collected as bits of longs, which combine before the shuffle
    like a sum does, whereas a distinct count would need a second exchange.
    """
    aggs = {"_w_min": F.min("weeks"), "_w_max": F.max("weeks")}
    if per_event:
        aggs["_n"] = F.count("*")
        n = F.col("_n")
    else:
        aggs |= week_bits(spec)
        n = distinct_weeks(spec)
    last = F.col("_w_min").cast("double")
    first = F.col("_w_max").cast("double")
    gap = F.when(n == 1, F.lit(float(spec.window_weeks)) - last).otherwise(
        F.try_divide(first - last, (n - 1).cast("double"))
    )
    return Measures(
        aggs,
        {
            f"last_{action}_time": last,
            f"per_{action}_time_interval": gap,
            f"is_exceed_{action}_interval": last - gap,
        },
    )


def last_row(events: DataFrame, order: list[str], key: str = KEY) -> DataFrame:
    """The latest row per key, ties broken by the remaining columns of ``order``."""
    return _edge_row(events, order, F.max, key)


def first_row(events: DataFrame, order: list[str], key: str = KEY) -> DataFrame:
    """The earliest row per key."""
    return _edge_row(events, order, F.min, key)


def _edge_row(events: DataFrame, order: list[str], pick, key: str) -> DataFrame:
    # A maximum of structs combines before the shuffle; ranking rows would sort a whole key in one task.
    row: Column = F.struct(*[F.col(c) for c in order])
    return events.groupBy(key).agg(pick(row).alias("_row")).select(key, "_row.*")
