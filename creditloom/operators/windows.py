"""Sums and counts over slots of time, as conditional aggregates of one grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.clock import BUCKET_NAMES
from creditloom.functions.money import encode
from creditloom.functions.rowwise import spread
from creditloom.operators.fused import KEY, Measures
from creditloom.spec import FeatureSpec


def month_sums(value: str, tag: str, spec: FeatureSpec) -> Measures:
    """Per observation month: the sum of ``value`` (SQL text) and the number of events."""
    aggs = {}
    for k in spec.slots:
        aggs[f"_{tag}_m{k}"] = F.expr(f"sum(if(slot = {k}, {value}, null))")
        aggs[f"_n_m{k}"] = F.expr(f"count_if(slot = {k})")
    return Measures(aggs)


def present_months(tag: str, spec: FeatureSpec) -> list[Column]:
    """Monthly sums, NULL for months without any event."""
    return [F.expr(f"if(_n_m{k} > 0, coalesce(_{tag}_m{k}, 0D), null)") for k in spec.slots]


def filled_months(tag: str, spec: FeatureSpec) -> list[Column]:
    """Monthly sums, 0 for months without any event."""
    return [F.expr(f"coalesce(_{tag}_m{k}, 0D)") for k in spec.slots]


def hour_counts(value: str) -> Measures:
    """Number of non-null values per four-hour bucket."""
    return Measures({f"_h_{b}": F.expr(f"count(if(bucket = '{b}', {value}, null))") for b in BUCKET_NAMES})


def cumulative_periods(value: str, prefix: str, spec: FeatureSpec) -> Measures:
    """Encoded sums over the last D days, for every period D: one grouping, not one per period."""
    aggs = {f"_{prefix}_p{d}": F.expr(f"sum(if(days <= {d}, {value}, null))") for d in spec.periods}
    outs = {f"{prefix}_{d}": encode(F.expr(f"coalesce(_{prefix}_p{d}, 0D)")) for d in spec.periods}
    return Measures(aggs, outs)


def week_sums(value: str, tag: str, spec: FeatureSpec) -> Measures:
    """Sums over the disjoint weeks before the anchor. The first one is open towards day 0."""
    aggs, inside = {}, ""
    for k, end in enumerate(spec.week_ends, start=1):
        aggs[f"_{tag}_w{k}"] = F.expr(f"sum(if({inside}days <= {end}, {value}, null))")
        inside = f"days > {end} and "
    return Measures(aggs)


def filled_weeks(tag: str, spec: FeatureSpec) -> list[Column]:
    return [F.expr(f"coalesce(_{tag}_w{k}, 0D)") for k in range(1, len(spec.week_ends) + 1)]


def week_spread(tag: str, prefix: str, spec: FeatureSpec) -> dict[str, Column]:
    return spread(prefix, filled_weeks(tag, spec))


STATS = ("min", "mean", "max", "median", "count", "sum", "std")


def disjoint_windows(
    events: DataFrame, value: str, prefix: str, spec: FeatureSpec, keys: tuple[str, ...] = (KEY,), times: str = "1"
) -> DataFrame:
    """Seven statistics in each half-open day window (d1, d2], one wide row per key.

    ``times`` is how many events a row stands for.

    Values are whole money units, so events are first counted per (key, window,
    value): combined before the shuffle, and spread over the cluster even if one
    key owns most events. What is left of a key, at most its distinct amounts per
    window, then moves once by key. Ranks, statistics and the wide row all use that
    partitioning, so no further exchange follows. The median is exact: the middle
    values are found by running counts.
    """
    # Edges ascend, so the first upper edge not exceeded names the window.
    window = F.when(F.col("days") <= spec.day_edges[0], None)
    for high in spec.day_edges[1:]:
        window = window.when(F.col("days") <= high, high)
    counted = (
        events.select(*keys, window.alias("_win"), F.col(value).alias("_v"), F.expr(times).alias("_times"))
        .groupBy(*keys, "_win", "_v")
        .agg(F.sum(F.when(F.col("_v").isNull(), 0).otherwise(F.col("_times"))).cast("double").alias("_n"))
        .repartition(*keys)
    )
    whole = Window.partitionBy(*keys, "_win").orderBy("_v")
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = counted.select(
        "*",
        F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("_n").over(everything).alias("_all"),
        (F.sum(F.col("_v") * F.col("_n")).over(everything) / F.sum("_n").over(everything)).alias("_mean"),
    )
    upto, n, off = F.col("_upto"), F.col("_all"), F.col("_v") - F.col("_mean")

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((upto >= rank) & (upto - F.col("_n") < rank), F.col("_v")))

    per_window = ranked.groupBy(*keys, "_win").agg(
        F.min("_v").alias("min"),
        F.first("_mean").alias("mean"),
        F.max("_v").alias("max"),
        ((at_rank(F.floor((n + 1) / 2)) + at_rank(F.floor(n / 2) + 1)) / 2).alias("median"),
        F.first("_all").alias("count"),
        F.sum(F.col("_v") * F.col("_n")).alias("sum"),
        F.sqrt(F.try_divide(F.sum(off * off * F.col("_n")), F.first(F.when(n > 1, n - 1)))).alias("std"),
    )
    wide = per_window.groupBy(*keys).agg(
        *[
            F.expr(f"coalesce(max(if(_win = {d}, {stat}, null)), 0D) as {prefix}_{d}_{stat}")
            for d in spec.day_edges[1:]
            for stat in STATS
        ]
    )
    return wide
