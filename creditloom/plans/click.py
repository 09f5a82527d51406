"""Click behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.clock import weekly_weight
from creditloom.functions.rowwise import present_stats
from creditloom.operators.fused import Measures, summarise
from creditloom.operators.recency import gap_measures
from creditloom.operators.windows import month_sums, present_months
from creditloom.plans.events import click_events
from creditloom.plans.loan import hour_shares
from creditloom.sources.tables import Tables
from creditloom.spec import FeatureSpec

STATS = ("min", "mean", "max", "std", "median", "count", "sum")


def weights() -> Measures:
    return Measures({"click_weights": F.sum(weekly_weight("weeks"))}, {"click_weights": F.col("click_weights")})


def value_shares(spec: FeatureSpec) -> Measures:
    """Smoothed share of each page and parameter among the user's clicks."""
    aggs, outs = {"_n": F.count("*")}, {}
    for col, vocabulary in (("pid", spec.pids), ("param", spec.params)):
        for v in vocabulary:
            aggs[f"_{col}_{v}"] = F.expr(f"count_if({col} = {v})")
            outs[f"{col}_{v}"] = F.expr(f"_{col}_{v} / (_n + 1D)")
    return Measures(aggs, outs)


def month_stats(spec: FeatureSpec) -> Measures:
    stats = present_stats(present_months("clicks", spec))
    return month_sums("1D", "clicks", spec) | {f"click_{s}": stats[s] for s in STATS}


def click_measures(spec: FeatureSpec) -> list[Measures]:
    return [
        weights(),
        value_shares(spec),
        month_stats(spec),
        hour_shares("click", "click_time"),
        gap_measures("click", spec, per_event=False),
    ]


def click_features(tables: Tables, spec: FeatureSpec) -> DataFrame:
    return summarise(click_events(tables, spec), *click_measures(spec))
