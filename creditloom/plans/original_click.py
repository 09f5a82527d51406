"""Click behaviour, original variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.clock import BUCKET_NAMES, hyperbolic_weight
from creditloom.functions.money import encode
from creditloom.functions.rowwise import spread
from creditloom.operators.fused import Measures, summarise
from creditloom.operators.windows import cumulative_periods, filled_months, hour_counts, month_sums
from creditloom.plans.events import click_events
from creditloom.sources.tables import Tables
from creditloom.spec import FeatureSpec


def decayed_values(spec: FeatureSpec) -> Measures:
    """Recency-weighted sums per page and parameter."""
    aggs = {"click_weights": F.sum("weight")}
    for col, vocabulary in (("pid", spec.pids), ("param", spec.params)):
        for v in vocabulary:
            aggs[f"{col}_{v}"] = F.expr(f"sum(if({col} = {v}, weight, 0D))")
    return Measures(aggs, {n: F.col(n) for n in aggs})


def month_spread(spec: FeatureSpec) -> Measures:
    stats = spread("click", filled_months("clicks", spec))
    order = ("min", "max", "mean", "sum", "std")
    return month_sums("1D", "clicks", spec) | {f"click_{s}": stats[f"click_{s}"] for s in order}


def hours() -> Measures:
    return hour_counts("click_time") | {
        f"click_hours_{b}": encode(F.col(f"_h_{b}")) for b in BUCKET_NAMES
    }


def click_measures(spec: FeatureSpec) -> list[Measures]:
    return [decayed_values(spec), month_spread(spec), hours()]


def period_measures(spec: FeatureSpec) -> list[Measures]:
    return [cumulative_periods("1D", "click", spec)]


def weighted_clicks(tables: Tables, spec: FeatureSpec) -> DataFrame:
    weight = hyperbolic_weight("days", 1.0, 1.0, spec.epsilon)
    return click_events(tables, spec).withColumn("weight", weight)


def original_click_features(tables: Tables, spec: FeatureSpec) -> DataFrame:
    return summarise(weighted_clicks(tables, spec), *click_measures(spec))


def original_click_periods(tables: Tables, spec: FeatureSpec) -> DataFrame:
    return summarise(click_events(tables, spec), *period_measures(spec))
