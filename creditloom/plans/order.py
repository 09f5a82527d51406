"""Purchase behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.clock import weekly_weight
from creditloom.functions.money import discount_rate
from creditloom.functions.rowwise import present_stats
from creditloom.operators.fused import Measures, fill_zero, summarise
from creditloom.operators.recency import gap_measures
from creditloom.operators.windows import month_sums, present_months
from creditloom.plans.events import order_events
from creditloom.sources.tables import Tables
from creditloom.spec import FeatureSpec

STATS = ("min", "mean", "max", "std", "median", "count", "sum")


def totals() -> Measures:
    w = weekly_weight("weeks")
    aggs = {
        "buy_weights": F.sum(w),
        "cost_weight": F.sum(F.col("paid") * w),
        "real_price": F.sum("paid"),
        "_saved": F.sum("saved"),
    }
    return Measures(
        aggs,
        {
            **{n: F.col(n) for n in ("buy_weights", "cost_weight", "real_price")},
            "dis_ratio": discount_rate("_saved", "real_price"),
        },
    )


def month_stats(spec: FeatureSpec) -> Measures:
    stats = present_stats(present_months("paid", spec))
    return month_sums("paid", "paid", spec) | {f"price_{s}": stats[s] for s in STATS}


def order_measures(spec: FeatureSpec) -> list[Measures]:
    return [totals(), month_stats(spec), gap_measures("order", spec, per_event=False)]


def order_features(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """All purchase features; missing ones are 0."""
    return fill_zero(summarise(order_events(tables, spec), *order_measures(spec)))
