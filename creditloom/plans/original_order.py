"""Purchase behaviour, original variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.clock import hyperbolic_weight
from creditloom.functions.money import discount_rate
from creditloom.functions.rowwise import spread, zero
from creditloom.operators.fused import Measures, summarise
from creditloom.operators.windows import cumulative_periods, filled_months, month_sums
from creditloom.plans.events import order_events
from creditloom.sources.tables import Tables
from creditloom.spec import FeatureSpec


def totals(spec: FeatureSpec) -> Measures:
    w = hyperbolic_weight("days", 1.0, spec.order_numerator, spec.epsilon)
    aggs = {
        "buy_weights": F.sum(w),
        "cost_weight": F.sum(F.col("paid") * w),
        "real_price": F.sum("paid"),
        "_saved": F.sum("saved"),
    }
    outs = {n: zero(F.col(n)) for n in ("buy_weights", "cost_weight", "real_price")}
    return Measures(aggs, {**outs, "dis_ratio": discount_rate("_saved", "real_price")})


def month_spread(spec: FeatureSpec) -> Measures:
    return month_sums("paid", "paid", spec) | spread("buy", filled_months("paid", spec))


def order_measures(spec: FeatureSpec) -> list[Measures]:
    return [totals(spec), month_spread(spec)]


def period_measures(spec: FeatureSpec) -> list[Measures]:
    return [cumulative_periods("paid", "order", spec)]


def original_order_features(tables: Tables, spec: FeatureSpec) -> DataFrame:
    return summarise(order_events(tables, spec, filled=False), *order_measures(spec))


def original_order_periods(tables: Tables, spec: FeatureSpec) -> DataFrame:
    return summarise(order_events(tables, spec, filled=False), *period_measures(spec))
