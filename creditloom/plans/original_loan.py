"""Loan behaviour, original variant: counts instead of shares, zero-filled months, hyperbolic decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.clock import BUCKET_NAMES, hyperbolic_weight
from creditloom.functions.coding import at_least_zero
from creditloom.functions.rowwise import spread, total, zero
from creditloom.operators.fused import KEY, Measures, summarise
from creditloom.operators.windows import (
    cumulative_periods,
    filled_months,
    filled_weeks,
    hour_counts,
    month_sums,
    week_spread,
    week_sums,
)
from creditloom.plans.events import loan_events
from creditloom.plans.loan import month_sets, plannum_counts, set_name
from creditloom.plans.user import original_user_features
from creditloom.sources.tables import Tables
from creditloom.spec import FeatureSpec


def totals(spec: FeatureSpec) -> Measures:
    weight = hyperbolic_weight("days", spec.loan_scale_days, 1.0, spec.epsilon)
    names = ("loan_amount", "plannum", "loanTime_weights", "loan_weights", "repay")
    aggs = {
        "loan_amount": F.sum("amount"),
        "plannum": F.sum(F.col("plannum").cast("double")),
        "loanTime_weights": F.sum(weight),
        "loan_weights": F.sum(F.col("amount") * weight),
        "repay": F.sum("due"),
    }
    return Measures(aggs, {n: F.col(n) for n in names})


def loan_counts(spec: FeatureSpec) -> Measures:
    """Number of loans, and whether a set of months has exactly one loan per month in total."""
    count = {k: F.col(f"_n_m{k}") for k in spec.slots}
    outs: dict[str, Column] = {"loan_months": total(list(count.values())).cast("double")}
    for months in month_sets(spec):
        hit = total([count[k] for k in months]) == len(months)
        outs[set_name(months)] = F.when(hit, 1.0).otherwise(0.0)
    return month_sums("amount", "amt", spec) | outs


def ratios(spec: FeatureSpec) -> dict[str, Column]:
    n = total([F.col(f"_n_m{k}") for k in spec.slots])
    return {
        "per_plannum": F.try_divide(F.col("plannum"), n),
        "per_times_loan": F.try_divide(F.col("loan_amount"), n),
    }


def month_spread(spec: FeatureSpec) -> Measures:
    return month_sums("amount", "amt", spec) | spread("loan", filled_months("amt", spec))


def plannum_spread(spec: FeatureSpec) -> Measures:
    counts = {f"plannum_{v:02d}": F.col(f"_plan_{v:02d}").cast("double") for v in spec.plannums}
    return plannum_counts(spec) | {**counts, **spread("plannum", list(counts.values()))}


def hours() -> Measures:
    return hour_counts("amount") | {
        f"loan_hours_{b}": F.col(f"_h_{b}").cast("double") for b in BUCKET_NAMES
    }


def loan_measures(spec: FeatureSpec) -> list[Measures]:
    return [
        totals(spec),
        loan_counts(spec),
        Measures({}, ratios(spec)),
        month_spread(spec),
        plannum_spread(spec),
        hours(),
    ]


def over_limit_flag(limit: Column) -> Column:
    """Whether the mean loan reaches the limit; no limit counts as no."""
    return at_least_zero(F.col("per_times_loan") - limit)


def original_loan_core(tables: Tables, spec: FeatureSpec) -> DataFrame:
    loans = loan_events(tables, spec, rounded=spec.round_original_loans)
    return summarise(loans, *loan_measures(spec))


def original_loan_features(tables: Tables, spec: FeatureSpec) -> DataFrame:
    core = original_loan_core(tables, spec)
    limits = original_user_features(tables, spec).select(KEY, "limit")
    flagged = core.join(limits, KEY, "left").withColumn("exceed_loan", over_limit_flag(F.col("limit")))
    names = [c for c in core.columns if c != KEY]
    at = names.index("per_times_loan") + 1
    names.insert(at, "exceed_loan")
    return flagged.select(KEY, *[zero(F.col(c)).alias(c) for c in names])


def period_measures(spec: FeatureSpec) -> list[Measures]:
    """Sums over cumulative periods and disjoint weeks, of whole money units."""
    amount = "rint(amount)"
    weeks = week_sums(amount, "loan", spec)
    named = {f"loan_filter_week{k}": c for k, c in enumerate(filled_weeks("loan", spec), start=1)}
    return [
        cumulative_periods(amount, "loan", spec),
        weeks | {**named, **week_spread("loan", "filter_loan", spec)},
    ]


def original_loan_periods(tables: Tables, spec: FeatureSpec) -> DataFrame:
    return summarise(loan_events(tables, spec), *period_measures(spec))
