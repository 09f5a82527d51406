"""Loan behaviour: one grouping of the loans, finished with the user's limit and age of account."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import money
from creditloom.functions.clock import BUCKET_NAMES, weekly_weight
from creditloom.functions.coding import indicator
from creditloom.functions.rowwise import present_stats, shares, total, zero
from creditloom.operators.fused import KEY, Measures, summarise
from creditloom.operators.recency import gap_measures
from creditloom.operators.windows import disjoint_windows, hour_counts, month_sums, present_months
from creditloom.plans.events import loan_events
from creditloom.plans.user import user_features
from creditloom.sources.tables import Tables
from creditloom.spec import FeatureSpec


def month_sets(spec: FeatureSpec) -> list[tuple[int, ...]]:
    """Pairs of observation months, then all of them: 12, 13, 23, 123."""
    return [*combinations(spec.slots, 2), tuple(spec.slots)]


def set_name(months: tuple[int, ...]) -> str:
    return "loan_" + "".join(str(k) for k in months)


def totals() -> Measures:
    amount = F.col("amount")
    aggs = {
        "loan_amount": F.sum(amount),
        "plannum": F.sum(F.col("plannum").cast("double")),
        "_n": F.count("*"),
        "loan_weights": F.sum(amount * weekly_weight("weeks")),
        "repay": F.sum("due"),
    }
    outs = {"loan_times": F.col("_n").cast("double")}
    outs = {n: outs.get(n, F.col(n)) for n in ("loan_amount", "plannum", "loan_times", "loan_weights", "repay")}
    return Measures(aggs, outs)


def active_months(spec: FeatureSpec) -> Measures:
    """Number of months with loans, and whether given months all have some."""
    active = {k: F.col(f"_n_m{k}") > 0 for k in spec.slots}
    months = total([indicator(a) for a in active.values()])

    def all_of(ks: tuple[int, ...]) -> Column:
        met = active[ks[0]]
        for k in ks[1:]:
            met = met & active[k]
        return indicator(met)

    outs = {"loan_times_months": months, **{set_name(ks): all_of(ks) for ks in month_sets(spec)}}
    return month_sums("amount", "amt", spec) | outs


def ratios(spec: FeatureSpec) -> dict[str, Column]:
    months = total([indicator(F.col(f"_n_m{k}") > 0) for k in spec.slots])
    return {
        "per_plannum_loan": F.try_divide(F.col("loan_amount"), F.col("plannum")),
        "per_times_loan": F.try_divide(F.col("loan_amount"), months),
    }


def month_stats(spec: FeatureSpec) -> Measures:
    stats = present_stats(present_months("amt", spec))
    outs = {f"loan_{s}": stats[s] for s in ("min", "mean", "median", "max", "std")}
    return month_sums("amount", "amt", spec) | outs


def plannum_counts(spec: FeatureSpec) -> Measures:
    return Measures(
        {f"_plan_{v:02d}": F.count(F.when(F.col("plannum") == v, F.col("amount"))) for v in spec.plannums}
    )


def plannum_shares(spec: FeatureSpec) -> Measures:
    counts = {f"plannum_{v:02d}": F.col(f"_plan_{v:02d}") for v in spec.plannums}
    return plannum_counts(spec) | {
        **shares(counts),
        "plannum_sum": total(list(counts.values())).cast("double"),
    }


def hour_shares(action: str, value: str) -> Measures:
    counts = {f"{action}_hours_{b}": F.col(f"_h_{b}") for b in BUCKET_NAMES}
    return hour_counts(value) | shares(counts)


def user_dependent(spec: FeatureSpec) -> Measures:
    """Aggregates kept for the columns that also need the user's row."""
    months = month_sums("amount", "amt", spec)
    aggs = {**months.aggs, "_w_max": F.max("weeks"), "_largest": F.max("amount")}
    outs = {f"_month_{k}": zero(F.col(f"_amt_m{k}")) for k in spec.slots}
    return Measures(aggs, {**outs, "_w_max": F.col("_w_max"), "_largest": F.col("_largest")})


def finish(spec: FeatureSpec) -> dict[str, Column]:
    """Columns from loan aggregates and user attributes in one row.

    All are NULL for users without loans, whose aggregates are NULL.
    """
    limit = F.col("limit")
    return {
        "active_loan_interval": F.col("a_date") - F.col("_w_max"),
        **{f"exceed_loan_{k}": money.over_limit(F.col(f"_month_{k}"), limit) for k in spec.slots},
        "new_limit": F.when(F.col("_largest").isNotNull(), money.raised_limit(limit, F.col("_largest"))),
    }


def loan_measures(spec: FeatureSpec) -> list[Measures]:
    return [
        totals(),
        active_months(spec),
        Measures({}, ratios(spec)),
        month_stats(spec),
        plannum_shares(spec),
        hour_shares("loan", "amount"),
        gap_measures("loan", spec, per_event=True),
        user_dependent(spec),
    ]


def loan_core(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Loan features short of the user-dependent ones; one scan and one shuffle."""
    return summarise(loan_events(tables, spec), *loan_measures(spec))


def finished(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Add the user-dependent columns behind the other loan columns and drop the helpers."""
    extra = finish(spec)
    kept = [c for c in df.columns if not c.startswith("_")]
    at = kept.index("is_exceed_loan_interval") + 1
    return df.select(*kept[:at], *[c.alias(n) for n, c in extra.items()], *kept[at:])


def loan_features(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """All loan features, one row per borrower."""
    users = user_features(tables, spec).select(KEY, "limit", "a_date")
    full = finished(loan_core(tables, spec).join(users, KEY, "left"), spec)
    return full.drop("limit", "a_date")


def loan_window_features(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Statistics of loan amounts in disjoint day windows."""
    return disjoint_windows(loan_events(tables, spec), "amount", "loan", spec)
