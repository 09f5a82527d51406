"""Matrices of several anchors from one pass over each table.

``open_panes`` scans loans, clicks and purchases once and stores their panes. ``anchored_matrix`` rolls them up into one row per
user and anchor. The feature columns are those of the single builds: only the aggregates they are made of are written here a
second time, as aggregates of panes, and ``_rolled`` makes sure that none is missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import clock
from creditloom.functions.clock import BUCKET_NAMES, weekly_weight
from creditloom.functions.money import decode_rounded
from creditloom.operators.fused import KEY, Measures, by_key, fill_zero, outer_merge
from creditloom.operators.panes import ANCHOR, at_anchors, by_anchor, check_specs, panes, rolled_out
from creditloom.operators.recency import week_bits
from creditloom.operators.windows import disjoint_windows
from creditloom.plans.click import click_measures
from creditloom.plans.events import priced
from creditloom.plans.loan import finished, loan_measures
from creditloom.plans.order import order_measures
from creditloom.plans.user import attributes
from creditloom.session import fresh_path
from creditloom.sources.sinks import materialize
from creditloom.sources.tables import Tables
from creditloom.spec import FeatureSpec

KEYS = (KEY, ANCHOR)


@dataclass(frozen=True)
class Panes:
    """Stored panes of the event tables, and the users they belong to."""

    user: DataFrame
    loan: DataFrame
    click: DataFrame
    order: DataFrame


def loan_panes(loans: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Loans per user, day and whole amount, so that medians can be read off the counts."""
    decoded = loans.select(
        KEY,
        "loan_time",
        "plannum",
        decode_rounded("loan_amount").alias("amount"),
        clock.hour_bucket("loan_time").alias("bucket"),
    )
    due = F.try_divide(F.col("amount"), F.col("plannum").cast("double"))
    at_once = F.coalesce(F.col("plannum") == 1, F.lit(False))
    partials = {
        "n": F.count("*"),
        "plannum": F.sum(F.col("plannum").cast("double")),
        "at_once": F.count_if(at_once),
        "due_at_once": F.sum(F.when(at_once, due)),
        "due_later": F.sum(F.when(~at_once, due)),
        **{f"h_{b}": F.expr(f"count(if(bucket = '{b}', amount, null))") for b in BUCKET_NAMES},
        **{f"plan_{v:02d}": F.expr(f"count(if(plannum = {v}, amount, null))") for v in spec.plannums},
    }
    return panes(decoded, "loan_time", partials, by=("amount",))


def click_panes(clicks: DataFrame) -> DataFrame:
    """Clicks per user, day, four-hour bucket, page and parameter: narrow rows, whatever the vocabularies."""
    placed = clicks.select(KEY, "click_time", "pid", "param", clock.hour_bucket("click_time").alias("bucket"))
    return panes(placed, "click_time", {"n": F.count("*")}, by=("bucket", "pid", "param"))


def order_panes(orders: DataFrame) -> DataFrame:
    partials = {"n": F.count("*"), "paid": F.sum("paid"), "saved": F.sum("saved")}
    return panes(priced(orders, filled=True), "buy_time", partials)


def open_panes(tables: Tables, spec: FeatureSpec, path: str | None = None) -> Panes:
    """Compute and store the panes of all events, or read those stored below ``path``. ``spec`` gives the vocabularies."""
    spark = tables.loan.sparkSession
    base = path or fresh_path(spark, "panes")
    return Panes(
        tables.user,
        materialize(spark, lambda: loan_panes(tables.loan, spec), f"{base}/loan"),
        materialize(spark, lambda: click_panes(tables.click), f"{base}/click"),
        materialize(spark, lambda: order_panes(tables.order), f"{base}/order"),
    )


def _slots(spec: FeatureSpec, value: str, tag: str) -> dict[str, Column]:
    sums = {f"_{tag}_m{k}": F.expr(f"sum(if(slot = {k}, {value}, null))") for k in spec.slots}
    return sums | {f"_n_m{k}": F.expr(f"sum(if(slot = {k}, n, 0))") for k in spec.slots}


def _distances(spec: FeatureSpec) -> dict[str, Column]:
    return {"_n": F.sum("n"), "_w_min": F.min("weeks"), "_w_max": F.max("weeks"), **week_bits(spec)}


def _loan_aggs(spec: FeatureSpec) -> dict[str, Column]:
    worth = F.col("amount") * F.col("n")
    # An instalment paid at once before the last observed month is not due any more.
    repaid = (F.col("month") < F.col("_last_month")) & (F.col("at_once") > 0)
    at_once, later = F.sum(F.when(repaid, 0.0).otherwise(F.col("due_at_once"))), F.sum("due_later")
    return {
        **_distances(spec),
        **_slots(spec, "amount * n", "amt"),
        "loan_amount": F.sum(worth),
        "plannum": F.sum("plannum"),
        "loan_weights": F.sum(worth * weekly_weight("weeks")),
        "repay": F.coalesce(at_once + later, at_once, later),
        "_largest": F.max("amount"),
        **{f"_h_{b}": F.sum(f"h_{b}") for b in BUCKET_NAMES},
        **{f"_plan_{v:02d}": F.sum(f"plan_{v:02d}") for v in spec.plannums},
    }


def _click_aggs(spec: FeatureSpec) -> dict[str, Column]:
    counts = {f"_h_{b}": F.expr(f"sum(if(bucket = '{b}', n, 0))") for b in BUCKET_NAMES}
    for name, vocabulary in (("pid", spec.pids), ("param", spec.params)):
        counts |= {f"_{name}_{v}": F.expr(f"sum(if({name} = {v}, n, 0))") for v in vocabulary}
    weights = F.sum(F.col("n") * weekly_weight("weeks"))
    return {**_distances(spec), **_slots(spec, "n * 1D", "clicks"), "click_weights": weights, **counts}


def _order_aggs(spec: FeatureSpec) -> dict[str, Column]:
    weight = weekly_weight("weeks")
    return {
        **_distances(spec),
        **_slots(spec, "paid", "paid"),
        "buy_weights": F.sum(F.col("n") * weight),
        "cost_weight": F.sum(F.col("paid") * weight),
        "real_price": F.sum("paid"),
        "_saved": F.sum("saved"),
    }


def _rolled(stored: DataFrame, specs: list[FeatureSpec], measures, aggs: dict[str, Column]) -> DataFrame:
    """The feature columns of one table at every anchor: one grouping of its panes."""
    each = [reduce(Measures.__add__, measures(s)) for s in specs]
    if missing := [n for n in each[0].aggs if n not in aggs]:
        raise ValueError(f"no aggregate of panes for {missing}")
    grouped = rolled_out(stored, specs).groupBy(*KEYS).agg(*[aggs[n].alias(n) for n in each[0].aggs])
    outs = by_anchor([(s.anchor, m.outs) for s, m in zip(specs, each)])
    return grouped.select(*KEYS, *[c.alias(n) for n, c in outs.items()])


def anchored_users(user: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    days = F.col("_anchor_day") - F.unix_date("active_date")
    return at_anchors(user, specs).select(*KEYS, *attributes(specs[0], days))


def anchored_matrix(found: Panes, specs: list[FeatureSpec], labels: DataFrame | None = None) -> DataFrame:
    """One row per user and anchor: the columns of the single builds, and ``anchor``.

    ``labels`` has uid, anchor, label; anchors without labels have none, and labels of other anchors add nothing.
    """
    check_specs(specs)
    spec, loans = specs[0], found.loan
    if spec.amount_band:
        low, high = spec.amount_band
        loans = loans.where((F.col("amount") > low) & (F.col("amount") <= high))
    sides = {
        "users": by_key(anchored_users(found.user, specs), *KEYS),
        "loans": _rolled(loans, specs, loan_measures, _loan_aggs(spec)),
        "windows": disjoint_windows(rolled_out(loans, specs), "amount", "loan", spec, KEYS, times="n"),
        "clicks": _rolled(found.click, specs, click_measures, _click_aggs(spec)),
        "orders": fill_zero(_rolled(found.order, specs, order_measures, _order_aggs(spec)), but=KEYS),
    }
    if labels is not None:
        known = labels.where(F.col(ANCHOR).isin([s.anchor for s in specs])).select(*KEYS, "label")
        sides["label"] = by_key(known, *KEYS)
    return finished(outer_merge(sides, *KEYS), spec)
