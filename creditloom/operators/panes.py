"""Panes: what events add up to per user and day, computed once and rolled up into the windows of any number of anchors.

A pane is a row of partial aggregates of one user, day and month. Panes are stored; a build for several anchors reads them
instead of the events. Every pane goes to the anchors in whose window its month lies, which are at most as many as windows overlap
on a day, and there its day becomes the distance to the anchor. Sums, counts, minima, maxima and bit sets of events are the same of
panes, so a window's aggregates are those of a single build.

Elapsed days are whole days between an event and the anchor's midnight. So the pane of a time is the midnight at or after it,
which is the day after for all but events at midnight, and the calendar month is part of the key.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.clock import weeks_of
from creditloom.operators.fused import KEY
from creditloom.spec import FeatureSpec

ANCHOR = "anchor"
_EPOCH = date(1970, 1, 1)


def pane_of(t: str, is_date: bool) -> Column:
    """Days from the epoch to the midnight at or after a time, or to a date."""
    if is_date:
        return F.unix_date(t).cast("bigint")
    return F.ceil(F.unix_timestamp(t) / F.lit(86400.0)).cast("bigint")


def month_number(t: str) -> Column:
    return (F.year(t) * 12 + F.month(t) - 1).cast("int")


def panes(events: DataFrame, time: str, partials: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Partial aggregates per user, day, month and further key columns of the events; one grouping, combined before its shuffle."""
    kind = dict(events.dtypes)[time]
    placed = events.withColumns({"pane": pane_of(time, kind == "date"), "month": month_number(time)})
    return placed.groupBy(KEY, "pane", "month", *by).agg(*[c.alias(n) for n, c in partials.items()])


def _number(day: date) -> int:
    return day.year * 12 + day.month - 1


def check_specs(specs: list[FeatureSpec]) -> None:
    """Anchors that go into one build differ in time only, and each comes once."""
    first = specs[0]
    shape = ("n_months", "day_edges", "sexes", "plannums", "pids", "params", "amount_band")
    for spec in specs[1:]:
        if any(getattr(spec, name) != getattr(first, name) for name in shape):
            raise ValueError("anchors of one build have the same columns")
    if len({s.anchor for s in specs}) < len(specs):
        raise ValueError("an anchor comes once")


def at_anchors(rows: DataFrame, specs: list[FeatureSpec], month: str | None = None) -> DataFrame:
    """Rows once for each anchor, or for each whose window has the month in column ``month``.

    Adds anchor, _anchor_day, _last_month (the number of the last observed month) and _first_month.
    """
    found = F.array(
        *[
            F.struct(
                F.lit(s.anchor).alias(ANCHOR),
                F.lit((s.anchor - _EPOCH).days).cast("bigint").alias("_anchor_day"),
                F.lit(_number(s.last_month_start)).alias("_last_month"),
                F.lit(_number(s.start)).alias("_first_month"),
            )
            for s in specs
        ]
    )
    if month:
        inside = lambda a: (F.col(month) >= a["_first_month"]) & (F.col(month) <= a["_last_month"])
        first, last = min(_number(s.start) for s in specs), max(_number(s.last_month_start) for s in specs)
        # The range of all windows reaches the scan of the stored panes.
        rows, found = rows.where(F.col(month).between(first, last)), F.filter(found, inside)
    return rows.withColumn("_at", F.explode(found)).select(*rows.columns, "_at.*")


def rolled_out(stored: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    """Panes at every anchor in whose window they lie, with slot, days and weeks as events have them."""
    placed = at_anchors(stored, specs, "month").withColumns(
        {"slot": F.col("month") - F.col("_first_month") + 1, "days": F.col("_anchor_day") - F.col("pane")}
    )
    return placed.withColumn("weeks", weeks_of("days"))


def by_anchor(of_spec: list[tuple[date, dict[str, Column]]]) -> dict[str, Column]:
    """Named expressions that may differ between anchors, as expressions of the anchor column."""
    out: dict[str, Column] = {}
    for name in of_spec[0][1]:
        each = [(anchor, exprs[name]) for anchor, exprs in of_spec]
        if len({str(c) for _, c in each}) == 1:
            out[name] = each[0][1]
            continue
        chosen = F.lit(None)
        for anchor, expr in each:
            chosen = F.when(F.col(ANCHOR) == F.lit(anchor), expr).otherwise(chosen)
        out[name] = chosen
    return out
