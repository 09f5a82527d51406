from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from conftest import plan_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditloom.operators import cohorts
from creditloom.plans import click, cross, loan, order
from creditloom.sources.monotone import Retimed
from creditloom.sources.retimed import OF_EVENTS, OF_ORDERS, open_tables
from creditloom.spec import TRAIN

SF = "/root/testdata/sf0.001"
EPOCH = datetime(1970, 1, 1)


def computed(r: Retimed, second: int) -> int:
    product = (second - r.origin) * r.stretch
    return r.base + (product // r.squeeze if product >= 0 else -(-product // r.squeeze))


@settings(max_examples=400, deadline=None)
@given(
    st.integers(-40, 40), st.integers(-(10**6), 10**6), st.integers(-(10**6), 10**6), st.integers(1, 100_000), st.integers(1, 100_000)
)
def test_the_least_stored_time_is_the_first_in_the_window(days, base, origin, squeeze, stretch):
    r, day = Retimed(base, origin, squeeze, stretch), date(1970, 1, 1) + timedelta(days=days)
    least, wanted = r.least_second(day), days * 86400
    assert computed(r, least) >= wanted > computed(r, least - 1)


def test_ranges_beyond_all_times_are_open():
    far = Retimed(0, 0, squeeze=10**7)
    assert far.least(date(2020, 1, 1)) == datetime.max and far.least(date(1960, 1, 1)) == datetime.min
    assert Retimed(0, 0).least(date(2020, 1, 1)) == EPOCH + timedelta(days=18262)


def test_factors_that_turn_time_back_are_refused():
    with pytest.raises(ValueError):
        Retimed(0, 0, squeeze=-5)


@pytest.mark.parametrize("retimed", [OF_ORDERS, OF_EVENTS])
def test_computed_times_and_their_ranges_agree(spark, retimed):
    borders = [retimed.least(date(2016, m, 1)) for m in (6, 8, 9, 11)]
    times = [b + timedelta(microseconds=d) for b in borders for d in (-1_000_001, -1_000_000, -1, 0, 1, 999_999, 1_000_000)]
    rows = spark.createDataFrame([(str(t),) for t in times] + [(None,)], "s string").select(F.expr("cast(s as timestamp_ntz) t"))
    placed = rows.withColumn("at", retimed.of("t"))
    for start, end in ((date(2016, 6, 1), date(2016, 8, 1)), (date(2016, 8, 1), date(2016, 11, 1)), (date(2016, 9, 1), date(2016, 9, 1))):
        want = placed.where((F.col("at") >= F.lit(start)) & (F.col("at") < F.lit(end)))
        assert sorted(r.t for r in retimed.within(rows, "t", start, end).collect()) == sorted(r.t for r in want.collect())


def test_opening_a_range_changes_no_event(spark):
    t = open_tables(spark, SF)
    whole = replace(t, ranged={})
    for name in ("loan", "click", "order"):
        for start, end in ((date(2016, 8, 1), date(2016, 11, 1)), (date(2016, 10, 1), date(2016, 12, 1)), (date(2015, 1, 1), date(2030, 1, 1))):
            a, b = t.during(name, start, end), whole.during(name, start, end)
            assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize(
    "build, column",
    [
        (lambda t: loan.loan_features(t, TRAIN), "o_orderdate"),
        (lambda t: loan.loan_window_features(t, TRAIN), "o_orderdate"),
        (lambda t: click.click_features(t, TRAIN), "ts"),
        (lambda t: order.order_features(t, TRAIN), "l_shipdate"),
        (lambda t: cross.union_features(t, TRAIN), "ts"),
        (lambda t: cohorts.cohorts(t, TRAIN), "o_orderdate"),
        (lambda t: t.loan_sum, "o_orderdate"),
    ],
)
def test_windows_on_computed_times_reach_the_scan(spark, build, column):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = plan_of(build(open_tables(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line and f"GreaterThanOrEqual({column}," in line]
    assert pushed and all(f"LessThan({column}," in line for line in pushed)


def test_tables_with_stored_times_filter_them_as_they_are(tables):
    plan = plan_of(tables.during("loan", date(2016, 8, 1), date(2016, 11, 1)))
    assert "loan_time" in plan and tables.during("loan", date(2016, 8, 1), date(2016, 11, 1)).count() == 7
