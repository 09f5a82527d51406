"""Hand-computed answers for the traps of time, nulls and counting."""

from statistics import stdev

import pytest
from conftest import by_uid
from pyspark.sql import functions as F

from creditloom import SCORE, TRAIN
from creditloom.functions import clock, coding, money, rowwise
from creditloom.operators import cohorts, recency, windows
from creditloom.operators.fused import summarise
from creditloom.plans import click, cross, loan, matrix, order, original_loan, original_matrix, original_order, user
from creditloom.plans.events import click_events, loan_events, order_events


def close(row, **want):
    for name, value in want.items():
        got = row[name]
        assert got is None if value is None else got == pytest.approx(value, abs=1e-4), (name, got, value)


def test_rounded_decode_is_half_even(spark):
    df = spark.createDataFrame([(1.5,)], "x double")
    assert df.select(money.decode_rounded("x")).first()[0] == 10
    ties = spark.sql("select rint(2.5D) a, rint(3.5D) b").first()
    assert (ties.a, ties.b) == (2, 4)


def test_encode_is_null_at_minus_one(spark):
    df = spark.createDataFrame([(-1.0,), (24.0,)], "x double")
    assert [r[0] for r in df.select(money.encode("x")).collect()] == [None, pytest.approx(2.0)]


def test_loan_times(tables):
    rows = loan_events(tables, TRAIN).orderBy("uid", "loan_time").select("days", "weeks", "bucket").collect()
    assert [tuple(r) for r in rows] == [
        (82, 12, "01"), (46, 7, "04"), (0, 0, "02"), (29, 4, "06"), (90, 13, "05"), (89, 13, "05"), (58, 8, "05"),
    ]


def test_age_of_events_after_the_anchor_is_floored(spark):
    df = spark.sql("select timestamp'2016-11-01 00:00:01' t")
    assert df.select(clock.age_days("t", TRAIN.anchor)).first()[0] == -1


def test_loan_features(tables):
    got = by_uid(loan.loan_features(tables, TRAIN))
    assert set(got) == {1, 2, 3}
    close(got[1], loan_amount=3872, plannum=10, loan_times=3, loan_weights=562.5, repay=1062, loan_times_months=3,
          loan_12=1, loan_13=1, loan_23=1, loan_123=1, loan_min=124, loan_mean=1290.6667, loan_median=624,
          loan_max=3124, loan_std=1607.2751, last_loan_time=0, per_loan_time_interval=6,
          is_exceed_loan_interval=-6, per_plannum_loan=387.2, per_times_loan=1290.6667, active_loan_interval=5,
          exceed_loan_1=-2500, exceed_loan_2=0, exceed_loan_3=-3000, new_limit=3124)
    close(got[2], loan_amount=624, loan_weights=124.8, repay=52, loan_std=None, loan_median=624, last_loan_time=4,
          per_loan_time_interval=9, is_exceed_loan_interval=-5, loan_12=0, loan_123=0, per_plannum_loan=52,
          active_loan_interval=None, exceed_loan_1=None, new_limit=624)
    close(got[3], loan_amount=72, loan_weights=6.0952, repay=8, loan_min=24, loan_mean=36, loan_median=36,
          loan_max=48, loan_std=16.9706, loan_12=1, loan_13=0, last_loan_time=8, per_loan_time_interval=2.5,
          is_exceed_loan_interval=5.5, per_plannum_loan=14.4, per_times_loan=36, new_limit=24)


def test_original_loan_counts_loans_not_months(tables):
    got = by_uid(original_loan.original_loan_features(tables, TRAIN))
    close(got[1], loan_months=3, loan_12=1, loan_std=1 / (1 + 1607.2751))
    close(got[2], loan_months=1, loan_12=0, loan_std=1 / (1 + 360.2666), exceed_loan=0)
    close(got[3], loan_months=3, loan_12=0, loan_13=1, loan_std=1 / (1 + 24.0))


def test_windows_leave_out_day_zero_and_the_far_end(tables):
    got = by_uid(loan.loan_window_features(tables, TRAIN))
    filled = {uid: {c.split("_")[1] for c, v in row.items() if c != "uid" and v} for uid, row in got.items()}
    assert filled == {1: {"49", "84"}, 2: {"35"}, 3: {"63"}}
    close(got[1], loan_49_min=3124, loan_49_median=3124, loan_49_count=1, loan_49_std=0, loan_84_sum=624)


def test_window_median_and_deviation_use_counts(spark):
    rows = [(1, 5, v) for v in (10.0, 10.0, 10.0, 20.0, 70.0, 70.0)] + [(2, 6, 1.0), (2, 6, 4.0)]
    events = spark.createDataFrame(rows, "uid bigint, days bigint, amount double")
    got = by_uid(windows.disjoint_windows(events, "amount", "loan", TRAIN))
    close(got[1], loan_7_median=15, loan_7_mean=31.6667, loan_7_std=stdev([10, 10, 10, 20, 70, 70]), loan_7_count=6, loan_7_sum=190)
    close(got[2], loan_7_median=2.5, loan_7_std=2.1213, loan_7_min=1, loan_7_max=4)


def test_periods_include_day_zero(tables):
    got = by_uid(original_loan.original_loan_periods(tables, TRAIN))
    close(got[1], loan_1=3.0, loan_90=money_log(3872), loan_filter_week1=124, filter_loan_max=124)
    close(got[2], loan_1=0)


def money_log(x):
    from math import log

    return log(x + 1, 5)


def test_click_features(tables):
    got = by_uid(click.click_features(tables, TRAIN))
    close(got[1], click_weights=2.25, pid_1=0.5, pid_2=0.25, param_1=0.75, click_count=1, click_sum=3, click_std=None,
          last_click_time=0, per_click_time_interval=3, is_exceed_click_interval=-3)
    close(got[9], per_click_time_interval=13 - 7, param_48=0.5)


def test_order_features_read_missing_as_zero(tables):
    got = by_uid(order.order_features(tables, TRAIN))
    close(got[1], buy_weights=0.8333, cost_weight=62, real_price=124, dis_ratio=0.5, price_std=0, price_sum=124)


def test_original_orders_keep_missing(tables):
    paid = [r.paid for r in order_events(tables, TRAIN, filled=False).orderBy("buy_time").collect()]
    assert paid == [0.0, None]
    close(by_uid(original_order.original_order_features(tables, TRAIN))[1], real_price=0, buy_sum=0)


def test_equal_width_codes(spark):
    df = spark.createDataFrame([(float(v),) for v in range(5)], "x double")
    codes = df.select(coding.equal_width_code(F.col("x"), F.lit(0.0), F.lit(4.0))).collect()
    assert [r[0] for r in codes] == [1, 1, 2, 3, 4]


def test_cohorts(spark, tables):
    loans = [(10, "2016-08-05"), (10, "2016-09-05"), (11, "2016-11-05"), (12, "2016-08-05"), (12, "2016-11-30")]
    loan_rows = spark.createDataFrame(loans, "uid bigint, d string").selectExpr(
        "uid", "cast(d as timestamp) loan_time", "1D loan_amount", "1 plannum"
    )
    users = spark.createDataFrame([(10,), (13,)], "uid bigint")
    t = tables.__class__(users, loan_rows, tables.click, tables.order, tables.loan_sum)
    got = {r.uid: r.cohort for r in cohorts.cohorts(t, TRAIN).collect()}
    assert got == {10: 2, 11: 1, 12: 3, 13: 0}


def test_matrix_keys_are_the_union_of_all_sides(tables):
    got = by_uid(matrix.training_matrix(tables, TRAIN))
    assert set(got) == {1, 2, 3, 4, 9}
    close(got[4], label=4.0, loan_amount=None, new_limit=None, limit=None)
    close(got[9], loan_amount=None, click_sum=1, price_sum=None, label=None)
    close(got[1], limit=3124, a_date=17, sex_2=1, new_limit=3124, label=None)


def test_scoring_uses_the_next_window(tables):
    got = by_uid(matrix.scoring_matrix(tables, SCORE))
    assert "label" not in got[1]
    close(got[4], loan_amount=624, loan_times=1, last_loan_time=4, repay=624)
    close(got[1], loan_amount=3248, repay=3124 / 3 + 124 / 6)


def test_cross_features_need_two_tables(tables):
    both = by_uid(cross.interactive_month_features(tables, TRAIN))
    assert set(both) == {1}
    all_rows = by_uid(cross.interactive_features(tables, TRAIN))
    assert set(all_rows) == {1, 2, 3, 9}
    close(all_rows[9], interactive_std_x=0, interactive_std_y=0, click_weeks_std=1)
    close(all_rows[2], loan_weeks_sum=0, click_weeks_std=0)


def test_union_codes_cover_active_months_only(tables):
    rows = {(r.uid, r.month): r for r in cross.union_codes(tables, TRAIN).collect()}
    assert (1, 10) in rows and (1, 11) not in rows and (4, 11) in rows
    assert rows[(1, 10)].clicks_code == 4 and rows[(2, 10)].clicks_code == 1


def test_repay_cost_needs_both_sides(tables):
    got = by_uid(original_matrix.borrower_matrix(tables, TRAIN))
    close(got[2], repay_cost=0)
    assert got[1]["repay_cost"] > 0 and got[9]["repay"] == 0


def test_unknown_plan_length_is_left_out_of_shares(spark, tables):
    rows = spark.createDataFrame([(1, 3), (1, 7)], "uid bigint, plannum int").selectExpr("*", "5D amount")
    got = by_uid(summarise(rows, loan.plannum_shares(TRAIN)))
    close(got[1], plannum_03=1, plannum_sum=1)


def test_empty_event_table(tables):
    t = tables.__class__(tables.user, tables.loan, tables.click.limit(0), tables.order, tables.loan_sum)
    assert click.click_features(t, TRAIN).count() == 0
    close(by_uid(matrix.training_matrix(t, TRAIN))[1], click_sum=None, loan_amount=3872)


def test_row_statistics_match_a_single_value(spark):
    df = spark.createDataFrame([(1.0, None, None), (1.0, 2.0, None), (3.0, 1.0, 8.0), (None, None, None)],
                               "a double, b double, c double")
    stats = rowwise.present_stats([F.col(c) for c in "abc"])
    rows = df.select(*[c.alias(n) for n, c in stats.items()]).collect()
    assert [r["median"] for r in rows] == [1, 1.5, 3, None]
    assert [r["count"] for r in rows] == [1, 2, 3, 0]
    assert rows[0]["std"] is None and rows[1]["std"] == pytest.approx(0.5**0.5)


def test_first_and_last_loan(tables):
    events = loan_events(tables, TRAIN)
    last = by_uid(recency.last_row(events, ["loan_time", "amount"]))
    first = by_uid(recency.first_row(events, ["loan_time", "amount"]))
    assert (last[1]["amount"], first[1]["amount"]) == (124, 624)


def test_prediction_adjustments(spark):
    df = spark.createDataFrame([(-2.0, 1.0), (3.0, 1.0), (3.0, None)], "p double, cap double")
    rows = df.select(coding.clamped(F.col("p")), coding.folded(F.col("p")), coding.decided(F.col("p")),
                     money.at_most("p", "cap")).collect()
    assert [tuple(r) for r in rows] == [(0, 2, 0, -2), (3, 3, 1, 1), (3, 3, 1, 3)]


def test_user_attributes(tables):
    close(by_uid(user.user_features(tables, TRAIN))[1], limit=3124, a_date=17, sex_1=0, sex_2=1, age=30)
    close(by_uid(user.original_user_features(tables, TRAIN))[1], a_date=119 / 7, sex=2)


def test_clicks_before_the_anchor(tables):
    days = sorted(r.days for r in click_events(tables, TRAIN).where("uid = 1").collect())
    assert days == [1, 2, 21]
