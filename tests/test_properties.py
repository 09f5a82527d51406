"""Invariants over generated loans."""

from datetime import datetime, timedelta, timezone

from conftest import by_uid
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from creditloom import TRAIN
from creditloom.plans import loan, original_loan
from creditloom.sources.tables import LOAN, Tables

START = datetime(2016, 8, 1, tzinfo=timezone.utc)
one_loan = st.tuples(
    st.integers(1, 4),
    st.integers(0, 92 * 86400 - 1).map(lambda s: START + timedelta(seconds=s)),
    st.floats(0.5, 7.0),
    st.sampled_from([1, 3, 6, 12]),
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(one_loan, min_size=1, max_size=40))
def test_loan_invariants(spark, tables, rows):
    t = Tables(tables.user, spark.createDataFrame(rows, LOAN), tables.click, tables.order, tables.loan_sum)
    features = by_uid(loan.loan_features(t, TRAIN))
    windows = by_uid(loan.loan_window_features(t, TRAIN))
    periods = by_uid(original_loan.original_loan_periods(t, TRAIN))
    assert set(features) == set(windows) == set(periods) == {r[0] for r in rows}
    anchor = datetime(2016, 11, 1, tzinfo=timezone.utc)
    for uid, f in features.items():
        mine = [r for r in rows if r[0] == uid]
        days = [(anchor - r[1]).days for r in mine]
        assert abs(sum(f[f"loan_hours_0{b}"] for b in range(1, 7)) - 1) < 1e-9
        assert abs(sum(f[f"plannum_{p:02d}"] for p in (1, 3, 6, 12)) - 1) < 1e-9
        assert f["new_limit"] >= round(max(5 ** r[2] - 1 for r in mine)) - 1
        if uid == 1:
            assert f["new_limit"] >= 3124
        inside = sum(windows[uid][f"loan_{d}_count"] for d in TRAIN.day_edges[1:])
        assert inside + sum(d == 0 for d in days) + sum(d > 84 for d in days) == len(mine)
        sums = [periods[uid][f"loan_{d}"] for d in TRAIN.periods]
        assert sums == sorted(sums)
