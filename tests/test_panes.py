from datetime import date

import pytest
from conftest import at, plan_of
from pyspark.sql import functions as F

from creditloom.operators import panes as pane_ops
from creditloom.plans import matrix, panes
from creditloom.sources.retimed import open_tables
from creditloom.sources.tables import CLICK, LOAN, ORDER, Tables
from creditloom.spec import SCORE, TRAIN, FeatureSpec

SF = "/root/testdata/sf0.001"


def close(a, b):
    if a is None or b is None or isinstance(a, str):
        return a == b
    return a == b or abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))


def rows_at(df, anchor):
    return {r["uid"]: r.asDict() for r in df.where(F.col("anchor") == F.lit(anchor)).drop("anchor").collect()}


def assert_equal(found, spec, single, drop=()):
    got, want = rows_at(found.drop(*drop), spec.anchor), {r["uid"]: r.asDict() for r in single.collect()}
    assert got.keys() == want.keys()
    for uid, row in want.items():
        assert got[uid].keys() == row.keys()
        bad = {n: (got[uid][n], v) for n, v in row.items() if not close(got[uid][n], v)}
        assert not bad, (uid, bad)


# Times on and around midnights, month borders and anchors.
EDGES = [
    "2016-08-01 00:00:00", "2016-08-01 00:00:01", "2016-08-31 23:59:59", "2016-09-01 00:00:00", "2016-09-30 12:00:00",
    "2016-10-04 00:00:00", "2016-10-04 00:00:01", "2016-10-31 23:59:59", "2016-11-01 00:00:00", "2016-11-01 00:00:01",
    "2016-11-30 23:59:59", "2016-12-01 00:00:00", "2016-07-31 23:59:59",
]


@pytest.fixture(scope="module")
def edge_tables(spark, tables):
    loans = [(u, at(t), 3.0 + (k % 4) / 3, (1, 3, 6, 12, None)[(k + u) % 5]) for u in (1, 2) for k, t in enumerate(EDGES * 2)]
    loans += [(7, at("2016-10-01 10:00:00"), None, 1), (8, at("2016-09-09 09:00:00"), 4.0, None)]
    clicks = [(u, at(t), 1 + k % 10, 1 + k % 48) for u in (2, 3) for k, t in enumerate(EDGES)] + [(3, at(EDGES[4]), None, None)]
    orders = [(u, date.fromisoformat(t[:10]), 2.0, 1 + k % 2, (None, 3.0)[k % 2]) for u in (1, 4) for k, t in enumerate(EDGES)]
    make = spark.createDataFrame
    return Tables(tables.user, make(loans, LOAN), make(clicks, CLICK), make(orders, ORDER), tables.loan_sum)


def test_two_anchors_equal_the_single_builds(spark):
    t = open_tables(spark, SF)
    labels = matrix.labels(t).withColumn("anchor", F.lit(TRAIN.anchor))
    both = panes.anchored_matrix(panes.open_panes(t, TRAIN), [TRAIN, SCORE], labels).cache()
    assert_equal(both, TRAIN, matrix.training_matrix(t, TRAIN))
    assert_equal(both, SCORE, matrix.scoring_matrix(t, SCORE), drop=("label",))
    both.unpersist()


def test_events_at_the_edges_of_days_months_and_windows(edge_tables):
    t, short = edge_tables, FeatureSpec(anchor=date(2016, 10, 1))
    specs = [TRAIN, SCORE, short]
    found = panes.anchored_matrix(panes.open_panes(t, TRAIN), specs).cache()
    for spec in specs:
        assert_equal(found, spec, matrix.scoring_matrix(t, spec))
    assert {r.anchor for r in found.select("anchor").distinct().collect()} == {s.anchor for s in specs}
    found.unpersist()


def test_a_band_of_amounts_and_a_single_anchor(edge_tables):
    spec = TRAIN.with_(amount_band=(499.0, 90000.0))
    found = panes.anchored_matrix(panes.open_panes(edge_tables, spec), [spec])
    assert_equal(found, spec, matrix.scoring_matrix(edge_tables, spec))


def test_panes_are_read_instead_of_the_events(spark, tmp_path):
    t, path = open_tables(spark, SF), str(tmp_path / "panes")
    one = panes.open_panes(t, TRAIN, path)
    before = one.loan.count()
    nothing = Tables(t.user, t.loan.where("false"), t.click.where("false"), t.order.where("false"), t.loan_sum)
    again = panes.open_panes(nothing, TRAIN, path)
    assert again.loan.count() == before > 0
    plan = plan_of(panes.anchored_matrix(again, [TRAIN, SCORE]))
    assert not any(f"{name}.parquet" in plan for name in ("orders", "events", "lineitem"))
    # The months of all windows reach the scan.
    assert "GreaterThanOrEqual(month," in plan


def test_each_event_table_is_scanned_once(spark):
    t = open_tables(spark, SF)
    for made, table in ((panes.loan_panes(t.loan, TRAIN), "orders"), (panes.click_panes(t.click), "events"), (panes.order_panes(t.order), "lineitem")):
        plan = plan_of(made)
        assert plan.count(f"{table}.parquet") == 1
        # One exchange for the grouping, and for purchases those that find the buyer.
        assert plan.count("Exchange hashpartitioning(uid") == 1


def test_anchors_of_other_shapes_are_refused(edge_tables):
    found = panes.open_panes(edge_tables, TRAIN)
    with pytest.raises(ValueError, match="same columns"):
        panes.anchored_matrix(found, [TRAIN, SCORE.with_(n_months=2)])
    with pytest.raises(ValueError, match="comes once"):
        panes.anchored_matrix(found, [TRAIN, TRAIN])


def test_a_pane_goes_to_the_windows_that_have_its_month(spark):
    rows = spark.createDataFrame([(1, 17000, m) for m in range(2016 * 12 + 6, 2016 * 12 + 12)], "uid long, pane long, month int")
    found = pane_ops.at_anchors(rows, [TRAIN, SCORE], "month").groupBy("month").count().collect()
    assert {r["month"] - 2016 * 12 + 1: r["count"] for r in found} == {8: 1, 9: 2, 10: 2, 11: 1}
