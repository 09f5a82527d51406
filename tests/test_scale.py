"""Plans and skew: number of exchanges, pushdown, no cross joins, no Python, hot keys."""

import random
import statistics

import pytest
from conftest import by_uid, plan_of
from pyspark.sql import functions as F

from creditloom import TRAIN
from creditloom.operators import fused, quantiles, sampling, windows
from creditloom.plans import click, cross, loan, matrix, order, original_matrix
from creditloom.sources.tables import LOAN, Tables, read_table


def exchanges(df) -> int:
    return plan_of(df).count("Exchange hashpartitioning")


def test_one_exchange_per_grouped_table(tables):
    assert exchanges(loan.loan_core(tables, TRAIN)) == 1
    assert exchanges(click.click_features(tables, TRAIN)) == 1
    assert exchanges(order.order_features(tables, TRAIN)) == 1
    assert exchanges(loan.loan_window_features(tables, TRAIN)) == 2


def test_merging_the_matrix_adds_no_exchange(tables):
    # users 1, loans 1, windows 2, clicks 1, orders 1, label 1
    assert exchanges(matrix.training_matrix(tables, TRAIN)) == 7


def test_no_cross_join_and_no_python(tables):
    for make in (matrix.training_matrix, original_matrix.original_training_matrix, cross.union_features):
        text = plan_of(make(tables, TRAIN))
        assert "NestedLoop" not in text and "CartesianProduct" not in text
        assert "Python" not in text and "Pandas" not in text


def test_time_filter_and_columns_reach_the_scan(spark, tables, tmp_path):
    path = str(tmp_path / "loan")
    tables.loan.write.parquet(path)
    stored = read_table(spark, path, LOAN, "parquet")
    t = Tables(tables.user, stored, tables.click, tables.order, tables.loan_sum)
    text = plan_of(loan.loan_window_features(t, TRAIN))
    assert "GreaterThanOrEqual(loan_time" in text and "LessThan(loan_time" in text
    assert "plannum" not in text.split("ReadSchema")[1]


def test_edges_reuse_the_grouped_exchange(tables):
    df = cross.union_features(tables, TRAIN)
    df.collect()
    assert "ReusedExchange" in plan_of(df)


def test_results_do_not_depend_on_partitioning(spark, tables):
    def repartitioned(n):
        return Tables(*[getattr(tables, f).repartition(n) for f in ("user", "loan", "click", "order", "loan_sum")])

    one = by_uid(matrix.training_matrix(repartitioned(1), TRAIN))
    many = by_uid(matrix.training_matrix(repartitioned(7), TRAIN))
    assert one.keys() == many.keys()
    for uid, row in one.items():
        for name, value in row.items():
            assert many[uid][name] == (value if value is None else pytest.approx(value)), (uid, name)


def test_window_statistics_of_a_hot_user(spark):
    random.seed(7)
    hot = [(1, random.randint(1, 7), float(random.randint(500, 900))) for _ in range(20000)]
    rest = [(u, random.randint(1, 84), float(random.randint(500, 900))) for u in range(2, 400) for _ in range(5)]
    events = spark.createDataFrame(hot + rest, "uid bigint, days bigint, amount double").repartition(8)
    got = by_uid(windows.disjoint_windows(events, "amount", "loan", TRAIN))
    for uid in (1, 2, 57, 399):
        for low, high in zip(TRAIN.day_edges, TRAIN.day_edges[1:]):
            values = [a for u, d, a in hot + rest if u == uid and low < d <= high]
            row = got[uid]
            assert row[f"loan_{high}_count"] == len(values)
            assert row[f"loan_{high}_median"] == (statistics.median(values) if values else 0)
            want = statistics.stdev(values) if len(values) > 1 else 0
            assert row[f"loan_{high}_std"] == pytest.approx(want)


def test_outer_merge_equals_full_joins(spark):
    a = spark.range(0, 60).selectExpr("id as uid", "id * 2 as a").repartition("uid")
    b = spark.range(30, 90).selectExpr("id as uid", "id * 3 as b").repartition("uid")
    c = spark.range(80, 95).selectExpr("id as uid", "if(id % 2 = 0, null, id) as c").repartition("uid")
    merged = fused.outer_merge({"x": a, "y": b, "z": c})
    joined = a.join(b, "uid", "full_outer").join(c, "uid", "full_outer")
    assert sorted(merged.collect(), key=str) == sorted(joined.select(merged.columns).collect(), key=str)


def test_quantiles_equal_brute_force(spark):
    random.seed(3)
    values = [random.choice([1.0, 1.0, 2.5, random.uniform(0, 9)]) for _ in range(5000)] + [4.0] * 2500
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r.prob: r.quantile for r in quantiles.exact_quantiles(df, "v", probs).collect()}
    ordered = sorted(values)
    for p in probs:
        spot = p * (len(ordered) - 1)
        low = int(spot)
        high = min(low + 1, len(ordered) - 1)
        assert got[p] == pytest.approx(ordered[low] + (ordered[high] - ordered[low]) * (spot - low))


def test_sample_is_exact_stable_and_disjoint_from_the_rest(spark):
    keys = spark.range(1000).select(F.col("id").alias("uid"), (F.col("id") % 3).alias("cohort"))
    first = sampling.sample_flags(keys, 5, fraction=0.2, stratum="cohort")
    again = sampling.sample_flags(keys.repartition(9), 5, fraction=0.2, stratum="cohort")
    assert sorted(first.collect()) == sorted(again.collect())
    sizes = {r.cohort: r.n for r in first.where("sampled").groupBy("cohort").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 66, 1: 66, 2: 66}
    other = sampling.sample_flags(keys, 6, fraction=0.2, stratum="cohort")
    assert sorted(first.collect()) != sorted(other.collect())


def test_fixed_size_sample_takes_all_of_a_small_stratum(spark):
    keys = spark.range(30).select(F.col("id").alias("uid"), (F.col("id") < 4).alias("few"))
    flagged = sampling.sample_flags(keys, 1, size=10, stratum="few").where("sampled")
    assert {r.few: r.n for r in flagged.groupBy("few").agg(F.count("*").alias("n")).collect()} == {True: 4, False: 10}


def test_folds_cover_everyone_once(spark):
    folds = spark.range(2000).select(F.col("id").alias("uid")).select(sampling.fold_id(2017).alias("f"))
    sizes = [r["count"] for r in folds.groupBy("f").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 2000 and min(sizes) > 300
