"""Longer and later windows, clashing names, and values worked out by hand."""

from datetime import date

import pytest
from conftest import at, by_uid
from pyspark.sql import functions as F

from creditloom.operators import cohorts, fused, recency, sampling
from creditloom.operators.fused import Measures
from creditloom.models import segments
from creditloom.queries import catalog
from creditloom.sources.artefacts import Artefacts, build_rules
from creditloom.sources.retimed import open_tables
from creditloom.plans import cross, loan, original_loan, original_matrix
from creditloom.plans.events import click_events
from creditloom.sources.tables import LOAN, Tables
from creditloom.spec import TRAIN, FeatureSpec


def spec_of(months: int) -> FeatureSpec:
    return FeatureSpec(anchor=date(2016, 11, 1), n_months=months, fit_from=date(2016, 7, 1), fit_to=date(2016, 12, 1))


@pytest.mark.parametrize("months", [2, 3, 4])
def test_union_slots_are_the_observed_months(tables, months):
    spec = spec_of(months)
    found = cross.union_features(tables, spec)
    names = [cross.slot_name(k) for k in spec.slots]
    assert [c for c in found.columns if c.startswith("lpc_")] == [f"lpc_{n}" for n in names]
    # User 4 borrows in the target month only, so none of its features is known.
    assert all(by_uid(found)[4][f"lpc_{n}"] == 0 for n in names)
    # User 1 has loans in October, the last observed month.
    assert by_uid(found)[1][f"lpc_{names[-1]}"] > 0


def test_fit_range_has_to_cover_the_window(tables):
    with pytest.raises(ValueError, match="2016-07-01"):
        cross.union_features(tables, TRAIN.with_(n_months=4))


def test_first_month_counts_over_the_turn_of_the_year(spark, tables):
    loans = [(1, at("2016-11-05 10:00:00"), 2.0, 1), (2, at("2017-01-03 10:00:00"), 2.0, 1), (3, at("2017-02-03 10:00:00"), 2.0, 1)]
    spec = FeatureSpec(anchor=date(2017, 2, 1))
    turned = Tables(tables.user, spark.createDataFrame(loans, LOAN), tables.click, tables.order, tables.loan_sum)
    found = by_uid(cohorts.first_month(turned, spec))
    assert {k: v["first_month"] for k, v in found.items()} == {1: 1, 2: 3, 3: 4}


def test_weeks_follow_the_window():
    assert TRAIN.window_weeks == 13 and spec_of(2).window_weeks == 8 and TRAIN.with_(weeks=5).window_weeks == 5


def test_different_expressions_under_one_name_are_refused(spark):
    a, b = Measures({"x": F.sum("a")}), Measures({"x": F.sum("b")})
    assert (a + Measures({"x": F.sum("a")})).aggs.keys() == {"x"}
    with pytest.raises(ValueError, match="x"):
        a + b
    spec = TRAIN.with_(periods=(1, 12, 30))
    with pytest.raises(ValueError, match="loan_12"):
        original_loan.loan_counts(spec) + original_loan.period_measures(spec)[0] + loan.active_months(spec)


def test_limit_of_the_second_model_keeps_its_scale(tables):
    found = by_uid(original_matrix.non_borrower_matrix(tables, TRAIN))
    # The stored limit is 5.0, a logarithm to base 5 of one more than the limit.
    assert found[1]["limit"] == pytest.approx(5**5 - 1, abs=1)
    first = by_uid(original_matrix.borrower_matrix(tables, TRAIN))
    assert first[1]["limit"] == pytest.approx(5.0, abs=1e-3)


def test_matrices_to_score_have_no_label(tables):
    for make in (original_matrix.borrower_matrix, original_matrix.non_borrower_matrix):
        with_label, without = make(tables, TRAIN), make(tables, TRAIN, label=False)
        assert set(with_label.columns) - set(without.columns) == {"label"}
    # User 4 is known from its label only, and from the months that edges are fitted on in the second matrix.
    assert 4 not in by_uid(original_matrix.borrower_matrix(tables, TRAIN, label=False))
    assert 4 in by_uid(original_matrix.borrower_matrix(tables, TRAIN))


def test_shuffle_keeps_every_row_in_hash_order(spark):
    df = spark.range(50).withColumnRenamed("id", "uid")
    first = [r.uid for r in sampling.shuffled(df, 1).collect()]
    assert sorted(first) == list(range(50)) and first != list(range(50))
    assert first == [r.uid for r in sampling.shuffled(df.repartition(3), 1).collect()]


SEGMENTS = ["loan_cluster_label", "order_cluster_label", "click_cluster_label", "cluster_label"]


def test_matrices_have_the_segments_of_their_groups(spark, tmp_path):
    t = open_tables(spark, "/root/testdata/sf0.001")
    store = Artefacts(spark, str(tmp_path / "artefacts"))
    with pytest.raises(LookupError, match="None is stored"):
        catalog.clustered_scoring_matrix(t, store)
    train = catalog.clustered_training_matrix(t, store, k=4, max_iter=5, restarts=2)
    score = catalog.clustered_scoring_matrix(t, store)
    plain = original_matrix.original_scoring_matrix(t, catalog.SCORE)
    assert score.columns == [*plain.columns, *SEGMENTS]
    assert set(train.columns) - set(score.columns) == {"label"}
    for found in (train.toPandas(), score.toPandas()):
        assert found.uid.is_unique and found.cluster_label.between(1, 4).all()
        assert all(found[n].between(0, 4).all() and (found[n] > 0).any() for n in SEGMENTS)
    # The other columns are those of the matrix without segments.
    mine, own = (df.select(*plain.columns).toPandas().set_index("uid").sort_index() for df in (score, plain))
    assert (mine.round(6) == own.round(6)).all().all()


def test_segments_of_other_columns_or_rules_are_not_applied(spark, tmp_path):
    store = Artefacts(spark, str(tmp_path / "artefacts"))
    rows = spark.createDataFrame([(i, float(i % 5), float(i)) for i in range(40)], "uid bigint, a double, b double")
    segments.store_segments(store, rows, TRAIN, "cluster_label", k=3, max_iter=5, restarts=1)
    again = segments.stored_segments(store, rows, catalog.SCORE, "cluster_label")
    assert again.count() == 40
    with pytest.raises(LookupError, match=r"lacks \['b'\], has \['c'\]"):
        segments.stored_segments(store, rows.withColumnRenamed("b", "c"), TRAIN, "cluster_label")
    with pytest.raises(LookupError, match="rules.n_months: 2 instead of 3"):
        segments.stored_segments(store, rows, TRAIN.with_(n_months=2), "cluster_label")
    with pytest.raises(LookupError, match="other order"):
        segments.stored_segments(store, rows.select("uid", "b", "a"), TRAIN, "cluster_label")
    contract = {"label": "cluster_label", "columns": ["a", "b"], "rules": build_rules(TRAIN)}
    assert store.facts("cluster_label", contract)["rows"] == 40


def test_edges_are_stored_and_drift_is_counted(spark, tables, tmp_path):
    store = Artefacts(spark, str(tmp_path / "artefacts"))
    own = TRAIN.with_(fit_from=None, fit_to=None)
    with pytest.raises(LookupError):
        cross.stored_edges(store, own)
    cross.store_edges(store, tables, own)
    edges = cross.stored_edges(store, catalog.SCORE)
    assert by_uid(cross.union_features(tables, own, edges)) == by_uid(cross.union_features(tables, own))
    still = {r.level: r for r in cross.edge_drift(tables, own, edges).collect()}
    assert set(still) == {"loan", "paid", "clicks"}
    assert all(r.below == r.above == 0 and (r.low, r.high) == (r.low_now, r.high_now) for r in still.values())
    higher = edges.withColumns({"loan_low": F.col("loan_high") - 0.01, "clicks_high": F.lit(0.5)})
    moved = {r.level: r for r in cross.edge_drift(tables, own, higher).collect()}
    assert moved["loan"].below == moved["loan"].n - 1 and moved["clicks"].above == 1 and moved["paid"].above == 0


@pytest.mark.parametrize("months", [3, 14, 15, 46])
def test_distinct_weeks_of_long_windows(spark, months):
    spec = FeatureSpec(anchor=date(2016, 11, 1), n_months=months)
    last = (spec.anchor - spec.start).days // 7
    weeks = {1: [0, 0, last], 2: list(range(last + 1)), 3: [min(63, last), min(64, last), min(127, last), min(128, last)]}
    rows = [(uid, w) for uid, ws in weeks.items() for w in ws]
    df = spark.createDataFrame(rows, "uid bigint, weeks bigint").repartition(3)
    bits = recency.week_bits(spec)
    found = df.groupBy("uid").agg(*[c.alias(n) for n, c in bits.items()]).select("uid", recency.distinct_weeks(spec).alias("n"))
    assert {r.uid: r.n for r in found.collect()} == {uid: len(set(ws)) for uid, ws in weeks.items()}
    gaps = fused.summarise(df, recency.gap_measures("click", spec, per_event=False))
    assert by_uid(gaps)[2]["per_click_time_interval"] == 1


def test_windows_of_more_than_sixty_weeks_build(tables):
    spec = FeatureSpec(anchor=date(2016, 11, 1), n_months=15)
    assert (spec.anchor - spec.start).days // 7 == 65
    gaps = [recency.gap_measures("click", spec, per_event=False)]
    found = by_uid(fused.summarise(click_events(tables, spec), *gaps))
    assert found[1]["last_click_time"] == 0 and found[1]["per_click_time_interval"] == 3
    assert found[9]["per_click_time_interval"] == spec.window_weeks - found[9]["last_click_time"]
