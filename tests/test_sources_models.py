"""Files, stored stages, models and the registry."""

import math

import duckdb
import pytest
from conftest import by_uid
from pyspark.sql import functions as F

import __spark_entry__ as registry
from creditloom import TRAIN
from creditloom.models import boosting, segments
from creditloom.operators import metrics
from creditloom.plans import loan
from creditloom.session import shared_dir
from creditloom.sources import sinks
from creditloom.sources.tables import SCHEMAS, USER, read_table, read_tables

SMALL = "/root/testdata/sf0.001"


def test_all_five_csv_tables(spark, tables, tmp_path):
    paths = {}
    for name in SCHEMAS:
        paths[name] = str(tmp_path / name)
        sinks.write_table(getattr(tables, name), paths[name])
    stored = read_tables(spark, paths)
    assert by_uid(loan.loan_features(stored, TRAIN)) == by_uid(loan.loan_features(tables, TRAIN))
    assert sorted(stored.order.collect(), key=str) == sorted(tables.order.collect(), key=str)


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    path = tmp_path / "user.csv"
    path.write_text("limit,extra,uid,sex,active_date,age\n5.0,x,7,1,2016-07-05,40\n")
    row = read_table(spark, str(path), USER).first()
    assert (row.uid, row.age, row.limit, str(row.active_date)) == (7, 40, 5.0, "2016-07-05")


def test_materialize_computes_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "stage")
    assert sinks.materialize(spark, make, path).count() == 3
    assert sinks.materialize(spark, make, path).count() == 3
    assert len(calls) == 1


def test_prediction_file_has_no_header(spark, tmp_path):
    path = str(tmp_path / "pred")
    sinks.write_predictions(spark.createDataFrame([(5, 0.25)], "uid bigint, pred double"), path)
    assert spark.read.text(path).first()[0] == "5,0.25"
    sinks.write_holdout(spark.createDataFrame([(5, 1.0)], "uid bigint, label double"), path + "h")
    assert spark.read.text(path + "h").first()[0] == "uid,label"


def test_shared_folder_is_named_by_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, float(i % 7), float((i * 13) % 11), float(i % 7 > 3) * 2.0 + (i % 3) * 0.1) for i in range(300)]
    return spark.createDataFrame(rows, "uid bigint, a double, b double, label double").repartition(4).cache()


SETTINGS = boosting.Boosting(rounds=4, step=0.5, min_leaf=5, depth=3)


def test_folds_predict_everyone(spark, points):
    folded = boosting.fit_folds(points, SETTINGS, folds=3)
    judged = folded.out_of_fold
    assert judged.count() == 300 and judged.select("uid").distinct().count() == 300
    errors = {r.fold: r.rmse for r in boosting.fold_rmse(folded).collect()}
    assert errors[None] == pytest.approx(sum(v for k, v in errors.items() if k is not None) / 3)
    assert errors[None] < 0.6
    pred = boosting.predict_folds(folded, points.drop("label"))
    assert pred.count() == 300 and all(math.isfinite(r.pred) for r in pred.collect())


def test_fits_repeat_for_a_seed(points):
    features = ["a", "b"]
    runs = [
        sorted(boosting.fit_regressor(points, features, SETTINGS).transform(points).select("uid", "pred").collect())
        for _ in range(2)
    ]
    assert runs[0] == runs[1]


WHOLE = boosting.Boosting(rounds=7, step=0.5, min_leaf=5, depth=3, rows=1.0, columns=1.0)


@pytest.mark.parametrize("block", [1, 3, 7, 50])
def test_blocks_continue_the_same_boosting(points, block):
    marked = points.withColumn("held", F.lit(False))
    model, best = boosting.fit_with_patience(marked, ["a", "b"], WHOLE, "held", patience=2, block=block)
    plain = boosting.fit_regressor(points, ["a", "b"], WHOLE)
    assert best == 7
    mine, own = ({r.uid: r.pred for r in m.transform(points).collect()} for m in (model, plain))
    assert mine == pytest.approx(own)


def test_boosting_ends_when_patience_is_over(spark, points, monkeypatch):
    # Held-out labels are the opposite of what is learned, so an early round is the best.
    marked = points.withColumn("held", F.col("uid") % 5 == 0)
    marked = marked.withColumn("label", F.when(F.col("held"), -F.col("label")).otherwise(F.col("label")))
    fitted, one_tree = [], boosting._one_tree
    monkeypatch.setattr(boosting, "_one_tree", lambda *a: fitted.append(1) or one_tree(*a))
    settings = boosting.Boosting(rounds=1500, step=0.3, min_leaf=5, depth=3)
    model, best = boosting.fit_with_patience(marked, ["a", "b"], settings, "held", patience=6, block=4)
    assert len(fitted) < 40 and 6 <= 6 + len(fitted) - best < 6 + 4 and model.stages[-1].getNumTrees == best


def test_best_round_is_that_of_the_whole_series(spark, points, tmp_path):
    marked = points.withColumn("held", F.col("uid") % 4 == 0)
    settings = boosting.Boosting(rounds=12, step=0.3, min_leaf=5, depth=2, rows=1.0, columns=1.0)
    model, best = boosting.fit_with_patience(marked, ["a", "b"], settings, "held", patience=5, block=3)
    whole = boosting.fit_regressor(marked.where("not held"), ["a", "b"], settings)
    errors = whole.stages[-1].evaluateEachIteration(whole.stages[0].transform(marked.where("held")), "squared")
    assert best == boosting.rounds_with_patience(errors, 5)
    sinks.save_model(model, str(tmp_path / "model"))
    again = sinks.load_model(str(tmp_path / "model"))
    assert sorted(again.transform(points).collect()) == sorted(model.transform(points).collect())


def test_importance_and_classifier(points):
    model = boosting.fit_regressor(points, ["a", "b"], SETTINGS)
    ranked = boosting.importance(model, ["a", "b"], points).collect()
    assert ranked[0].feature == "a" and sum(r.importance for r in ranked) == pytest.approx(1)
    target = points.withColumn("label", F.when(F.col("a") > 3, 2.0).otherwise(0.0))
    scored = boosting.borrow_probability(boosting.fit_borrow_classifier(target, SETTINGS), target)
    m = metrics.binary_metrics(scored).first()
    assert m.accuracy == 1 and m.f1 == 1 and m.label_1 + m.label_0 == 300


def test_segments_survive_storage(points, tmp_path):
    path = str(tmp_path / "segments")
    data = points.select("uid", "a", "b")
    fitted = segments.segmented(data, path, fit=True, k=4, max_iter=10, restarts=2)
    applied = segments.segmented(data, path, fit=False)
    assert sorted(fitted.collect()) == sorted(applied.collect())
    assert {r.cluster_label for r in applied.collect()} <= {1.0, 2.0, 3.0, 4.0}


def test_standardised_matches_population_deviation(points):
    row = segments.standardised(points.withColumn("c", F.lit(3.0)), ["a", "c"]).agg(
        F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.max(F.abs("c")).alias("c")
    ).first()
    assert row.m == pytest.approx(0) and row.s == pytest.approx(1) and row.c == 0


def test_rmse_of_known_errors(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 4.0)], "pred double, label double")
    row = metrics.rmse(df).first()
    assert (row.mse, row.n) == (2.5, 2) and row.rmse == pytest.approx(2.5**0.5)


def test_registry_is_consistent():
    queries, oracle = registry.queries(), registry.oracle_sql()
    assert oracle.keys() <= queries.keys()
    without = {
        "q_user_clusters", "q_gbt_cv_rmse", "q_gbt_predictions", "q_feature_importance", "q_grid_search",
        "q_borrow_classifier", "q_cohort_classifier", "q_two_model_predictions", "q_blend",
        "q_borrow_holdout_metrics", "q_cohort_holdout_confusion", "q_two_model_holdout_rmse",
        "q_stored_model_predictions", "q_v1_loan_clustered", "q_v1_order_clustered", "q_v1_click_clustered",
        "q_v1_training_clustered", "q_v1_scoring_clustered",
    }
    own = {name for name in queries if name.startswith("q_")}
    assert own - oracle.keys() == without


@pytest.mark.parametrize("name", ["q_loan_features", "q_loan_windows", "q_union_features", "q_union_features_scoring", "q_union_edge_drift", "q_click_recency_gap", "q_profile", "q_cohorts"])
def test_small_queries_equal_sql(spark, name):
    from check import compare, connect

    result = compare(spark, connect(SMALL), SMALL, name, registry.queries()[name], registry.oracle_sql()[name])
    assert result.endswith("equal"), result


def test_entry_has_rows(spark):
    df = registry.entry(spark)
    assert len(df.columns) == 223 and df.count() > 100
    assert duckdb is not None
