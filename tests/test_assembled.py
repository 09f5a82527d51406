"""Fits read their matrix once: what they pass over many times is a stored stage of vectors."""

from creditloom.models import boosting

TINY = boosting.Boosting(rounds=2, step=0.3, min_leaf=2, depth=2, rows=1.0, columns=1.0)
SCHEMA = "uid bigint, a double, b double, label double"


def _counted(spark):
    """Rows that count how often they are made."""
    made = spark.sparkContext.accumulator(0)

    def row(k: int) -> tuple:
        made.add(1)
        return k, float(k % 7), float(k % 3), float(k % 7 * 2 + k % 3)

    return made, spark.createDataFrame(spark.sparkContext.parallelize(range(60), 2).map(row), SCHEMA)


def test_a_regressor_reads_its_rows_once(spark):
    made, points = _counted(spark)
    boosting.fit_regressor(points, ["a", "b"], TINY)
    assert made.value == 60


def test_blended_models_share_one_reading(spark):
    made, points = _counted(spark)
    rows = boosting.assembled(points, ["a", "b"], "label")
    models = [boosting.fit_assembled(rows, ["a", "b"], s) for s in (TINY, boosting.Boosting(rounds=1, min_leaf=2))]
    assert made.value == 60
    alone = boosting.fit_regressor(points, ["a", "b"], TINY).transform(points).select("uid", "pred").collect()
    assert sorted(models[0].transform(points).select("uid", "pred").collect()) == sorted(alone)


def test_folds_assemble_their_rows_once(spark, monkeypatch):
    assembled, made = boosting.VectorAssembler.transform, []
    monkeypatch.setattr(boosting.VectorAssembler, "transform", lambda *of: made.append(1) or assembled(*of))
    folded = boosting.fit_folds(_counted(spark)[1], TINY, folds=3)
    assert len(made) == 1
    assert folded.out_of_fold.count() == 60
