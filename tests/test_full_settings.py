"""Registered model queries fit what the settings' own defaults say, not a few rounds."""

import pytest
from pyspark.sql import functions as F

from creditloom.models import boosting
from creditloom.queries import catalog
from creditloom.sources.tables import Tables

LIBRARY = boosting.Boosting()


@pytest.fixture
def users(spark, monkeypatch):
    """A tiny matrix in the place of the built ones; every fit notes its settings and does three rounds."""
    made = spark.range(60).select(
        F.col("id").alias("uid"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("label")
    )
    for name in ("training_matrix", "scoring_matrix"):
        monkeypatch.setattr(catalog.matrix, name, lambda *_, **__: made)
    for name in ("borrower_matrix", "non_borrower_matrix"):
        monkeypatch.setattr(catalog.original_matrix, name, lambda *_, **__: made)
    split = made.select("uid", (F.col("uid") % 2 + 1).alias("train_model"))
    monkeypatch.setattr(catalog.cohorts, "population_split", lambda *_: split)
    monkeypatch.setattr(catalog.cohorts, "cohorts", lambda *_: made.select("uid", F.lit(0).alias("cohort")))
    return made


def _noted(monkeypatch, name):
    asked, fit = [], getattr(boosting, name)
    short = {"rounds": 3, "min_leaf": 2, "depth": 2}

    def noting(rows, features, settings, *more, **named):
        asked.append(settings)
        return fit(rows, features, boosting.Boosting(**vars(settings) | short), *more, **named)

    monkeypatch.setattr(boosting, name, noting)
    return asked


def _whole(settings, **other):
    return settings == boosting.Boosting(**other) and settings.rounds == LIBRARY.rounds


def _tables(users):
    return Tables(user=users, loan=users, click=users, order=users, loan_sum=users)


def test_blend_fits_both_models_whole(users, monkeypatch):
    """Three rounds each were fitted."""
    asked = _noted(monkeypatch, "fit_assembled")
    assert catalog.blended(_tables(users)).count() == 60
    asked.sort(key=lambda s: s.columns)
    assert len(asked) == 2 and _whole(asked[0], columns=0.75) and _whole(asked[1])


def test_fold_predictions_fit_all_folds_whole(users, monkeypatch):
    """Three rounds each were fitted."""
    asked = _noted(monkeypatch, "fit_with_patience")
    assert catalog.cv_predictions(_tables(users)).count() == 60
    assert len(asked) == 5 and all(map(_whole, asked))


def test_two_model_report_fits_both_models_whole(users, monkeypatch):
    """Three rounds each were fitted."""
    asked = _noted(monkeypatch, "fit_regressor")
    found = {r.model: r.n for r in catalog.two_model_report(_tables(users)).collect()}
    assert found == {1: 6, 2: 6}
    assert len(asked) == 2 and all(map(_whole, asked))
