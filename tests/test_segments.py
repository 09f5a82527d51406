"""K-means starts that move together against Spark's own k-means."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from creditloom.models import segments


@pytest.fixture(scope="module")
def scaled(spark):
    parts = [F.randn(seed) + F.col("id") % 5 * (3 - seed) for seed in (1, 2, 3)]
    rows = spark.range(0, 400, 1, 3).select(array_to_vector(F.array(*parts)).alias("scaled")).persist()
    yield rows
    rows.unpersist()


def _start(scaled, seed, k=7, max_iter=0):
    return KMeans(featuresCol="scaled", predictionCol="segment", k=k, maxIter=max_iter, seed=seed).fit(scaled)


@pytest.mark.parametrize("max_iter", [1, 3, 200])
def test_all_starts_move_as_in_spark(scaled, max_iter):
    seeds = range(11, 15)
    centres = [np.array(_start(scaled, seed).clusterCenters()) for seed in seeds]
    costs = segments.improve(scaled, centres, max_iter, 1e-4)
    for seed, moved, cost in zip(seeds, centres, costs):
        own = _start(scaled, seed, max_iter=max_iter)
        assert np.allclose(moved, own.clusterCenters(), atol=1e-9)
        assert cost == pytest.approx(own.summary.trainingCost)


def test_rounds_do_not_multiply_with_the_starts(scaled, monkeypatch):
    """Every start was a series of jobs of its own."""
    placed, rounds = segments._placed, []
    monkeypatch.setattr(segments, "_placed", lambda *of: rounds.append(len(of[1].value)) or placed(*of))
    centres = [np.array(_start(scaled, seed).clusterCenters()) for seed in range(6)]
    segments.improve(scaled, centres, 200, 1e-4)
    assert rounds[0] == 6 and rounds == sorted(rounds, reverse=True)
    assert len(rounds) == max(_start(scaled, seed, max_iter=200).summary.numIter for seed in range(6))


def test_centres_without_rows_stay(scaled):
    centres = [np.array([[0.0, 0.0, 0.0], [1e6, 0.0, 0.0]])]
    segments.improve(scaled, centres, 5, 1e-4)
    assert centres[0][1].tolist() == [1e6, 0.0, 0.0]


def test_segments_are_those_of_the_best_start_of_spark(spark, tmp_path):
    rows = spark.range(0, 300, 1, 2).select(
        F.col("id").alias("uid"), *[(F.randn(s) + F.col("id") % 4 * s).alias(f"x{s}") for s in (1, 2)]
    )
    rows.write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    model = segments.fit_segments(stored, k=5, max_iter=50, restarts=3, seed=5)
    for stage in model.stages[:-1]:
        stored = stage.transform(stored)
    scaled = stored.select("scaled")
    own = min((_start(scaled, 5 + n, 5, 50) for n in range(3)), key=lambda m: m.summary.trainingCost)
    assert np.allclose(model.stages[-1].clusterCenters(), own.clusterCenters(), atol=1e-9)
    assert (model.stages[-1].getK(), model.stages[-1].getMaxIter(), model.stages[-1].getSeed()) == (5, 50, own.getSeed())
    model.write().save(f"{tmp_path}/model")
    assert type(model).load(f"{tmp_path}/model").transform(rows).count() == 300


@pytest.mark.parametrize("width", [0, segments.WIDE])
def test_near_ties_are_decided_in_double_precision(spark, width):
    """Single precision, which finds the candidates, cannot tell these centres apart."""
    values = [(float(k % 7), float(k % 5), 1000.0 * (k % 3)) for k in range(200)]
    values = [v + (0.0,) * width for v in values]
    rows = spark.createDataFrame([(v,) for v in values], "x array<double>").select(array_to_vector("x").alias("scaled"))
    x = np.array(values)
    start = np.array([[3.0, 2.0, 1000.0], [3.0, 2.0, 1000.0 + 1e-3], [3.0, 2.0, 1000.0], [0.0, 0.0, 1e6], [1.0, 1.0, 0.0]])
    start = np.hstack([start, np.zeros((len(start), width))])
    place = ((x[:, None, :] - start) ** 2).sum(axis=2).argmin(axis=1)
    wanted = np.array([x[place == k].mean(axis=0) if (place == k).any() else start[k] for k in range(len(start))])
    centres = [start.copy(), start[::-1].copy()]
    costs = segments.improve(rows, centres, 1, 1e-4)
    assert np.allclose(centres[0], wanted, rtol=0, atol=1e-9)
    assert costs[0] == pytest.approx(((x - start[place]) ** 2).sum())



def test_groups_are_fitted_side_by_side(spark, monkeypatch):
    """One after the other they would wait for each other in vain."""
    from threading import Barrier
    from types import SimpleNamespace

    from creditloom.queries import catalog

    users, together = spark.range(5).withColumnRenamed("id", "uid"), Barrier(len(catalog.CLUSTERED), timeout=60)
    monkeypatch.setattr(catalog, "CLUSTERED", dict.fromkeys(catalog.CLUSTERED, lambda t, spec: users.where("uid < 3")))

    def place(df, spec, name):
        if name in catalog.CLUSTERED:
            together.wait()
        return df.withColumn(name, F.lit(2.0))

    made = catalog._with_segments(SimpleNamespace(loan=users), None, place, users)
    assert made.columns == ["uid", *catalog.CLUSTERED, "cluster_label"]
    assert sorted(r[1] for r in made.collect()) == [0.0, 0.0, 2.0, 2.0, 2.0]
