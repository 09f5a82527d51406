"""Standardised features and user segments."""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import _py2java
from pyspark.mllib.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.fused import KEY, fill_zero
from creditloom.sources.artefacts import Artefacts, build_rules, row_facts
from creditloom.sources.sinks import load_model, save_model
from creditloom.spec import FeatureSpec


PIECE = 1024  # rows whose distances to one start's centres are in memory at once
WIDE = 64  # columns from which single precision is worth its masks
BLOCK_VALUES = 1 << 21  # numbers of a block of rows, and a batch more


def feature_columns(df: DataFrame, but: tuple[str, ...] = (KEY, "label", "label2", "fold")) -> list[str]:
    return [c for c in df.columns if c not in but]


def standardised(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns with mean 0 and population deviation 1; constant columns become 0.

    Two passes over the data: one global aggregate, read back as a scalar
    subquery, and one projection.
    """
    moments = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in cols]
    stats = df.agg(*moments).select(F.struct("*")).scalar()
    with_stats = df.withColumn("_stats", stats)
    scaled = {
        c: F.coalesce(
            F.try_divide(F.col(c) - F.col(f"_stats.{c}.mean"), F.col(f"_stats.{c}.std")),
            F.when(F.col(c).isNotNull(), 0.0),
        )
        for c in cols
    }
    return with_stats.withColumns(scaled).drop("_stats")


def fit_segments(
    df: DataFrame, k: int = 180, max_iter: int = 1200, restarts: int = 10, seed: int = 2017, parallelism: int = 4
) -> PipelineModel:
    """Assemble, standardise and cluster; the best of several k-means starts.

    The scaler is part of the stored model, so users scored later are measured on
    the scale the clusters were fitted on. Spark scales by the sample deviation;
    the population one differs by the same factor in every dimension, which
    changes no assignment. Spark's k-means finds the first centres of every start.
    """
    features = feature_columns(df)
    filled = fill_zero(df.select(KEY, *features)).persist()
    try:
        prepared = Pipeline(
            stages=[
                VectorAssembler(inputCols=features, outputCol="raw"),
                StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
            ]
        ).fit(filled)
        scaled = prepared.transform(filled).select("scaled").persist()
        try:
            def start(number: int) -> KMeansModel:
                return KMeans(
                    featuresCol="scaled", predictionCol="segment", k=k, maxIter=0,
                    initMode="k-means||", seed=seed + number,
                ).fit(scaled)

            with ThreadPool(min(parallelism, restarts)) as pool:
                starts = pool.map(inheritable_thread_target(df.sparkSession)(start), range(restarts))
            centres = [np.array(model.clusterCenters()) for model in starts]
            costs = improve(scaled, centres, max_iter, starts[0].getTol())
        finally:
            scaled.unpersist()
    finally:
        filled.unpersist()
    # Of equal costs the first start's wins.
    best = min(range(restarts), key=lambda number: (costs[number], number))
    return PipelineModel([*prepared.stages, _with_centres(starts[best], centres[best], max_iter)])


def improve(scaled: DataFrame, centres: list[np.ndarray], max_iter: int, tol: float) -> list[float]:
    """Move the centres of all starts, in place, until none of a start moves by more than ``tol``; their costs.

    The rounds are those of Spark's k-means: a centre moves to the mean of its rows, one without rows stays, and the
    cost is that of the last round's assignment. One pass over the rows serves every start that still moves. A task
    adds up its rows by start and centre, Spark adds up the tasks, and the driver sees the sums of each centre.
    """
    context = scaled.sparkSession.sparkContext
    parts = max(scaled.rdd.getNumPartitions(), context.defaultParallelism)
    blocks = _blocks(scaled, parts).persist(StorageLevel.MEMORY_AND_DISK)
    costs = [0.0] * len(centres)
    moving = list(range(len(centres)))
    try:
        for _ in range(max_iter):
            shared = context.broadcast([centres[start] for start in moving])
            found = dict(_placed(blocks, shared, min(parts, len(moving))).collect())
            shared.destroy()
            still = []
            for at, start in enumerate(moving):
                n, total, cost = found.get(at, (np.zeros(len(centres[start])), np.zeros(centres[start].shape), 0.0))
                filled = n > 0
                means = total[filled] / n[filled, None]
                moved = means - centres[start][filled]
                centres[start][filled] = means
                costs[start] = float(cost)
                if (moved * moved).sum(axis=1).max(initial=0.0) > tol * tol:
                    still.append(start)
            moving = still
            if not moving:
                break
    finally:
        blocks.unpersist()
    return costs


def _blocks(scaled: DataFrame, parts: int) -> RDD:
    """The rows as few matrices a task. What tasks run goes to them by value, so they need not have this package."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows in few matrices, as bytes."""

        def block() -> pa.RecordBatch:
            whole = np.vstack(held)
            columns = [pa.array([whole.shape[1]], pa.int32()), pa.array([whole.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["width", "block"])

        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            if sum(x.size for x in held) >= BLOCK_VALUES:
                yield block()
                held = []
        if held:
            yield block()

    rows = scaled.select(vector_to_array("scaled").alias("row")).repartition(parts)
    blocks = rows.mapInArrow(packed, "width int, block binary").rdd
    return blocks.map(lambda r: np.frombuffer(r.block).reshape(-1, r.width))


def _placed(blocks: RDD, shared, parts: int) -> RDD:
    """By start: number and sum of the rows nearest to each centre, and their squared distances together."""

    def added(one: tuple, other: tuple) -> tuple:
        return one[0] + other[0], one[1] + other[1], one[2] + other[2]

    def sums(x: np.ndarray, norms: np.ndarray, places: np.ndarray, centres: np.ndarray) -> tuple:
        n, total = np.bincount(places, minlength=len(centres)), np.zeros(centres.shape)
        order, ends = places.astype(np.min_scalar_type(len(centres))).argsort(kind="stable"), np.cumsum(n)
        for k in np.flatnonzero(n):
            total[k] = x.take(order[ends[k] - n[k] : ends[k]], axis=0).sum(axis=0)
        # The squared distances of a centre's rows follow from their sum.
        apart = np.bincount(places, norms, len(centres)) - 2 * np.einsum("ij,ij->i", total, centres) + n * (centres * centres).sum(axis=1)
        return n.astype(float), total, float(np.maximum(apart, 0.0).sum())

    def nearness(x: np.ndarray, norms: np.ndarray) -> list[np.ndarray]:
        """The rows and ones in pieces; of wide rows also their lengths, in single precision and as columns."""
        one = np.ones((len(x), 1))
        if x.shape[1] < WIDE:
            whole = np.hstack([x, one])
            return [whole[first : first + PIECE] for first in range(0, len(x), PIECE)]
        whole = np.hstack([x, np.sqrt(norms)[:, None], one]).astype(np.float32)
        return [whole[first : first + PIECE].T for first in range(0, len(x), PIECE)]

    def halves(pieces: list[np.ndarray], centres: np.ndarray) -> np.ndarray:
        """The nearest centre by half the squared distance, less half the row's own square."""
        to = np.vstack([-centres.T, (centres * centres).sum(axis=1) / 2])
        room = np.empty(PIECE * len(centres))
        parts = (np.matmul(x, to, out=room[: len(x) * len(centres)].reshape(len(x), -1)).argmin(axis=1) for x in pieces)
        return np.concatenate(list(parts))

    def nearest(x: np.ndarray, norms: np.ndarray, pieces: list[np.ndarray], centres: np.ndarray) -> np.ndarray:
        """The nearest centre of every row, the first of equal ones.

        Of wide rows single precision tells which centres can be the nearest: half the squared distances, less half the row's own square, come out too
        small by as much as they may be wrong. Rows of which more than one centre can be are looked at in double precision.
        """
        if x.shape[1] < WIDE:
            return halves(pieces, centres)
        lengths = np.sqrt((centres * centres).sum(axis=1))
        off = (centres.shape[1] + 16) * float(np.finfo(np.float32).eps)
        low = np.vstack([-centres.T, -off * lengths, lengths * lengths * (0.5 - off)]).T.astype(np.float32)
        own, room, first = np.zeros(len(x), np.intp), np.empty(len(centres) * PIECE, np.float32), 0
        with np.errstate(invalid="ignore", over="ignore"):
            for piece in pieces:
                size = piece.shape[1]
                least = np.matmul(low, piece, out=room[: len(low) * size].reshape(len(low), size))
                best, square = least.min(axis=0).astype(float), norms[first : first + size]
                # No centre that is as near as this can be longer.
                reach = (1 + off) * np.sqrt(square) + np.sqrt(np.maximum(2 * best + square, 0.0) * (1 + off) + 4 * off * square)
                most = best + 4 * off * (np.sqrt(square) * reach + reach * reach)
                centre, row = np.divmod(np.flatnonzero(least <= most.astype(np.float32)), size)
                own[first + row] = centre
                open_ = first + np.flatnonzero(np.bincount(row, minlength=size) != 1)
                if len(open_):
                    own[open_] = halves([np.hstack([x[open_], np.ones((len(open_), 1))])], centres)
                first += size
        return own

    def by_task(own: Iterator[np.ndarray]) -> Iterator[tuple]:
        found = [(np.zeros(len(c)), np.zeros(c.shape), 0.0) for c in shared.value]
        for x in own:
            norms = np.einsum("ij,ij->i", x, x)
            pieces = nearness(x, norms)
            for at, centres in enumerate(shared.value):
                found[at] = added(found[at], sums(x, norms, nearest(x, norms, pieces, centres), centres))
        yield from enumerate(found)

    return blocks.mapPartitions(by_task).reduceByKey(added, parts)


def _with_centres(start: KMeansModel, centres: np.ndarray, max_iter: int) -> KMeansModel:
    """The model of a start with the centres it has moved to."""
    sc = SparkContext.getOrCreate()
    moved = sc._jvm.org.apache.spark.mllib.clustering.KMeansModel(_py2java(sc, [Vectors.dense(c) for c in centres]))
    model = KMeansModel(sc._jvm.org.apache.spark.ml.clustering.KMeansModel(start.uid, moved))
    return start._copyValues(model)._set(maxIter=max_iter)


def assign_segments(df: DataFrame, model: PipelineModel, name: str = "cluster_label") -> DataFrame:
    """Segment number of every user, from 1."""
    placed = model.transform(fill_zero(df))
    return placed.select(*df.columns, (F.col("segment") + 1).cast("double").alias(name))


def with_clusters(matrix: DataFrame, groups: dict[str, DataFrame]) -> DataFrame:
    """A matrix with the segment columns of its feature groups, by column name; 0 for users a group does not have."""
    for name, group in groups.items():
        matrix = matrix.join(group.select(KEY, name), KEY, "left").fillna(0.0, [name])
    return matrix


def segmented(df: DataFrame, path: str, fit: bool, name: str = "cluster_label", **params) -> DataFrame:
    """Fit and store segments on training data, or apply the stored ones to scoring data."""
    if fit:
        save_model(fit_segments(df, **params), path)
    return assign_segments(df, load_model(path), name)


def _contract(df: DataFrame, spec: FeatureSpec, name: str) -> dict:
    return {"label": name, "columns": feature_columns(df), "rules": build_rules(spec)}


def store_segments(store: Artefacts, df: DataFrame, spec: FeatureSpec, name: str, **params) -> DataFrame:
    """Fit segments on training rows, store them for rows of the same columns and rules, and assign them."""
    model = fit_segments(df, **params)
    store.put_model(name, _contract(df, spec, name), model, anchor=spec.anchor, **row_facts(df, KEY))
    return assign_segments(df, model, name)


def stored_segments(store: Artefacts, df: DataFrame, spec: FeatureSpec, name: str) -> DataFrame:
    """Assign the segments that a training run stored for these columns and rules; LookupError if none did."""
    return assign_segments(df, store.model(name, _contract(df, spec, name)), name)
