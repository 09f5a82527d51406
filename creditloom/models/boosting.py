"""Boosted trees: regression with folds, grid search, classifiers, blends."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.coding import binarised, clamped, decided
from creditloom.functions.rowwise import mean
from creditloom.models.segments import feature_columns
from creditloom.operators.fused import KEY, fill_zero
from creditloom.operators.metrics import squared_error
from creditloom.operators.sampling import fold_id
from creditloom.session import fresh_path
from creditloom.sources.sinks import in_name_order, materialize, release


@dataclass(frozen=True)
class Boosting:
    """Settings of a boosted-tree model; the defaults are those of the refactored variant."""

    depth: int = 5
    rounds: int = 1500
    step: float = 0.02
    rows: float = 0.8
    columns: float = 0.8
    min_leaf: int = 300
    seed: int = 2017
    tolerance: float = 0.0

    def params(self) -> dict:
        return {
            "maxDepth": self.depth,
            "maxIter": self.rounds,
            "stepSize": self.step,
            "subsamplingRate": self.rows,
            "featureSubsetStrategy": str(self.columns),
            "minInstancesPerNode": self.min_leaf,
            "seed": self.seed,
        }


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features")


def fit_regressor(
    df: DataFrame, features: list[str], settings: Boosting, validation: str | None = None
) -> PipelineModel:
    """Fit on all rows, or stop early on the rows flagged by a boolean ``validation`` column."""
    more = [validation] if validation else []
    return fit_assembled(assembled(df, features, "label", *more), features, settings, validation)


def assembled(df: DataFrame, features: list[str], *more: str) -> DataFrame:
    """A stored stage of the feature vectors and ``more`` columns.

    Every pass of a fit would read and assemble the columns again otherwise, and a fit passes several times.
    """
    picked = _assembler(features).transform(df).select("features", *more)
    return _kept(picked, fresh_path(df.sparkSession, "assembled"))


def _kept(df: DataFrame, path: str) -> DataFrame:
    """A stored stage that is read in the same order each time it is made, so that fits repeat for a seed."""
    materialize(df.sparkSession, lambda: df, path)
    return in_name_order(df.sparkSession, path)


def fit_assembled(
    rows: DataFrame, features: list[str], settings: Boosting, validation: str | None = None
) -> PipelineModel:
    """As ``fit_regressor``, on rows that are ``assembled`` already; several fits can share them."""
    stop = {"validationIndicatorCol": validation, "validationTol": settings.tolerance} if validation else {}
    return PipelineModel([_assembler(features), _regressor(settings, "label", **stop).fit(rows)])


def _regressor(settings: Boosting, label: str, **more) -> GBTRegressor:
    return GBTRegressor(labelCol=label, featuresCol="features", predictionCol="pred", **settings.params() | more)


def rounds_with_patience(errors: list[float], patience: int) -> int:
    """The best round of a series of validation errors, as a run that stops ``patience`` rounds after its best finds it."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def joined_trees(spark: SparkSession, trees: list, weights: list[float]) -> GBTRegressionModel:
    """One boosted model of single trees and their weights."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    made = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    sizes = gateway.new_array(gateway.jvm.double, len(trees))
    for k, (tree, weight) in enumerate(zip(trees, weights)):
        made[k], sizes[k] = tree._java_obj, float(weight)
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("gbtr")
    model = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, made, sizes))
    return model.setFeaturesCol("features").setPredictionCol("pred")


def fit_with_patience(
    df: DataFrame, features: list[str], settings: Boosting, validation: str, patience: int = 100, block: int = 25
) -> tuple[PipelineModel, int]:
    """Boost on the unflagged rows until the flagged ones have not been predicted better for ``patience`` rounds.

    Spark's own stopping ends at the first round whose error rises, and its boosting cannot be continued. So the first
    ``patience`` rounds are one boosting and later ones are fitted one by one: each is a tree on what the model so far leaves over, as in Spark's boosting, where the first
    tree counts fully and each later one, fitted to twice what is left (the slope of the squared error), by the step. After every ``block`` rounds the held-out errors of all of them come
    from one pass, and what is left over is written to the shared folder, which cuts the lineage; a lost executor
    costs at most a block. Rows that are ``assembled`` already are taken as they are. Returns the model up to its best round, and that round, from 1. No held-out row, or one
    round only, leaves nothing to choose: then all rounds are kept.
    """
    if patience < 1 or block < 1:
        raise ValueError("patience and block are at least one round")
    spark, assembler = df.sparkSession, _assembler(features)
    path = fresh_path(spark, "boosting")
    vectors = df if "features" in df.columns else assembler.transform(df)
    picked = vectors.select("features", F.col("label").alias("rest"), F.col(validation).alias("held"))
    rows = _kept(picked, path)
    judged = not rows.where("held").isEmpty()
    trees, weights, errors = [], [], []
    while True:
        train, start = rows.where("not held"), len(trees)
        if not trees:
            # No run ends before its patience is over, so the first rounds are one fit of Spark's own.
            first = _regressor(settings, "rest", maxIter=min(patience, settings.rounds)).fit(train)
            trees, weights = list(first.trees), list(first.treeWeights)
        else:
            for _ in range(min(block, settings.rounds - start)):
                left = train
                if len(trees) > start:
                    so_far = joined_trees(spark, trees[start:], weights[start:])
                    left = so_far.transform(train).withColumn("rest", F.col("rest") - F.col("pred")).drop("pred")
                trees.append(_one_tree(left.withColumn("rest", 2 * F.col("rest")), settings, len(trees)))
                weights.append(settings.step)
        added = joined_trees(spark, trees[start:], weights[start:])
        if judged:
            errors += _errors_by_round(added, rows.where("held"))
        best = rounds_with_patience(errors, patience) if judged else len(trees)
        if len(trees) >= settings.rounds or (judged and len(trees) - best >= patience):
            break
        after = fresh_path(spark, "boosting")
        next_rows = added.transform(rows).select("features", (F.col("rest") - F.col("pred")).alias("rest"), "held")
        rows = _kept(next_rows, after)
        release(spark, path)
        path = after
    release(spark, path)
    return PipelineModel([assembler, joined_trees(spark, trees[:best], weights[:best])]), best


def _one_tree(rows: DataFrame, settings: Boosting, number: int):
    """A tree on a sample of rows and columns, drawn anew each round."""
    params = settings.params()
    for boosting_only in ("maxIter", "stepSize"):
        del params[boosting_only]
    single = RandomForestRegressor(
        labelCol="rest", featuresCol="features", numTrees=1, bootstrap=False, **params | {"seed": settings.seed + number}
    )
    return single.fit(rows).trees[0]


def _errors_by_round(added: GBTRegressionModel, held: DataFrame) -> list[float]:
    """Mean squared error after each round of a block, from one pass."""
    return added.evaluateEachIteration(held.withColumnRenamed("rest", "label"), "squared")


@dataclass(frozen=True)
class FoldedModel:
    models: list[PipelineModel]
    out_of_fold: DataFrame  # uid, fold, label, pred


def fit_folds(
    matrix: DataFrame, settings: Boosting, folds: int = 5, seed: int = 2017, patience: int = 100, parallelism: int = 5
) -> FoldedModel:
    """One model per fold, each stopped with patience on its own fold and judged on it.

    The fits run side by side, ``parallelism`` at a time; each is a series of distributed jobs over the stored matrix.
    """
    features = feature_columns(matrix)
    spark = matrix.sparkSession
    numbered = fill_zero(matrix).withColumn("fold", fold_id(seed, folds))
    rows = assembled(numbered, features, KEY, "fold", "label")

    def fit(k: int) -> PipelineModel:
        marked = rows.withColumn("_validate", F.col("fold") == k)
        return fit_with_patience(marked, features, settings, "_validate", patience)[0]

    with ThreadPool(min(parallelism, folds)) as pool:
        models = pool.map(inheritable_thread_target(spark)(fit), range(folds))
    judged = [
        model.stages[-1].transform(rows.where(F.col("fold") == k)).select(KEY, "fold", "label", "pred")
        for k, model in enumerate(models)
    ]
    return FoldedModel(models, reduce(DataFrame.unionByName, judged))


def fold_rmse(folded: FoldedModel) -> DataFrame:
    """RMSE per fold, and their mean in the row without a fold."""
    per_fold = folded.out_of_fold.groupBy("fold").agg(
        F.sqrt(F.avg(squared_error("pred", "label"))).alias("rmse")
    )
    mean = per_fold.agg(F.avg("rmse").alias("rmse")).select(F.lit(None).cast("int").alias("fold"), "rmse")
    return per_fold.unionByName(mean)


def mean_of_models(models: list[PipelineModel], scoring: DataFrame, adjust=lambda p: p) -> DataFrame:
    """Mean over models of their (adjusted) predictions, as one pass without a shuffle."""
    scored = models[0].stages[0].transform(fill_zero(scoring))
    names = [f"_pred_{k}" for k in range(len(models))]
    for name, model in zip(names, models):
        scored = model.stages[-1].transform(scored).withColumnRenamed("pred", name)
    return scored.select(KEY, mean([adjust(F.col(n)) for n in names]).alias("pred"))


def predict_folds(folded: FoldedModel, scoring: DataFrame) -> DataFrame:
    """Mean prediction of the fold models for every user to score."""
    return mean_of_models(folded.models, scoring)


def importance(model: PipelineModel, features: list[str], top: DataFrame) -> DataFrame:
    """Features by falling importance. Their number is that of the columns, not of the rows."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(features, weights)]
    ranked = top.sparkSession.createDataFrame(rows, "feature string, importance double")
    return ranked.orderBy(F.desc("importance"), "feature")


def grid_search(
    matrix: DataFrame, settings: Boosting, grid: dict[str, list], folds: int = 5, parallelism: int = 2
) -> tuple[PipelineModel, DataFrame]:
    """Cross-validated RMSE of every parameter combination; the best is refitted on all rows."""
    features = feature_columns(matrix)
    filled = fill_zero(matrix).withColumn("fold", fold_id(settings.seed, folds))
    trees = GBTRegressor(labelCol="label", featuresCol="features", predictionCol="pred", **settings.params())
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(trees.getParam(name), values)
    combinations = builder.build()
    search = CrossValidator(
        estimator=Pipeline(stages=[_assembler(features), trees]),
        estimatorParamMaps=combinations,
        evaluator=RegressionEvaluator(labelCol="label", predictionCol="pred", metricName="rmse"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=settings.seed,
    ).fit(filled)
    rows = [
        (*[float(c[trees.getParam(n)]) for n in grid], float(score))
        for c, score in zip(combinations, search.avgMetrics)
    ]
    schema = ", ".join(f"{n} double" for n in grid) + ", rmse double"
    return search.bestModel, matrix.sparkSession.createDataFrame(rows, schema)


def fit_borrow_classifier(matrix: DataFrame, settings: Boosting) -> PipelineModel:
    """Will the user borrow at all next month."""
    features = feature_columns(matrix)
    target = fill_zero(matrix).withColumn("label", binarised(F.col("label")))
    trees = GBTClassifier(labelCol="label", featuresCol="features", **settings.params())
    return Pipeline(stages=[_assembler(features), trees]).fit(target)


def borrow_probability(model: PipelineModel, matrix: DataFrame) -> DataFrame:
    """Probability of borrowing and the decision at one half, next to the true class if known."""
    scored = model.transform(fill_zero(matrix))
    p = F.get(vector_to_array("probability"), 1)
    kept = [binarised(F.coalesce("label", F.lit(0.0))).alias("label")] if "label" in matrix.columns else []
    return scored.select(KEY, *kept, p.alias("probability"), decided(p).alias("pred"))


def fit_cohort_classifier(matrix: DataFrame, settings: Boosting) -> PipelineModel:
    """Which of the four cohorts a user belongs to: one classifier against the rest per cohort."""
    features = feature_columns(matrix)
    trees = GBTClassifier(labelCol="label2", featuresCol="features", **settings.params())
    one_vs_rest = OneVsRest(classifier=trees, labelCol="label2", featuresCol="features", predictionCol="pred")
    return Pipeline(stages=[_assembler(features), one_vs_rest]).fit(fill_zero(matrix))


def two_model_predictions(
    borrowers: DataFrame, others: DataFrame, score_borrowers: DataFrame, score_others: DataFrame,
    settings: Boosting,
) -> DataFrame:
    """Separate models for users with and without loans, each scoring its own population."""

    def one(train: DataFrame, score: DataFrame, model_id: int) -> DataFrame:
        features = [c for c in feature_columns(train) if c in score.columns]
        model = fit_regressor(fill_zero(train), features, settings)
        scored = model.transform(fill_zero(score))
        return scored.select(KEY, F.lit(model_id).cast("bigint").alias("model"), clamped(F.col("pred")).alias("pred"))

    return one(borrowers, score_borrowers, 1).unionByName(one(others, score_others, 2))


def blend(models: list[PipelineModel], scoring: DataFrame) -> DataFrame:
    """Mean of the clamped predictions of several models."""
    return mean_of_models(models, scoring, clamped)
