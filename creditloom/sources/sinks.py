"""Stored stages, prediction files and fitted models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators.fused import KEY


def materialize(spark: SparkSession, make: Callable[[], DataFrame], path: str) -> DataFrame:
    """Load a stage if it is stored, otherwise compute and store it first.

    A stage that died half way has no _SUCCESS marker; it is computed again.
    """
    if not complete(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether the writing job committed. Spark's readers hide the marker, so ask the file system."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def in_name_order(spark: SparkSession, path: str) -> DataFrame:
    """A stored stage whose files are taken in the order of their names.

    Spark deals files out by size and takes equal ones as the store happens to list them, which for a local folder is any order; fits
    that draw samples by a row's place would not repeat.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    names = sorted(status.getPath().getName() for status in listed)
    return spark.read.parquet(*[f"{path.rstrip('/')}/{name}" for name in names if name.startswith("part-")])


def release(spark: SparkSession, path: str) -> None:
    """Remove a stage that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def write_predictions(df: DataFrame, path: str) -> None:
    """Headerless two-column file: uid, pred."""
    df.select(KEY, "pred").write.mode("overwrite").option("header", False).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{KEY} bigint, pred double").option("header", False).csv(path)


def write_holdout(df: DataFrame, path: str) -> None:
    """Held-out users and their labels, with a header row."""
    df.select(KEY, "label").write.mode("overwrite").option("header", True).csv(path)


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("header", True).csv(path)
    return text.select(F.col(KEY).cast("bigint"), F.col("label").cast("double"))


def write_table(df: DataFrame, path: str) -> None:
    """An input table as CSV, in the form the readers take."""
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
