"""Prediction quality, each as one global aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.operators.fused import KEY


def squared_error(pred: str, label: str) -> Column:
    gap = F.col(pred) - F.col(label)
    return gap * gap


def rmse(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    mse = F.avg(squared_error(pred, label))
    return df.agg(F.count("*").alias("n"), mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def confusion(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Counts per (label, pred) pair."""
    return df.groupBy(label, pred).agg(F.count("*").alias("n"))


def class_confusion(df: DataFrame, classes: int, pred: str = "pred", label: str = "label") -> DataFrame:
    """Counts of every pair of the classes 0 .. classes-1, those that do not occur included, in one global aggregate."""
    pairs = [(y, p) for y in range(classes) for p in range(classes)]
    counts = df.agg(
        *(F.count(F.when((F.col(label) == y) & (F.col(pred) == p), 1)).alias(f"n_{y}_{p}") for y, p in pairs)
    )
    cells = [
        F.struct(F.lit(y).cast("bigint").alias("label"), F.lit(p).cast("bigint").alias("pred"), F.col(f"n_{y}_{p}").alias("n"))
        for y, p in pairs
    ]
    return counts.select(F.inline(F.array(*cells)))


def binary_metrics(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Accuracy, precision, recall, F1, the four confusion counts and the class counts."""
    p, y = F.col(pred) == 1, F.col(label) == 1
    counts = df.agg(
        F.count(F.when(p & y, 1)).alias("tp"),
        F.count(F.when(p & ~y, 1)).alias("fp"),
        F.count(F.when(~p & y, 1)).alias("fn"),
        F.count(F.when(~p & ~y, 1)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counts.select(
        "tp", "fp", "fn", "tn",
        (F.col("tp") + F.col("fn")).alias("label_1"),
        (F.col("fp") + F.col("tn")).alias("label_0"),
        (F.col("tp") + F.col("fp")).alias("pred_1"),
        (F.col("fn") + F.col("tn")).alias("pred_0"),
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def mean_prediction(predictions: DataFrame, pred: str = "pred") -> DataFrame:
    """Average of several predictions per user."""
    return predictions.groupBy(KEY).agg(F.avg(pred).alias(pred))
