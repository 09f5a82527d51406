"""Indicator, threshold and bin codes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def indicator(condition: Column) -> Column:
    """1 when true, 0 when false or NULL."""
    return F.when(condition, 1.0).otherwise(0.0)


def one_hot(prefix: str, col: Column | str, vocabulary: Iterable[int]) -> dict[str, Column]:
    """One indicator per value of a fixed vocabulary, so the schema never depends on data."""
    col = F.col(col) if isinstance(col, str) else col
    return {f"{prefix}_{value}": indicator(col == value) for value in vocabulary}


def at_least_zero(x: Column) -> Column:
    return indicator(x >= 0)


def equal_width_code(x: Column, low: Column, high: Column) -> Column:
    """Code 1..4 by equal-width bins between low and high; upper edges belong to the bin."""
    width = high - low
    return (
        F.when(x <= low + width * 0.25, 1.0)
        .when(x <= low + width * 0.50, 2.0)
        .when(x <= low + width * 0.75, 3.0)
        .when(x.isNotNull(), 4.0)
    )


def clamped(pred: Column) -> Column:
    return F.when(pred <= 0, 0.0).otherwise(pred)


def folded(pred: Column) -> Column:
    return F.abs(pred)


def decided(pred: Column, threshold: float = 0.5) -> Column:
    return indicator(pred >= threshold)


def binarised(label: Column) -> Column:
    """1 for any non-zero label; NULL stays NULL."""
    return F.when(label != 0, 1.0).when(label == 0, 0.0)
