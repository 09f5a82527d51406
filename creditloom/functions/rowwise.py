"""Statistics across the columns of one row, as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def total(cols: Sequence[Column]) -> Column:
    return reduce(add, cols)


def least(cols: Sequence[Column]) -> Column:
    return F.least(*cols) if len(cols) > 1 else cols[0]


def greatest(cols: Sequence[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def mean(cols: Sequence[Column]) -> Column:
    return total(cols) / F.lit(float(len(cols)))


def sample_std(cols: Sequence[Column]) -> Column:
    """Sample standard deviation of non-null columns; NULL for a single one."""
    if len(cols) < 2:
        return F.lit(None).cast("double")
    m = mean(cols)
    squares = total([(c - m) * (c - m) for c in cols])
    return F.sqrt(squares / F.lit(float(len(cols) - 1)))


def inverse_dispersion(std: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + std)


def spread(prefix: str, cols: Sequence[Column]) -> dict[str, Column]:
    """Min, max, sum, mean and inverse dispersion of non-null columns, named by prefix."""
    return {
        f"{prefix}_min": least(cols),
        f"{prefix}_max": greatest(cols),
        f"{prefix}_sum": total(cols),
        f"{prefix}_mean": mean(cols),
        f"{prefix}_std": inverse_dispersion(sample_std(cols)),
    }


def present_stats(cols: Sequence[Column]) -> dict[str, Column]:
    """Statistics over the non-null ones among a few columns.

    All of it is closed-form per row: sorting at most a handful of monthly values
    replaces a second grouping with a median aggregate.
    """
    n = total([F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    s = total([zero(c) for c in cols])
    m = F.try_divide(s, n.cast("double"))
    squares = total([F.when(c.isNotNull(), (c - m) * (c - m)).otherwise(0.0) for c in cols])
    ordered = F.sort_array(F.array(*cols), asc=False)  # NULLs last
    low, high = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return {
        "min": least(cols),
        "mean": m,
        "max": greatest(cols),
        "std": F.sqrt(F.try_divide(squares, F.when(n > 1, (n - 1).cast("double")))),
        "median": F.when(n > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2),
        "count": n.cast("double"),
        "sum": F.when(n > 0, s),
    }


def shares(cols: dict[str, Column]) -> dict[str, Column]:
    """Each column as a share of their sum."""
    whole = total(list(cols.values()))
    return {name: F.try_divide(c.cast("double"), whole) for name, c in cols.items()}
