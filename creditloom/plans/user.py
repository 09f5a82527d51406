"""User attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions import clock, money
from creditloom.functions.coding import one_hot
from creditloom.operators.fused import KEY
from creditloom.sources.tables import Tables
from creditloom.spec import FeatureSpec


def _days_active(spec: FeatureSpec) -> F.Column:
    return clock.age_days_of_date(F.col("active_date"), spec.anchor)


def attributes(spec: FeatureSpec, days: F.Column) -> list[F.Column]:
    """Age, limit, whole weeks since activation, and sex indicators; ``days`` is the number of days since activation."""
    sexes = one_hot("sex", "sex", spec.sexes)
    return [
        F.col("age").cast("double").alias("age"),
        money.decode_rounded("limit").alias("limit"),
        clock.weeks_of(days).cast("double").alias("a_date"),
        *[c.alias(n) for n, c in sexes.items()],
    ]


def user_features(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """The attributes at the anchor."""
    return tables.user.select(KEY, *attributes(spec, _days_active(spec)))


def original_user_features(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Unrounded limit, fractional weeks since activation, sex as a number."""
    return tables.user.select(
        KEY,
        F.col("age").cast("double").alias("age"),
        F.col("sex").cast("double").alias("sex"),
        money.decode_exact("limit").alias("limit"),
        clock.fractional_weeks(_days_active(spec)).alias("a_date"),
    )
