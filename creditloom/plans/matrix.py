"""The wide matrices: every feature group of a user in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.fused import KEY, by_key, outer_merge
from creditloom.plans.click import click_features
from creditloom.plans.loan import finished, loan_core, loan_window_features
from creditloom.plans.order import order_features
from creditloom.plans.user import user_features
from creditloom.sources.tables import Tables
from creditloom.spec import FeatureSpec


def labels(tables: Tables) -> DataFrame:
    """The quantity to predict, as stored."""
    return tables.loan_sum.select(KEY, F.col("loan_sum").alias("label"))


def _sides(tables: Tables, spec: FeatureSpec) -> dict[str, DataFrame]:
    return {
        "users": by_key(user_features(tables, spec)),
        "loans": loan_core(tables, spec),
        "windows": loan_window_features(tables, spec),
        "clicks": click_features(tables, spec),
        "orders": order_features(tables, spec),
    }


def training_matrix(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """User, loan, window, click and order features with the label; gaps stay NULL."""
    sides = _sides(tables, spec) | {"label": by_key(labels(tables))}
    return finished(outer_merge(sides), spec)


def scoring_matrix(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """The same features at another anchor, without a label."""
    return finished(outer_merge(_sides(tables, spec)), spec)
