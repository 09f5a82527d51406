"""Who borrowed when, relative to the target month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.coding import indicator
from creditloom.operators.fused import KEY, by_key, outer_merge
from creditloom.sources.tables import Tables
from creditloom.spec import FeatureSpec

# Cohort codes.
NONE, NEW, LAPSED, RETAINED = 0, 1, 2, 3


def borrowing_flags(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Every known user with: listed as user, borrowed in window, borrowed in target month."""
    t = F.col("loan_time")
    loans = (
        tables.during("loan", spec.start, spec.target_end)
        .groupBy(KEY)
        .agg(
            F.max(indicator(t < F.lit(spec.anchor))).alias("earlier"),
            F.max(indicator(t >= F.lit(spec.anchor))).alias("target"),
        )
    )
    users = by_key(tables.user.select(KEY, F.lit(1.0).alias("listed")))
    return outer_merge({"u": users, "l": loans}).fillna(0.0, ["listed", "earlier", "target"])


def cohorts(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Cohort of every user: new, lapsed, retained, or none."""
    earlier, target = F.col("earlier") == 1, F.col("target") == 1
    code = (
        F.when(earlier & target, RETAINED).when(earlier, LAPSED).when(target, NEW).otherwise(NONE)
    )
    return borrowing_flags(tables, spec).select(KEY, code.alias("cohort"))


def cohort_labels(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Class label 1, 2 or 3 of users with any loan; others have no row."""
    return (
        cohorts(tables, spec)
        .where(F.col("cohort") != NONE)
        .select(KEY, F.col("cohort").cast("double").alias("label2"))
    )


def _position(time: str, spec: FeatureSpec) -> Column:
    months = F.year(time) * 12 + F.month(time)
    return (months - (spec.start.year * 12 + spec.start.month) + 1).cast("bigint")


def first_month(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Month of the first loan of every borrower, by its position from the window start, from 1.

    A user is a new borrower of exactly this month. The target month follows the last observed one.
    """
    t = F.col("loan_time")
    return (
        tables.during("loan", spec.start, spec.target_end)
        .groupBy(KEY)
        .agg(F.min(t).alias("_t"))
        .select(KEY, _position("_t", spec).alias("first_month"))
    )


def population_split(tables: Tables, train: FeatureSpec, score: FeatureSpec) -> DataFrame:
    """Model of each user: 1 with loans in the window, 2 without; at training and at scoring."""

    def borrowers(spec: FeatureSpec) -> DataFrame:
        return tables.during("loan", spec.start, spec.anchor).groupBy(KEY)

    sides = {
        "u": by_key(tables.user.select(KEY, F.lit(1).alias("listed"))),
        "t": borrowers(train).agg(F.lit(1).alias("train_model")),
        "s": borrowers(score).agg(F.lit(1).alias("submit_model")),
    }
    merged = outer_merge(sides)
    listed = F.col("listed") == 1

    def model(flag: str):
        return F.when(F.col(flag) == 1, 1).when(listed, 2).cast("bigint").alias(flag)

    return merged.select(KEY, model("train_model"), model("submit_model"))


def among(df: DataFrame, members: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is in a set of users."""
    return df.join(members.select(key).distinct(), key, "left_semi")


def not_among(df: DataFrame, members: DataFrame, key: str = KEY) -> DataFrame:
    return df.join(members.select(key).distinct(), key, "left_anti")
