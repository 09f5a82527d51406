"""Behavioural credit features as Spark jobs.

The package turns user, loan, click and purchase tables into one wide row per
user before an anchor date, and trains and scores Spark ML models on it.
"""

from creditloom.sources.tables import Tables
from creditloom.spec import SCORE, TRAIN, FeatureSpec

__all__ = ["FeatureSpec", "SCORE", "TRAIN", "Tables"]
