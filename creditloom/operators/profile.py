"""Looking at data: describe, value counts, first rows, feature dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.operators.quantiles import exact_quantiles, quantiles_of, value_table

QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, std, min, quartiles and max of a column, as (``stat``, ``value``) rows.

    The quartiles are exact, which Spark's own ``summary`` does not promise.
    """
    moments = df.agg(
        F.count(value).cast("double").alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    )
    stats = moments.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("value")) for c in moments.columns]))
    )
    quartiles = exact_quantiles(df, value, list(QUARTILES)).select(
        F.concat(F.round(F.col("prob") * 100).cast("int"), F.lit("%")).alias("stat"),
        F.col("quantile").alias("value"),
    )
    return stats.unionByName(quartiles)


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in but]


def describe_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The eight statistics of every numeric column, as (``column``, ``stat``, ``value``) rows.

    The frame is read once, into how often each column has each value; everything else is read off that table. A column
    without values has a count of zero and no other statistic. NaN counts as missing.
    """
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, stat string, value double")
    placed, n, v = value_table(df, columns), F.col("_n"), F.col("_v")
    sums = placed.groupBy("_c").agg(
        F.sum("_n").cast("double").alias("count"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    # The mean first, then distances from it: a difference of two large sums would lose the small deviations.
    off = v - F.col("mean")
    spread = placed.join(sums.select("_c", "mean"), "_c").groupBy("_c").agg(
        F.sqrt(F.try_divide(F.sum(off * off * n), F.nullif(F.sum(n) - 1, F.lit(0)))).alias("std")
    )
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "_c int, column string")
    whole = names.join(sums, "_c", "left").join(spread, "_c", "left").fillna(0.0, ["count"])
    kinds = ("count", "mean", "std", "min", "max")
    moments = whole.select("column", F.inline(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(k).alias("value")) for k in kinds])))
    quartiles = F.array(*[F.struct(F.lit(_percent(p)).alias("stat"), F.lit(p).alias("prob")) for p in QUARTILES])
    wanted = names.select("_c", "column", F.inline(quartiles))
    found = wanted.join(quantiles_of(placed, list(QUARTILES)), ["_c", "prob"], "left")
    return moments.unionByName(found.select("column", "stat", F.col("quantile").alias("value")))


def _percent(prob: float) -> str:
    return f"{round(100 * prob)}%"


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("cols", F.lit(len(df.columns)))


def top_rows(df: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(by).limit(n)


def feature_dictionary(df: DataFrame) -> dict[int, str]:
    """Position to column name, from the schema alone."""
    return dict(enumerate(df.columns))
