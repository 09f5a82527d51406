"""Exact quantiles of columns of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.session import shared_dir


def value_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """_c (position of the column), _v, _n, _slice: how often each column has each value, in bounded sorted slices; checkpointed.

    All columns go through one grouping and one range partitioning, so there is no loop over them. Values are counted before the
    shuffle; NULL and NaN are missing. The partition number, made permanent by the checkpoint, cuts each sorted column into slices.
    """
    shared_dir(df.sparkSession)
    cells = F.array(*[F.struct(F.lit(k).alias("_c"), F.col(f"`{c}`").cast("double").alias("_v")) for k, c in enumerate(columns)])
    known = df.select(F.explode(cells).alias("e")).select("e.*").where("_v is not null and not isnan(_v)")
    return (
        known.groupBy("_c", "_v")
        .agg(F.count("*").alias("_n"))
        .repartitionByRange("_c", "_v")
        .withColumn("_slice", F.spark_partition_id())
        .checkpoint()
    )


def quantiles_of(placed: DataFrame, probs: list[float]) -> DataFrame:
    """Linearly interpolated quantiles (``_c``, ``prob``, ``quantile``) of every column of a value table.

    Slice totals tell which slice holds a rank of a column, and ranks are resolved inside it, so no column is gathered.
    """
    # A row per slice and column: of a column as many as there are shuffle partitions.
    slices = placed.groupBy("_c", "_slice").agg(F.sum("_n").alias("_size"))
    column = Window.partitionBy("_c")
    slices = slices.select(
        "_c",
        "_slice",
        F.coalesce(
            F.sum("_size").over(column.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_size").over(column).alias("_total"),
    )
    within = Window.partitionBy("_c", "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("_upto", F.sum("_n").over(within)).join(slices, ["_c", "_slice"])
    last = F.col("_before") + F.col("_upto")  # 1-based rank of the last copy of a value
    first = last - F.col("_n") + 1
    picks = []
    for k, p in enumerate(probs):
        spot = F.lit(p) * (F.col("_total") - 1)  # 0-based, fractional
        low, high = F.floor(spot) + 1, F.ceil(spot) + 1
        picks += [
            F.max(F.when((first <= low) & (low <= last), F.col("_v"))).alias(f"_lo{k}"),
            F.max(F.when((first <= high) & (high <= last), F.col("_v"))).alias(f"_hi{k}"),
            F.max(spot - F.floor(spot)).alias(f"_f{k}"),
        ]
    found = ranked.groupBy("_c").agg(*picks)
    entries = [
        F.struct(
            F.lit(float(p)).alias("prob"),
            (F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * F.col(f"_f{k}")).alias("quantile"),
        )
        for k, p in enumerate(probs)
    ]
    return found.select("_c", F.inline(F.array(*entries)))


def exact_quantiles(df: DataFrame, value: str, probs: list[float]) -> DataFrame:
    """Linearly interpolated quantiles (``prob``, ``quantile``) of one column; NULL where it has no value."""
    wanted = df.sparkSession.createDataFrame([(float(p),) for p in probs], "prob double")
    return wanted.join(quantiles_of(value_table(df, [value]), probs).drop("_c"), "prob", "left")
