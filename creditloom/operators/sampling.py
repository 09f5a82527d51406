"""Deterministic samples, splits and folds from a hash of the user id.

The hash is md5 of ``uid|seed``, so the same rows are drawn on any cluster, in any
partitioning, after any retry, and by any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.fused import KEY

BUCKET_DIGITS = 4  # hexadecimal: 65,536 buckets per stratum


def hash_text(seed: int, key: str = KEY) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def hash_number(seed: int, digits: int = 8, key: str = KEY) -> Column:
    return F.conv(F.substring(hash_text(seed, key), 1, digits), 16, 10).cast("bigint")


def fold_id(seed: int, folds: int = 5, key: str = KEY) -> Column:
    """Fold 0 .. folds-1 of a key; stateless, so no shuffle."""
    return F.pmod(hash_number(seed, key=key), F.lit(folds)).cast("int")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in hash order, by a distributed sort."""
    return df.orderBy(hash_text(seed), KEY)


def sample_flags(
    keys: DataFrame,
    seed: int,
    fraction: float | None = None,
    size: int | None = None,
    stratum: str | None = None,
    flag: str = "sampled",
    bucket_digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Mark an exact sample without replacement among unique keys: a fraction or a size per stratum.

    Of each stratum the rows with the smallest hashes are taken. Ranking a stratum
    as a whole would put it into one task, so rows are ranked within hash buckets,
    which are even by construction, and bucket totals (a bounded table) say how many
    rows come before each bucket.
    """
    if (fraction is None) == (size is None):
        raise ValueError("give either a fraction or a size")
    bounds = [stratum] if stratum else []
    hashed = keys.withColumns({"_hash": hash_text(seed), "_bucket": hash_number(seed, bucket_digits)})
    place = F.row_number().over(Window.partitionBy(*bounds, "_bucket").orderBy("_hash", KEY))
    placed = hashed.withColumn("_place", place)
    # The last place of a bucket is its size, and is read off the same exchange.
    totals = placed.groupBy(*bounds, "_bucket").agg(F.max("_place").alias("_n"))
    by_bucket = Window.partitionBy(*bounds or [F.lit(0)])
    if size is not None:
        quota = F.lit(size)
    else:
        quota = F.floor(F.sum("_n").over(by_bucket) * F.lit(fraction))
    before = by_bucket.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *bounds,
        "_bucket",
        quota.alias("_quota"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    return (
        placed.join(totals, [*bounds, "_bucket"])
        .withColumn(flag, F.col("_before") + F.col("_place") <= F.col("_quota"))
        .select(*keys.columns, flag)
    )
