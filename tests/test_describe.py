import math
import random

import numpy as np
import pandas as pd
from conftest import plan_of
from pyspark.sql import functions as F

from creditloom.operators import profile, quantiles


def test_a_frame_is_described_as_pandas_does(spark):
    rng = random.Random(4)
    rows = []
    for k in range(500):
        rows.append((k, rng.choice([None, 1.0, 2.0, 2.5]), rng.gauss(1e9, 1e-3), None, float("nan") if k % 3 else k / 7, "text", k % 2 == 0))
    columns = "k long, `few.values` double, far double, empty double, gaps double, name string, flag boolean"
    df = spark.createDataFrame(rows, columns).repartition(5)
    got = {(r.column, r.stat): r.value for r in profile.describe_frame(df).collect()}
    names = ["k", "few.values", "far", "empty", "gaps"]
    assert {c for c, _ in got} == set(names) and len(got) == 8 * len(names)
    want = pd.DataFrame([r[:5] for r in rows], columns=names).astype(float).describe()
    for name in names:
        for stat in want.index:
            a, b = got[name, stat], want.loc[stat, name]
            assert (a is None and math.isnan(b)) or np.isclose(a, b, rtol=1e-12, atol=1e-6 if stat == "std" else 1e-12), (name, stat, a, b)


def test_single_values_ties_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 7, 5), (1.0, None, 5)], "a double, b int, c int")
    got = {(r.column, r.stat): r.value for r in profile.describe_frame(df).collect()}
    assert got["a", "std"] == 0 and got["b", "std"] is None and got["b", "50%"] == 7 and got["c", "count"] == 2
    none = {(r.column, r.stat): r.value for r in profile.describe_frame(df.where("false")).collect()}
    assert len(none) == 24 and all(v == (0 if s == "count" else None) for (_, s), v in none.items())
    assert profile.describe_frame(df.select(F.lit("x").alias("x"))).count() == 0


def test_many_columns_share_one_scan_and_few_exchanges(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(50).select(*[(F.col("id") * k).cast("double").alias(f"c{k}") for k in range(40)]).write.parquet(path)
    wide = spark.read.parquet(path)
    one, many = (plan_of(quantiles.quantiles_of(quantiles.value_table(wide, cols), [0.5])) for cols in (["c1"], wide.columns))
    assert one.count("Exchange") == many.count("Exchange")
    assert [r.value for r in profile.describe_frame(wide).where("column = 'c39' and stat = '50%'").collect()] == [24.5 * 39]


def test_single_column_quantiles_keep_their_rows(spark):
    df = spark.createDataFrame([(float(k),) for k in range(5)], "v double")
    assert {r.prob: r.quantile for r in quantiles.exact_quantiles(df, "v", [0.0, 0.5, 1.0]).collect()} == {0.0: 0, 0.5: 2, 1.0: 4}
    assert [r.quantile for r in quantiles.exact_quantiles(df.where("false"), "v", [0.5]).collect()] == [None]
