"""The five input tables: schemas, CSV and Parquet readers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.clock import between

USER = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("sex", T.IntegerType()),
        T.StructField("active_date", T.DateType()),
        T.StructField("limit", T.DoubleType()),
    ]
)
LOAN = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("loan_time", T.TimestampType()),
        T.StructField("loan_amount", T.DoubleType()),
        T.StructField("plannum", T.IntegerType()),
    ]
)
CLICK = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("click_time", T.TimestampType()),
        T.StructField("pid", T.IntegerType()),
        T.StructField("param", T.IntegerType()),
    ]
)
ORDER = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("buy_time", T.DateType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("qty", T.IntegerType()),
        T.StructField("discount", T.DoubleType()),
    ]
)
LOAN_SUM = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("loan_sum", T.DoubleType()),
    ]
)

SCHEMAS = {"user": USER, "loan": LOAN, "click": CLICK, "order": ORDER, "loan_sum": LOAN_SUM}


#: The time of each event table.
TIMES = {"loan": "loan_time", "click": "click_time", "order": "buy_time"}


@dataclass(frozen=True)
class Tables:
    """The inputs of a feature build. Every member is lazy.

    Tables with computed times also have a function in ``ranged`` that opens them for a range of days, from fewer stored rows.
    """

    user: DataFrame
    loan: DataFrame
    click: DataFrame
    order: DataFrame
    loan_sum: DataFrame
    ranged: dict[str, Callable[[date, date], DataFrame]] = field(default_factory=dict)

    def during(self, name: str, start: date, end: date) -> DataFrame:
        """The events of one table in [start, end)."""
        events = self.ranged[name](start, end) if name in self.ranged else getattr(self, name)
        return events.where(between(TIMES[name], start, end))


def read_table(spark: SparkSession, path: str, schema: T.StructType, format: str = "csv") -> DataFrame:
    """Scan one table with a fixed schema.

    CSV files carry a header row and are matched to the schema by name, so column
    order and extra columns do not matter; nothing is inferred from the data.
    """
    if format != "csv":
        return spark.read.schema(schema).format(format).load(path)
    text = spark.read.option("header", True).csv(path)
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def read_tables(spark: SparkSession, paths: dict[str, str], format: str = "csv") -> Tables:
    """Open all five tables; ``paths`` maps table name to file or folder."""
    return Tables(**{name: read_table(spark, paths[name], SCHEMAS[name], format) for name in SCHEMAS})
