"""The five inputs derived from a star-schema data set with an events table.

Orders become loans, events clicks, line items purchases and customers users,
with their times squeezed into 2016-08-01 .. 2016-12-03. Everything is a
projection except purchases, which pick up the buyer from their order.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.money import decode_rounded, encode
from creditloom.session import use_utc
from creditloom.sources.monotone import Retimed
from creditloom.sources.tables import Tables

# Epoch seconds of 2016-08-01, 1995-01-01 and 2024-01-01, and the time squeeze.
WINDOW_EPOCH = 1470009600
ORDER_EPOCH = 788918400
EVENT_EPOCH = 1704067200
ORDER_SQUEEZE = 5
EVENT_STRETCH = 4
LABEL_MONTH = (date(2016, 11, 1), date(2016, 12, 1))

OF_ORDERS = Retimed(WINDOW_EPOCH, ORDER_EPOCH, squeeze=ORDER_SQUEEZE)
OF_EVENTS = Retimed(WINDOW_EPOCH, EVENT_EPOCH, stretch=EVENT_STRETCH)


# The columns used of each table; a stated schema spares a job that would read it off a file.
COLUMNS = {
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _floored(col: F.Column) -> F.Column:
    return encode(F.floor(col))


def users(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("uid"),
        (F.lit(18) + F.col("c_nationkey")).alias("age"),
        (F.lit(1) + F.col("c_nationkey") % 2).alias("sex"),
        F.expr("date_sub(date'2016-08-01', cast((c_custkey * 37) % 500 as int))").alias("active_date"),
        _floored(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 60).alias("limit"),
    )


def loans(orders: DataFrame) -> DataFrame:
    level = F.substring("o_orderpriority", 1, 1)
    return orders.select(
        F.col("o_custkey").alias("uid"),
        OF_ORDERS.of("o_orderdate").alias("loan_time"),
        _floored(F.col("o_totalprice")).alias("loan_amount"),
        F.when(level == "2", 3).when(level == "3", 6).when(level == "4", 12).otherwise(1).alias("plannum"),
    )


def clicks(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("uid"),
        OF_EVENTS.of("ts").alias("click_time"),
        F.when(kind == "click", 1)
        .when(kind == "error", 2)
        .when(kind == "purchase", 3)
        .when(kind == "signup", 4)
        .otherwise(5)
        .alias("pid"),
        (F.get_json_object("props", "$.k").cast("int") % 48 + 1).alias("param"),
    )


def purchases(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    buyers = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("uid"))
    discount = F.col("l_extendedprice") * F.col("l_discount") * 12
    return lineitem.join(buyers, "l_orderkey").select(
        "uid",
        F.to_date(OF_ORDERS.of("l_shipdate")).alias("buy_time"),
        _floored(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.when(F.col("l_linenumber") != 7, _floored(discount)).alias("discount"),
    )


def loan_sums(loan: DataFrame) -> DataFrame:
    """Next-month totals per user, the label of the training anchor."""
    start, end = (F.lit(day) for day in LABEL_MONTH)
    month = loan.where((F.col("loan_time") >= start) & (F.col("loan_time") < end))
    return month.groupBy("uid").agg(encode(F.sum(decode_rounded("loan_amount"))).alias("loan_sum"))


def open_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The five inputs on top of the Parquet tables in ``sf_dir``."""
    use_utc(spark)

    customer, orders, lineitem, events = (scan(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "events"))

    def loans_of(start: date, end: date) -> DataFrame:
        return loans(OF_ORDERS.within(orders, "o_orderdate", start, end))

    return Tables(
        user=users(customer),
        loan=loans(orders),
        click=clicks(events),
        order=purchases(lineitem, orders),
        loan_sum=loan_sums(loans_of(*LABEL_MONTH)),
        ranged={
            "loan": loans_of,
            "click": lambda start, end: clicks(OF_EVENTS.within(events, "ts", start, end)),
            "order": lambda start, end: purchases(OF_ORDERS.within(lineitem, "l_shipdate", start, end), orders),
        },
    )
