"""Events of each table, decoded and placed relative to the anchor.

Filters on time are on stored columns, so they reach the scan; columns a
feature group does not use are pruned from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions import clock, money
from creditloom.operators.fused import KEY
from creditloom.sources.tables import Tables
from creditloom.spec import FeatureSpec


def _placed(df: DataFrame, time: str, spec: FeatureSpec) -> DataFrame:
    is_date = dict(df.dtypes)[time] == "date"
    days = clock.age_days_of_date(time, spec.anchor) if is_date else clock.age_days(time, spec.anchor)
    placed = df.withColumns({"slot": clock.month_slot(time, spec), "days": days})
    return placed.withColumn("weeks", clock.weeks_of("days"))


def loan_events(tables: Tables, spec: FeatureSpec, rounded: bool = True) -> DataFrame:
    """Loans in the window with decoded ``amount``."""
    decode = money.decode_rounded if rounded else money.decode_exact
    loans = tables.during("loan", spec.start, spec.anchor).withColumn("amount", decode("loan_amount"))
    if spec.amount_band:
        low, high = spec.amount_band
        loans = loans.where((F.col("amount") > low) & (F.col("amount") <= high))
    loans = loans.select(
        KEY,
        "loan_time",
        F.col("plannum"),
        "amount",
        clock.hour_bucket("loan_time").alias("bucket"),
        money.installment_due(F.col("amount"), F.col("plannum"), F.col("loan_time"), spec).alias("due"),
    )
    return _placed(loans, "loan_time", spec)


def click_events(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Clicks in the window."""
    clicks = tables.during("click", spec.start, spec.anchor).select(
        KEY, "click_time", "pid", "param", clock.hour_bucket("click_time").alias("bucket")
    )
    return _placed(clicks, "click_time", spec)


def order_events(tables: Tables, spec: FeatureSpec, filled: bool = True) -> DataFrame:
    """Purchases in the window with the price ``paid`` and the ``saved`` discount.

    ``filled`` reads missing inputs as 0 and rounds decoded money; otherwise money
    is exact, and a purchase with a missing input has no paid price.
    """
    return _placed(priced(tables.during("order", spec.start, spec.anchor), filled), "buy_time", spec)


def priced(orders: DataFrame, filled: bool) -> DataFrame:
    if filled:
        price, saved = (money.decode_rounded(F.coalesce(F.col(c), F.lit(0.0))) for c in ("price", "discount"))
        qty = F.coalesce(F.col("qty"), F.lit(0))
    else:
        price, saved = money.decode_exact("price"), money.decode_exact("discount")
        qty = F.col("qty")
    return orders.select(KEY, "buy_time", money.net_price(price, qty, saved).alias("paid"), saved.alias("saved"))
