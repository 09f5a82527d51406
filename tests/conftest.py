import sys
from datetime import date, datetime, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from creditloom.session import build_session  # noqa: E402
from creditloom.sources.tables import CLICK, LOAN, LOAN_SUM, ORDER, USER, Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    return datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc)


LOANS = [
    (1, at("2016-08-10 09:00:00"), 4.0, 1),
    (1, at("2016-09-15 22:00:00"), 5.0, 3),
    (1, at("2016-10-31 12:00:00"), 3.0, 6),
    (2, at("2016-10-02 03:00:00"), 4.0, 12),
    (3, at("2016-08-02 05:00:00"), 2.0, 1),
    (3, at("2016-08-03 05:00:00"), 2.0, 1),
    (3, at("2016-09-03 05:00:00"), 2.0, 3),
    # Outside the window: exactly at the anchor, and in the target month.
    (2, at("2016-11-01 00:00:00"), 4.0, 1),
    (4, at("2016-11-05 08:00:00"), 4.0, 1),
]
CLICKS = [
    (1, at("2016-10-30 10:00:00"), 1, 1),
    (1, at("2016-10-29 10:00:00"), 1, 1),
    (1, at("2016-10-10 01:00:00"), 2, 1),
    (9, at("2016-09-10 01:00:00"), 2, 48),
]
ORDERS = [
    (1, date(2016, 10, 20), 2.0, 2, 3.0),
    (1, date(2016, 10, 27), 3.0, 1, None),
]


@pytest.fixture(scope="session")
def tables(spark) -> Tables:
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return Tables(
        user=make([(1, 30, 2, date(2016, 7, 5), 5.0)], USER),
        loan=make(LOANS, LOAN),
        click=make(CLICKS, CLICK),
        order=make(ORDERS, ORDER),
        loan_sum=make([(4, 4.0), (2, 4.0)], LOAN_SUM),
    )


def by_uid(df) -> dict:
    return {row["uid"]: row.asDict() for row in df.collect()}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
