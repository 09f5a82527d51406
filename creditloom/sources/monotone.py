"""Times computed from stored ones, and the stored range that a window of computed times comes from.

A window on a computed column cannot reach the scan, which knows stored columns only. Where the computation never turns time back,
a window is a range of stored times, and that range can: it is pushed to the files, and fewer rows are joined and moved.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Retimed:
    """Whole seconds since ``origin``, times ``stretch`` and divided by ``squeeze`` (towards zero), counted from ``base``."""

    base: int
    origin: int
    squeeze: int = 1
    stretch: int = 1

    def __post_init__(self) -> None:
        if self.squeeze < 1 or self.stretch < 1:
            raise ValueError("only positive factors keep the order of times")

    def of(self, col: str) -> Column:
        return F.timestamp_seconds(
            F.expr(f"{self.base} + ((unix_timestamp({col}) - {self.origin}) * {self.stretch}) div {self.squeeze}")
        )

    def least_second(self, day: date) -> int:
        """The first stored second whose computed time is at or after the start of a day."""
        wanted = (day - _EPOCH.date()).days * 86400 - self.base
        # Division towards zero: up to zero, a quotient covers what lies above the one before it.
        product = wanted * self.squeeze if wanted > 0 else (wanted - 1) * self.squeeze + 1
        return self.origin - (-product // self.stretch)

    def least(self, day: date) -> datetime:
        """That second as a time; the first or last time there is if it lies beyond."""
        try:
            return _EPOCH + timedelta(seconds=self.least_second(day))
        except OverflowError:
            return datetime.max if self.least_second(day) > 0 else datetime.min

    def within(self, df: DataFrame, col: str, start: date, end: date) -> DataFrame:
        """Rows whose computed time lies in [start, end), by the stored column ``col``, a time without zone."""
        low, high = (F.expr(f"timestamp_ntz'{self.least(day)}'") for day in (start, end))
        return df.where((F.col(col) >= low) & (F.col(col) < high))
