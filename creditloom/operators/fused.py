"""Grouping and merging by user with as few shuffles as possible.

``summarise`` evaluates any number of feature groups of one table in a single
``groupBy``: one scan, one shuffle of map-side combined rows. A user with a
third of all events therefore reaches the reducer as one row per map task.

``outer_merge`` is the full outer join of those results. A chain of full outer
joins would move the growing row again at every step, because its output has no
known partitioning. Here each side is packed into one struct column, the sides
are unioned and merged by the key. The sides are already hash-partitioned by the
key, and the union keeps that partitioning, so the merge adds no exchange.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "uid"


@dataclass(frozen=True)
class Measures:
    """A feature group over one table.

    ``aggs`` are aggregates over its events. ``outs`` are the feature columns,
    computed from the aggregates. Aggregates shared by groups carry the same name.
    """

    aggs: dict[str, Column]
    outs: dict[str, Column] = field(default_factory=dict)

    def __add__(self, other: Measures) -> Measures:
        return Measures(joined(self.aggs, other.aggs), joined(self.outs, other.outs))

    def __or__(self, outs: dict[str, Column]) -> Measures:
        return Measures(self.aggs, joined(self.outs, outs))


def joined(some: dict[str, Column], more: dict[str, Column]) -> dict[str, Column]:
    """Named expressions together. A name may come twice only for the same expression."""
    clashes = [n for n in some.keys() & more.keys() if str(some[n]) != str(more[n])]
    if clashes:
        raise ValueError(f"different expressions under one name: {sorted(clashes)}")
    return {**some, **more}


def aggregate(events: DataFrame, measures: Measures, *keys: str) -> DataFrame:
    """The raw aggregates of a group, one row per key."""
    return events.groupBy(*(keys or (KEY,))).agg(*[c.alias(n) for n, c in measures.aggs.items()])


def summarise(events: DataFrame, *groups: Measures, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """All feature groups of one table in one grouping."""
    measures = reduce(lambda a, b: a + b, groups)
    grouped = aggregate(events, measures, *keys)
    return grouped.select(*keys, *[c.alias(n) for n, c in measures.outs.items()])


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a keyed table the way the grouped ones are."""
    return df.repartition(*(keys or (KEY,)))


def outer_merge(sides: dict[str, DataFrame], *keys: str, unpack: bool = True) -> DataFrame:
    """Full outer join of tables with one row per user, or per combination of the given keys.

    Columns a side does not have for a key are NULL. With ``unpack=False`` each
    side stays one struct column, NULL where the key is absent.
    """
    keys = keys or (KEY,)
    packed = []
    for name, df in sides.items():
        columns = ", ".join(f"`{c}`" for c in df.columns if c not in keys)
        packed.append(df.selectExpr(*keys, f"struct({columns}) as {name}"))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed)
    merged = stacked.groupBy(*keys).agg(*[F.first(name, ignorenulls=True).alias(name) for name in sides])
    return merged.select(*keys, *[f"{name}.*" for name in sides]) if unpack else merged


def fill_zero(df: DataFrame, but: tuple[str, ...] = (KEY,)) -> DataFrame:
    """NULL becomes 0 in every feature column."""
    return df.fillna(0.0, [c for c in df.columns if c not in but])


def with_replaced(df: DataFrame, cols: list[str], f: Callable[[Column], Column]) -> DataFrame:
    """Apply one expression to several columns, keeping column order."""
    return df.withColumns({c: f(F.col(c)) for c in cols})
