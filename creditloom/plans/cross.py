"""Features across loans, purchases and clicks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import clock, money
from creditloom.functions.coding import equal_width_code
from creditloom.functions.rowwise import greatest, least, spread, total, zero
from creditloom.operators.fused import KEY, Measures, fill_zero, outer_merge, summarise
from creditloom.operators.windows import filled_months, filled_weeks, month_sums, week_spread, week_sums
from creditloom.plans.events import click_events, loan_events, order_events, priced
from creditloom.sources.artefacts import Artefacts, build_rules
from creditloom.sources.tables import Tables
from creditloom.spec import FeatureSpec, add_months

LEVELS = ("loan", "paid", "clicks")
# Names of the table pairs and triples, and of the month slots.
UNION_SETS = {"lp": ("loan", "paid"), "lc": ("loan", "clicks"), "pc": ("paid", "clicks"), "lpc": LEVELS}
PRODUCT_SETS = {"lo": ("loan", "paid"), "co": ("clicks", "paid"), "lc": ("loan", "clicks"), "lco": LEVELS}
SLOT_NAMES = ("first", "two", "three")


def slot_name(slot: int) -> str:
    """Name of an observation month by its position; longer windows go on by number."""
    return SLOT_NAMES[slot - 1] if slot <= len(SLOT_NAMES) else f"month_{slot}"


def _fit_months(spec: FeatureSpec) -> list:
    start, end = spec.fit_range
    months = []
    while start < end:
        months.append(start)
        start = add_months(start, 1)
    return months


def stacked_events(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Loans, purchases and clicks of the fitting months on one pile: uid, time, and what each adds."""
    start, end = spec.fit_range

    def pile(df: DataFrame, time: str, **adds: Column) -> DataFrame:
        levels = [adds.get(n, F.lit(None).cast("double")).alias(n) for n in LEVELS]
        return df.select(KEY, F.to_date(time).alias("day"), *levels)

    loans, orders, clicks = (tables.during(name, start, end) for name in ("loan", "order", "click"))
    paid = priced(orders, filled=False)
    return (
        pile(loans, "loan_time", loan=money.decode_rounded("loan_amount"))
        .unionByName(pile(paid, "buy_time", paid=F.col("paid")))
        .unionByName(pile(clicks, "click_time", clicks=F.when(F.col("click_time").isNotNull(), 1.0)))
    )


def _levels_by_user(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Encoded monthly levels of every user, NULL for months without any event."""
    aggs: dict[str, Column] = {}
    for k, month in enumerate(_fit_months(spec)):
        here = clock.between("day", month, add_months(month, 1))
        aggs[f"_n_{k}"] = F.count(F.when(here, 1))
        for level in LEVELS:
            aggs[f"_{level}_{k}"] = F.sum(F.when(here, F.col(level)))
    outs = {
        f"{level}_{k}": F.when(F.col(f"_n_{k}") > 0, money.encode(zero(F.col(f"_{level}_{k}"))))
        for k in range(len(_fit_months(spec)))
        for level in LEVELS
    }
    levels = summarise(stacked_events(tables, spec), Measures(aggs, outs))
    # True for every row, as each user here has an event. It keeps all months in the grouping even
    # where only some are used later, so that the edges and the features share one exchange.
    return levels.where(F.greatest(*[F.col(n) for n in outs]) >= 0)


def _bounds(months: int) -> list[Column]:
    """Smallest and largest level over all users and months."""
    bounds = []
    for level in LEVELS:
        cols = [F.col(f"{level}_{k}") for k in range(months)]
        bounds += [F.min(least(cols)).alias(f"{level}_low"), F.max(greatest(cols)).alias(f"{level}_high")]
    return bounds


def _edges(levels: DataFrame, months: int) -> Column:
    """The bounds as a scalar subquery. It reads the same grouped rows as the main query, whose exchange is reused."""
    return levels.agg(*_bounds(months)).select(F.struct("*")).scalar()


def fitted_edges(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """The smallest and largest level per measure over the fitting months, as one row to be stored with a model."""
    return _levels_by_user(tables, spec).agg(*_bounds(len(_fit_months(spec))))


def _edges_contract(spec: FeatureSpec) -> dict:
    return {"levels": list(LEVELS), "rules": build_rules(spec)}


def store_edges(store: Artefacts, tables: Tables, spec: FeatureSpec) -> None:
    """Fit the edges in training and store them for every build by the same rules."""
    store.put_table("union-edges", _edges_contract(spec), fitted_edges(tables, spec), fitted_on=spec.fit_range)


def stored_edges(store: Artefacts, spec: FeatureSpec) -> DataFrame:
    """The edges that a training run stored; LookupError if none were for these rules."""
    return store.table("union-edges", _edges_contract(spec))


def edge_drift(tables: Tables, spec: FeatureSpec, edges: DataFrame) -> DataFrame:
    """What has become of the levels since edges were fitted, one row per measure.

    Stored and present edges, the number of levels in the fitting months of ``spec``, and how many of them lie below and
    above the stored edges, where codes no longer tell them apart.
    """
    months = len(_fit_months(spec))
    values = [
        F.struct(F.lit(level).alias("level"), F.col(f"{level}_{k}").alias("value"))
        for k in range(months)
        for level in LEVELS
    ]
    bounds = [
        F.struct(F.lit(level).alias("level"), F.col(f"{level}_low").alias("low"), F.col(f"{level}_high").alias("high"))
        for level in LEVELS
    ]
    found = _levels_by_user(tables, spec).select(F.inline(F.array(*values))).where(F.col("value").isNotNull())
    return (
        found.join(F.broadcast(edges.select(F.inline(F.array(*bounds)))), "level")  # one row per measure
        .groupBy("level", "low", "high")
        .agg(
            F.min("value").alias("low_now"),
            F.max("value").alias("high_now"),
            F.count("*").alias("n"),
            F.count_if(F.col("value") < F.col("low")).alias("below"),
            F.count_if(F.col("value") > F.col("high")).alias("above"),
        )
    )


def user_codes(tables: Tables, spec: FeatureSpec, edges: DataFrame | None = None) -> DataFrame:
    """Equal-width codes 1..4 per user, month and level; NULL for months without any event.

    ``edges`` are stored ones; without, they are fitted on the same months.
    """
    months = len(_fit_months(spec))
    levels = _levels_by_user(tables, spec)
    fitted = _edges(levels, months) if edges is None else edges.select(F.struct("*")).scalar()
    with_edges = levels.withColumn("_edges", fitted)
    return with_edges.select(
        KEY,
        *[
            equal_width_code(
                F.col(f"{level}_{k}"), F.col(f"_edges.{level}_low"), F.col(f"_edges.{level}_high")
            ).alias(f"{level}_{k}")
            for k in range(months)
            for level in LEVELS
        ],
    )


def union_codes(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """The codes in long form: one row per user and month with any event."""
    entries = [
        F.struct(
            F.lit(month.month).cast("bigint").alias("month"),
            *[F.col(f"{level}_{k}").alias(f"{level}_code") for level in LEVELS],
        )
        for k, month in enumerate(_fit_months(spec))
    ]
    long = user_codes(tables, spec).select(KEY, F.inline(F.array(*entries)))
    return long.where(F.col("loan_code").isNotNull())


def union_features(tables: Tables, spec: FeatureSpec, edges: DataFrame | None = None) -> DataFrame:
    """Sums of the codes of table pairs and triples in each observation month, by stored or by newly fitted edges."""
    fit = _fit_months(spec)
    missing = [str(spec.month_starts[slot - 1]) for slot in spec.slots if spec.month_starts[slot - 1] not in fit]
    if missing:
        raise ValueError(f"the fit range does not cover the observed months {missing}")
    outs: dict[str, Column] = {}
    for slot in spec.slots:
        k = fit.index(spec.month_starts[slot - 1])
        for name, levels in UNION_SETS.items():
            outs[f"{name}_{slot_name(slot)}"] = total([zero(F.col(f"{level}_{k}")) for level in levels])
    sums = user_codes(tables, spec, edges).select(KEY, *[c.alias(n) for n, c in outs.items()])
    return sums.select("*", *[c.alias(n) for n, c in spread("union", [F.col(n) for n in outs]).items()])


def _months_and_weeks(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Monthly and weekly sums of the three tables, one struct per table, NULL where a user has no events."""
    value = {"loan": "amount", "paid": "paid", "clicks": "1D"}
    events = {
        "loan": loan_events(tables, spec),
        "paid": order_events(tables, spec, filled=False),
        "clicks": click_events(tables, spec),
    }
    sides = {}
    for level in LEVELS:
        outs = {f"m{k}": c for k, c in enumerate(filled_months(level, spec), start=1)}
        outs |= {f"w{k}": c for k, c in enumerate(filled_weeks(level, spec), start=1)}
        measures = month_sums(value[level], level, spec) + week_sums(value[level], level, spec)
        sides[level] = summarise(events[level], measures | outs)
    return outer_merge(sides, unpack=False)


def _has(level: str) -> Column:
    return F.col(level).isNotNull()


def _in_two_tables() -> Column:
    met = None
    for a, b in combinations(LEVELS, 2):
        both = _has(a) & _has(b)
        met = both if met is None else met | both
    return met


def _month_products(spec: FeatureSpec) -> dict[str, Column]:
    return _products("", [f"m{k}" for k in spec.slots], money.encode)


def _week_products(spec: FeatureSpec) -> dict[str, Column]:
    return _products("week_", [f"w{k}" for k in range(1, len(spec.week_ends) + 1)], lambda c: c)


def _products(prefix: str, fields: list[str], transform) -> dict[str, Column]:
    """Products of the levels of table pairs and triples; 0 where one of the tables is missing."""
    outs = {}
    for name, levels in PRODUCT_SETS.items():
        for k, field in enumerate(fields, start=1):
            product = None
            for level in levels:
                factor = transform(F.col(f"{level}.{field}"))
                product = factor if product is None else product * factor
            outs[f"{prefix}{name}_{k}"] = zero(product)
    return outs


def _select(df: DataFrame, outs: dict[str, Column], when: Column | None = None) -> DataFrame:
    """Compute products, then their statistics; both 0 where ``when`` does not hold."""
    names = list(outs)
    step = df.select("*", *[c.alias(n) for n, c in outs.items()])
    stats = spread("interactive", [F.col(n) for n in names])
    return step.select(
        KEY,
        *names,
        *[(c if when is None else F.when(when, c).otherwise(0.0)).alias(n) for n, c in stats.items()],
    )


def interactive_month_features(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Products of encoded monthly levels, for users seen in at least two tables."""
    both = _months_and_weeks(tables, spec).where(_in_two_tables())
    return _select(both, _month_products(spec))


def interactive_features(tables: Tables, spec: FeatureSpec) -> DataFrame:
    """Monthly products, weekly statistics per table and weekly products.

    Users of a single table have 0 throughout the products and their statistics.
    The two sets of product statistics are told apart by _x (months) and _y (weeks).
    """
    base = _months_and_weeks(tables, spec)
    monthly, weekly = _month_products(spec), _week_products(spec)
    weeks = {}
    for level, prefix in zip(LEVELS, ("loan", "order", "click")):
        cols = [F.col(f"{level}.w{k}") for k in range(1, len(spec.week_ends) + 1)]
        weeks |= {n: F.when(_has(level), c) for n, c in spread(f"{prefix}_weeks", cols).items()}
    step = base.select(
        "*", *[c.alias(n) for n, c in {**monthly, **weeks, **weekly}.items()]
    )

    def stats(products: dict[str, Column], suffix: str) -> dict[str, Column]:
        found = spread("interactive", [F.col(n) for n in products])
        return {n + suffix: F.when(_in_two_tables(), c) for n, c in found.items()}

    x, y = stats(monthly, "_x"), stats(weekly, "_y")
    full = step.select(
        KEY,
        *monthly,
        *[c.alias(n) for n, c in x.items()],
        *weeks,
        *weekly,
        *[c.alias(n) for n, c in y.items()],
    )
    return fill_zero(full)
