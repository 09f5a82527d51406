"""Wide matrices: full outer joins of the groups."""

from __future__ import annotations

from oracle import groups as g
from oracle.base import Anchor, log5

LOG_FULL = [
    "cost_weight", "real_price", "buy_weights", "loan_amount", "click_weights", "click_min", "click_max",
    "click_mean", "click_sum", "click_std", "per_times_loan", "repay", "repay_cost", "loan_min", "loan_max",
    "loan_mean", "loan_sum", "loan_std", "limit", "buy_min", "buy_mean", "buy_max", "buy_sum", "buy_std",
]
LOG_NO_LOAN = [
    "cost_weight", "real_price", "buy_weights", "click_weights", "click_min", "click_max", "click_mean",
    "click_sum", "click_std", "buy_min", "buy_mean", "buy_max", "buy_sum", "buy_std",
]
LOG_COHORT = ["cost_weight", "real_price", "click_weights"]


def outer(parts: list[g.Group]) -> g.Group:
    """Full outer join on uid; every column keeps its name."""
    source = f"({g.select(parts[0])}) t0"
    cols = list(parts[0][0])
    for i, part in enumerate(parts[1:], 1):
        source += f"\nfull join ({g.select(part)}) t{i} using (uid)"
        cols += list(part[0])
    return {c: f'"{c}"' for c in cols}, source


def training(a: Anchor) -> g.Group:
    return outer([g.user(a), g.loan(a), g.loan_windows(a), g.click(a), g.order(a), g.label(a)])


def scoring(a: Anchor) -> g.Group:
    return outer([g.user(a), g.loan(a), g.loan_windows(a), g.click(a), g.order(a)])


def logged(group: g.Group, names: list[str]) -> g.Group:
    """Gaps to 0, then some columns to the log scale."""
    cols, source = group
    filled = {n: f"coalesce({e},0)" for n, e in cols.items()}
    return {n: (log5(e) if n in names else e) for n, e in filled.items()}, source


def _loan_side(a: Anchor, before: list[g.Group], after: list[g.Group], names: list[str]) -> g.Group:
    """Groups with the sum of what is owed and was spent, which needs both sides."""
    first = outer(before)
    cols = dict(first[0])
    cols["repay_cost"] = "repay+cost_weight"
    return logged(outer([(cols, first[1]), *after]), names)


def original(a: Anchor, label: bool) -> g.Group:
    before = [g.original_user(a), g.original_order(a), g.original_order_periods(a), g.original_loan(a),
              g.original_loan_periods(a)]
    after = [g.original_click(a), g.original_click_periods(a), g.union(a), g.interactive_all(a)]
    return _loan_side(a, before, after + ([g.label(a)] if label else []), LOG_FULL)


def model1(a: Anchor, label: bool = True) -> g.Group:
    before = [g.original_user(a), g.original_order(a), g.original_order_periods(a), g.original_loan(a),
              g.original_loan_periods(a)]
    return _loan_side(a, before, [g.original_click(a), g.original_click_periods(a), *([g.label(a)] if label else [])],
                      LOG_FULL)


def model2(a: Anchor, label: bool = True) -> g.Group:
    parts = [g.original_user(a), g.original_order(a), g.original_order_periods(a), g.original_click(a),
             g.original_click_periods(a), g.union(a), *([g.label(a)] if label else [])]
    return logged(outer(parts), LOG_NO_LOAN)


def cohort(a: Anchor, label: bool) -> g.Group:
    known = outer([g.original_user(a), g.original_order(a), g.original_click(a), g.original_click_periods(a)])
    if not label:
        return logged(outer([known, g.union(a)]), LOG_COHORT)
    cols = {**known[0]}
    source = f"({g.select(known)}) k"
    for alias, part in (("u", g.union(a)), ("c", ({"label2": "cohort"}, "(select * from cohorts where cohort>0)"))):
        source += f"\nleft join ({g.select(part)}) {alias} using (uid)"
        cols |= {c: f'"{c}"' for c in part[0]}
    return logged((cols, source), LOG_COHORT)


# Cohorts against the month after the anchor, by set operations.
COHORTS = """
    with b as (select distinct uid from v_loan
               where loan_time >= timestamp '{start}' and loan_time < timestamp '{day}'),
         t as (select distinct uid from v_loan
               where loan_time >= timestamp '{day}' and loan_time < timestamp '{day}' + interval 1 month)
    select uid, 1 as cohort from (from t except from b)
    union all select uid, 2 from (from b except from t)
    union all select uid, 3 from (from b intersect from t)
    union all select uid, 0 from (select uid from v_user except (from b union from t))"""


def cohorts(a: Anchor) -> str:
    return COHORTS.format(start=a.start, day=a.day)
