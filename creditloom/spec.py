"""What one feature build looks at: the anchor date and everything relative to it."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date


def add_months(day: date, months: int) -> date:
    """First-of-month arithmetic; anchors are always the first of a month."""
    index = day.year * 12 + day.month - 1 + months
    return date(index // 12, index % 12 + 1, day.day)


@dataclass(frozen=True)
class FeatureSpec:
    """Parameters of a feature build.

    ``anchor`` is the first day of the month to predict; the observation window
    is the ``n_months`` calendar months before it.
    """

    anchor: date
    n_months: int = 3

    # Window edges, periods and vocabularies the features are named after.
    day_edges: tuple[int, ...] = (0, 3, 7, 14, 21, 28, 35, 42, 49, 56, 63, 70, 77, 84)
    periods: tuple[int, ...] = (1, 2, 3, 5, 7, 9, 15, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90)
    week_ends: tuple[int, ...] = (7, 14, 21, 28)
    sexes: tuple[int, ...] = (1, 2)
    plannums: tuple[int, ...] = (1, 3, 6, 12)
    pids: tuple[int, ...] = tuple(range(1, 11))
    params: tuple[int, ...] = tuple(range(1, 49))

    # Hyperbolic decay of the original variant: numerator / (epsilon + days / scale).
    epsilon: float = 1e-6
    loan_scale_days: float = 30.0
    order_numerator: float = 1.0

    # The original variant rounds decoded loan amounts only when it scores.
    round_original_loans: bool = False

    # Optional loan amount band (low, high]; off by default.
    amount_band: tuple[float, float] | None = None

    # Whole weeks of the window; by default as many as fit into it.
    weeks: int | None = None

    # Range of whole months over which the equal-width code edges are fitted.
    fit_from: date | None = None
    fit_to: date | None = None

    def __post_init__(self) -> None:
        if self.anchor.day != 1:
            raise ValueError("the anchor must be the first day of a month")
        if self.n_months < 1:
            raise ValueError("the window needs at least one month")

    @property
    def start(self) -> date:
        return add_months(self.anchor, -self.n_months)

    @property
    def window_weeks(self) -> int:
        return (self.anchor - self.start).days // 7 if self.weeks is None else self.weeks

    @property
    def month_starts(self) -> list[date]:
        """Start of each observation month, followed by the anchor."""
        return [add_months(self.start, k) for k in range(self.n_months + 1)]

    @property
    def slots(self) -> list[int]:
        """Positions of the observation months, oldest first, from 1."""
        return list(range(1, self.n_months + 1))

    @property
    def target_end(self) -> date:
        return add_months(self.anchor, 1)

    @property
    def last_month_start(self) -> date:
        return add_months(self.anchor, -1)

    @property
    def fit_range(self) -> tuple[date, date]:
        return (self.fit_from or self.start, self.fit_to or self.anchor)

    def with_(self, **changes) -> FeatureSpec:
        return replace(self, **changes)


_FIT = {"fit_from": date(2016, 8, 1), "fit_to": date(2016, 12, 1)}

TRAIN = FeatureSpec(anchor=date(2016, 11, 1), **_FIT)
SCORE = FeatureSpec(
    anchor=date(2016, 12, 1), order_numerator=0.1, round_original_loans=True, **_FIT
)
