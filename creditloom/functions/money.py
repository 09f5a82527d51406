"""Money: the log-5 storage encoding, prices, discounts and instalments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.spec import FeatureSpec

BASE = 5.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_exact(x: Column | str) -> Column:
    """Stored value to money: 5^x - 1."""
    return F.pow(F.lit(BASE), _col(x)) - 1


def decode_rounded(x: Column | str) -> Column:
    """Stored value to whole money units, ties to even."""
    return F.rint(decode_exact(x))


def encode(x: Column | str) -> Column:
    """Money or count to log base 5 of x + 1; NULL at or below -1."""
    return F.log(BASE, _col(x) + 1)


def net_price(price: Column | str, qty: Column | str, discount: Column | str) -> Column:
    """Price times quantity less discount, not below zero; NULL inputs stay NULL."""
    net = _col(price) * _col(qty) - _col(discount)
    return F.when(net < 0, 0.0).otherwise(net)


def discount_rate(discount: Column | str, paid: Column | str) -> Column:
    """Share of the list price that was discounted; nothing bought counts as 0."""
    return F.coalesce(F.try_divide(_col(discount), _col(discount) + _col(paid)), F.lit(0.0))


def installment_due(amount: Column, plannum: Column, loan_time: Column, spec: FeatureSpec) -> Column:
    """Instalment falling due in the target month.

    A single-instalment loan taken before the last observed month is already repaid.
    """
    repaid = (plannum == 1) & (loan_time < F.lit(spec.last_month_start))
    return F.when(repaid, 0.0).otherwise(F.try_divide(amount, plannum.cast("double")))


def over_limit(total: Column, limit: Column) -> Column:
    """How far a monthly total is above the limit; negative when below."""
    return total - limit


def raised_limit(limit: Column, largest_loan: Column) -> Column:
    """The limit a user must have by now: the larger of limit and largest loan."""
    return F.greatest(limit, largest_loan)


def at_most(pred: Column | str, cap: Column | str) -> Column:
    """Cap a prediction; a missing cap leaves it alone."""
    return F.least(_col(pred), _col(cap))
