"""Small Column helpers shared by the other modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    """A column name stays a reference; anything that is not a name or Column is a literal."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def ratio(num, den) -> Column:
    """Division whose zero denominator gives NULL (ANSI mode would raise)."""
    return F.try_divide(as_col(num), as_col(den))


def clip(value, lo, hi) -> Column:
    """Bound a value; NULL stays NULL (least/greatest alone would skip it)."""
    v = as_col(value)
    return F.when(v.isNotNull(), F.least(F.greatest(v, as_col(lo)), as_col(hi)))


def total(cols) -> Column:
    """Sum of several Columns."""
    return reduce(lambda a, b: a + b, [as_col(c) for c in cols])


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def floor_div(value, step) -> Column:
    """Integer division rounding down, also below zero."""
    return F.floor(as_col(value) / F.lit(float(step))).cast("int")


def let(value, body) -> Column:
    """Bind an expression to a name: ``body`` gets a variable, so nested reuse does not grow the plan."""
    return F.element_at(F.transform(F.array(as_col(value)), body), 1)
