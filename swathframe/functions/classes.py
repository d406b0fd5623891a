"""Pixel classes as CASE chains over half-open ranges."""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathframe.constants import (
    ASPECT_CLASSES, ASPECT_FLAT, N_LAND_CLASSES, SEVERITY_CLASSES, SLOPE_CLASSES,
)
from swathframe.functions.common import as_col


def range_class(value, ranges, default: int) -> Column:
    """First class whose ``lo <= v < hi`` holds. ``ranges`` is a list of (class id, lo, hi)."""
    v = as_col(value)
    chain = None
    for class_id, lo, hi in ranges:
        hit = (v >= F.lit(float(lo))) & (v < F.lit(float(hi)))
        chain = F.when(hit, F.lit(class_id)) if chain is None else chain.when(hit, F.lit(class_id))
    return chain.otherwise(F.lit(default))


def _reaches(value: Column, bound: float, digits: int) -> Column:
    """``bround(value, digits) >= bound`` as a plain comparison.

    Decimal rounding per row is slow.  The rounded value reaches the bound
    exactly when the value reaches the tie just below the smallest rounded
    number that does; half-even rounding takes the tie up only to an even digit.
    """
    step = Decimal(1).scaleb(-digits)
    smallest = (Decimal(repr(bound)) / step).to_integral_value(ROUND_CEILING)
    tie = F.lit(float((smallest - Decimal("0.5")) * step))
    return value >= tie if smallest % 2 == 0 else value > tie


def fire_severity(difference, classes=None) -> Column:
    """Burn class of a vegetation-index difference rounded half-even to 4 decimals, -1 if none.

    The difference is bound once: a filter on classes would otherwise compute it anew for each bound.
    """
    def chosen(v):
        chain = None
        for i, (_, lo, hi) in enumerate(classes or SEVERITY_CLASSES):
            hit = _reaches(v, float(lo), 4) & ~_reaches(v, float(hi), 4)
            chain = F.when(hit, F.lit(i)) if chain is None else chain.when(hit, F.lit(i))
        return chain.otherwise(F.lit(-1))

    return F.get(F.transform(F.array(as_col(difference)), chosen), F.lit(0))


def slope_class(slope, classes=None) -> Column:
    table = classes or SLOPE_CLASSES
    return range_class(slope, [(i, lo, hi) for i, (_, lo, hi) in enumerate(table)], 1)


def aspect_class(aspect) -> Column:
    """Flat is 0, North 1, then clockwise to NorthWest 8; no match is 1."""
    v = as_col(aspect)
    flat_value, flat_id = ASPECT_FLAT
    sectors = range_class(v, [(i, lo, hi) for _, i, lo, hi in ASPECT_CLASSES], 1)
    return F.when(v == flat_value, F.lit(flat_id)).otherwise(sectors)


def agreement(label, predicted, threshold: float = 1) -> Column:
    return F.abs(as_col(label) - as_col(predicted)) < F.lit(threshold)


def not_confused(label, predicted, label_class: int, predicted_class: int) -> Column:
    """False exactly where ``label_class`` was taken for ``predicted_class``."""
    return (as_col(label) != label_class) | (as_col(predicted) != predicted_class)


def recode_where(mask, value, code: int = N_LAND_CLASSES) -> Column:
    return F.when(as_col(mask), F.lit(code)).otherwise(as_col(value))
