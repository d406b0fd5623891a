"""Value rescaling: ten stat-based methods, decibels, fixed scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathframe.constants import MASK_SCALE, REFLECTANCE_SCALE, SAR_SCALE
from swathframe.functions.common import as_col, clip, ratio


def _half(lo: Column, hi: Column) -> Column:
    return (hi - lo) / F.lit(2.0)


#: Formulas over (value, min, max).
BY_RANGE = {
    "normalization": lambda x, lo, hi: ratio(x - lo, hi - lo),
    "normalization_r": lambda x, lo, hi: x * (hi - lo) + lo,
    "normalization11": lambda x, lo, hi: 2 * ratio(x - lo, hi - lo) - 1,
    "normalization11_r": lambda x, lo, hi: (x + 1) / F.lit(2.0) * (hi - lo) + lo,
    "center_norm11": lambda x, lo, hi: ratio(x - _half(lo, hi), _half(lo, hi)),
    "center_norm11_r": lambda x, lo, hi: x * _half(lo, hi) + _half(lo, hi),
}
#: Formulas over (value, mean, standard deviation).
BY_SPREAD = {
    "centering": lambda x, mean, std: x - mean,
    "centering_r": lambda x, mean, std: x + mean,
    "standardization": lambda x, mean, std: (clip(ratio(x - mean, std), F.lit(-1.0), F.lit(1.0)) + 1) / F.lit(2.0),
    "standardization11": lambda x, mean, std: ratio(x - mean, std),
}


def rescale(method: str, value, s1, s2) -> Column:
    """Apply one method; ``s1, s2`` are the two numbers that ``statistic_for`` names."""
    formulas = BY_RANGE if statistic_for(method) == "min_max" else BY_SPREAD
    return formulas[method](as_col(value), as_col(s1), as_col(s2))


def reverse_rescale(method: str, value, s1, s2) -> Column:
    """Exact inverse for the three reversible methods."""
    if method not in ("normalization11_r", "normalization_r", "centering_r"):
        raise ValueError(f"no reverse function for {method!r}")
    return rescale(method, value, s1, s2)


def statistic_for(method: str) -> str:
    if method in BY_RANGE:
        return "min_max"
    if method in BY_SPREAD:
        return "mean_std"
    raise ValueError(f"unknown rescaling method {method!r}")


def to_db(value) -> Column:
    """10 log10(x); NULL where x <= 0."""
    x = as_col(value)
    return F.when(x > 0, 10 * F.log10(x))


def from_db(value) -> Column:
    return F.pow(F.lit(10.0), as_col(value) / F.lit(10.0))


def scale_array(value, kind: str, maximum=None, sar_scale: float = SAR_SCALE) -> Column:
    """Storage type -> working value: optical /10000, SAR /scale, mask /5, other /maximum."""
    x = as_col(value)
    if kind == "optical":
        return x / F.lit(REFLECTANCE_SCALE)
    if kind == "sar":
        return x / F.lit(float(sar_scale))
    if kind == "mask":
        return x / F.lit(MASK_SCALE)
    if kind == "max":
        return ratio(x, maximum)
    raise ValueError(f"unknown kind {kind!r}")


def threshold_ramp(value, t0: float, t1: float) -> Column:
    """0 at t0, 1 at t1, linear and unbounded."""
    return (as_col(value) - F.lit(float(t0))) / F.lit(float(t1) - float(t0))
