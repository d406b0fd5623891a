"""Speckle filters on block arrays: minimum mean square error (Lee 1980), sigma range (Lee 2009), edge-directed (Lee 1981).

Variances are taken about the mean of the very window, in a second pass, so
large values with a small spread keep their digits.  A null or NaN value counts
as absent and gives null.  Pixels are shuffled once; a block's arrays are bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from swathframe.constants import SIGMA_RANGE_90
from swathframe.operators.block_arrays import grouped
from swathframe.operators.focal import _BC, _BR, BLOCK, run_offsets, square_runs, with_halo

#: Half the window's width; a window is 7 x 7 with nine 3 x 3 parts, two pixels apart.
REACH = 3
_WINDOW = [(r, c) for r in range(-REACH, REACH + 1) for c in range(-REACH, REACH + 1)]
_PART = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
#: For each direction of change: a part on one side, as (row, column); the other side is opposite.
_SIDES = [(0, 1), (-1, 1), (-1, 0), (-1, -1)]


def half_window(side: tuple[int, int]) -> list[tuple[int, int]]:
    """Offsets on the given side of the line through the centre, the line included."""
    return [(r, c) for r, c in _WINDOW if r * side[0] + c * side[1] >= 0]


def _near(z: np.ndarray, offsets, reach: int):
    """The values at each offset from all inner pixels of ``z``, which has a margin of ``reach`` pixels."""
    h, w = z.shape[0] - 2 * reach, z.shape[1] - 2 * reach
    for r, c in offsets:
        yield z[reach + r:reach + r + h, reach + c:reach + c + w]


def _moments(z: np.ndarray, offsets, reach: int = REACH, low=-np.inf, high=np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the present values within [low, high] at ``offsets`` of each inner pixel; NaN where there is none."""
    shape = (z.shape[0] - 2 * reach, z.shape[1] - 2 * reach)
    count, mean, spread = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for x in _near(z, offsets, reach):
        there = (x >= low) & (x <= high)
        count += there
        mean += np.where(there, x, 0.0)
    count[count == 0] = np.nan
    mean /= count
    for x in _near(z, offsets, reach):
        d = x - mean
        spread += np.where((x >= low) & (x <= high), d * d, 0.0)
    return mean, spread / count


def _mmse(z: np.ndarray, mean: np.ndarray, variance: np.ndarray, noise) -> np.ndarray:
    """Estimate under multiplicative noise of relative variance ``noise``."""
    signal = np.maximum((variance - mean * mean * noise) / (1.0 + noise), 0.0)
    gain = np.minimum(np.divide(signal, variance, out=np.zeros_like(signal), where=variance > 0), 1.0)
    return mean + gain * (z - mean)


def refine(z: np.ndarray, looks: float | None) -> np.ndarray:
    """Filtered values of the inner pixels of ``z``, which has a margin of ``REACH`` pixels; absent ones are NaN."""
    inner = z[REACH:-REACH, REACH:-REACH]
    mean, variance = _moments(z, _WINDOW)
    relative = variance / (mean * mean)
    parts = {(i, j): _moments(z, [(2 * i + r, 2 * j + c) for r, c in _PART]) for i, j in _PART}
    part = {at: m for at, (m, _) in parts.items()}
    whole = ~np.isnan(sum(_near(z, _WINDOW, REACH)))  # a missing value leaves no number

    def toward(side):
        """Sum of the three parts on one side."""
        near = [at for at in _PART if at[0] * side[0] + at[1] * side[1] > 0]
        return sum(part[at] for at in near)

    change = np.stack([np.abs(toward(s) - toward((-s[0], -s[1]))) for s in _SIDES])
    direction = np.where(np.isnan(change), -1.0, change).argmax(axis=0)
    for k, side in enumerate(_SIDES):
        back = (-side[0], -side[1])
        ahead = np.abs(part[side] - part[0, 0]) <= np.abs(part[back] - part[0, 0])
        for own, at in ((side, ahead), (back, ~ahead)):
            use = whole & (direction == k) & at
            if use.any():
                m, v = _moments(z, half_window(own))
                mean, variance = np.where(use, m, mean), np.where(use, v, variance)
    if looks is None:
        small = np.sort(np.stack([v / (m * m) for m, v in parts.values()]), axis=0)[:5].mean(axis=0)
        noise = np.where(whole, small, relative)
    else:
        noise = 1.0 / looks
    return _mmse(inner, mean, variance, noise)


def _square(size: int) -> list[tuple[int, int]]:
    return run_offsets(square_runs(size // 2))


def smooth(z: np.ndarray, size: int, looks: float, reach: int) -> np.ndarray:
    """``lee_filter`` of the inner pixels of ``z``, which has a margin of ``reach`` pixels; absent ones are NaN."""
    return _mmse(z[reach:z.shape[0] - reach, reach:z.shape[1] - reach], *_moments(z, _square(size), reach), 1.0 / looks)


def _by_block(df: DataFrame, value: str, reach: int, keys, name: str, block: int, fn) -> DataFrame:
    """``df`` with ``name``: ``fn`` of each block's array, which has a margin of ``reach`` pixels."""
    base, groups = df.columns, [*keys, _BR, _BC]
    out = StructType([*df.schema.fields, *StructType().add(name, DoubleType()).fields])

    def run(batches):
        with np.errstate(divide="ignore", invalid="ignore"):
            for table in grouped(batches, groups):
                rows, cols = (table.column(x).to_numpy().astype(np.int64) for x in ("row", "col"))
                r, c = rows - rows.min() + reach, cols - cols.min() + reach
                z = np.full((int(r.max()) + reach + 1, int(c.max()) + reach + 1), np.nan)
                z[r, c] = pc.fill_null(table.column("_focal"), np.nan).to_numpy()
                got = fn(z)[r - reach, c - reach]
                own = (rows // block == table.column(_BR).to_numpy()) & (cols // block == table.column(_BC).to_numpy())
                kept = table.select(base).append_column(name, pa.array(got, pa.float64(), mask=np.isnan(got)))
                yield from kept.filter(pa.array(own)).to_batches()

    halo = with_halo(df.withColumn("_focal", F.col(value).cast("double")), reach, keys, block)
    return halo.sortWithinPartitions(*groups).mapInArrow(run, out)


def lee_filter(df: DataFrame, value: str, size: int = 9, looks: float = 1.0, keys=("tile_id",),
               name: str = "filtered", block: int = BLOCK) -> DataFrame:
    """Minimum-mean-square-error filter for multiplicative noise over the present pixels of a square window (Lee 1980)."""
    reach = size // 2
    return _by_block(df, value, reach, keys, name, block, lambda z: smooth(z, size, looks, reach))


def lee_sigma_filter(df: DataFrame, value: str, size: int = 9, target: int = 5, looks: float = 1.0,
                     low: float | None = None, high: float | None = None, std: float | None = None,
                     keys=("tile_id",), name: str = "filtered", block: int = BLOCK) -> DataFrame:
    """Lee filter over the neighbours inside the sigma range of an a-priori mean (Lee et al. 2009).

    The a-priori mean is the plain filter over the ``target`` window; the
    estimate uses only window values in [low, high] times that mean, and is the
    a-priori mean where there is none.
    """
    low = SIGMA_RANGE_90["low"] if low is None else low
    high = SIGMA_RANGE_90["high"] if high is None else high
    std = SIGMA_RANGE_90["std"] if std is None else std
    reach = max(size, target) // 2

    def fn(z):
        inner, prior = z[reach:z.shape[0] - reach, reach:z.shape[1] - reach], smooth(z, target, looks, reach)
        mean, variance = _moments(z, _square(size), reach, low * prior, high * prior)
        estimate = np.where(np.isnan(mean), prior, _mmse(inner, mean, variance, std * std))
        return np.where(np.isnan(inner), np.nan, estimate)

    return _by_block(df, value, reach, keys, name, block, fn)


def refined_lee_filter(df: DataFrame, value: str, looks: float | None = 1.0, keys=("tile_id",), name: str = "filtered",
                       block: int = BLOCK) -> DataFrame:
    """Minimum-mean-square-error filter over the half of a 7 x 7 window that lies on the pixel's side of an edge.

    The nine 3 x 3 parts of the window tell the direction of the strongest
    change; of the two halves along it the one whose part is nearer to the
    middle part is used (ties: the first direction, the right or upper side).
    The relative variance of the noise is ``1 / looks``, or with ``looks=None``
    the mean of the five least among the nine parts.  Where a pixel of the
    window is absent the present ones are used as one window, and ``looks=None``
    returns their mean.
    """
    return _by_block(df, value, REACH, keys, name, block, lambda z: refine(z, looks))
