"""Vegetation indices and differences (pixel-wise Columns).

``bands`` maps R, G, B, NIR to column names, so the same index reads the
pre-event, post-event or predicted bands.  NumPy's inf/NaN become NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathframe.constants import EVI
from swathframe.functions.common import as_col, ratio


def normalized_difference(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    return ratio(a - b, a + b)


def ndvi(bands: dict, lo=None, hi=None) -> Column:
    """(nir-red)/(nir+red), 0 where the sum is 0; optionally min-max scaled by the tile's range."""
    red, nir = as_col(bands["R"]), as_col(bands["NIR"])
    den = nir + red
    value = F.when(den == 0, F.lit(0.0)).otherwise(ratio(nir - red, den))
    if lo is None:
        return value
    return ratio(value - as_col(lo), as_col(hi) - as_col(lo))


def evi(bands: dict, params: dict | None = None) -> Column:
    p = params or EVI
    red, nir, blue = as_col(bands["R"]), as_col(bands["NIR"]), as_col(bands["B"])
    return F.lit(p["G"]) * ratio(nir - red, nir + p["C1"] * red - p["C2"] * blue + p["L"])


def msavi(bands: dict) -> Column:
    red, nir = as_col(bands["R"]), as_col(bands["NIR"])
    b = 2 * nir + 1
    radicand = b * b - 8 * (nir - red)
    return F.when(radicand >= 0, (b - F.sqrt(radicand)) / F.lit(2.0))


def bai(bands: dict, form: str = "product") -> Column:
    """Burned-area index; ``form="sum"`` gives the published variant."""
    red, nir = as_col(bands["R"]), as_col(bands["NIR"])
    a, b = (F.lit(0.1) - red), (F.lit(0.06) - nir)
    if form == "product":
        den = (a * a) * (b * b)
    elif form == "sum":
        den = (a * a) + (b * b)
    else:
        raise ValueError(f"form must be 'product' or 'sum', not {form!r}")
    return ratio(F.lit(1.0), den)


def vegetation_index(name: str, bands: dict, **options) -> Column:
    """Dispatch by name; ``identity`` passes a single band through."""
    builders = {"ndvi": ndvi, "evi": evi, "msavi": msavi, "bai": bai}
    if name == "identity":
        return as_col(bands["value"])
    if name not in builders:
        raise ValueError(f"unknown vegetation index {name!r}")
    return builders[name](bands, **options)


def vi_difference(name: str, pre: dict, post: dict, **options) -> Column:
    return vegetation_index(name, pre, **options) - vegetation_index(name, post, **options)


def vi_relative_difference(name: str, pre: dict, post: dict, **options) -> Column:
    before = vegetation_index(name, pre, **options)
    return ratio(before - vegetation_index(name, post, **options), F.sqrt(F.abs(before)))
