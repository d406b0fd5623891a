"""Image-quality metrics between a true and a predicted image, and score losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathframe.functions.common import total
from swathframe.operators.focal import focal_square


def _pair(band: str, suffixes) -> tuple[Column, Column]:
    return F.col(f"{band}_{suffixes[0]}"), F.col(f"{band}_{suffixes[1]}")


def _squared_errors(bands, suffixes) -> list[Column]:
    aggs = []
    for b in bands:
        t, p = _pair(b, suffixes)
        d = t.cast("float").cast("double") - p.cast("float").cast("double")
        aggs.append(F.avg(d * d).alias(f"_mse_{b}"))
    return aggs


def _mean_psnr(out: DataFrame, bands, max_value: float) -> DataFrame:
    """Adds ``psnr_<band>`` and their mean to a table of mean squared errors."""
    for b in bands:
        mse = F.col(f"_mse_{b}")
        out = out.withColumn(f"psnr_{b}", F.when(mse == 0, F.lit(100.0)).otherwise(
            20 * F.log10(F.lit(float(max_value)) / F.sqrt(mse))))
    return out.withColumn("psnr", total([F.col(f"psnr_{b}") for b in bands]) / F.lit(float(len(bands))))


def psnr(df: DataFrame, bands, max_value: float = 4095.0, suffixes=("true", "pred"), keys=("tile_id",)) -> DataFrame:
    """Per tile: signal-to-noise ratio of each band (``psnr_<band>``, 100 when equal) and their mean."""
    out = _mean_psnr(df.groupBy(*keys).agg(*_squared_errors(bands, suffixes)), bands, max_value)
    return out.select(*keys, *[f"psnr_{b}" for b in bands], "psnr")


def spectral_angle(bands, suffixes=("true", "pred")) -> Column:
    """Angle between the two spectra of a pixel; NULL when one is the zero vector."""
    pairs = [_pair(b, suffixes) for b in bands]
    dot = total([t * p for t, p in pairs])
    norm = F.sqrt(total([t * t for t, _ in pairs])) * F.sqrt(total([p * p for _, p in pairs]))
    cosine = F.try_divide(dot, norm)
    return F.when(cosine.isNotNull(), F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))


def _mean_angle(bands, suffixes) -> Column:
    """Mean angle; NULL if some pixel has none."""
    angle = spectral_angle(bands, suffixes)
    return F.when(F.count(angle) == F.count(F.lit(1)), F.avg(angle))


def sam(df: DataFrame, bands, suffixes=("true", "pred"), keys=("tile_id",), zero: str = "null") -> DataFrame:
    """Mean spectral angle per tile.

    A zero vector has no angle: by default its tile gets NULL (an undefined
    mean), ``zero="skip"`` leaves such pixels out.
    """
    out = df.select(*keys, spectral_angle(bands, suffixes).alias("_a"))
    mean = F.avg("_a")
    if zero == "null":
        mean = F.when(F.count("_a") == F.count(F.lit(1)), F.avg("_a"))
    return out.groupBy(*keys).agg(mean.alias("sam"))


def ssim(df: DataFrame, bands, data_range: float, size: int = 7, suffixes=("true", "pred"), keys=("tile_id",),
         k1: float = 0.01, k2: float = 0.03, block: int = 256) -> DataFrame:
    """Mean structural similarity per tile: uniform windows fully inside the image, mean over bands.

    All sums of all bands travel through one pair of window passes.  A window
    that lacks pixels (the border) is left out, which drops ``size // 2``
    pixels on each side.
    """
    full = size * size
    values = {}
    for b in bands:
        t, p = (c.cast("double") for c in _pair(b, suffixes))
        values.update({f"_x_{b}": t, f"_y_{b}": p, f"_xx_{b}": t * t, f"_yy_{b}": p * p, f"_xy_{b}": t * p})
    slim = df.select(*keys, "row", "col", *[c.alias(n) for n, c in values.items()], F.lit(1.0).alias("_one"))
    src = focal_square(slim.select(*keys, "row", "col", *values, "_one"),
                       {**{f"s{n}": F.col(n) for n in values}, "_full": F.col("_one")}, "sum", size // 2, keys, block)
    src = src.filter(F.col("_full") == full)
    c1, c2 = (k1 * data_range) ** 2, (k2 * data_range) ** 2
    norm = full / (full - 1)
    maps = []
    for b in bands:
        ux, uy, uxx, uyy, uxy = (F.col(f"s_{n}_{b}") / F.lit(float(full)) for n in ("x", "y", "xx", "yy", "xy"))
        vx, vy, vxy = (F.lit(norm) * (uxx - ux * ux), F.lit(norm) * (uyy - uy * uy), F.lit(norm) * (uxy - ux * uy))
        maps.append(((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux * ux + uy * uy + c1) * (vx + vy + c2)))
    return src.groupBy(*keys).agg(F.avg(total(maps) / F.lit(float(len(bands)))).alias("ssim"))


def quality_report(df: DataFrame, bands, max_value: float = 4095.0, data_range: float = 2.0,
                   with_sam: bool = False, suffixes=("true", "pred"), keys=("tile_id",)) -> DataFrame:
    """(name, value): batch means of psnr, ssim and sam (NULL unless asked for)."""
    # psnr and sam are sums over the same pixels: one aggregate; ssim needs windows and is the other.
    angle = [_mean_angle(bands, suffixes).alias("sam")] if with_sam else [F.lit(None).cast("double").alias("sam")]
    per_tile = _mean_psnr(df.groupBy(*keys).agg(*_squared_errors(bands, suffixes), *angle), bands, max_value)
    means = per_tile.agg(F.avg("psnr").alias("psnr"), F.avg("sam").alias("sam")).select(F.inline(F.array(
        F.struct(F.lit("psnr").alias("name"), F.col("psnr").alias("value")),
        F.struct(F.lit("sam").alias("name"), F.col("sam").alias("value")))))
    return means.unionByName(ssim(df, bands, data_range, suffixes=suffixes, keys=keys).agg(
        F.avg("ssim").alias("value")).select(F.lit("ssim").alias("name"), "value"))


def bce_with_logits(logit, target) -> Column:
    x, z = F.col(logit) if isinstance(logit, str) else logit, target
    return F.greatest(x, F.lit(0.0)) - x * z + F.log1p(F.exp(-F.abs(x)))


def score_losses(df: DataFrame, real: str = "real_score", fake: str = "fake_score", truth: str = "truth",
                 predicted: str = "pred", weight: float = 100.0, smoothing: float = 0.0) -> DataFrame:
    """Mean losses of a table of scores: L1, cross-entropy, log, smoothed and Wasserstein forms."""
    r, f = F.col(real), F.col(fake)
    d_real, d_fake = 1 / (1 + F.exp(-r)), 1 / (1 + F.exp(-f))
    return df.agg(
        (F.avg(F.abs(F.col(truth) - F.col(predicted))) * F.lit(float(weight))).alias("l1"),
        F.avg(bce_with_logits(r, F.lit(1.0))).alias("bce_real"),
        F.avg(bce_with_logits(f, F.lit(0.0))).alias("bce_fake"),
        F.avg(bce_with_logits(f, F.lit(1.0))).alias("bce_generator"),
        F.avg(bce_with_logits(r, F.lit(1.0 - smoothing))).alias("bce_real_smoothed"),
        (-F.avg(F.log(d_real))).alias("log_real"), (-F.avg(F.log(1 - d_fake))).alias("log_fake"),
        (-F.avg(F.log(d_fake))).alias("log_generator"),
        (F.avg(f) - F.avg(r)).alias("wasserstein_critic"), (-F.avg(f)).alias("wasserstein_generator"))


def log_metrics(metrics: DataFrame, step: int, path: str) -> None:
    """Append (name, value, step) rows to a metric log."""
    metrics.select("name", "value", F.lit(step).cast("long").alias("step")).write.mode("append").parquet(path)
