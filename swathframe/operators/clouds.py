"""Cloud scoring of optical scenes, cloud statistics of a zone, shadow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathframe.constants import (
    CLOUD_HEIGHTS, CLOUD_THRESHOLD, DARK_SUM, DILATION_RADIUS, EROSION_RADIUS, REFLECTANCE_SCALE,
    WATER_NDVI, ZONE_CLOUD_MAX,
)
from swathframe.functions.common import total
from swathframe.functions.geometry import box_area, box_intersection
from swathframe.functions.indices import normalized_difference
from swathframe.functions.rescale import threshold_ramp
from swathframe.operators.block_arrays import displaced_mean, displaced_parts, focal_passes, with_displaced_mean
from swathframe.operators.focal import circle_runs, focal_square, run_offsets, runs_reach
from swathframe.operators.layout import attach
from swathframe.session import write_once


def pixel_cloud_score(scale: float = REFLECTANCE_SCALE) -> Column:
    """Brightness, moisture and snow tests of one pixel, between 0.001 and 1.

    Reads b1, b2, b3, b4, b8, b10, b11.  A missing test does not take part.
    """
    def refl(*bands):
        return total([F.col(b) / F.lit(scale) for b in bands])

    tests = [threshold_ramp(refl("b2"), 0.1, 0.5), threshold_ramp(refl("b1"), 0.1, 0.3),
             threshold_ramp(refl("b1", "b10"), 0.15, 0.2), threshold_ramp(refl("b4", "b3", "b2"), 0.2, 0.8),
             threshold_ramp(normalized_difference("b8", "b11"), -0.1, 0.1),
             threshold_ramp(normalized_difference("b3", "b11"), 0.8, 0.6)]
    return F.greatest(F.least(F.lit(1.0), *tests), F.lit(0.001))


def cloud_score(df: DataFrame, keys=("scene_id",), scale: float = REFLECTANCE_SCALE, block: int = 256) -> DataFrame:
    """Pixel score smoothed over 11 x 11 pixels."""
    return focal_square(df, {"cloud_score": pixel_cloud_score(scale)}, "mean", 5, keys, block)


def cloud_stats(scored: DataFrame, zones: DataFrame, pixel_area: float, keys=("scene_id",)) -> DataFrame:
    """Cloudy area inside the zone as a share of footprint and zone, and the zone coverage (percent).

    ``zones`` has one row per key with boxes ``footprint`` and ``zone``; the
    pixels are already clipped to the zone.
    """
    cloudy = F.sum(F.when(F.col("cloud_score") > CLOUD_THRESHOLD, F.lit(float(pixel_area))).otherwise(F.lit(0.0)))
    area = scored.groupBy(*keys).agg(cloudy.alias("_cloudy"))
    fp, zone = F.col("footprint"), F.col("zone")
    # A scene without a pixel in the zone has no cloud there.
    known = zones.join(area, list(keys), "left").withColumn("_cloudy", F.coalesce("_cloudy", F.lit(0.0)))
    return known.select(
        *keys,
        (F.try_divide(F.col("_cloudy"), box_area(fp)) * 100).alias("cloud_pct"),
        (F.try_divide(F.coalesce(box_area(box_intersection(zone, fp)), F.lit(0.0)), box_area(zone)) * 100).alias("zone_coverage_pct"),
        (F.try_divide(F.col("_cloudy"), box_area(zone)) * 100).alias("zone_cloud_pct"))


def clip_to_zone(df: DataFrame, zones: DataFrame, keys=("scene_id",), x: str = "x", y: str = "y") -> DataFrame:
    z = attach(df, zones.select(*keys, F.col("zone").alias("_zone")), keys)
    return z.filter((F.col(x) >= F.col("_zone.xmin")) & (F.col(x) <= F.col("_zone.xmax"))
                    & (F.col(y) >= F.col("_zone.ymin")) & (F.col(y) <= F.col("_zone.ymax"))).drop("_zone")


def filter_clouds(df: DataFrame, zones: DataFrame, pixel_area: float, keys=("scene_id",),
                  limit: float = ZONE_CLOUD_MAX, scale: float = REFLECTANCE_SCALE, block: int = 256) -> DataFrame:
    """Scenes with less cloud over the zone than ``limit`` percent, clearest first."""
    scored = cloud_score(clip_to_zone(df, zones, keys), keys, scale, block)
    stats = cloud_stats(scored, zones, pixel_area, keys)
    return stats.filter(F.col("zone_cloud_pct") < limit).orderBy("zone_cloud_pct", *keys)


def dilated_erosion(df: DataFrame, value: str, keys=("scene_id",), name: str = "opened") -> DataFrame:
    """Three circular minima of radius 1.5, then three circular maxima of radius 3, on block arrays."""
    erode, dilate = circle_runs(EROSION_RADIUS), circle_runs(DILATION_RADIUS)
    passes = [("min", run_offsets(erode))] * 3 + [("max", run_offsets(dilate))] * 3
    return focal_passes(df, value, passes, 3 * (runs_reach(erode) + runs_reach(dilate)), keys, name)


def sun_shifts(df: DataFrame, res: float, keys=("scene_id",), heights=CLOUD_HEIGHTS) -> DataFrame:
    """(keys, shifts): where a cloud's shadow falls, once per scene, as an array of (dr, dc, w).

    Needs ``azimuth`` and ``zenith`` (degrees, one per scene).  Heights that
    round to the same shift become one weighted shift.
    """
    low, high, step = heights
    sun = df.groupBy(*keys).agg(F.max("azimuth").alias("_az"), F.max("zenith").alias("_zen"))
    away = F.radians(F.col("_az") + 180)
    reach = F.tan(F.radians(F.col("_zen"))) * F.col("_h") / F.lit(float(res))
    per_height = sun.withColumn("_h", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))))
    shifts = per_height.groupBy(*keys, (-F.floor(F.cos(away) * reach + 0.5)).cast("int").alias("dr"),
                                (-F.floor(-F.sin(away) * reach + 0.5)).cast("int").alias("dc")).agg(F.count(F.lit(1)).alias("w"))
    # At most one entry per height and scene; a scene without sun angles casts no shadow.
    return shifts.filter("dr is not null and dc is not null").groupBy(*keys).agg(
        F.collect_list(F.struct("dr", "dc", "w")).alias("shifts"))


def shadow_mean(df: DataFrame, res: float, keys=("scene_id",), heights=CLOUD_HEIGHTS) -> DataFrame:
    """Mean of the cloud score displaced away from the sun for every assumed cloud height, wherever one falls.

    Needs ``cloud_score``, ``azimuth`` and ``zenith``.  Blocks of scores are
    shifted as arrays; a block sends one partial array to each block its
    shadows reach.
    """
    return displaced_mean(displaced_parts(df, "cloud_score", sun_shifts(df, res, keys, heights), keys), keys, "shadow_mean")


def dark_pixel(scale: float = REFLECTANCE_SCALE) -> Column:
    """Dark in the infrared, not water and not cloud."""
    infrared = total([F.col(b) / F.lit(scale) for b in ("b8", "b11", "b12")])
    water = F.coalesce(normalized_difference("b8", "b4") < WATER_NDVI, F.lit(False))
    return (infrared < DARK_SUM) & ~water & ~(F.col("cloud_score") > CLOUD_THRESHOLD)


def project_shadows(df: DataFrame, res: float, keys=("scene_id",), scale: float = REFLECTANCE_SCALE) -> DataFrame:
    """``shadow_score``: projected cloud scores on dark pixels, opened and spread by one pixel.

    The scored pixels are read twice, for their own rows and for the shadows
    they cast, so they are stored once.
    """
    base, df = df.columns, write_once(df)
    parts = displaced_parts(df, "cloud_score", sun_shifts(df, res, keys), keys)
    masked = with_displaced_mean(df, parts, keys, "shadow_mean").withColumn(
        "_shadow", F.coalesce("shadow_mean", F.lit(0.0)) * F.when(dark_pixel(scale), 1.0).otherwise(0.0)).drop("shadow_mean")
    cleaned = dilated_erosion(masked, "_shadow", keys, "_opened")
    return focal_square(cleaned, {"shadow_score": F.col("_opened")}, "max", 1, keys).select(*base, "shadow_score")


def quality_score(df: DataFrame, keys=("scene_id",), block: int = 256) -> DataFrame:
    """Negative smoothed maximum of cloud and shadow score: higher is clearer."""
    out = focal_square(df, {"_q": F.greatest("cloud_score", "shadow_score")}, "mean", 5, keys, block)
    return out.withColumn("cloud_shadow_score", -F.col("_q")).drop("_q")
