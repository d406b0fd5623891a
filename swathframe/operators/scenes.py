"""Scene catalogue filters and projections.

Filters are plain predicates, so they reach the parquet scan; month and grid
cell predicates prune partitions when the table is stored by them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathframe.constants import S1_DEFAULTS, S2_DEFAULTS
from swathframe.functions.common import all_of
from swathframe.functions.geometry import polygons_intersect
from swathframe.functions.names import gridcell_overlaps


def acquired_between(begin, end, time: str = "acquired_at") -> Column:
    """Begin inclusive, end exclusive."""
    return (F.col(time) >= F.lit(begin).cast("timestamp")) & (F.col(time) < F.lit(end).cast("timestamp"))


def bbox_meets(zone) -> Column:
    """Scene columns xmin/ymin/xmax/ymax against a constant (xmin, ymin, xmax, ymax)."""
    x0, y0, x1, y1 = (float(v) for v in zone)
    return (F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)


def filter_scenes(scenes: DataFrame, begin, end, zone=None, sensor: int | None = None, ring: Column | None = None) -> DataFrame:
    """Date range, then bounding boxes, then (with a ``ring``) the exact footprint test."""
    conditions = [acquired_between(begin, end)]
    if sensor is not None:
        conditions.append(F.col("sensor") == sensor)
    if zone is not None:
        conditions.append(bbox_meets(zone))
    out = scenes.filter(all_of(conditions))
    return out if ring is None else out.filter(polygons_intersect(F.col("footprint"), ring))


def filter_s1(scenes: DataFrame, mode: str | None = None, polarisations=(), pass_direction: str = "DESCENDING") -> DataFrame:
    """Instrument mode, every listed polarisation, pass direction."""
    conditions = [F.col("pass_direction") == pass_direction]
    if mode is not None:
        conditions.append(F.col("mode") == mode)
    conditions += [F.array_contains("polarisations", p) for p in polarisations]
    return scenes.filter(all_of(conditions))


def filter_cloud(scenes: DataFrame, limit: float, column: str = "cloud_pct") -> DataFrame:
    return scenes.filter(F.col(column) < F.lit(limit))


def filter_product_id(scenes: DataFrame, product_id, column: str = "scene_id") -> DataFrame:
    return scenes.filter(F.col(column) == F.lit(product_id))


def filter_params(scenes: DataFrame, params: dict, sensor: int | None = None, around=None,
                  time: str = "acquired_at") -> DataFrame:
    """name = value conditions, all of them, with the sensor's defaults merged in.

    ``around`` keeps scenes from the day before to the day after a date.  A
    condition on a column that the catalogue lacks is an error.
    """
    wanted = {**params, **{1: S1_DEFAULTS, 2: S2_DEFAULTS}.get(sensor, {})}
    lacking = sorted(set(wanted) - set(scenes.columns))
    if lacking:
        raise ValueError(f"no column {', '.join(lacking)} to compare with")
    out = reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])), wanted.items(), scenes)
    if around is None:
        return out
    day = F.to_date(F.lit(around))
    return out.filter(F.to_date(time).between(F.date_sub(day, 1), F.date_add(day, 1)))


def with_partitions(scenes: DataFrame, time: str = "acquired_at") -> DataFrame:
    """Partition columns of the stored catalogue."""
    return scenes.withColumn("ym", F.date_format(time, "yyyy-MM")).withColumn("ymd", F.date_format(time, "yyyy-MM-dd"))


def prune_by_month(scenes: DataFrame, start: str, end: str, daily: bool = False, time: str = "acquired_at") -> DataFrame:
    """Directory-level pruning by ``ym`` (or ``ymd``), then the exact inclusive dates. Dates are ``yyyymmdd``."""
    dash = lambda d: f"{d[:4]}-{d[4:6]}-{d[6:]}"
    s, e = dash(start), dash(end)
    coarse = F.col("ymd").between(s, e) if daily else F.col("ym").between(s[:7], e[:7])
    first, last = F.to_timestamp(F.lit(s)), F.to_timestamp(F.lit(e)) + F.expr("interval 1 day")
    return scenes.filter(coarse).filter((F.col(time) >= first) & (F.col(time) < last))  # plain bounds reach the scan


def prune_by_gridcell(scenes: DataFrame, west, east, south, north, column: str = "gridcell") -> DataFrame:
    return scenes.filter(gridcell_overlaps(column, F.lit(west), F.lit(east), F.lit(south), F.lit(north)))


def scene_names(scenes: DataFrame, sensor: int | None = None) -> DataFrame:
    """Id, acquisition day and footprint box."""
    out = scenes if sensor is None else scenes.filter(F.col("sensor") == sensor)
    return out.select("scene_id", F.date_format("acquired_at", "yyyy-MM-dd").alias("day"), "xmin", "ymin", "xmax", "ymax")


def find_scenes(scenes: DataFrame, begin, end, zone, sensor: int, cloud_limit: float | None = None,
                mode: str | None = None, polarisations=(), pass_direction: str = "DESCENDING") -> DataFrame:
    """Names of the scenes of one sensor over a zone and period."""
    out = filter_scenes(scenes, begin, end, zone, sensor)
    if sensor == 1:
        out = filter_s1(out, mode, polarisations, pass_direction)
    elif cloud_limit is not None:
        out = filter_cloud(out, cloud_limit)
    return scene_names(out)
