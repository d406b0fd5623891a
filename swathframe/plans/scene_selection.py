"""Choosing scenes: groups, the best scene per group, and its radar companion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.functions.geometry import box, box_area, clip_zone_box
from swathframe.operators.matching import nearest_scene_by_footprint, zone_cover_short_circuit
from swathframe.operators.scenes import filter_cloud, filter_s1, filter_scenes

CRITERIA = {"begin": ("acquired_at", True), "end": ("acquired_at", False), "lessclouds": ("zone_cloud_pct", True)}


def scene_groups(scenes: DataFrame, sensor: int, zone) -> DataFrame:
    """Scenes with their ``group_id`` (tile for optical, orbit for radar), cut to one covering group if any."""
    key = "tile_no" if sensor == 2 else "orbit_no"
    grouped = scenes.filter(F.col("sensor") == sensor).withColumn("group_id", F.col(key))
    return zone_cover_short_circuit(grouped, "group_id", zone)


def best_scene_per_group(scenes: DataFrame, criterion: str = "lessclouds", cloud_limit: float = 20.0,
                         group="group_id", keep=("acquired_at",)) -> DataFrame:
    """Earliest, latest or clearest scene of each group below the cloud limit (lowest id on ties).

    ``group`` is a column or several.  A running minimum per group, combined
    before the shuffle, not a sort of the group.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {sorted(CRITERIA)}")
    column, ascending = CRITERIA[criterion]
    value = F.col(column)
    if column == "acquired_at":
        value = F.unix_micros(value.cast("timestamp"))
    rank = value if ascending else -value
    groups, kept = [group] if isinstance(group, str) else list(group), [c for c in keep if c != "scene_id"]
    best = filter_cloud(scenes, cloud_limit).groupBy(*groups).agg(
        F.min(F.struct(rank.alias("rank"), F.col("scene_id"), *[F.col(c) for c in kept])).alias("_b"))
    return best.select(*groups, "_b.scene_id", *[f"_b.{c}" for c in kept])


def with_zone_area(s2: DataFrame, zone) -> DataFrame:
    """What the radar scene has to cover, as ``zone_area`` and box ``wanted``: the zone cut to the optical footprint."""
    asked = box(*[F.lit(float(v)) for v in zone])
    return s2.withColumn("wanted", clip_zone_box(asked, box("xmin", "ymin", "xmax", "ymax"))).withColumn(
        "zone_area", box_area(F.col("wanted")))


def selection_plan(scenes: DataFrame, periods, zone, criterion: str = "lessclouds", cloud_limit: float = 20.0,
                   max_days: int = 12, mode: str | None = None, polarisations=(), names=None, cell: float = 1.0) -> DataFrame:
    """Scenes to fetch: per period the chosen optical scenes and the radar scene matched to each.

    ``periods`` is a list of (begin, end); ``names`` optionally gives the
    optical scene of each period.  Output: period, sensor, scene_id, day,
    matched_to; an optical scene without a radar scene in reach has a radar row
    without scene and day.  Radar scenes are searched by place, on a grid of
    ``cell`` degrees: their footprint has to meet the zone within the optical scene.

    A scene finds its periods in a constant array, so every step runs once for
    all periods; the scans are bounded by the first and the last date.
    """
    columns = ("acquired_at", "tile_no", "xmin", "ymin", "xmax", "ymax")
    id_type = dict(scenes.dtypes)["scene_id"]
    stamp = lambda d: F.lit(d).cast("timestamp")
    begin, end = (pick(F.array(*[stamp(p[k]) for p in periods])) for pick, k in ((F.array_min, 0), (F.array_max, 1)))
    table = F.array(*[F.struct(F.lit(i).alias("period"), stamp(b).alias("begin"), stamp(e).alias("end"),
                               F.lit(names[i] if names else None).cast(id_type).alias("wanted"))
                      for i, (b, e) in enumerate(periods)])
    time = F.col("acquired_at").cast("timestamp")
    inside = F.filter(table, lambda p: (time >= p["begin"]) & (time < p["end"]))
    candidates = filter_scenes(scenes, begin, end, zone, 2).withColumn("_p", F.explode(inside)).withColumns(
        {"period": F.col("_p.period"), "group_id": F.col("tile_no")})

    free = filter_cloud(candidates.filter("_p.wanted is null"), cloud_limit)
    x0, y0, x1, y1 = (float(v) for v in zone)
    first = free.groupBy("period", "group_id").agg(
        F.min_by(F.struct("xmin", "ymin", "xmax", "ymax"), F.struct("acquired_at", "scene_id")).alias("f"))
    alone = first.filter((F.col("f.xmin") <= x0) & (F.col("f.ymin") <= y0) & (F.col("f.xmax") >= x1) & (F.col("f.ymax") >= y1)
                         ).groupBy("period").agg(F.min("group_id").alias("_alone"))
    grouped = free.join(F.broadcast(alone), "period", "left").filter("_alone is null or _alone = group_id")  # a row a period
    chosen = with_zone_area(best_scene_per_group(grouped, criterion, cloud_limit, ("period", "group_id"), columns), zone)
    optical = chosen.select("period", "scene_id", "wanted", "acquired_at", "zone_area")
    if names and any(n is not None for n in names):
        named = candidates.filter("_p.wanted = scene_id").withColumn("wanted", box("xmin", "ymin", "xmax", "ymax")).withColumn(
            "zone_area", box_area(F.col("wanted")))
        optical = optical.unionByName(named.select(optical.columns))

    reach = F.make_dt_interval(F.lit(max_days + 1))
    radar = filter_s1(filter_scenes(scenes, begin - reach, end + reach, None, 1), mode, polarisations).withColumn(
        "area", box_area(box("xmin", "ymin", "xmax", "ymax")))
    keyed = optical.select(F.struct("period", "scene_id").alias("scene_id"), "wanted.*", "acquired_at", "zone_area")
    matched = nearest_scene_by_footprint(keyed, radar, max_days, cell=cell)
    day = F.date_format("acquired_at", "yyyy-MM-dd").alias("day")
    days = radar.select(F.col("scene_id").alias("s1_id"), day)
    return optical.select("period", F.lit(2).alias("sensor"), "scene_id", day, F.lit(None).cast(id_type).alias("matched_to")).unionByName(
        matched.join(days, "s1_id", "left").select(F.col("s2_id.period").alias("period"), F.lit(1).alias("sensor"),
                                                   F.col("s1_id").alias("scene_id"), "day", F.col("s2_id.scene_id").alias("matched_to")))
