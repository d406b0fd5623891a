"""Matching optical scenes to radar scenes in time, and zone coverage tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathframe.constants import AREA_FACTOR
from swathframe.functions.geometry import box, boxes_intersect, polygons_intersect

_DAY_US = 86_400_000_000


def nearest_scene_join(s2: DataFrame, s1: DataFrame, max_days: int, direction: str = "both",
                       factor: float = AREA_FACTOR, on=("tile_no",), time: str = "acquired_at") -> DataFrame:
    """For each optical scene the radar scene found by widening a day window.

    Windows of 1, 2, ... days are searched around the optical scene (``[t-i, t)``
    before, ``[t, t+i)`` after) until one holds a radar scene whose area is at
    least ``factor * zone_area``; the largest radar scene seen so far is
    returned (nearer window, then lower id on ties).  If none qualifies within
    ``max_days`` the largest overall is returned with ``all_found = false``;
    without any radar scene in reach the match is NULL.

    ``s2``: scene_id, keys, time, zone_area.  ``s1``: scene_id, keys, time, area.
    Only radar scenes with the same keys are candidates; for a search by place
    see ``nearest_scene_by_footprint``.

    No scene pairs are formed.  Relative to one radar *day*, every radar scene
    later than the optical scene's time of day lies in one search window and
    every earlier one in the next, so a running best over the time of day
    answers both.  Each optical scene probes ``max_days + 1`` days on each side
    searched, its own day once; groups are (key, day), sorted once in each direction.
    """
    if direction not in ("before", "after", "both"):
        raise ValueError(f"direction must be before, after or both, not {direction!r}")
    if max_days < 1:
        raise ValueError("max_days must be at least 1")
    on = list(on)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    day, tod = F.floor(micros / _DAY_US).cast("long"), F.pmod(micros, F.lit(_DAY_US))
    radar = s1.select(*on, day.alias("_day"), tod.alias("_tod"), F.lit(1).alias("_kind"),
                      F.lit(None).cast(dict(s2.dtypes)["scene_id"]).alias("_s2"), F.lit(None).cast("int").alias("_k"),
                      F.lit(None).cast("double").alias("_zone_area"),
                      F.struct((-F.col("area")).alias("neg_area"), F.col("scene_id").alias("s1_id")).alias("_best"))
    probes = s2.select(*on, day.alias("_d"), tod.alias("_tod"), F.col("scene_id").alias("_s2"),
                       F.col("zone_area").cast("double").alias("_zone_area"),
                       F.explode(F.sequence(F.lit(-max_days), F.lit(max_days))).alias("_k"))
    probes = probes.select(*on, (F.col("_d") + F.col("_k")).alias("_day"), "_tod", F.lit(0).alias("_kind"), "_s2",
                           "_k", "_zone_area", F.lit(None).cast(radar.schema["_best"].dataType).alias("_best"))
    both = radar.unionByName(probes)
    # A radar scene at the very same time of day sorts after the probe: it counts as later.
    up = Window.partitionBy(*on, "_day").orderBy("_tod", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*on, "_day").orderBy(F.desc("_tod"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    answered = both.select("*", F.min("_best").over(up).alias("_earlier"), F.min("_best").over(down).alias("_later")).filter(
        F.col("_kind") == 0)
    # Search ring of radar scenes k days away: same side of the optical time or not.
    k = F.col("_k")
    after = F.when(k >= 0, F.array(F.struct((k + 1).alias("ring"), F.col("_later").alias("best")),
                                   F.struct(k.alias("ring"), F.col("_earlier").alias("best"))))
    before = F.array(F.struct((1 - k).alias("ring"), F.col("_earlier").alias("best")),
                     F.struct((-k).alias("ring"), F.col("_later").alias("best")))
    # k = 0 and earlier is before; k = 0 and later is after; ring 0 does not exist.
    later_side = F.filter(F.coalesce(after, F.expr("array()").cast(_ring_type(radar))), lambda c: c["ring"] >= 1)
    earlier_side = F.filter(F.when(k <= 0, before).otherwise(F.expr("array()").cast(_ring_type(radar))), lambda c: c["ring"] >= 1)
    sides = {"after": later_side, "before": earlier_side, "both": F.concat(later_side, earlier_side)}[direction]
    usable = F.filter(sides, lambda c: (c["ring"] <= max_days) & c["best"].isNotNull())
    found = answered.select("_s2", "_zone_area", F.explode_outer(usable).alias("_c")).groupBy("_s2").agg(
        F.max("_zone_area").alias("zone_area"),
        # at most 2 * (2 * max_days + 1) candidates per scene
        F.collect_list(F.when(F.col("_c.ring").isNotNull(), F.struct(
            F.col("_c.best.neg_area").alias("neg_area"), F.col("_c.ring").alias("ring"),
            F.col("_c.best.s1_id").alias("s1_id")))).alias("_cands"))
    return _pick(found.withColumnRenamed("_s2", "s2_id"), factor)


def _days(max_days: int, direction: str) -> tuple[int, int]:
    """First and last day searched, counted from the optical scene's own."""
    return (0 if direction == "after" else -max_days), (0 if direction == "before" else max_days)


def cover_cells(df: DataFrame, cell: float, corners=("xmin", "ymin", "xmax", "ymax")) -> DataFrame:
    """One row for each grid cell of ``cell`` degrees that the box of a row touches, as columns ``_cx`` and ``_cy``."""
    index = {c: F.floor(F.col(c) / F.lit(float(cell))).cast("long") for c in corners}
    x0, y0, x1, y1 = (index[c] for c in corners)
    return (df.withColumn("_cx", F.explode(F.when(x0 <= x1, F.sequence(x0, x1))))
            .withColumn("_cy", F.explode(F.when(y0 <= y1, F.sequence(y0, y1)))))


def nearest_scene_by_footprint(s2: DataFrame, s1: DataFrame, max_days: int, direction: str = "both",
                               factor: float = AREA_FACTOR, cell: float = 1.0, ring: str | None = None,
                               time: str = "acquired_at") -> DataFrame:
    """``nearest_scene_join`` among all radar scenes whose footprint meets the wanted area, whatever tile they are filed under.

    ``s2``: scene_id, time, zone_area, and the wanted area's box (xmin, ymin,
    xmax, ymax).  ``s1``: scene_id, time, area, and the footprint's box.  With
    ``ring`` both also have a ring of points in that column, and the rings have
    to meet, not only the boxes.  A scene with a null corner meets nothing.

    No scene pairs are formed.  Scenes of one place (box, and ring) and time are
    one row, and of a place and day only radar scenes stay that are the best
    up to or from some time on.  These and the distinct wanted places of each
    searched day are spread over the grid cells that their boxes touch and meet
    in an equi-join on cell and day.  A meeting counts only in the cell of the
    lower left corner of the common box, so nothing has to be made distinct.
    ``nearest_scene_join`` then searches with the wanted place as the key.  The
    work grows with scenes times the places that they meet in a day; where no
    two scenes share a place, those are as many as meeting scenes.  A cell
    should be about as large as a footprint.
    """
    if direction not in ("before", "after", "both"):
        raise ValueError(f"direction must be before, after or both, not {direction!r}")
    if max_days < 1:
        raise ValueError("max_days must be at least 1")
    corners, size = ["xmin", "ymin", "xmax", "ymax"], F.lit(float(cell))
    place = [*corners, *([ring] if ring else [])]
    stamp = F.col(time).cast("timestamp")
    day = F.floor(F.unix_micros("_time") / _DAY_US).cast("long")

    optical = s2.select("scene_id", "zone_area", *place, stamp.alias("_time"))
    first, last = _days(max_days, direction)
    wanted = (optical.select(*place, day.alias("_own")).distinct()
              .select(*place, F.explode(F.sequence(F.col("_own") + first, F.col("_own") + last)).alias("_day")).distinct())
    best = F.struct((-F.col("area").cast("double")).alias("neg_area"), F.col("scene_id").alias("s1_id"))
    radar = (s1.select(*place, stamp.alias("_time"), best.alias("_best")).filter("_time is not null and _best.neg_area is not null")
             .groupBy(*place, day.alias("_day"), "_time").agg(F.min("_best").alias("_best")))
    radar = _useful(radar, place).select(F.struct(*corners).alias("_s1box"), *([F.col(ring).alias("_s1ring")] if ring else []),
                                         *corners, "_day", "_time", "_best")
    probes = cover_cells(wanted.withColumn("_s2box", F.struct(*corners)), cell)
    o, r = F.col("_s2box"), F.col("_s1box")
    home = ((F.col("_cx") == F.floor(F.greatest(o["xmin"], r["xmin"]) / size))
            & (F.col("_cy") == F.floor(F.greatest(o["ymin"], r["ymin"]) / size)))
    met = (probes.join(cover_cells(radar, cell).drop(*corners), ["_cx", "_cy", "_day"])
           .filter(home & boxes_intersect(box(*(o[c] for c in corners)), box(*(r[c] for c in corners)))))
    if ring:
        met = met.filter(polygons_intersect(ring, "_s1ring"))
    met = met.select(*place, "_time", F.col("_best.s1_id").alias("scene_id"), (-F.col("_best.neg_area")).alias("area"))
    return nearest_scene_join(optical, met, max_days, direction, factor, on=place, time="_time")


def _useful(radar: DataFrame, place) -> DataFrame:
    """Of a place and day the radar scenes better than all earlier or all later ones; no search window prefers another."""
    group = Window.partitionBy(*place, "_day")
    before = group.orderBy("_time").rowsBetween(Window.unboundedPreceding, -1)
    after = group.orderBy(F.desc("_time")).rowsBetween(Window.unboundedPreceding, -1)
    seen = radar.select("*", F.min("_best").over(before).alias("_before"), F.min("_best").over(after).alias("_after"))
    return seen.filter("_before is null or _after is null or _best < _before or _best < _after").drop("_before", "_after")


def _pick(found: DataFrame, factor: float) -> DataFrame:
    """Of each scene's candidates the largest within the first window that holds one of ``factor * zone_area``."""
    good = F.filter("_cands", lambda c: -c["neg_area"] >= F.lit(factor) * F.col("zone_area"))
    found = found.withColumn("stop_ring", F.array_min(F.transform(good, lambda c: c["ring"])))
    pick = F.array_min(F.filter("_cands", lambda c: F.col("stop_ring").isNull() | (c["ring"] <= F.col("stop_ring"))))
    return found.withColumn("_chosen", pick).select(
        "s2_id", F.col("_chosen.s1_id").alias("s1_id"), (-F.col("_chosen.neg_area")).alias("s1_area"),
        F.col("_chosen.ring").alias("ring"), F.col("stop_ring"), F.col("stop_ring").isNotNull().alias("all_found"))


def _ring_type(radar: DataFrame) -> str:
    return f"array<struct<ring:int,best:{radar.schema['_best'].dataType.simpleString()}>>"


def group_first(scenes: DataFrame, group: str, order=("acquired_at", "scene_id")) -> DataFrame:
    """Footprint box of the first scene of every group."""
    first = scenes.groupBy(group).agg(F.min_by(F.struct("xmin", "ymin", "xmax", "ymax"), F.struct(*order)).alias("_f"))
    return first.select(group, "_f.*")


def zone_cover_short_circuit(scenes: DataFrame, group: str, zone, order=("acquired_at", "scene_id")) -> DataFrame:
    """If the first scene of some group contains the zone, only that group; otherwise all groups.

    The lowest such group wins; the choice reaches the scenes as one scalar.
    """
    x0, y0, x1, y1 = (float(v) for v in zone)
    covering = group_first(scenes, group, order).filter(
        (F.col("xmin") <= x0) & (F.col("ymin") <= y0) & (F.col("xmax") >= x1) & (F.col("ymax") >= y1))
    chosen = covering.agg(F.min(group).alias("g")).scalar()
    return scenes.withColumn("_g", chosen).filter(F.col("_g").isNull() | (F.col(group) == F.col("_g"))).drop("_g")


def largest_footprint(scenes: DataFrame, zone_area: float, factor: float = AREA_FACTOR, keys=()) -> DataFrame:
    """Largest area (first wins ties) and whether it reaches ``factor * zone_area``."""
    best = scenes.groupBy(*keys).agg(F.min(F.struct((-F.col("area")).alias("neg"), "acquired_at", "scene_id")).alias("_b"))
    area = -F.col("_b.neg")
    return best.select(*keys, F.col("_b.scene_id").alias("scene_id"), area.alias("area"),
                       (area >= F.lit(factor * zone_area)).alias("covers"))


def zone_union_coverage(scenes: DataFrame, zone, cell: float, factor: float = AREA_FACTOR, keys=()) -> DataFrame:
    """Area of the zone under the union of all footprints, on a raster of ``cell`` degrees.

    Each footprint lists the zone cells whose centre it holds; distinct cells
    are counted.  The work per scene is bounded by the number of zone cells.
    """
    x0, y0, x1, y1 = (float(v) for v in zone)
    nx, ny = round((x1 - x0) / cell), round((y1 - y0) / cell)

    def cells(lo, hi, origin, n):
        first = F.greatest(F.ceil((F.col(lo) - origin) / cell - 0.5), F.lit(0)).cast("int")
        last = F.least(F.floor((F.col(hi) - origin) / cell - 0.5), F.lit(n - 1)).cast("int")
        return F.when(first <= last, F.sequence(first, last))

    hit = scenes.select(*keys, cells("xmin", "xmax", x0, nx).alias("_cx"), cells("ymin", "ymax", y0, ny).alias("_cy"))
    # Footprints that cover the same cell block are one row before they are spread out.
    hit = hit.filter("_cx is not null and _cy is not null").distinct()
    covered = hit.select(*keys, F.explode("_cx").alias("_x"), "_cy").select(*keys, "_x", F.explode("_cy").alias("_y")).distinct()
    n = F.count(F.lit(1))
    return covered.groupBy(*keys).agg(n.alias("n_cells"), (n * F.lit(cell * cell)).alias("area"),
                                      (n > F.lit(float(factor * nx * ny))).alias("covers"))
