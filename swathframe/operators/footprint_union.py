"""Exact area of the union of footprints inside a zone, by a sweep along the longitude.

Between two neighbouring event positions (vertices, crossings of edges, edges
of the zone) the covered length is linear, so its value in the middle times the
width is the exact area of the slab.  The zone is cut into strips first: edges
meet only edges and slabs of their own strip, and a group with very many
footprints is spread over as many tasks as it has strips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathframe.constants import AREA_FACTOR
from swathframe.functions.geometry import edges, open_ring


def union_area(footprints: DataFrame, zone, ring: str = "ring", keys=(), strips: int = 32,
               factor: float = AREA_FACTOR) -> DataFrame:
    """(keys, area, covers): area of ``zone`` (a box) under the union of the footprints of each group.

    Rings may be slanted, concave, touch or overlap; a ring that crosses itself
    counts by the even-odd rule.  Equal rings of a group are one before
    anything is paired.  Null rings and rings of fewer than three vertices
    cover nothing; a group that covers nothing has area 0.  ``covers`` says
    whether the area reaches ``factor`` times the zone.  Within a strip and
    group all edges whose boxes meet are compared: choose ``strips`` so that a
    strip is about as wide as a footprint or narrower.
    """
    x0, y0, x1, y1 = (float(v) for v in zone)
    if not (x0 < x1 and y0 < y1):
        raise ValueError("the zone must have an area")
    width = (x1 - x0) / strips
    group = F.struct(*(F.col(k) for k in keys), F.lit(0).alias("_all")).alias("_g")
    rings = footprints.select(group, open_ring(ring).alias("_ring")).distinct()
    sides = (rings.filter(F.size("_ring") >= 3)
             .select("_g", F.md5(F.to_json("_ring")).alias("_id"), F.explode(edges("_ring")).alias("_e"))
             .select("_g", "_id", F.least("_e.p", "_e.q").alias("_a"), F.greatest("_e.p", "_e.q").alias("_b"))
             .filter("_a.lon < _b.lon")  # a vertical side bounds a slab by the ends of its neighbours
             .select("_g", "_id", F.col("_a.lon").alias("ax"), F.col("_a.lat").alias("ay"),
                     F.col("_b.lon").alias("bx"), F.col("_b.lat").alias("by"))
             .filter((F.col("bx") > x0) & (F.col("ax") < x1)))

    def strip(x):
        return F.greatest(F.least(F.floor((F.col(x) - x0) / width), F.lit(strips - 1)), F.lit(0)).cast("int")

    sides = sides.withColumn("_strip", F.explode(F.sequence(strip("ax"), strip("bx"))))
    sides = sides.repartition("_g", "_strip")
    line = sides.select("_g", "_strip", "ax", "ay", "bx", "by").distinct()
    lo = F.col("_strip") * width + x0
    hi = F.when(F.col("_strip") == strips - 1, F.lit(x1)).otherwise((F.col("_strip") + 1) * width + x0)

    other = line.select("_g", "_strip", *(F.col(c).alias(f"o{c}") for c in ("ax", "ay", "bx", "by")))
    slope, oslope = ((F.col(f"{o}by") - F.col(f"{o}ay")) / (F.col(f"{o}bx") - F.col(f"{o}ax")) for o in ("", "o"))
    crossing = F.try_divide(F.col("oay") - F.col("ay") + slope * F.col("ax") - oslope * F.col("oax"), slope - oslope)
    near = (F.struct("ax", "ay", "bx", "by") < F.struct("oax", "oay", "obx", "oby")) & (F.col("ax") < F.col("obx")) & (
        F.col("oax") < F.col("bx")) & (F.least("ay", "by") <= F.greatest("oay", "oby")) & (F.least("oay", "oby") <= F.greatest("ay", "by"))
    met = line.join(other, ["_g", "_strip"]).filter(near).select("_g", "_strip", crossing.alias("x"))
    border = F.array(*(F.col("ax") + F.try_divide(F.lit(y) - F.col("ay"), slope) for y in (y0, y1)))
    own = line.select("_g", "_strip", F.explode(F.concat(F.array("ax", "bx", lo, hi), border)).alias("x"))
    events = own.unionByName(met).filter((F.col("x") >= lo) & (F.col("x") <= hi)).distinct()
    slabs = (events.withColumn("_to", F.lead("x").over(Window.partitionBy("_g", "_strip").orderBy("x")))
             .filter("_to > x").select("_g", "_strip", F.col("x").alias("_from"), "_to", ((F.col("x") + F.col("_to")) / 2).alias("_mid")))

    at = F.col("ay") + (F.col("_mid") - F.col("ax")) * slope
    cut = (sides.join(slabs, ["_g", "_strip"]).filter("ax < _mid and bx > _mid")
           .groupBy("_g", "_strip", "_from", "_to", "_id").agg(F.sort_array(F.collect_list(at)).alias("_y")))
    inside = F.transform(F.sequence(F.lit(1), F.floor(F.size("_y") / 2).cast("int")), lambda i: F.struct(
        F.greatest(F.element_at("_y", 2 * i - 1), F.lit(y0)).alias("lo"), F.least(F.element_at("_y", 2 * i), F.lit(y1)).alias("hi")))
    spans = (cut.filter(F.size("_y") >= 2).select("_g", "_strip", "_from", "_to", F.explode(inside).alias("_s"))
             .filter("_s.lo < _s.hi").distinct())
    before = F.max("_s.hi").over(Window.partitionBy("_g", "_strip", "_from", "_to").orderBy("_s.lo", "_s.hi")
                                 .rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("_s.hi") - F.greatest(F.col("_s.lo"), F.coalesce(before, F.col("_s.lo"))), F.lit(0.0))
    area = spans.withColumn("_new", new).groupBy("_g").agg(F.sum(F.col("_new") * (F.col("_to") - F.col("_from"))).alias("area"))
    out = rings.select("_g").distinct().join(area, "_g", "left").withColumn("area", F.coalesce("area", F.lit(0.0)))
    return out.select(*(F.col("_g")[k].alias(k) for k in keys), "area",
                      (F.col("area") >= F.lit(factor * (x1 - x0) * (y1 - y0))).alias("covers"))
