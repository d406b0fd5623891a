"""Footprint geometry on ``ARRAY<STRUCT<lon DOUBLE, lat DOUBLE>>`` rings and on boxes.

Areas are planar (in the units of the coordinates) or spherical; the
ellipsoidal error of the spherical form is below one percent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathframe.constants import EARTH_RADIUS_M
from swathframe.functions.common import as_col, let
from swathframe.functions.projection import from_utm, to_utm

RING_TYPE = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


def point(lon, lat) -> Column:
    return F.struct(as_col(lon).cast("double").alias("lon"), as_col(lat).cast("double").alias("lat"))


def box_ring(xmin, ymin, xmax, ymax) -> Column:
    """Closed counter-clockwise ring of a box."""
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax),
                   point(xmin, ymin))


def outer_ring(coordinates, swap: bool = False) -> Column:
    """Outer ring of GeoJSON polygon coordinates (holes dropped), optionally swapping lat/long."""
    first, second = (1, 0) if swap else (0, 1)
    return F.transform(F.element_at(as_col(coordinates), 1), lambda p: point(p[first], p[second]))


def close_ring(ring) -> Column:
    return let(ring, lambda r: F.when(F.size(r) == 0, r).when(
        F.get(r, 0) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))))


def open_ring(ring) -> Column:
    """Without a repeated closing vertex."""
    return let(ring, lambda r: F.when((F.size(r) > 1) & (F.get(r, 0) == F.element_at(r, -1)),
                                      F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))


def _rotated(ring: Column) -> Column:
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def edges(ring) -> Column:
    """Consecutive vertex pairs; the wrap-around pair of a closed ring has zero length."""
    return let(ring, lambda r: F.zip_with(r, _rotated(r), lambda p, q: F.struct(p.alias("p"), q.alias("q"))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring) -> Column:
    return _sum(F.transform(edges(ring), lambda e: e["p"]["lon"] * e["q"]["lat"]
                            - e["q"]["lon"] * e["p"]["lat"])) / F.lit(2.0)


def polygon_area(ring) -> Column:
    """Planar shoelace area."""
    return F.abs(signed_area(ring))


def spherical_area(ring, radius: float = EARTH_RADIUS_M) -> Column:
    """Area in square metres on a sphere (trapezoids between meridians)."""
    parts = F.transform(edges(ring), lambda e: F.radians(e["q"]["lon"] - e["p"]["lon"])
                        * (2 + F.sin(F.radians(e["p"]["lat"])) + F.sin(F.radians(e["q"]["lat"]))))
    return F.abs(_sum(parts)) * F.lit(radius * radius / 2)


def bounds(ring) -> Column:
    lons = F.transform(as_col(ring), lambda p: p["lon"])
    lats = F.transform(as_col(ring), lambda p: p["lat"])
    return F.struct(F.array_min(lons).alias("xmin"), F.array_min(lats).alias("ymin"),
                    F.array_max(lons).alias("xmax"), F.array_max(lats).alias("ymax"))


# --- boxes ------------------------------------------------------------------

def box(xmin, ymin, xmax, ymax) -> Column:
    return F.struct(as_col(xmin).alias("xmin"), as_col(ymin).alias("ymin"),
                    as_col(xmax).alias("xmax"), as_col(ymax).alias("ymax"))


def boxes_intersect(a: Column, b: Column) -> Column:
    return ((a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"])
            & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"]))


def box_contains(outer: Column, inner: Column) -> Column:
    return ((outer["xmin"] <= inner["xmin"]) & (outer["xmax"] >= inner["xmax"])
            & (outer["ymin"] <= inner["ymin"]) & (outer["ymax"] >= inner["ymax"]))


def box_area(b: Column) -> Column:
    return (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"])


def box_intersection(a: Column, b: Column) -> Column:
    """Shared box, NULL when the boxes do not meet."""
    shared = box(F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"]),
                 F.least(a["xmax"], b["xmax"]), F.least(a["ymax"], b["ymax"]))
    return F.when(boxes_intersect(a, b), shared)


def clip_zone_box(zone: Column, scene: Column) -> Column:
    """Zone smaller than the scene: their intersection; otherwise the scene footprint."""
    return F.when(box_area(zone) < box_area(scene), box_intersection(zone, scene)).otherwise(scene)


# --- polygons ---------------------------------------------------------------

def _cross(a: Column, b: Column, c: Column) -> Column:
    return ((b["lon"] - a["lon"]) * (c["lat"] - a["lat"])
            - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"]))


def _on_segment(p: Column, a: Column, b: Column) -> Column:
    within = ((p["lon"] >= F.least(a["lon"], b["lon"])) & (p["lon"] <= F.greatest(a["lon"], b["lon"]))
              & (p["lat"] >= F.least(a["lat"], b["lat"])) & (p["lat"] <= F.greatest(a["lat"], b["lat"])))
    return within & (_cross(a, b, p) == 0)


def contains_point(ring, p: Column) -> Column:
    """Even-odd rule; a point on the boundary is inside."""
    def crosses(e):
        a, b = e["p"], e["q"]
        straddles = (a["lat"] > p["lat"]) != (b["lat"] > p["lat"])
        x = a["lon"] + F.try_divide((p["lat"] - a["lat"]) * (b["lon"] - a["lon"]), b["lat"] - a["lat"])
        return straddles & F.coalesce(p["lon"] < x, F.lit(False))

    return let(edges(ring), lambda es: (F.size(F.filter(es, crosses)) % 2 == 1)
               | F.exists(es, lambda e: _on_segment(p, e["p"], e["q"])))


def _edges_cross(e: Column, f: Column) -> Column:
    d1, d2 = _cross(e["p"], e["q"], f["p"]), _cross(e["p"], e["q"], f["q"])
    d3, d4 = _cross(f["p"], f["q"], e["p"]), _cross(f["p"], f["q"], e["q"])
    return (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)


def _any_crossing(a, b) -> Column:
    return let(edges(b), lambda fs: F.exists(edges(a), lambda e: F.exists(fs, lambda f: _edges_cross(e, f))))


def polygons_intersect(a, b) -> Column:
    """Bounding-box test first, then shared vertices or crossing edges."""
    def test(ra, rb):
        boxes = let(bounds(ra), lambda x: let(bounds(rb), lambda y: boxes_intersect(x, y)))
        return boxes & (F.exists(ra, lambda p: contains_point(rb, p))
                        | F.exists(rb, lambda p: contains_point(ra, p)) | _any_crossing(ra, rb))

    return let(a, lambda ra: let(b, lambda rb: test(ra, rb)))


def polygon_contains(outer, inner) -> Column:
    """``inner`` lies in ``outer`` (boundaries may touch) and is not the larger one."""
    def test(ro, ri):
        boxes = let(bounds(ro), lambda x: let(bounds(ri), lambda y: box_contains(x, y)))
        return (boxes & F.forall(ri, lambda p: contains_point(ro, p))
                & ~_any_crossing(ro, ri) & (polygon_area(ri) <= polygon_area(ro)))

    return let(outer, lambda ro: let(inner, lambda ri: test(ro, ri)))


def _clip_by(subject: Column, keep, cut) -> Column:
    """One Sutherland-Hodgman step: vertices that satisfy ``keep`` plus the cut points."""
    empty = F.slice(subject, 1, 0)
    pieces = F.zip_with(subject, _rotated(subject), lambda p, q: F.when(
        keep(p) & keep(q), F.array(q)).when(keep(p), F.array(cut(p, q))).when(
        keep(q), F.array(cut(p, q), q)).otherwise(empty))
    return F.coalesce(F.flatten(pieces), empty)


def clip_convex(subject, window) -> Column:
    """Part of ``subject`` inside a convex ``window`` (open ring; empty when disjoint)."""
    ccw = let(open_ring(window), lambda w: F.when(signed_area(w) >= 0, w).otherwise(F.reverse(w)))

    def step(poly, e):
        a, b = e["p"], e["q"]

        def cut(p, q):
            dp, dq = _cross(a, b, p), _cross(a, b, q)
            t = F.try_divide(dp, dp - dq)
            return point(p["lon"] + t * (q["lon"] - p["lon"]), p["lat"] + t * (q["lat"] - p["lat"]))

        return _clip_by(poly, lambda p: _cross(a, b, p) >= 0, cut)

    return F.aggregate(edges(ccw), open_ring(subject), step)


def utm_epsg(ring) -> Column:
    """Suitable projection code of a footprint; NULL for strips taller than 90 degrees."""
    def median(a):
        n = F.size(a)
        return (F.element_at(a, ((n + 1) / 2).cast("int")) + F.element_at(a, (n / 2).cast("int") + 1)) / F.lit(2.0)

    def code(lons, lats):
        low, high = F.element_at(lats, 1), F.element_at(lats, -1)
        zone = ((median(lons) + 180) / 6).cast("int") % 60 + 1
        base = F.when(median(lats) < 0, F.lit(32700)).otherwise(F.lit(32600))
        return (F.when(high - low > 90, F.lit(None).cast("int")).when(low < -80, F.lit(32761))
                .when(high > 80, F.lit(32661)).otherwise(base + zone))

    r = as_col(ring)
    return let(F.sort_array(F.transform(r, lambda p: p["lon"])), lambda lons: let(
        F.sort_array(F.transform(r, lambda p: p["lat"])), lambda lats: code(lons, lats)))


def _ring_centroid(ring: Column) -> Column:
    """Planar centroid relative to the first vertex, which keeps the products small."""
    def w(e):
        return e["p"]["lon"] * e["q"]["lat"] - e["q"]["lon"] * e["p"]["lat"]

    def mean(origin, es):
        six_a = _sum(F.transform(es, w)) * 3
        cx = _sum(F.transform(es, lambda e: (e["p"]["lon"] + e["q"]["lon"]) * w(e)))
        cy = _sum(F.transform(es, lambda e: (e["p"]["lat"] + e["q"]["lat"]) * w(e)))
        return point(origin["lon"] + F.try_divide(cx, six_a), origin["lat"] + F.try_divide(cy, six_a))

    def local(r, origin):
        return F.transform(r, lambda p: point(p["lon"] - origin["lon"], p["lat"] - origin["lat"]))

    return let(ring, lambda r: let(F.element_at(r, 1), lambda origin: let(
        edges(local(r, origin)), lambda es: mean(origin, es))))


def centroid(ring, epsg) -> Column:
    """Centroid computed in the UTM projection ``epsg`` and returned as lon/lat."""
    code = as_col(epsg)
    projected = F.transform(as_col(ring), lambda p: _as_point(to_utm(p["lon"], p["lat"], code)))
    return let(_ring_centroid(projected), lambda c: _as_lonlat(from_utm(c["lon"], c["lat"], code)))


def _as_point(projected: Column) -> Column:
    return let(projected, lambda v: point(v["easting"], v["northing"]))


def _as_lonlat(back: Column) -> Column:
    return let(back, lambda v: point(v["lon"], v["lat"]))


def _chain(points: Column) -> Column:
    """Lower hull of points in order, without its last point.

    A chain turns left throughout and the next point lies right of it, so the
    edges that see that point on their left are a prefix: it stays, the rest goes.
    """
    def turns_left(out, k, p):
        u, v = F.element_at(out, k - 1), F.element_at(out, k)
        return (v["lon"] - u["lon"]) * (p["lat"] - u["lat"]) - (v["lat"] - u["lat"]) * (p["lon"] - u["lon"]) > 0

    def step(out, p):
        edges_ = F.when(F.size(out) > 1, F.sequence(F.lit(2), F.size(out))).otherwise(F.array().cast("array<int>"))
        kept = F.size(F.filter(edges_, lambda k: turns_left(out, k, p))) + 1
        return F.array_append(F.slice(out, 1, kept), p)

    chain = F.aggregate(points, F.array().cast(RING_TYPE), step)
    return let(chain, lambda c: F.slice(c, 1, F.size(c) - 1))


def _hull(ring: Column) -> Column:
    """Monotone-chain hull: lower chain forwards, upper chain backwards, closed."""
    own = F.array_sort(F.array_distinct(F.transform(ring, lambda p: point(p["lon"], p["lat"]))))

    def closed(points):
        both = F.concat(_chain(points), _chain(F.reverse(points)))
        return F.when(F.size(points) < 3, points).otherwise(let(both, lambda c: F.concat(c, F.slice(c, 1, 1))))

    return let(own, closed)


def convex_hull(points, epsg=None) -> Column:
    """Closed counter-clockwise hull, computed in the projection ``epsg`` if one is given."""
    if epsg is None:
        return _hull(as_col(points))
    code = as_col(epsg)
    projected = F.transform(as_col(points), lambda p: _as_point(to_utm(p["lon"], p["lat"], code)))

    return F.transform(_hull(projected), lambda p: _as_lonlat(from_utm(p["lon"], p["lat"], code)))


def crosses_dateline(ring) -> Column:
    """True when two adjacent vertices are more than 180 degrees of longitude apart."""
    return F.exists(edges(ring), lambda e: F.abs(e["p"]["lon"] - e["q"]["lon"]) > 180)


def dateline_parts(ring) -> Column:
    """Array of (part, ring): ``east`` and ``west`` of 180 degrees, or the ring itself as ``whole``.

    Parts with fewer than three vertices are dropped, rings are closed.
    """
    r = as_col(ring)
    unwrapped = open_ring(F.transform(r, lambda p: point(
        F.when(p["lon"] < 0, p["lon"] + 360).otherwise(p["lon"]), p["lat"])))

    def cut(p, q):
        t = F.try_divide(F.lit(180.0) - p["lon"], q["lon"] - p["lon"])
        return point(F.lit(180.0), p["lat"] + t * (q["lat"] - p["lat"]))

    def part(name, value):
        return F.struct(F.lit(name).alias("part"), close_ring(value).alias("ring"))

    def halves(u):
        east = _clip_by(u, lambda p: p["lon"] <= 180, cut)
        west = F.transform(_clip_by(u, lambda p: p["lon"] >= 180, cut), lambda p: point(p["lon"] - 360, p["lat"]))
        return F.filter(F.array(part("east", east), part("west", west)), lambda s: F.size(s["ring"]) > 3)

    split = let(unwrapped, halves)
    return F.when(crosses_dateline(r), split).otherwise(F.array(part("whole", r)))


def tile_centre(ulx, uly, n_rows, n_cols, step: float = 10.0) -> Column:
    """Centre of a tile in its own projection: whole cells from the upper-left corner."""
    half = lambda n: F.floor(as_col(n) / 2)
    return F.struct((as_col(ulx) + half(n_cols) * F.lit(step)).alias("x"),
                    (as_col(uly) - half(n_rows) * F.lit(step)).alias("y"))


def utm_zone(epsg) -> Column:
    """Zone number of a 326xx/327xx code, NULL otherwise."""
    code = as_col(epsg).cast("int")
    return F.when(F.floor(code / 100).isin(326, 327), code % 100)
