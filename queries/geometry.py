"""Footprint geometry and projections."""

from pyspark.sql import functions as F

from queries.fixtures import SQL_SCENES, rd, rounded, scenes
from queries.registry import query
from swathframe.functions import geometry as ge
from swathframe.functions import projection as pr

OTHER = (149.32, -34.98, 149.62, -34.85)
LIT_BOX = "149.32e0 AS a, -34.98e0 AS b, 149.62e0 AS c, -34.85e0 AS d"
SQL_Z = f"{SQL_SCENES}, z AS (SELECT *, {LIT_BOX} FROM scenes)"


def scene_ring():
    return ge.box_ring("xmin", "ymin", "xmax", "ymax")


def zone_box():
    return ge.box(*[F.lit(v) for v in OTHER])


@query("polygon_area", f"WITH {SQL_SCENES} SELECT scene_id, {rd('(xmax-xmin)*(ymax-ymin)', 9)} AS area FROM scenes")
def polygon_area(spark, sf):
    return scenes(spark, sf).select("scene_id", rounded(ge.polygon_area(scene_ring()), 9).alias("area"))


@query("spherical_area", f"WITH {SQL_SCENES} SELECT scene_id, {rd('abs(radians(xmax-xmin)*(sin(radians(ymax))-sin(radians(ymin))))*6371008.8e0*6371008.8e0/1e6', 3)} AS km2 FROM scenes")
def spherical_area(spark, sf):
    return scenes(spark, sf).select("scene_id", rounded(ge.spherical_area(scene_ring()) / 1e6, 3).alias("km2"))


@query("boxes", f"""WITH {SQL_Z}, t AS (SELECT *, (xmin <= c AND xmax >= a AND ymin <= d AND ymax >= b) AS meets FROM z)
  SELECT scene_id, meets, (xmin <= a AND xmax >= c AND ymin <= b AND ymax >= d) AS contains,
    {rd('CASE WHEN meets THEN (least(xmax,c)-greatest(xmin,a))*(least(ymax,d)-greatest(ymin,b)) END', 9)} AS shared FROM t""")
def boxes(spark, sf):
    scene, zone = ge.box("xmin", "ymin", "xmax", "ymax"), zone_box()
    return scenes(spark, sf).select("scene_id", ge.boxes_intersect(scene, zone).alias("meets"), ge.box_contains(scene, zone).alias("contains"),
                                    rounded(ge.box_area(ge.box_intersection(scene, zone)), 9).alias("shared"))


@query("clip_zone", f"""WITH {SQL_Z}, t AS (SELECT *, (c-a)*(d-b) < (xmax-xmin)*(ymax-ymin) AS small, (xmin <= c AND xmax >= a AND ymin <= d AND ymax >= b) AS meets FROM (SELECT * REPLACE (xmin + 0.03e0 AS c) FROM z))
  SELECT scene_id, {rd('CASE WHEN small THEN CASE WHEN meets THEN greatest(xmin,a) END ELSE xmin END')} AS xmin, {rd('CASE WHEN small THEN CASE WHEN meets THEN least(xmax,c) END ELSE xmax END')} AS xmax FROM t""")
def clip_zone(spark, sf):
    """The zone's right edge moves with the scene, so both branches occur."""
    zone = ge.box(F.lit(OTHER[0]), F.lit(OTHER[1]), F.col("xmin") + 0.03, F.lit(OTHER[3]))
    out = scenes(spark, sf).select("scene_id", ge.clip_zone_box(zone, ge.box("xmin", "ymin", "xmax", "ymax")).alias("c"))
    return out.select("scene_id", rounded("c.xmin").alias("xmin"), rounded("c.xmax").alias("xmax"))


@query("polygon_relations", f"""WITH {SQL_Z} SELECT scene_id, (xmin <= c AND xmax >= a AND ymin <= d AND ymax >= b) AS meets,
    (a <= xmin AND c >= xmax AND b <= ymin AND d >= ymax) AS inside,
    {rd('greatest(0e0, least(xmax,c)-greatest(xmin,a))*greatest(0e0, least(ymax,d)-greatest(ymin,b))', 8)} AS shared FROM z""")
def polygon_relations(spark, sf):
    """General polygon tests; on boxes they must agree with the box formulas."""
    zone = ge.box_ring(*[F.lit(v) for v in OTHER])
    out = scenes(spark, sf).withColumn("ring", scene_ring())
    return out.select("scene_id", ge.polygons_intersect("ring", zone).alias("meets"), ge.polygon_contains(zone, "ring").alias("inside"),
                      rounded(ge.polygon_area(ge.clip_convex("ring", zone)), 8).alias("shared"))


SQL_FAR = """far AS (SELECT scene_id, -179e0+(scene_id*13)%357 AS lon, -88e0+(scene_id*7)%176 AS lat FROM scenes)"""


def far(spark, sf):
    return scenes(spark, sf).select("scene_id", (F.lit(-179.0) + (F.col("scene_id") * 13) % 357).alias("lon"),
                                    (F.lit(-88.0) + (F.col("scene_id") * 7) % 176).alias("lat"))


@query("utm_epsg", f"""WITH {SQL_SCENES}, {SQL_FAR} SELECT scene_id, CAST(CASE WHEN lat-1e0 < -80 THEN 32761 WHEN lat+1e0 > 80 THEN 32661
    ELSE CASE WHEN lat-1e0 < 0 THEN 32700 ELSE 32600 END + CAST(trunc((lon-1e0+180)/6) AS INT) % 60 + 1 END AS INT) AS epsg FROM far""")
def utm_epsg(spark, sf):
    """Boxes of two degrees: the closing vertex makes the median the lower corner."""
    ring = ge.box_ring(F.col("lon") - 1, F.col("lat") - 1, F.col("lon") + 1, F.col("lat") + 1)
    return far(spark, sf).select("scene_id", ge.utm_epsg(ring).alias("epsg"))


@query("ring_coords", f"WITH {SQL_SCENES} SELECT scene_id, 5 AS n, {rd('xmin')} AS lon, {rd('ymin')} AS lat FROM scenes")
def ring_coords(spark, sf):
    """Polygon text with latitude first and a hole: outer ring, swapped, closed."""
    pair = lambda x, y: F.array(F.col(y), F.col(x))
    outer = F.array(pair("xmin", "ymin"), pair("xmax", "ymin"), pair("xmax", "ymax"), pair("xmin", "ymax"))
    hole = F.array(pair("xmin", "ymin"), pair("xmax", "ymin"), pair("xmax", "ymax"))
    ring = ge.close_ring(ge.outer_ring(F.array(outer, hole), swap=True))
    out = scenes(spark, sf).select("scene_id", ring.alias("r"))
    return out.select("scene_id", F.size("r").alias("n"), rounded(F.element_at("r", -1)["lon"]).alias("lon"), rounded(F.element_at("r", -1)["lat"]).alias("lat"))


@query("dateline_parts", f"""WITH {SQL_SCENES}, {SQL_FAR}, b AS (SELECT scene_id, lat, lon AS w, CASE WHEN lon+8 > 180 THEN lon+8-360 ELSE lon+8 END AS e FROM far)
  SELECT scene_id, 'whole' AS part, 5 AS n, {rd('8e0*2')} AS area FROM b WHERE w < e UNION ALL
  SELECT scene_id, 'east', 5, {rd('(180e0-w)*2')} FROM b WHERE w > e AND w < 180 UNION ALL SELECT scene_id, 'west', 5, {rd('(e+180e0)*2')} FROM b WHERE w > e AND e > -180""")
def dateline_parts(spark, sf):
    east = F.when(F.col("lon") + 8 > 180, F.col("lon") + 8 - 360).otherwise(F.col("lon") + 8)
    ring = ge.box_ring(F.col("lon"), F.col("lat") - 1, east, F.col("lat") + 1)
    out = far(spark, sf).select("scene_id", F.explode(ge.dateline_parts(ring)).alias("p"))
    return out.select("scene_id", "p.part", F.size("p.ring").alias("n"), rounded(ge.polygon_area("p.ring")).alias("area"))


# Fixed values of the WGS84 transverse Mercator series (fourth order), as literals: the checking SQL shares no code
# with the projection it checks.
UTM_SCALE, UTM_ECC = "6364902.16616508594e0", "0.0818191908426214943e0"
UTM_ALPHA = ("0.000837731820630352897e0", "7.60852771424899860e-7", "1.19763800156052304e-9", "2.44337619452206391e-12")


def _utm_sql(lon, lat, zone):
    lam, phi = f"radians({lon}-({zone}*6-183))", f"radians({lat})"
    t = f"sinh(atanh(sin({phi}))-{UTM_ECC}*atanh({UTM_ECC}*sin({phi})))"
    base = f"SELECT scene_id, {lat} AS lat, {zone} AS zone, atan2({t}, cos({lam})) AS xi, atanh(sin({lam})/sqrt(1+{t}*{t})) AS eta FROM far"
    e = "eta+" + "+".join(f"{a}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(UTM_ALPHA, 1))
    nn = "xi+" + "+".join(f"{a}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(UTM_ALPHA, 1))
    return base, f"500000e0+{UTM_SCALE}*({e})", f"(CASE WHEN lat < 0 THEN 10000000e0 ELSE 0e0 END)+{UTM_SCALE}*({nn})"


_ZONE = "(CAST(trunc((lon+180)/6) AS INT)+1)"
_BASE, _E, _NORTH = _utm_sql("lon", "lat", _ZONE)


def _epsg():
    """Zone code of the point's own hemisphere."""
    return F.when(F.col("lat") < 0, F.lit(32700)).otherwise(F.lit(32600)) + ((F.col("lon") + 180) / 6).cast("int") + 1


@query("to_utm", f"WITH {SQL_SCENES}, {SQL_FAR}, p AS ({_BASE}) SELECT scene_id, {rd(_E, 3)} AS easting, {rd(_NORTH, 3)} AS northing FROM p")
def to_utm(spark, sf):
    out = far(spark, sf).select("scene_id", pr.to_utm("lon", "lat", _epsg()).alias("u"))
    return out.select("scene_id", rounded("u.easting", 3).alias("easting"), rounded("u.northing", 3).alias("northing"))


@query("utm_round_trip", f"WITH {SQL_SCENES}, {SQL_FAR} SELECT scene_id, {rd('lon')} AS lon, {rd('lat')} AS lat FROM far")
def utm_round_trip(spark, sf):
    out = far(spark, sf).withColumn("u", pr.to_utm("lon", "lat", _epsg()))
    back = out.select("scene_id", pr.from_utm("u.easting", "u.northing", _epsg()).alias("b"))
    return back.select("scene_id", rounded("b.lon").alias("lon"), rounded("b.lat").alias("lat"))


@query("albers_round_trip", f"WITH {SQL_SCENES}, {SQL_FAR} SELECT scene_id, {rd('lon/10e0+130')} AS lon, {rd('lat/6e0-25')} AS lat FROM far")
def albers_round_trip(spark, sf):
    near = far(spark, sf).select("scene_id", (F.col("lon") / 10 + 130).alias("lon"), (F.col("lat") / 6 - 25).alias("lat"))
    back = near.withColumn("a", pr.to_albers("lon", "lat")).select("scene_id", pr.from_albers("a.x", "a.y").alias("b"))
    return back.select("scene_id", rounded("b.lon").alias("lon"), rounded("b.lat").alias("lat"))


# Albers equal area on GRS80, parallels 18 and 36 south, origin 0, 132 east; q is the authalic function of the latitude.
SQL_ALBERS = """k AS (SELECT 0.0818191910428158e0 AS e), q AS (SELECT *, lon/10e0+130 AS x0, sin(radians(lat/6e0-25)) AS s, sin(radians(-18e0)) AS s1, sin(radians(-36e0)) AS s2 FROM far, k),
  w AS (SELECT *, (1-e*e)*(s/(1-e*e*s*s)-ln((1-e*s)/(1+e*s))/(2*e)) AS q, (1-e*e)*(s1/(1-e*e*s1*s1)-ln((1-e*s1)/(1+e*s1))/(2*e)) AS q1,
    (1-e*e)*(s2/(1-e*e*s2*s2)-ln((1-e*s2)/(1+e*s2))/(2*e)) AS q2, (1-s1*s1)/(1-e*e*s1*s1) AS m1, (1-s2*s2)/(1-e*e*s2*s2) AS m2 FROM q),
  v AS (SELECT *, (m1-m2)/(q2-q1) AS n FROM w), u AS (SELECT *, m1+n*q1 AS c FROM v)"""


@query("to_albers", f"""WITH {SQL_SCENES}, {SQL_FAR}, {SQL_ALBERS} SELECT scene_id, {rd('6378137e0/n*sqrt(c-n*q)*sin(n*radians(x0-132))', 3)} AS x,
    {rd('6378137e0/n*sqrt(c)-6378137e0/n*sqrt(c-n*q)*cos(n*radians(x0-132))', 3)} AS y FROM u""")
def to_albers(spark, sf):
    near = far(spark, sf).select("scene_id", (F.col("lon") / 10 + 130).alias("lon"), (F.col("lat") / 6 - 25).alias("lat"))
    out = near.select("scene_id", pr.to_albers("lon", "lat").alias("a"))
    return out.select("scene_id", rounded("a.x", 3).alias("x"), rounded("a.y", 3).alias("y"))


# Fixed values of the inverse series, as literals like those above.
UTM_BETA = ('8.37732164060057418e-04', '5.90586956793398774e-08', '1.67348888035484859e-10', '2.16773776302203622e-13')
UTM_DELTA = ('3.35655146912521279e-03', '6.57187308396013260e-06', '1.76465640047585012e-08', '5.40048208169354359e-11')


def _latitude_sql(easting, northing, south):
    """Latitude of a UTM point."""
    x, y = f"(({northing}-{south})/{UTM_SCALE})", f"(({easting}-500000e0)/{UTM_SCALE})"
    x1 = x + "".join(f"-({b})*sin({2 * j}*{x})*cosh({2 * j}*{y})" for j, b in enumerate(UTM_BETA, 1))
    y1 = y + "".join(f"-({b})*cos({2 * j}*{x})*sinh({2 * j}*{y})" for j, b in enumerate(UTM_BETA, 1))
    chi = f"asin(sin({x1})/cosh({y1}))"
    return f"degrees({chi}" + "".join(f"+({d})*sin({2 * j}*{chi})" for j, d in enumerate(UTM_DELTA, 1)) + ")"


SQL_MGRS = f"""p AS ({_BASE}), u AS (SELECT scene_id, zone, {_E} AS e, {_NORTH} AS n, CASE WHEN lat < 0 THEN 10000000e0 ELSE 0e0 END AS south FROM p),
  b AS (SELECT *, ({_latitude_sql('200000e0', 'n', 'south')}+{_latitude_sql('700000e0', 'n', 'south')})/2 AS middle FROM u),
  i AS (SELECT *, least(CAST(trunc((middle+80)/8) AS INT)+2, 21) AS band, CASE zone % 3 WHEN 1 THEN 0 WHEN 2 THEN 8 ELSE 16 END+CAST(trunc(e/100000) AS INT)-1 AS c,
    CAST(trunc(((n+CASE WHEN zone % 2 = 0 THEN 500000e0 ELSE 0e0 END) % 2000000)/100000) AS INT) AS r, 'ABCDEFGHJKLMNPQRSTUVWXYZ' AS t FROM b)"""


@query("mgrs_square", f"""WITH {SQL_SCENES}, {SQL_FAR}, {SQL_MGRS} SELECT scene_id, lon, far.lat,
    CASE WHEN zone <> 61 THEN lpad(CAST(zone AS VARCHAR), 2, '0') || substr(t, band+1, 1) || substr(t, c+1, 1) || substr(t, r+1, 1) END AS square FROM i JOIN far USING (scene_id)""")
def mgrs_square(spark, sf):
    """Grid squares of all points."""
    pts = far(spark, sf)
    u = pts.withColumn("epsg", _epsg()).withColumn("u", pr.to_utm("lon", "lat", F.col("epsg")))
    return u.select("scene_id", "lon", "lat", pr.mgrs_square("epsg", "u.easting", "u.northing").alias("square"))


@query("centroid", f"WITH {SQL_SCENES} SELECT scene_id, {rd('(xmin+xmax)/2', 3)} AS lon, {rd('(ymin+ymax)/2', 3)} AS lat FROM scenes")
def centroid(spark, sf):
    """A box of a tenth of a degree: to three digits the projected centroid is the middle of the box."""
    ring = scenes(spark, sf).select("scene_id", scene_ring().alias("ring"))
    c = ring.withColumn("epsg", ge.utm_epsg("ring")).select("scene_id", ge.centroid("ring", "epsg").alias("c"))
    return c.select("scene_id", rounded("c.lon", 3).alias("lon"), rounded("c.lat", 3).alias("lat"))


@query("convex_hull", f"WITH {SQL_SCENES} SELECT scene_id, 5 AS n, {rd('(xmax-xmin)*(ymax-ymin)', 9)} AS area FROM scenes")
def convex_hull(spark, sf):
    """Corner points in scrambled order plus inner points: the hull is the box again."""
    mid_x, mid_y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    cloud = F.array(ge.point("xmax", "ymax"), ge.point(mid_x, mid_y), ge.point("xmin", "ymin"), ge.point("xmin", "ymax"),
                    ge.point(mid_x, "ymin"), ge.point("xmax", "ymin"))
    out = scenes(spark, sf).select("scene_id", ge.convex_hull(cloud).alias("h"))
    return out.select("scene_id", F.size("h").alias("n"), rounded(ge.polygon_area("h"), 9).alias("area"))
