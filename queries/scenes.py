"""Scene catalogue: filters, names, matching, selection."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from queries.fixtures import SQL_IN_ZONE, SQL_SCENES, ZONE, rd, rounded, scenes
from queries.registry import query
from swathframe.functions import names as nm
from swathframe.functions.geometry import box, box_area, point
from swathframe.operators import matching as mt
from swathframe.operators import scenes as sc
from swathframe.operators.footprint_union import union_area
from swathframe.plans import scene_selection as ss


@query("filter_scenes", f"WITH {SQL_SCENES} SELECT scene_id FROM scenes WHERE sensor = 2 AND acquired_at >= TIMESTAMP '2024-01-05' AND acquired_at < TIMESTAMP '2024-01-20' AND {SQL_IN_ZONE}")
def filter_scenes(spark, sf):
    return sc.filter_scenes(scenes(spark, sf), "2024-01-05", "2024-01-20", ZONE, 2).select("scene_id")


@query("filter_scenes_exact", f"WITH {SQL_SCENES} SELECT scene_id FROM scenes WHERE acquired_at >= TIMESTAMP '2024-01-05' AND acquired_at < TIMESTAMP '2024-01-20' AND {SQL_IN_ZONE}")
def filter_scenes_exact(spark, sf):
    """Exact footprint test on rings; for boxes it agrees with the bounding boxes."""
    from swathframe.functions.geometry import box_ring
    sc_ = scenes(spark, sf).withColumn("footprint", box_ring("xmin", "ymin", "xmax", "ymax"))
    ring = box_ring(*[F.lit(v) for v in ZONE])
    return sc.filter_scenes(sc_, "2024-01-05", "2024-01-20", ZONE, ring=ring).select("scene_id")


@query("filter_s1", f"WITH {SQL_SCENES} SELECT scene_id FROM scenes WHERE sensor = 1 AND mode = 'IW' AND list_contains(polarisations, 'VV') AND list_contains(polarisations, 'VH') AND pass_direction = 'DESCENDING'")
def filter_s1(spark, sf):
    return sc.filter_s1(scenes(spark, sf).filter("sensor = 1"), "IW", ["VV", "VH"]).select("scene_id")


@query("filter_cloud", f"WITH {SQL_SCENES} SELECT scene_id, {rd('cloud_pct')} AS cloud_pct FROM scenes WHERE cloud_pct < 10")
def filter_cloud(spark, sf):
    return sc.filter_cloud(scenes(spark, sf), 10).select("scene_id", rounded("cloud_pct").alias("cloud_pct"))


@query("filter_product_id", f"WITH {SQL_SCENES} SELECT scene_id, sensor FROM scenes WHERE scene_id = 123")
def filter_product_id(spark, sf):
    return sc.filter_product_id(scenes(spark, sf), 123).select("scene_id", "sensor")


@query("filter_params", f"WITH {SQL_SCENES} SELECT scene_id FROM scenes WHERE sensor = 1 AND scene_id % 11 <> 0 AND mode = 'IW' AND product_type = 'GRD' AND pass_direction = 'DESCENDING' AND CAST(acquired_at AS DATE) BETWEEN DATE '2024-01-09' AND DATE '2024-01-11'")
def filter_params(spark, sf):
    instrument = F.when(F.col("scene_id") % 11 == 0, "OTHER").otherwise("C-SAR")
    radar = scenes(spark, sf).filter("sensor = 1").withColumn("instrument", instrument)
    return sc.filter_params(radar, {"pass_direction": "DESCENDING"}, 1, around="2024-01-10").select("scene_id")


@query("prune_by_month", f"WITH {SQL_SCENES} SELECT scene_id, strftime(acquired_at, '%Y-%m-%d') AS ymd FROM scenes WHERE strftime(acquired_at, '%Y%m%d') BETWEEN '20231215' AND '20240110'")
def prune_by_month(spark, sf):
    """The range crosses a year end."""
    return sc.prune_by_month(sc.with_partitions(scenes(spark, sf)), "20231215", "20240110").select("scene_id", "ymd")


GRID_SQL = """located AS (SELECT scene_id, -60e0+(scene_id*7)%121 AS lat, -175e0+(scene_id*11)%351 AS lon, sat_id, product_type, mode, acquired_at FROM scenes),
  cell AS (SELECT *, CAST(trunc(lat/5) AS INT)*5 - CASE WHEN lat < 0 THEN 5 ELSE 0 END AS bottom, CAST(trunc(lon/5) AS INT)*5 - CASE WHEN lon < 0 THEN 5 ELSE 0 END AS lft FROM located),
  named AS (SELECT *, format('{:02d}{}{:03d}{}-{:02d}{}{:03d}{}', abs(bottom+5), CASE WHEN bottom+5 < 0 THEN 'S' ELSE 'N' END, abs(lft), CASE WHEN lft < 0 THEN 'W' ELSE 'E' END,
    abs(bottom), CASE WHEN bottom < 0 THEN 'S' ELSE 'N' END, abs(lft+5), CASE WHEN lft+5 < 0 THEN 'W' ELSE 'E' END) AS gridcell FROM cell)"""


def located(spark, sf):
    """Scenes with centroids all over the globe, exact multiples of the cell size included."""
    return scenes(spark, sf).withColumn("lat", F.lit(-60.0) + (F.col("scene_id") * 7) % 121).withColumn(
        "lon", F.lit(-175.0) + (F.col("scene_id") * 11) % 351)


@query("gridcell_name", f"WITH {SQL_SCENES}, {GRID_SQL} SELECT scene_id, gridcell FROM named")
def gridcell_name(spark, sf):
    return located(spark, sf).select("scene_id", nm.gridcell_name("lon", "lat", F.lit(5)).alias("gridcell"))


@query("prune_by_gridcell", f"WITH {SQL_SCENES}, {GRID_SQL} SELECT scene_id FROM named WHERE lft+5 >= 100 AND lft <= 150 AND bottom <= 10 AND bottom+5 >= -40")
def prune_by_gridcell(spark, sf):
    cells = located(spark, sf).withColumn("gridcell", nm.gridcell_name("lon", "lat", F.lit(5)))
    return sc.prune_by_gridcell(cells, 100, 150, -40, 10).select("scene_id")


LEVEL_SQL = "CASE WHEN sat_id LIKE 'S1%' THEN CASE product_type WHEN 'RAW' THEN 'LEVEL-0' WHEN 'OCN' THEN 'LEVEL-2' ELSE 'LEVEL-1' END WHEN sat_id LIKE 'S2%' THEN 'L2A' ELSE 'LEVEL-Level-2A' END"


@query("processing_level", f"WITH {SQL_SCENES} SELECT scene_id, {LEVEL_SQL} AS level FROM scenes")
def processing_level(spark, sf):
    return scenes(spark, sf).select("scene_id", nm.processing_level("sat_id", "product_type", F.lit("Level-2A")).alias("level"))


@query("archive_path", f"""WITH {SQL_SCENES}, {GRID_SQL} SELECT scene_id, concat_ws('/', 'Sentinel-' || substr(sat_id, 2, 1),
    CASE WHEN sat_id LIKE 'S1%' THEN 'C-SAR' WHEN sat_id LIKE 'S2%' THEN 'MSI' ELSE 'OLCI' END, CASE WHEN sat_id LIKE 'S2%' THEN 'L2A' ELSE product_type END,
    strftime(acquired_at, '%Y'), strftime(acquired_at, '%Y-%m'),
    CASE WHEN substr(sat_id, 2, 1) IN ('3','5') OR product_type = 'OCN' THEN strftime(acquired_at, '%Y-%m-%d') WHEN mode = 'WV' THEN 'WV'
      WHEN scene_id % 11 <> 0 THEN gridcell END) AS path FROM named""")
def archive_path(spark, sf):
    at = located(spark, sf).withColumn("lon", F.when(F.col("scene_id") % 11 != 0, F.col("lon")))
    return at.select("scene_id", nm.archive_path("sat_id", F.lit("OLCI"), "product_type", F.lit("Level-2A"), "mode", "acquired_at",
                                                 "lon", "lat").alias("path"))


@query("scene_names", f"WITH {SQL_SCENES} SELECT scene_id, strftime(acquired_at, '%Y-%m-%d') AS day, {rd('xmin')} AS xmin, {rd('ymin')} AS ymin, {rd('xmax')} AS xmax, {rd('ymax')} AS ymax FROM scenes WHERE sensor = 2")
def scene_names(spark, sf):
    return sc.scene_names(scenes(spark, sf), 2).select("scene_id", "day", *[rounded(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("find_scenes", f"""WITH {SQL_SCENES} SELECT scene_id, strftime(acquired_at, '%Y-%m-%d') AS day FROM scenes WHERE acquired_at >= TIMESTAMP '2024-01-02' AND acquired_at < TIMESTAMP '2024-01-25' AND {SQL_IN_ZONE}
  AND ((sensor = 2 AND cloud_pct < 20) OR (sensor = 1 AND mode = 'IW' AND list_contains(polarisations, 'VV') AND pass_direction = 'DESCENDING'))""")
def find_scenes(spark, sf):
    period = ("2024-01-02", "2024-01-25", ZONE)
    optical = sc.find_scenes(scenes(spark, sf), *period, sensor=2, cloud_limit=20)
    radar = sc.find_scenes(scenes(spark, sf), *period, sensor=1, mode="IW", polarisations=["VV"])
    return optical.unionByName(radar).select("scene_id", "day")


@query("date_helpers", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS mm,
  strftime(o_orderdate + INTERVAL 12 DAY, '%Y-%m-%d') AS later, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS earlier FROM orders""")
def date_helpers(spark, sf):
    from queries.fixtures import table
    o = table(spark, sf, "orders").withColumn("day", nm.format_day("o_orderdate"))
    return o.select("o_orderkey", "day", nm.pad2(F.month("o_orderdate")).alias("mm"), nm.shift_day("day", F.lit(12)).alias("later"),
                    nm.shift_day("day", F.lit(-1)).alias("earlier"))


@query("tile_id_from_path", """SELECT event_id, format('{:02d}_{:02d}.tif', user_id % 100, event_id % 100) AS tile_id, concat('Sentinel', event_id % 2 + 1, '_t0/sub') AS relative_dir, concat('S1', event_type) AS platform FROM events""")
def tile_id_from_path(spark, sf):
    from queries.fixtures import table
    ev = table(spark, sf, "events")
    path = F.format_string("/data/dataX/Sentinel%d_t0/sub/merged_crop_sent1_t0_%02d_%02d.tif", F.col("event_id") % 2 + 1, F.col("user_id") % 100, F.col("event_id") % 100)
    name = F.concat(F.lit("S1"), "event_type", F.lit("_IW_GRD"))
    return ev.select("event_id", nm.tile_id_from_path(path).alias("tile_id"), nm.relative_dir(path).alias("relative_dir"), nm.platform_of(name).alias("platform"))


@query("product_name_fields", f"""WITH {SQL_SCENES}, p AS (SELECT scene_id, sat_id, mode, CASE WHEN product_type = 'SLC' THEN 'RAW' ELSE product_type END AS kind, date_trunc('second', acquired_at) AS t FROM scenes)
  SELECT scene_id, sat_id, mode, kind AS product_type, CASE WHEN kind IN ('RAW','OCN') THEN strftime(t, '%Y-%m-%d %H:%M:%S') END AS start_time, CASE WHEN kind IN ('RAW','OCN') THEN CAST(scene_id AS INT) END AS absolute_orbit FROM p""")
def product_name_fields(spark, sf):
    kind = F.when(F.col("product_type") == "SLC", "RAW").otherwise(F.col("product_type"))
    stamp = F.date_format("acquired_at", "yyyyMMdd'T'HHmmss")
    name = F.concat_ws("_", "sat_id", "mode", kind, F.lit("0S"), F.lit("SDV"), stamp, stamp, F.format_string("%06d", "scene_id"), F.lit("ABCD.zip"))
    f = scenes(spark, sf).select("scene_id", nm.product_name_fields(name).alias("f"))
    return f.select("scene_id", "f.sat_id", "f.mode", "f.product_type", F.date_format("f.start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"), "f.absolute_orbit")


@query("fix_tile_id", """WITH t AS (SELECT event_id, concat('T55HF', chr(CAST(65 + event_id % 4 AS INT))) AS esa, concat('55HF', chr(CAST(65 + event_id % 3 AS INT))) AS ours,
    CASE WHEN event_id % 5 = 0 THEN '02.04' ELSE '02.00' END AS baseline FROM events)
  SELECT event_id, CASE WHEN baseline < '02.01' AND right(esa, 1) <> right(ours, 1) THEN lower('t' || ours) ELSE lower(esa) END AS tile_id FROM t""")
def fix_tile_id(spark, sf):
    from queries.fixtures import table
    letter = lambda k: F.char(F.lit(65) + F.col("event_id") % k)
    t = table(spark, sf, "events").select("event_id", F.concat(F.lit("T55HF"), letter(4)).alias("esa"), F.concat(F.lit("55HF"), letter(3)).alias("ours"),
                                          F.when(F.col("event_id") % 5 == 0, "02.04").otherwise("02.00").alias("baseline"))
    return t.select("event_id", nm.fix_tile_id("esa", "ours", "baseline").alias("tile_id"))


SQL_MATCH = """s2 AS (SELECT scene_id AS s2_id, tile_no, epoch_us(acquired_at) AS t, 0.0085e0+(scene_id%%4)*0.001e0 AS zone_area FROM scenes WHERE sensor = 2),
  s1 AS (SELECT scene_id AS s1_id, tile_no, epoch_us(acquired_at) AS t, (xmax-xmin)*(ymax-ymin) AS area FROM scenes WHERE sensor = 1 AND pass_direction = 'DESCENDING'),
  c AS (SELECT s2_id, s1_id, area, zone_area, s1.t - s2.t AS d FROM s2 JOIN s1 USING (tile_no)),
  r AS (SELECT *, CAST(CASE WHEN d >= 0 THEN d // 86400000000 + 1 ELSE (-d + 86399999999) // 86400000000 END AS INT) AS ring FROM c WHERE %s),
  k AS (SELECT *, MIN(CASE WHEN area >= zone_area THEN ring END) OVER (PARTITION BY s2_id) AS stop_ring FROM r WHERE ring <= %d)
  SELECT s2_id, s1_id, %s AS s1_area, ring, stop_ring, stop_ring IS NOT NULL AS all_found FROM s2 LEFT JOIN (SELECT * EXCLUDE (zone_area) FROM (
    SELECT *, row_number() OVER (PARTITION BY s2_id ORDER BY area DESC, ring, s1_id) AS rk FROM k WHERE stop_ring IS NULL OR ring <= stop_ring) WHERE rk = 1) b USING (s2_id)"""


def match_inputs(spark, sf):
    all_scenes = scenes(spark, sf)
    s2 = all_scenes.filter("sensor = 2").withColumn("zone_area", F.lit(0.0085) + (F.col("scene_id") % 4) * 0.001)
    s1 = all_scenes.filter("sensor = 1 and pass_direction = 'DESCENDING'").withColumn("area", box_area(box("xmin", "ymin", "xmax", "ymax")))
    return s2, s1


def _match(direction, days):
    def run(spark, sf):
        out = mt.nearest_scene_join(*match_inputs(spark, sf), max_days=days, direction=direction)
        return out.select("s2_id", "s1_id", rounded("s1_area").alias("s1_area"), "ring", "stop_ring", "all_found")
    return run


for _name, _side, _test, _days in (("nearest_scene_join", "both", "TRUE", 5), ("nearest_scene_before", "before", "d < 0", 3), ("nearest_scene_after", "after", "d >= 0", 2), ("nearest_scene_day", "both", "TRUE", 1)):
    query(_name, f"WITH {SQL_SCENES}, " + SQL_MATCH % (_test, _days, rd("area")))(_match(_side, _days))


# The same search by place: all radar scenes whose footprint meets the optical one's, whatever tile they are filed under.
SQL_BY_PLACE = SQL_MATCH.replace("s2_id, tile_no,", "s2_id, xmin, xmax, ymin, ymax,").replace("s1_id, tile_no,", "s1_id, xmin, xmax, ymin, ymax,").replace(
    "JOIN s1 USING (tile_no)", "JOIN s1 ON s1.xmin <= s2.xmax AND s1.xmax >= s2.xmin AND s1.ymin <= s2.ymax AND s1.ymax >= s2.ymin")


def _match_by_place(direction, days):
    def run(spark, sf):
        out = mt.nearest_scene_by_footprint(*match_inputs(spark, sf), max_days=days, direction=direction, cell=0.05)
        return out.select("s2_id", "s1_id", rounded("s1_area").alias("s1_area"), "ring", "stop_ring", "all_found")
    return run


for _name, _side, _test, _days in (("nearest_scene_by_footprint", "both", "TRUE", 5), ("nearest_footprint_before", "before", "d < 0", 3), ("nearest_footprint_after", "after", "d >= 0", 2)):
    query(_name, f"WITH {SQL_SCENES}, " + SQL_BY_PLACE % (_test, _days, rd("area")))(_match_by_place(_side, _days))


WIDE = (149.25, -34.98, 149.85, -34.92)
SQL_SHORT = """f AS (SELECT sensor, grp, arg_min(struct_pack(a := xmin, b := xmax), struct_pack(t := acquired_at, i := scene_id)) AS fp FROM g GROUP BY sensor, grp)"""


@query("zone_cover_short_circuit", f"""WITH {SQL_SCENES}, g AS (SELECT *, tile_no AS grp FROM scenes WHERE sensor = 2), {SQL_SHORT},
  w AS (SELECT MIN(grp) AS grp FROM f WHERE fp.a <= 149.32e0 AND fp.b >= 149.36e0) SELECT scene_id, tile_no FROM g, w WHERE w.grp IS NULL OR g.grp = w.grp""")
def zone_cover_short_circuit(spark, sf):
    return mt.zone_cover_short_circuit(scenes(spark, sf).filter("sensor = 2"), "tile_no", (149.32, -34.98, 149.36, -34.92)).select("scene_id", "tile_no")


@query("scene_groups", f"""WITH {SQL_SCENES}, g AS (SELECT *, CASE WHEN sensor = 2 THEN tile_no ELSE orbit_no END AS grp FROM scenes), {SQL_SHORT},
  w AS (SELECT sensor, MIN(grp) AS grp FROM f WHERE fp.a <= 149.25e0 AND fp.b >= 149.85e0 GROUP BY sensor)
  SELECT g.sensor, g.grp AS group_id, COUNT(*) AS n FROM g LEFT JOIN w USING (sensor) WHERE w.grp IS NULL OR g.grp = w.grp GROUP BY 1, 2""")
def scene_groups(spark, sf):
    """No scene covers the wide zone: all groups stay."""
    both = [ss.scene_groups(scenes(spark, sf), s, WIDE) for s in (1, 2)]
    return both[0].unionByName(both[1]).groupBy("sensor", "group_id").agg(F.count(F.lit(1)).alias("n"))


@query("largest_footprint", f"""WITH {SQL_SCENES}, a AS (SELECT *, (xmax-xmin)*(ymax-ymin) AS area FROM scenes)
  SELECT tile_no, scene_id, {rd('area')} AS area, area >= 0.0105e0 AS covers FROM (SELECT *, row_number() OVER (PARTITION BY tile_no ORDER BY area DESC, acquired_at, scene_id) AS rk FROM a) WHERE rk = 1""")
def largest_footprint(spark, sf):
    areas = scenes(spark, sf).withColumn("area", box_area(box("xmin", "ymin", "xmax", "ymax")))
    return mt.largest_footprint(areas, 0.0105, keys=("tile_no",)).select("tile_no", "scene_id", rounded("area").alias("area"), "covers")


@query("zone_union_coverage", f"""WITH {SQL_SCENES}, cells AS (SELECT 149.27e0+(x.i+0.5e0)*0.007e0 AS cx, -34.95e0+(y.j+0.5e0)*0.007e0 AS cy, x.i, y.j FROM range(60) x(i), range(10) y(j)),
  boxes AS (SELECT DISTINCT sensor, xmin, xmax, ymin, ymax FROM scenes),
  hit AS (SELECT DISTINCT sensor, i, j FROM cells JOIN boxes ON cx >= xmin AND cx <= xmax AND cy >= ymin AND cy <= ymax)
  SELECT sensor, COUNT(*) AS n_cells, {rd('COUNT(*)*0.007e0*0.007e0')} AS area, COUNT(*) > 0.9e0*600 AS covers FROM hit GROUP BY sensor""")
def zone_union_coverage(spark, sf):
    out = mt.zone_union_coverage(scenes(spark, sf), (149.27, -34.95, 149.69, -34.88), 0.007, factor=0.9, keys=("sensor",))
    return out.select("sensor", "n_cells", rounded("area").alias("area"), "covers")


@query("footprint_union_area", f"""WITH {SQL_SCENES}, boxes AS (SELECT DISTINCT sensor, xmin, xmax, -35e0+(scene_id%5)*0.02e0 AS y0, -34.9e0+(scene_id%5)*0.02e0 AS y1 FROM scenes),
  xs AS (SELECT sensor, xmin AS x FROM boxes UNION SELECT sensor, xmax FROM boxes), ys AS (SELECT sensor, y0 AS y FROM boxes UNION SELECT sensor, y1 FROM boxes),
  xc AS (SELECT sensor, x, lead(x) OVER (PARTITION BY sensor ORDER BY x) AS x2 FROM xs), yc AS (SELECT sensor, y, lead(y) OVER (PARTITION BY sensor ORDER BY y) AS y2 FROM ys),
  covered AS (SELECT DISTINCT xc.sensor, x, x2, y, y2 FROM xc JOIN yc USING (sensor) JOIN boxes b ON b.sensor = xc.sensor AND xmin < (x+x2)/2 AND xmax > (x+x2)/2 AND y0 < (y+y2)/2 AND y1 > (y+y2)/2)
  SELECT sensor, {rd('SUM((x2-x)*(y2-y))')} AS area, SUM((x2-x)*(y2-y)) >= 0.5e0*1.6e0*0.3e0 AS covers FROM covered GROUP BY sensor""")
def footprint_union_area(spark, sf):
    """Slanted footprints of shifted rows; one shear for all keeps every area, so the SQL can count upright boxes."""
    y0, y1 = (F.lit(y) + (F.col("scene_id") % 5) * F.lit(0.02) for y in (-35.0, -34.9))
    corners = [(x, y) for x, y in (("xmin", y0), ("xmax", y0), ("xmax", y1), ("xmin", y1))]
    ring = F.array(*(point(F.col(x) + F.lit(0.3) * (y + F.lit(35.0)), y) for x, y in corners))
    out = union_area(scenes(spark, sf).withColumn("ring", ring), (148.8, -35.1, 150.4, -34.8), keys=("sensor",), factor=0.5)
    return out.select("sensor", rounded("area").alias("area"), "covers")


@query("best_scene_per_group", f"""WITH {SQL_SCENES}, c AS (SELECT * FROM scenes WHERE sensor = 2 AND cloud_pct < 20),
  r AS (SELECT *, row_number() OVER (PARTITION BY tile_no ORDER BY acquired_at, scene_id) AS b, row_number() OVER (PARTITION BY tile_no ORDER BY acquired_at DESC, scene_id) AS e,
    row_number() OVER (PARTITION BY tile_no ORDER BY cloud_pct, scene_id) AS l FROM c)
  SELECT tile_no AS group_id, 'begin' AS criterion, scene_id FROM r WHERE b = 1 UNION ALL SELECT tile_no, 'end', scene_id FROM r WHERE e = 1 UNION ALL SELECT tile_no, 'lessclouds', scene_id FROM r WHERE l = 1""")
def best_scene_per_group(spark, sf):
    s2 = scenes(spark, sf).filter("sensor = 2").withColumn("group_id", F.col("tile_no")).withColumn("zone_cloud_pct", F.col("cloud_pct"))
    parts = [ss.best_scene_per_group(s2, c).select("group_id", F.lit(c).alias("criterion"), "scene_id") for c in ("begin", "end", "lessclouds")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _plan_sql(zone, limit):
    x0, y0, x1, y1 = (f"({v}e0)" for v in zone)
    parts = []
    for i, (b, e) in enumerate(PERIODS):
        parts.append(f"""SELECT {i} AS period, * FROM scenes WHERE sensor = 2 AND cloud_pct < {limit} AND acquired_at >= TIMESTAMP '{b}' AND acquired_at < TIMESTAMP '{e}'
          AND xmin <= {x1} AND xmax >= {x0} AND ymin <= {y1} AND ymax >= {y0}""")
    return f"""WITH {SQL_SCENES}, cand AS ({' UNION ALL '.join(parts)}),
      f AS (SELECT period, tile_no, arg_min(struct_pack(a := xmin, b := xmax, c := ymin, d := ymax), struct_pack(t := acquired_at, i := scene_id)) AS fp FROM cand GROUP BY 1, 2),
      w AS (SELECT period, MIN(tile_no) AS g FROM f WHERE fp.a <= {x0} AND fp.b >= {x1} AND fp.c <= {y0} AND fp.d >= {y1} GROUP BY period),
      kept AS (SELECT cand.* FROM cand LEFT JOIN w USING (period) WHERE w.g IS NULL OR w.g = tile_no),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, tile_no ORDER BY cloud_pct, scene_id) AS rk FROM kept) WHERE rk = 1),
      w2 AS (SELECT *, ({x1}-{x0})*({y1}-{y0}) < (xmax-xmin)*(ymax-ymin) AS cut FROM best),
      o AS (SELECT *, (wx1-wx0)*(wy1-wy0) AS zone_area FROM (SELECT *,
        CASE WHEN cut THEN greatest(xmin, {x0}) ELSE xmin END AS wx0, CASE WHEN cut THEN least(xmax, {x1}) ELSE xmax END AS wx1,
        CASE WHEN cut THEN greatest(ymin, {y0}) ELSE ymin END AS wy0, CASE WHEN cut THEN least(ymax, {y1}) ELSE ymax END AS wy1 FROM w2)),
      c AS (SELECT o.period, o.scene_id AS s2_id, s.scene_id AS s1_id, (s.xmax-s.xmin)*(s.ymax-s.ymin) AS area, zone_area, epoch_us(s.acquired_at)-epoch_us(o.acquired_at) AS d, s.acquired_at AS t1
        FROM o JOIN scenes s ON s.xmin <= o.wx1 AND s.xmax >= o.wx0 AND s.ymin <= o.wy1 AND s.ymax >= o.wy0 AND s.sensor = 1 AND s.pass_direction = 'DESCENDING' AND s.mode = 'IW'),
      r AS (SELECT *, CASE WHEN d >= 0 THEN d // 86400000000 + 1 ELSE (-d + 86399999999) // 86400000000 END AS ring FROM c),
      k AS (SELECT *, MIN(CASE WHEN area >= zone_area THEN ring END) OVER (PARTITION BY period, s2_id) AS stop FROM r WHERE ring <= 6),
      p AS (SELECT *, row_number() OVER (PARTITION BY period, s2_id ORDER BY area DESC, ring, s1_id) AS rk FROM k WHERE stop IS NULL OR ring <= stop)
      SELECT period, 2 AS sensor, scene_id, strftime(acquired_at, '%Y-%m-%d') AS day, NULL AS matched_to FROM o
      UNION ALL SELECT o.period, 1, s1_id, strftime(t1, '%Y-%m-%d'), o.scene_id FROM o LEFT JOIN (SELECT * FROM p WHERE rk = 1) q ON q.period = o.period AND q.s2_id = o.scene_id"""


PERIODS = [("2024-01-01", "2024-01-12"), ("2024-01-12", "2024-01-31")]


def _plan(zone):
    def run(spark, sf):
        sc_ = scenes(spark, sf).withColumn("zone_cloud_pct", F.col("cloud_pct"))
        return ss.selection_plan(sc_, PERIODS, zone, cloud_limit=20, max_days=6, mode="IW", cell=0.05)
    return run


query("selection_plan", _plan_sql(WIDE, 20))(_plan(WIDE))
query("selection_plan_one_tile", _plan_sql((149.32, -34.98, 149.36, -34.92), 20))(_plan((149.32, -34.98, 149.36, -34.92)))


@query("first_by_criterion", f"WITH {SQL_SCENES} SELECT orbit_no, scene_id, CAST(rk AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY orbit_no ORDER BY acquired_at, scene_id) AS rk FROM scenes WHERE sensor = 1) WHERE rk <= 2")
def first_by_criterion(spark, sf):
    """Ranking inside groups: the first two acquisitions of every orbit."""
    rank = F.row_number().over(Window.partitionBy("orbit_no").orderBy("acquired_at", "scene_id"))
    return scenes(spark, sf).filter("sensor = 1").withColumn("position", rank).filter("position <= 2").select("orbit_no", "scene_id", "position")


@query("sorted_scenes", f"WITH {SQL_SCENES} SELECT scene_id, sensor FROM scenes ORDER BY acquired_at, scene_id")
def sorted_scenes(spark, sf):
    return scenes(spark, sf).orderBy("acquired_at", "scene_id").select("scene_id", "sensor")


@query("newest_of_tile", f"WITH {SQL_SCENES} SELECT tile_no, sensor, scene_id, CAST(rk AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY tile_no, sensor ORDER BY acquired_at DESC, scene_id) AS rk FROM scenes) WHERE rk <= 5")
def newest_of_tile(spark, sf):
    """Top-k report: the five newest scenes of every tile and sensor; ranks are cut in each task before the shuffle."""
    newest = F.row_number().over(Window.partitionBy("tile_no", "sensor").orderBy(F.desc("acquired_at"), "scene_id"))
    return scenes(spark, sf).withColumn("position", newest).filter("position <= 5").select("tile_no", "sensor", "scene_id", "position")


@query("scene_difference", f"WITH {SQL_SCENES} SELECT tile_no, orbit_no FROM scenes WHERE sensor = 2 EXCEPT SELECT tile_no, orbit_no FROM scenes WHERE sensor = 1 AND mode = 'WV'")
def scene_difference(spark, sf):
    s = scenes(spark, sf)
    return s.filter("sensor = 2").select("tile_no", "orbit_no").distinct().join(
        s.filter("sensor = 1 and mode = 'WV'").select("tile_no", "orbit_no"), ["tile_no", "orbit_no"], "left_anti")
