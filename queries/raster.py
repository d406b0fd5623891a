"""Raster algebra: bands, mosaics, crops, tiles, resampling, land-cover joins."""

from pyspark.sql import functions as F

from queries.fixtures import SQL_BANDS, SQL_PIXELS, SQL_PLACED, bands13, pixels, placed, rd, rounded
from queries.indices import KEYS, KEYS_SQL
from queries.registry import query
from swathframe.functions.geometry import tile_centre, utm_zone
from swathframe.operators import grid as gr
from swathframe.operators.layout import melt
from swathframe.plans.dataset_build import build_tiles

OPTICAL = ["r_t0", "g_t0", "b_t0", "nir_t0"]
TOP = "SELECT x, y, " + ", ".join(f"arg_max({b}, source_order) AS {b}" for b in OPTICAL) + " FROM placed GROUP BY x, y"


def rsel(cols, digits=6):
    return ", ".join(f"{rd(c, digits)} AS {c}" for c in cols)


@query("combine_bands", f"WITH {SQL_PIXELS} SELECT {KEYS_SQL}, {rsel(OPTICAL)} FROM pixels")
def combine_bands(spark, sf):
    single = melt(pixels(spark, sf), {b: [b] for b in OPTICAL}, KEYS)
    return gr.combine_bands(single, OPTICAL, KEYS).select(*KEYS, *[rounded(b).alias(b) for b in OPTICAL])


@query("mosaic", f"WITH {SQL_PLACED}, m AS ({TOP}) SELECT x, y, {rsel(OPTICAL)} FROM m")
def mosaic(spark, sf):
    return gr.mosaic(placed(spark, sf), OPTICAL).select("x", "y", *[rounded(b).alias(b) for b in OPTICAL])


@query("mosaic_list", f"WITH {SQL_PLACED} SELECT x, y, {rd('COALESCE(MAX(CASE WHEN tile_id % 2 = 1 THEN r_t0 END), MAX(r_t0))')} AS r_t0 FROM (SELECT x, y, tile_id % 2 AS tile_id, arg_max(r_t0, tile_id) AS r_t0 FROM placed GROUP BY 1, 2, 3) GROUP BY x, y")
def mosaic_list(spark, sf):
    """Two image lists, each a mosaic; the second is drawn over the first."""
    p = placed(spark, sf)
    halves = [gr.mosaic(p.filter(F.col("tile_id") % 2 == i), ["r_t0"]) for i in (0, 1)]
    return gr.mosaic_all(halves, ["r_t0"]).select("x", "y", rounded("r_t0").alias("r_t0"))


@query("crop", f"WITH {SQL_PLACED} SELECT tile_id, x, y, {rd('r_t0')} AS r_t0 FROM placed WHERE x >= 3 AND x <= 20 AND y >= 4 AND y <= 60")
def crop(spark, sf):
    lo_x, lo_y, hi_x, hi_y = gr.pad_bbox((4, 5, 19, 59), (-1, -1, 1, 1))
    return gr.crop(placed(spark, sf), lo_x, hi_y, hi_x, lo_y).select("tile_id", "x", "y", rounded("r_t0").alias("r_t0"))


@query("retile", f"WITH {SQL_BANDS} SELECT scene_id, format('{{:02d}}_{{:02d}}', \"row\"//10+1, col//10+1) AS tile_id, CAST(\"row\"%10 AS INT) AS \"row\", CAST(col%10 AS INT) AS col, {rd('b4')} AS b4 FROM bands13")
def retile(spark, sf):
    return gr.retile(bands13(spark, sf), 10, keys=("scene_id",)).select("scene_id", "tile_id", "row", "col", rounded("b4").alias("b4"))


@query("retile_overlap", f"""WITH {SQL_BANDS}, d AS (SELECT scene_id, MAX("row")+1 AS nr, MAX(col)+1 AS nc FROM bands13 GROUP BY 1),
  t AS (SELECT b.*, tr.i AS tr, tc.j AS tc FROM bands13 b JOIN d USING (scene_id), range(5) tr(i), range(5) tc(j)
    WHERE "row" >= tr.i*7 AND "row" < tr.i*7+10 AND col >= tc.j*7 AND col < tc.j*7+10
      AND tr.i <= CASE WHEN nr <= 10 THEN 0 ELSE ceil((nr-10)/7e0) END AND tc.j <= CASE WHEN nc <= 10 THEN 0 ELSE ceil((nc-10)/7e0) END)
  SELECT scene_id, format('{{:02d}}_{{:02d}}', tr+1, tc+1) AS tile_id, CAST("row"-tr*7 AS INT) AS "row", CAST(col-tc*7 AS INT) AS col, {rd('b4')} AS b4 FROM t""")
def retile_overlap(spark, sf):
    return gr.retile(bands13(spark, sf), 10, overlap=3, keys=("scene_id",)).select("scene_id", "tile_id", "row", "col", rounded("b4").alias("b4"))


@query("build_dataset", f"""WITH {SQL_PLACED}, m AS ({TOP}) SELECT format('{{:02d}}_{{:02d}}', (60-y)//8+1, (x-2)//8+1) AS tile_id,
    CAST((60-y)%8 AS INT) AS "row", CAST((x-2)%8 AS INT) AS col, {rsel(OPTICAL)} FROM m WHERE x >= 2 AND x <= 29 AND y >= 3 AND y <= 60""")
def build_dataset(spark, sf):
    """Single-band images -> bands -> mosaic -> crop -> tiles."""
    images = melt(placed(spark, sf), {b: [b] for b in OPTICAL}, ["source_order", "x", "y"])
    return build_tiles(images, OPTICAL, (2, 60, 29, 3), size=8).select(*KEYS, *[rounded(b).alias(b) for b in OPTICAL])


@query("band_select", f"WITH {SQL_BANDS} SELECT scene_id, \"row\", col, {rsel(['b4', 'b8'])} FROM bands13 WHERE \"row\" >= 4 AND \"row\" <= 20")
def band_select(spark, sf):
    region = bands13(spark, sf).filter(F.col("row").between(4, 20))
    return gr.band_select(region, ["b4", "b8"], ["scene_id", "row", "col"]).select("scene_id", "row", "col", rounded("b4").alias("b4"), rounded("b8").alias("b8"))


@query("resample_down", f"WITH {SQL_BANDS} SELECT scene_id, CAST(\"row\"//3 AS INT) AS \"row\", CAST(col//3 AS INT) AS col, {rd('AVG(b4)')} AS b4, {rd('arg_min(b8, \"row\"*100+col)')} AS b8 FROM bands13 GROUP BY scene_id, \"row\"//3, col//3")
def resample_down(spark, sf):
    return gr.block_mean(bands13(spark, sf), ["b4"], 3, ("scene_id",), flags=["b8"]).select("scene_id", "row", "col", rounded("b4").alias("b4"), rounded("b8").alias("b8"))


@query("resample_up", f"""WITH {SQL_BANDS}, t AS (SELECT scene_id, "row"*2+i.i AS tr, col*2+j.j AS tc FROM bands13, range(2) i(i), range(2) j(j)),
  w AS (SELECT t.scene_id, tr, tc, b.b4, b.b8, (1-abs((tr+0.5e0)/2-0.5e0-b."row"))*(1-abs((tc+0.5e0)/2-0.5e0-b.col)) AS w FROM t JOIN bands13 b ON b.scene_id = t.scene_id
    AND b."row" BETWEEN tr//2-1 AND tr//2+1 AND b.col BETWEEN tc//2-1 AND tc//2+1
    AND abs((tr+0.5e0)/2-0.5e0-b."row") < 1 AND abs((tc+0.5e0)/2-0.5e0-b.col) < 1)
  SELECT scene_id, CAST(tr AS INT) AS "row", CAST(tc AS INT) AS col, {rd('SUM(b4*w)/SUM(w)', 7)} AS b4, {rd('SUM(b8*w)/SUM(w)', 7)} AS b8 FROM w GROUP BY scene_id, tr, tc""")
def resample_up(spark, sf):
    return gr.upsample_bilinear(bands13(spark, sf), ["b4", "b8"], 2, ("scene_id",)).select(
        "scene_id", "row", "col", rounded("b4", 7).alias("b4"), rounded("b8", 7).alias("b8"))


@query("multilook", f"WITH {SQL_BANDS} SELECT scene_id, CAST(\"row\"//2 AS INT) AS \"row\", CAST(col//2 AS INT) AS col, {rd('AVG(b4)')} AS b4, {rd('AVG(b11)')} AS b11 FROM bands13 GROUP BY scene_id, \"row\"//2, col//2")
def multilook(spark, sf):
    return gr.multilook(bands13(spark, sf), ["b4", "b11"], keys=("scene_id",)).select("scene_id", "row", "col", rounded("b4").alias("b4"), rounded("b11").alias("b11"))


_U, _V = "(0.9e0*x-0.2e0*y+3e0)", "(0.2e0*x+0.9e0*y-2e0)"


def _targets(spark, sf):
    """Output cells on a turned and shifted grid, one per mosaic cell."""
    cells = placed(spark, sf).select((F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y")).distinct()
    source = gr.mosaic(placed(spark, sf), ["r_t0"]).select(F.col("y").alias("row"), F.col("x").alias("col"), "r_t0")
    turn = lambda x, y: F.struct((0.9 * x - 0.2 * y + 3.0).alias("u"), (-(0.2 * x + 0.9 * y - 2.0)).alias("v"))
    return source, cells, turn


SQL_REPROJECT = f"""{SQL_PLACED}, m AS ({TOP}), t AS (SELECT DISTINCT x+0.5e0 AS x, y+0.5e0 AS y FROM placed), p AS (SELECT x, y, {_U} AS u, {_V} AS v FROM t)"""


@query("reproject_nearest", f"WITH {SQL_REPROJECT} SELECT p.x, p.y, {rd('m.r_t0')} AS r_t0 FROM p JOIN m ON m.x = floor(u) AND m.y = floor(v)")
def reproject_nearest(spark, sf):
    source, cells, turn = _targets(spark, sf)
    return gr.reproject(source, cells, turn, (0.0, 0.0), 1.0, ["r_t0"]).select("x", "y", rounded("r_t0").alias("r_t0"))


@query("reproject_bilinear", f"""WITH {SQL_REPROJECT}, w AS (SELECT p.x, p.y, m.r_t0 AS s, (1-abs(v-0.5e0-m.y))*(1-abs(u-0.5e0-m.x)) AS w FROM p JOIN m
    ON m.x BETWEEN floor(u-0.5e0) AND floor(u-0.5e0)+1 AND m.y BETWEEN floor(v-0.5e0) AND floor(v-0.5e0)+1)
  SELECT x, y, {rd('SUM(s*w)/NULLIF(SUM(w),0)')} AS r_t0 FROM w GROUP BY x, y""")
def reproject_bilinear(spark, sf):
    source, cells, turn = _targets(spark, sf)
    return gr.reproject(source, cells, turn, (0.0, 0.0), 1.0, ["r_t0"], "bilinear").select("x", "y", rounded("r_t0").alias("r_t0"))


@query("merge_view_angles", f"""WITH {SQL_PIXELS}, a AS (SELECT class_id AS band, "row", col, tile_id AS detector, CASE WHEN vv_t0 < 0 THEN NULL ELSE vv_t0 END AS v FROM pixels)
  SELECT band, "row", col, {rd('arg_max(v, detector)')} AS value FROM a WHERE v IS NOT NULL GROUP BY band, "row", col""")
def merge_view_angles(spark, sf):
    """Negative cells are NaN holes of a detector grid."""
    a = pixels(spark, sf).select(F.col("class_id").alias("band"), "row", "col", F.col("tile_id").alias("detector"),
                                 F.when(F.col("vv_t0") < 0, float("nan")).otherwise(F.col("vv_t0")).alias("value"))
    return gr.merge_view_angles(a).select("band", "row", "col", rounded("value").alias("value"))


@query("tile_centre", f"WITH {SQL_PLACED} SELECT tile_id, {rd('MIN(x)*10e0 + (COUNT(DISTINCT col)//2)*10')} AS cx, {rd('6000000e0 - MIN(y)*10e0 - (COUNT(DISTINCT \"row\")//2)*10')} AS cy, 55 AS zone FROM placed GROUP BY tile_id")
def tile_centre_q(spark, sf):
    t = placed(spark, sf).groupBy("tile_id").agg((F.min("x") * 10.0).alias("ulx"), (F.lit(6000000.0) - F.min("y") * 10.0).alias("uly"),
                                                 (F.max("row") + 1).alias("nr"), (F.max("col") + 1).alias("nc"))
    c = t.withColumn("c", tile_centre("ulx", "uly", "nr", "nc"))
    return c.select("tile_id", rounded("c.x").alias("cx"), rounded("c.y").alias("cy"), utm_zone(F.lit(32755)).alias("zone"))


@query("join_landclass", f"""WITH {SQL_PLACED}, l AS (SELECT x, y, arg_max(class_id, tile_id) AS class_id FROM placed GROUP BY x, y)
  SELECT p.tile_id, p."row", p.col, l.class_id FROM placed p JOIN l ON l.x = p.x AND l.y = p.y""")
def join_landclass(spark, sf):
    p = placed(spark, sf)
    land = p.groupBy("x", "y").agg(F.max_by("class_id", "tile_id").alias("class_id")).select(
        (F.col("x") + 0.25).alias("x"), (-F.col("y") - 0.25).alias("y"), "class_id")
    at = p.select(*KEYS, (F.col("x") + 0.5).alias("x"), (-F.col("y") - 0.5).alias("y"))
    return gr.join_landclass(at, land, 0.0, 0.0, 1.0).select(*KEYS, "class_id")


@query("landclass_of_tiles", f"""WITH {SQL_PLACED}, l AS (SELECT x, y, arg_max(class_id, tile_id) AS class_id FROM placed GROUP BY x, y),
  t AS (SELECT tile_id, MIN(x) AS x0, MIN(y) AS y0, MAX(x)+1 AS x1, MAX(y)+1 AS y1 FROM placed GROUP BY tile_id)
  SELECT t.tile_id, l.x, l.y, l.class_id FROM l JOIN t ON l.x >= x0 AND l.x < x1 AND l.y >= y0 AND l.y < y1""")
def landclass_of_tiles(spark, sf):
    p = placed(spark, sf)
    land = p.groupBy("x", "y").agg(F.max_by("class_id", "tile_id").alias("class_id"))
    tiles = p.groupBy("tile_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    return gr.landclass_of_tiles(land, tiles, 8.0, 8.0)


@query("georeference_predictions", f"""WITH {SQL_PLACED}, t AS (SELECT tile_id, MIN(x)*10e0 AS x0, 6000000e0-MIN(y)*10e0 AS y0 FROM placed GROUP BY tile_id)
  SELECT p.tile_id, p."row", p.col, {rd('x0+p.col*10e0')} AS x, {rd('y0-p."row"*10e0')} AS y, {rd('p.r_t0')} AS r_t0 FROM placed p JOIN t USING (tile_id)""")
def georeference_predictions(spark, sf):
    p = placed(spark, sf)
    tiles = p.groupBy("tile_id").agg((F.min("x") * 10.0).alias("x0"), (F.lit(6000000.0) - F.min("y") * 10.0).alias("y0"))
    return gr.georeference(p.select(*KEYS, "r_t0"), tiles, 10.0).select(*KEYS, rounded("x").alias("x"), rounded("y").alias("y"), rounded("r_t0").alias("r_t0"))
