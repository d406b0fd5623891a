"""Vegetation indices and differences."""

from pyspark.sql import functions as F

from queries.fixtures import SQL_PREDICTIONS, pixels, pix_flat, predictions, rd, rounded, SQL_FLAT, SQL_PIXELS
from queries.registry import query
from swathframe.functions import indices as vi
from swathframe.operators.confusion import changed_tiles, keep_changed_tiles
from swathframe.operators.normalise import join_tile_stats
from swathframe.operators.statistics import tile_band_minmax
from swathframe.plans.burn_severity import POST, PRE, PREDICTED, vi_report

KEYS = ["tile_id", "row", "col"]
KEYS_SQL = 'tile_id, "row", col'


def ndvi_sql(r, n):
    return f"(CASE WHEN {n}+{r} = 0 THEN 0e0 ELSE ({n}-{r})/({n}+{r}) END)"


def evi_sql(r, n, b):
    return f"2.5e0*({n}-{r})/NULLIF({n}+6e0*{r}-7.5e0*{b}+1e0, 0)"


def msavi_sql(r, n):
    rad = f"((2*{n}+1)*(2*{n}+1)-8*({n}-{r}))"
    return f"CASE WHEN {rad} >= 0 THEN (2*{n}+1-sqrt(CASE WHEN {rad} >= 0 THEN {rad} END))/2 END"


def bai_sql(r, n, form="*"):
    return f"1e0/NULLIF(((0.1e0-{r})*(0.1e0-{r})){form}((0.06e0-{n})*(0.06e0-{n})), 0)"


@query("ndvi", f"WITH {SQL_PIXELS} SELECT {KEYS_SQL}, {rd(ndvi_sql('r_t0', 'nir_t0'))} AS ndvi FROM pixels")
def ndvi(spark, sf):
    return pixels(spark, sf).select(*KEYS, rounded(vi.ndvi(PRE)).alias("ndvi"))


@query("ndvi_tile_scaled", f"""WITH {SQL_PIXELS},
  v AS (SELECT {KEYS_SQL}, {ndvi_sql('r_t0', 'nir_t0')} AS ndvi FROM pixels),
  s AS (SELECT tile_id, MIN(ndvi) lo, MAX(ndvi) hi FROM v GROUP BY tile_id)
  SELECT v.tile_id, v."row", v.col, {rd('(ndvi-lo)/NULLIF(hi-lo, 0)')} AS ndvi FROM v JOIN s USING (tile_id)""")
def ndvi_tile_scaled(spark, sf):
    """Index scaled by a stored per-tile range: the table is derived, then joined like a file would be."""
    px = pixels(spark, sf)
    stats = tile_band_minmax(px.withColumn("ndvi", vi.ndvi(PRE)), ["ndvi"])
    joined = join_tile_stats(px, stats, ["ndvi"], divide_by=1)
    return joined.select(*KEYS, rounded(vi.ndvi(PRE, "ndvi_min", "ndvi_max")).alias("ndvi"))


@query("normalized_difference", f"""WITH {SQL_PIXELS} SELECT {KEYS_SQL},
  {rd('(nir_t0-g_t0)/NULLIF(nir_t0+g_t0, 0)')} AS nd_nir_g, {rd('(g_t0-r_t0)/NULLIF(g_t0+r_t0, 0)')} AS nd_g_r FROM pixels""")
def normalized_difference(spark, sf):
    return pixels(spark, sf).select(*KEYS, rounded(vi.normalized_difference("nir_t0", "g_t0")).alias("nd_nir_g"),
                                    rounded(vi.normalized_difference("g_t0", "r_t0")).alias("nd_g_r"))


@query("evi", f"WITH {SQL_PIXELS} SELECT {KEYS_SQL}, {rd(evi_sql('r_t0', 'nir_t0', 'b_t0'))} AS evi FROM pixels")
def evi(spark, sf):
    return pixels(spark, sf).select(*KEYS, rounded(vi.evi(PRE)).alias("evi"))


@query("msavi", f"WITH {SQL_PIXELS} SELECT {KEYS_SQL}, {rd(msavi_sql('r_t0', 'nir_t0'))} AS msavi FROM pixels")
def msavi(spark, sf):
    return pixels(spark, sf).select(*KEYS, rounded(vi.msavi(PRE)).alias("msavi"))


@query("bai", f"""WITH {SQL_PIXELS} SELECT {KEYS_SQL}, {rd(bai_sql('r_t0', 'nir_t0'), 3)} AS bai,
  {rd(bai_sql('r_t0', 'nir_t0', '+'))} AS bai_sum FROM pixels""")
def bai(spark, sf):
    return pixels(spark, sf).select(*KEYS, rounded(vi.bai(PRE), 3).alias("bai"), rounded(vi.bai(PRE, "sum")).alias("bai_sum"))


@query("vegetation_index_table", f"""WITH {SQL_FLAT}
  SELECT tile_id, {rd(f"SUM({ndvi_sql('r_t0', 'nir_t0')})")} AS ndvi, {rd(f"SUM({evi_sql('r_t0', 'nir_t0', '(b_t0/10e0)')})")} AS evi,
    {rd(f"SUM({msavi_sql('r_t0', 'nir_t0')})")} AS msavi, {rd("SUM(nir_t0)")} AS identity
  FROM pix_flat GROUP BY tile_id""")
def vegetation_index_table(spark, sf):
    """All indices by name, summed per tile over every pixel row."""
    bands = {"R": "r_t0", "NIR": "nir_t0", "B": F.col("b_t0") / 10, "value": "nir_t0"}
    return pix_flat(spark, sf).groupBy("tile_id").agg(*[
        rounded(F.sum(vi.vegetation_index(n, bands))).alias(n) for n in ("ndvi", "evi", "msavi", "identity")])


@query("vi_difference", f"""WITH {SQL_PIXELS} SELECT {KEYS_SQL},
  {rd(ndvi_sql('r_t0', 'nir_t0') + '-' + ndvi_sql('r_t1', 'nir_t1'))} AS d_ndvi,
  {rd(f"({evi_sql('r_t0', 'nir_t0', 'b_t0')})-({evi_sql('r_t1', 'nir_t1', 'b_t1')})")} AS d_evi FROM pixels""")
def vi_difference(spark, sf):
    return pixels(spark, sf).select(*KEYS, rounded(vi.vi_difference("ndvi", PRE, POST)).alias("d_ndvi"),
                                    rounded(vi.vi_difference("evi", PRE, POST)).alias("d_evi"))


@query("vi_relative_difference", f"""WITH {SQL_PIXELS} SELECT {KEYS_SQL},
  {rd(f"({ndvi_sql('r_t0', 'nir_t0')}-{ndvi_sql('r_t1', 'nir_t1')})/NULLIF(sqrt(abs({ndvi_sql('r_t0', 'nir_t0')})), 0)")} AS rd_ndvi FROM pixels""")
def vi_relative_difference(spark, sf):
    return pixels(spark, sf).select(*KEYS, rounded(vi.vi_relative_difference("ndvi", PRE, POST)).alias("rd_ndvi"))


@query("is_changed", f"""WITH {SQL_PIXELS} SELECT tile_id,
  NOT (median({ndvi_sql('r_t0', 'nir_t0')}-{ndvi_sql('r_t1', 'nir_t1')}) < 0.005e0) AS changed FROM pixels GROUP BY tile_id""")
def is_changed(spark, sf):
    return changed_tiles(pixels(spark, sf), vi.vi_difference("ndvi", PRE, POST), 0.005)


@query("is_changed_flat", f"""WITH {SQL_FLAT} SELECT tile_id,
  NOT (median({ndvi_sql('r_t0', 'nir_t0')}-{ndvi_sql('r_t1', 'nir_t1')}) < 0.14e0) AS changed FROM pix_flat GROUP BY tile_id""")
def is_changed_flat(spark, sf):
    return changed_tiles(pix_flat(spark, sf), vi.vi_difference("ndvi", PRE, POST))


@query("keep_changed_tiles", f"""WITH {SQL_PIXELS}, c AS (SELECT tile_id FROM pixels GROUP BY tile_id
  HAVING NOT (median({ndvi_sql('r_t0', 'nir_t0')}-{ndvi_sql('r_t1', 'nir_t1')}) < 0.005e0))
  SELECT {KEYS_SQL}, {rd('r_t0')} AS r_t0, {rd('r_t1')} AS r_t1 FROM pixels WHERE tile_id IN (SELECT tile_id FROM c)""")
def keep_changed(spark, sf):
    px = pixels(spark, sf)
    changed = changed_tiles(px, vi.vi_difference("ndvi", PRE, POST), 0.005)
    return keep_changed_tiles(px, changed).select(*KEYS, rounded("r_t0").alias("r_t0"), rounded("r_t1").alias("r_t1"))


@query("batch_vi_report", f"""WITH {SQL_PREDICTIONS}, v AS (SELECT {KEYS_SQL}, {ndvi_sql('r_t0', 'nir_t0')} AS a,
    {ndvi_sql('r_t1', 'nir_t1')} AS b, {ndvi_sql('r_pred', 'nir_pred')} AS c FROM predictions)
  SELECT {KEYS_SQL}, {rd('a')} AS vi_pre, {rd('b')} AS vi_true, {rd('c')} AS vi_pred, {rd('a-b')} AS d_true, {rd('a-c')} AS d_pred FROM v""")
def batch_vi_report(spark, sf):
    out = vi_report(predictions(spark, sf), "ndvi", PRE, POST, PREDICTED)
    return out.select(*KEYS, *[rounded(c).alias(c) for c in ("vi_pre", "vi_true", "vi_pred", "d_true", "d_pred")])


