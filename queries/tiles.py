"""Tile checks, splits, layout joins."""

from pyspark.sql import functions as F

from queries.fixtures import CHANNELS, SQL_FLAT, SQL_PIXELS, pix_flat, pixels, rd, rounded, table
from queries.indices import KEYS, KEYS_SQL
from queries.registry import query
from swathframe.constants import LABEL_CHANNELS, X_CHANNELS
from swathframe.operators import layout as ly
from swathframe.operators import tile_checks as tc
from swathframe.plans import dataset_build as db

SQL_TILES = """tiles AS (SELECT CAST(vec_id AS BIGINT) AS tile_id, generate_subscripts(embedding, 1) - 1 AS pos,
  CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""


def vector_tiles(spark, sf):
    """Every embedding as an 8 x 8 single-band tile."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("tile_id"), F.lit("e").alias("band"),
                                                 F.lit(8).alias("n_rows"), F.lit(8).alias("n_cols"), F.col("embedding").alias("values"))


@query("tiles_to_pixels", f"WITH {SQL_TILES} SELECT tile_id, 'e' AS band, CAST(pos // 8 AS INT) AS \"row\", CAST(pos % 8 AS INT) AS col, {rd('value')} AS value FROM tiles")
def tiles_to_pixels(spark, sf):
    return ly.tiles_to_pixels(vector_tiles(spark, sf)).withColumn("value", rounded("value"))


@query("pixels_to_tiles", f"""WITH {SQL_PIXELS}, m AS (SELECT tile_id, 'r' AS band, "row", col, r_t0 AS v FROM pixels UNION ALL SELECT tile_id, 'nir', "row", col, nir_t0 FROM pixels)
  SELECT tile_id, band, 8 AS n_rows, 8 AS n_cols, COUNT(*) AS n, {rd("SUM(v * (\"row\"*8+col))", 4)} AS weighted, {rd('MAX(CASE WHEN "row"=0 AND col=0 THEN v END)')} AS first_value,
    {rd('MAX(CASE WHEN "row"=7 AND col=7 THEN v END)')} AS last_value FROM m GROUP BY tile_id, band""")
def pixels_to_tiles(spark, sf):
    long = ly.melt(pixels(spark, sf), {"r": ["r_t0"], "nir": ["nir_t0"]}, KEYS)
    v = F.col("values")
    weighted = F.aggregate(F.transform(v, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return ly.pixels_to_tiles(long).select("tile_id", "band", "n_rows", "n_cols", F.size(v).cast("long").alias("n"),
                                           rounded(weighted, 4).alias("weighted"), rounded(F.element_at(v, 1)).alias("first_value"),
                                           rounded(F.element_at(v, -1)).alias("last_value"))


def _four(spark, sf):
    px = pixels(spark, sf)
    radar = lambda t: px.select(*KEYS, F.col(f"vv_{t}").alias("vv"), F.col(f"vh_{t}").alias("vh"))
    optical = lambda t: px.select(*KEYS, *[F.col(f"{b}_{t}").alias(b) for b in ("r", "g", "b", "nir")])
    return radar("t0"), radar("t1"), optical("t0"), optical("t1")


@query("stack_channels", f"WITH {SQL_PIXELS} SELECT {KEYS_SQL}, {', '.join(rd(c) + f' AS {c}' for c in CHANNELS)} FROM pixels")
def stack_channels(spark, sf):
    return ly.stack_channels(*_four(spark, sf)).select(*KEYS, *[rounded(c).alias(c) for c in CHANNELS])


@query("join_x_label", f"WITH {SQL_PIXELS} SELECT {KEYS_SQL}, {rd('vv_t0')} AS vv_t0, {rd('r_t1')} AS r_t1 FROM pixels")
def join_x_label(spark, sf):
    px = pixels(spark, sf)
    out = ly.join_x_label(px.select(*KEYS, *X_CHANNELS), px.select(*KEYS, *LABEL_CHANNELS))
    return out.select(*KEYS, rounded("vv_t0").alias("vv_t0"), rounded("r_t1").alias("r_t1"))


@query("channel_shape", f"WITH {SQL_PIXELS} SELECT tile_id, 12 AS n_bands, 8 AS x_channels, 4 AS label_channels FROM pixels GROUP BY tile_id")
def channel_shape(spark, sf):
    """Bands counted in the data next to the counts the layout implies."""
    shape = ly.channel_shape()
    tiles = ly.melt(pixels(spark, sf), {c: [c] for c in CHANNELS}, ["tile_id"])
    return ly.band_count(tiles).select("tile_id", F.col("n_bands").cast("int").alias("n_bands"), F.lit(shape["dataX"]).alias("x_channels"),
                                       F.lit(shape["label"]).alias("label_channels"))


BANDS = ["vv_t0", "r_t0"]
SQL_CHECK = f"""{SQL_PIXELS}, px AS (SELECT *, CASE WHEN tile_id % 3 = 0 AND "row" < 5 THEN 0e0 ELSE r_t0 END AS r0, ("row"*col+tile_id) % 4 AS mask FROM pixels WHERE NOT (tile_id % 5 = 0 AND "row" = 7)),
  checks AS (SELECT tile_id, CAST(MAX("row")+1 AS INT) AS n_rows, CAST(MAX(col)+1 AS INT) AS n_cols,
    CAST(SUM(CASE WHEN r0 <> 0 THEN 1 ELSE 0 END + CASE WHEN vv_t0 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_nonzero, COUNT(*)*2 AS n_values,
    COUNT(*) FILTER (WHERE mask IN (2,3)) AS n_cloud FROM px GROUP BY tile_id),
  judged AS (SELECT *, (n_rows <> 8 OR n_cols <> 8) AS wrong_size, n_nonzero < n_values*0.7e0 AS no_signal, n_cloud > 24 AS cloudy, tile_id % 7 = 0 AS no_data FROM checks),
  reasons AS (SELECT *, CASE WHEN wrong_size THEN 'wrong_size' WHEN no_signal THEN 'no_signal' WHEN cloudy THEN 'cloudy' WHEN no_data THEN 'no_data' END AS reason FROM judged)"""


def checked(spark, sf):
    """Some tiles lose a row, some lose their signal, some declare a no-data value."""
    px = pixels(spark, sf).filter(~((F.col("tile_id") % 5 == 0) & (F.col("row") == 7)))
    px = px.withColumn("r0", F.when((F.col("tile_id") % 3 == 0) & (F.col("row") < 5), 0.0).otherwise(F.col("r_t0")))
    px = px.withColumn("mask", (F.col("row") * F.col("col") + F.col("tile_id")) % 4)
    meta = px.select("tile_id").distinct().withColumn("band_no", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn(
        "nodata", F.when(((F.col("tile_id") % 7 == 0) & (F.col("band_no") == 1)) | (F.col("band_no") == 3), 0.0))
    return tc.tile_checks(px, ["vv_t0", "r0"], size=8, mask="mask", cloud_limit=24, band_meta=meta, skip_last_band=True)


_CHECK_COLUMNS = ["tile_id", "n_rows", "n_cols", "n_nonzero", "n_values", "n_cloud", "wrong_size", "no_signal", "cloudy", "no_data", "reason"]


@query("tile_checks", f"WITH {SQL_CHECK} SELECT {', '.join(_CHECK_COLUMNS)}, reason IS NULL AS conform FROM reasons")
def tile_checks(spark, sf):
    return checked(spark, sf).select(*_CHECK_COLUMNS, "conform")


@query("wrong_size", f"WITH {SQL_CHECK} SELECT tile_id, wrong_size FROM judged")
def wrong_size(spark, sf):
    return checked(spark, sf).select("tile_id", "wrong_size")


@query("no_signal", f"WITH {SQL_CHECK} SELECT tile_id, no_signal FROM judged")
def no_signal(spark, sf):
    return checked(spark, sf).select("tile_id", "no_signal")


@query("cloudy", f"WITH {SQL_CHECK} SELECT tile_id, n_cloud, cloudy FROM judged")
def cloudy(spark, sf):
    return checked(spark, sf).select("tile_id", "n_cloud", "cloudy")


@query("has_no_data", f"WITH {SQL_CHECK} SELECT tile_id, no_data FROM judged")
def has_no_data(spark, sf):
    return checked(spark, sf).select("tile_id", "no_data")


@query("unconformed_tiles", f"WITH {SQL_CHECK} SELECT tile_id FROM reasons WHERE reason IS NOT NULL")
def unconformed_tiles(spark, sf):
    c = checked(spark, sf)
    return tc.unconformed_tiles([c, c.filter("wrong_size")])


@query("conformed_tiles", f"WITH {SQL_CHECK} SELECT tile_id FROM reasons WHERE reason IS NULL")
def conformed_tiles(spark, sf):
    c = checked(spark, sf)
    return tc.conformed_tiles(c.select("tile_id"), tc.unconformed_tiles([c]))


@query("drop_unconformed", f"WITH {SQL_CHECK} SELECT {KEYS_SQL} FROM pixels WHERE tile_id NOT IN (SELECT tile_id FROM reasons WHERE reason IS NOT NULL)")
def drop_unconformed(spark, sf):
    return tc.conformed_tiles(pixels(spark, sf).select(*KEYS), tc.unconformed_tiles([checked(spark, sf)]))


SQL_SPLIT = """o AS (SELECT o_orderkey AS tile_id, row_number() OVER (ORDER BY md5(concat('2', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS p,
    COUNT(*) OVER () AS n FROM (SELECT DISTINCT o_orderkey FROM orders)),
  sized AS (SELECT *, ceil(round(n*0.1e0, 9)) AS nt FROM o), s AS (SELECT *, ceil(round((n-nt)*(0.2e0/(0.2e0+0.7e0)), 9)) AS nv FROM sized),
  split AS (SELECT tile_id, CASE WHEN p <= nt THEN 'test' WHEN p <= nt+nv THEN 'val' ELSE 'train' END AS split FROM s)"""


@query("split_train_val_test", f"WITH {SQL_SPLIT} SELECT tile_id, split FROM split")
def split_train_val_test(spark, sf):
    """Exact-size split of every order key taken as a tile id."""
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"))
    return tc.split_train_val_test(ids, 0.7, 0.2, 0.1)


@query("ordered_position", "SELECT o_orderkey AS tile_id, row_number() OVER (ORDER BY md5(concat('7', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS position FROM orders")
def ordered_position(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"))
    return tc.ordered_position(ids, "tile_id", 7)


@query("sample_tiles", "SELECT o_orderkey AS tile_id FROM (SELECT DISTINCT o_orderkey FROM orders) ORDER BY md5(concat('2', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 10")
def sample_tiles(spark, sf):
    return tc.sample_tiles(table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id")), 10)


@query("first_tiles", f"WITH {SQL_FLAT} SELECT DISTINCT tile_id FROM pix_flat ORDER BY tile_id LIMIT 5")
def first_tiles(spark, sf):
    return tc.first_tiles(pix_flat(spark, sf), 5)


@query("conform_and_split", f"""WITH {SQL_PIXELS}, o AS (SELECT tile_id, row_number() OVER (ORDER BY md5(concat('2', CAST(tile_id AS VARCHAR))), tile_id) AS p, COUNT(*) OVER () AS n
    FROM (SELECT DISTINCT tile_id FROM pixels)), sized AS (SELECT *, ceil(round(n*0.1e0, 9)) AS nt FROM o), s AS (SELECT *, ceil(round((n-nt)*(0.2e0/(0.2e0+0.7e0)), 9)) AS nv FROM sized)
  SELECT tile_id, "row", col, CASE WHEN p <= nt THEN 'test' WHEN p <= nt+nv THEN 'val' ELSE 'train' END AS split FROM s JOIN pixels USING (tile_id)""")
def conform_and_split(spark, sf):
    names = ("s1_t0", "s1_t1", "s2_t0", "s2_t1")
    bands = {n: (["vv", "vh"] if n.startswith("s1") else ["r", "g", "b", "nir"]) for n in names}
    split = db.conform_and_split(dict(zip(names, _four(spark, sf))), bands, size=8)
    return db.with_split(pixels(spark, sf).select(*KEYS), split)


@query("distinct_tiles", f"WITH {SQL_FLAT} SELECT DISTINCT tile_id FROM pix_flat")
def distinct_tiles(spark, sf):
    return pix_flat(spark, sf).select("tile_id").distinct()
