"""Band statistics, rescaling, scalers, imputation, histograms."""

import uuid

from pyspark.sql import functions as F

from queries.fixtures import CHANNELS, SQL_FLAT, SQL_PIXELS, SQL_SCENES, pix_flat, pixels, rd, rounded, scenes
from queries.indices import KEYS, KEYS_SQL, evi_sql, ndvi_sql
from queries.registry import query
from swathframe.constants import LABEL_BANDS, OPTICAL_GROUPS, SAR_GROUPS, X_BANDS
from swathframe.functions import rescale as rs
from swathframe.functions.common import clip
from swathframe.operators import normalise as nm
from swathframe.operators import statistics as st
from swathframe.operators.knn_fill import knn_fill
from swathframe.operators.layout import pooled_columns
from swathframe.session import shared_folder

POOLED = pooled_columns(X_BANDS, LABEL_BANDS)
# Long form of the pixels: (tile_id, band, value).
SQL_LONG = f"""{SQL_PIXELS}, long AS ({' UNION ALL '.join(
    f"SELECT tile_id, '{b}' AS band, {c} AS v FROM pixels" for b, cs in POOLED.items() for c in cs)}),
  stats AS (SELECT tile_id, band, AVG(v) AS mean, stddev_pop(v) AS std, MIN(v) AS lo, MAX(v) AS hi, COUNT(*) AS n FROM long GROUP BY ALL)"""


@query("band_stats_mean_std", f"WITH {SQL_LONG} SELECT tile_id, band, {rd('mean')} AS s1, {rd('std')} AS s2, n FROM stats")
def band_stats_mean_std(spark, sf):
    return st.band_stats(pixels(spark, sf), POOLED).select("tile_id", "band", rounded("s1").alias("s1"), rounded("s2").alias("s2"), "n")


@query("band_stats_min_max", f"WITH {SQL_LONG} SELECT tile_id, band, {rd('lo')} AS s1, {rd('hi')} AS s2, n FROM stats")
def band_stats_min_max(spark, sf):
    return st.band_stats(pixels(spark, sf), POOLED, "min_max").select("tile_id", "band", rounded("s1").alias("s1"), rounded("s2").alias("s2"), "n")


@query("image_stats", f"WITH {SQL_FLAT} SELECT tile_id, 'R' AS band, {rd('AVG(r_t0)')} AS s1, {rd('stddev_pop(r_t0)')} AS s2 FROM pix_flat GROUP BY 1 UNION ALL SELECT tile_id, 'NIR', {rd('AVG(nir_t0)')}, {rd('stddev_pop(nir_t0)')} FROM pix_flat GROUP BY 1")
def image_stats(spark, sf):
    out = st.band_stats(pix_flat(spark, sf), {"R": ["r_t0"], "NIR": ["nir_t0"]})
    return out.select("tile_id", "band", rounded("s1").alias("s1"), rounded("s2").alias("s2"))


@query("batch_stats", f"WITH {SQL_LONG} SELECT band, {rd('AVG(mean)')} AS s1, {rd('AVG(std)')} AS s2 FROM stats GROUP BY band")
def batch_stats(spark, sf):
    out = st.batch_stats(st.band_stats(pixels(spark, sf), POOLED))
    return out.select("band", rounded("s1").alias("s1"), rounded("s2").alias("s2"))


METHODS = {"normalization": "(x-a)/NULLIF(b-a,0)", "normalization11": "2*((x-a)/NULLIF(b-a,0))-1",
           "center_norm11": "(x-(b-a)/2)/NULLIF((b-a)/2,0)", "center_norm11_r": "x*((b-a)/2)+(b-a)/2",
           "standardization11": "(x-a)/NULLIF(b,0)", "standardization": "(least(greatest((x-a)/NULLIF(b,0),-1e0),1e0)+1)/2",
           "normalization11_r": "(x+1)/2*(b-a)+a", "normalization_r": "x*(b-a)+a", "centering_r": "x+a", "centering": "x-a"}


@query("rescale_methods", f"WITH {SQL_PIXELS}, v AS (SELECT *, r_t0 AS x, g_t0 AS a, nir_t0 AS b FROM pixels) SELECT {KEYS_SQL}, {', '.join(rd(e, 4) + f' AS {n}' for n, e in METHODS.items())} FROM v")
def rescale_methods(spark, sf):
    """All ten formulas on stored statistics taken from two other bands."""
    return pixels(spark, sf).select(*KEYS, *[rounded(rs.rescale(n, "r_t0", "g_t0", "nir_t0"), 4).alias(n) for n in METHODS])


@query("reverse_norm", f"WITH {SQL_PIXELS} SELECT {KEYS_SQL}, {rd('(r_t0+1)/2*(nir_t0-g_t0)+g_t0')} AS n11, {rd('r_t0*(nir_t0-g_t0)+g_t0')} AS n01, {rd('r_t0+g_t0')} AS centred FROM pixels")
def reverse_norm(spark, sf):
    names = {"normalization11_r": "n11", "normalization_r": "n01", "centering_r": "centred"}
    return pixels(spark, sf).select(*KEYS, *[rounded(rs.reverse_rescale(m, "r_t0", "g_t0", "nir_t0")).alias(n) for m, n in names.items()])


def _pooled_sql(method_of):
    """Rescale every column by the pooled statistics of its band."""
    out = []
    for band, cols in POOLED.items():
        kind = rs.statistic_for(method_of[band])
        a, b = ("mean", "std") if kind == "mean_std" else ("lo", "hi")
        for c in cols:
            e = METHODS[method_of[band]]
            for k, v in (("x", f"p.{c}"), ("a", f"s_{band}.{a}"), ("b", f"s_{band}.{b}")):
                e = __import__("re").sub(rf"\b{k}\b", v, e)
            out.append(f"{rd(e)} AS {c}")
    joins = " ".join(f"JOIN stats s_{b} ON s_{b}.tile_id = p.tile_id AND s_{b}.band = '{b}'" for b in POOLED)
    return f'SELECT p.tile_id, p."row", p.col, {", ".join(out)} FROM pixels p {joins}'


@query("normalise_image", f"WITH {SQL_LONG} {_pooled_sql({b: 'normalization11' for b in POOLED})}")
def normalise_image(spark, sf):
    out = nm.normalise_image(pixels(spark, sf), POOLED, "normalization11")
    return out.select(*KEYS, *[rounded(c).alias(c) for c in CHANNELS])


MIXED = {"VV": "centering", "VH": "standardization", "R": "normalization11", "G": "center_norm11", "B": "normalization", "NIR": "standardization11"}


@query("rescale_combined", f"WITH {SQL_LONG} {_pooled_sql(MIXED)}")
def rescale_combined(spark, sf):
    """Each band its own method and its own statistics."""
    out = nm.rescale_bands(pixels(spark, sf), POOLED, MIXED)
    return out.select(*KEYS, *[rounded(c).alias(c) for c in CHANNELS])


def _group_sql(groups, factor):
    return " UNION ALL ".join(
        f"SELECT '{g}' AS band_group, AVG(v) AS mean, stddev_pop(v) AS std, {factor}e0 AS factor, COUNT(v) AS n FROM ("
        + " UNION ALL ".join(f"SELECT {c} AS v FROM pixels" for c in cs) + ")" for g, cs in groups.items())


@query("fit_scaler", f"WITH {SQL_PIXELS}, s AS ({_group_sql(OPTICAL_GROUPS, 0.2)}) SELECT band_group, {rd('mean')} AS mean, {rd('std')} AS std, factor, n FROM s")
def fit_scaler(spark, sf):
    out = nm.fit_scaler(pixels(spark, sf), OPTICAL_GROUPS, 0.2)
    return out.select("band_group", rounded("mean").alias("mean"), rounded("std").alias("std"), "factor", "n")


@query("apply_scaler", f"""WITH {SQL_PIXELS}, s AS ({_group_sql(OPTICAL_GROUPS, 0.2)})
  SELECT {KEYS_SQL}, {', '.join(rd(f"least(greatest(({c}-(SELECT mean FROM s WHERE band_group = '{g}'))/(SELECT std FROM s WHERE band_group = '{g}')*0.2e0, -1e0), 1e0)") + f' AS {c}' for g, cs in OPTICAL_GROUPS.items() for c in cs)} FROM pixels""")
def apply_scaler(spark, sf):
    px = pixels(spark, sf)
    out = nm.apply_scaler(px, nm.fit_scaler(px, OPTICAL_GROUPS, 0.2), OPTICAL_GROUPS, bounds=(-1.0, 1.0))
    return out.select(*KEYS, *[rounded(c).alias(c) for cs in OPTICAL_GROUPS.values() for c in cs])


@query("invert_scaler", f"WITH {SQL_PIXELS} SELECT {KEYS_SQL}, {', '.join(rd(c) + f' AS {c}' for cs in OPTICAL_GROUPS.values() for c in cs)} FROM pixels")
def invert_scaler(spark, sf):
    """Forward then inverse gives the input back."""
    px = pixels(spark, sf)
    scalers = nm.fit_scaler(px, OPTICAL_GROUPS, 0.2)
    out = nm.apply_scaler(nm.apply_scaler(px, scalers, OPTICAL_GROUPS), scalers, OPTICAL_GROUPS, invert=True)
    return out.select(*KEYS, *[rounded(c).alias(c) for cs in OPTICAL_GROUPS.values() for c in cs])


@query("clip", f"WITH {SQL_PIXELS} SELECT {KEYS_SQL}, {rd('least(greatest(vv_t0, -0.1e0), 0.1e0)')} AS vv_t0 FROM pixels")
def clip_q(spark, sf):
    return pixels(spark, sf).select(*KEYS, rounded(clip("vv_t0", -0.1, 0.1)).alias("vv_t0"))


@query("to_db", f"""WITH {SQL_PIXELS} SELECT {KEYS_SQL}, {rd('CASE WHEN vv_t0 > 0 THEN 10*log10(CASE WHEN vv_t0 > 0 THEN vv_t0 END) END')} AS db,
  {rd('CASE WHEN vv_t0 > 0 THEN vv_t0 END')} AS back FROM pixels""")
def to_db(spark, sf):
    return pixels(spark, sf).select(*KEYS, rounded(rs.to_db("vv_t0")).alias("db"), rounded(rs.from_db(rs.to_db("vv_t0"))).alias("back"))


SAR = [c for cs in SAR_GROUPS.values() for c in cs]


def _knn_sql(cols=SAR, k=5):
    """Brute force: every receiver row against every donor row of the tile."""
    return f"""cells AS ({' UNION ALL '.join(
        f"SELECT tile_id, '{c}' AS band, \"row\" AS rw, col, CASE WHEN {c} >= 0 THEN {c} END AS v FROM pixels" for c in cols)}),
  dist AS (SELECT a.tile_id, a.band, a.rw AS ra, b.rw AS rb,
      sqrt(SUM((a.v-b.v)*(a.v-b.v)) * 8e0 / NULLIF(COUNT(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 1 END), 0)) AS d
    FROM cells a JOIN cells b ON a.tile_id = b.tile_id AND a.band = b.band AND a.col = b.col GROUP BY ALL),
  ranked AS (SELECT m.tile_id, m.band, m.rw, m.col, n.v, d.d, row_number() OVER (PARTITION BY m.tile_id, m.band, m.rw, m.col ORDER BY d.d NULLS LAST, n.rw) AS rk
    FROM cells m JOIN cells n ON n.tile_id = m.tile_id AND n.band = m.band AND n.col = m.col AND n.v IS NOT NULL
    JOIN dist d ON d.tile_id = m.tile_id AND d.band = m.band AND d.ra = m.rw AND d.rb = n.rw WHERE m.v IS NULL),
  cm AS (SELECT tile_id, band, col, AVG(v) AS m FROM cells GROUP BY ALL),
  fill AS (SELECT r.tile_id, r.band, r.rw, r.col, CASE WHEN COUNT(r.d) = 0 THEN MAX(cm.m) ELSE AVG(r.v) END AS f
    FROM ranked r JOIN cm USING (tile_id, band, col) WHERE rk <= {k} GROUP BY ALL),
  filled AS (SELECT c.tile_id, c.rw, c.col, {', '.join(f"MAX(CASE WHEN c.band = '{c}' THEN COALESCE(c.v, f.f) END) AS {c}" for c in cols)}
    FROM cells c LEFT JOIN fill f USING (tile_id, band, rw, col) GROUP BY ALL)"""


@query("knn_impute", f"WITH {SQL_PIXELS}, {_knn_sql()} SELECT tile_id, rw AS \"row\", col, {', '.join(rd(c) + f' AS {c}' for c in SAR)} FROM filled")
def knn_impute(spark, sf):
    px = pixels(spark, sf)
    masked = px.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in SAR})
    return knn_fill(masked, SAR).select(*KEYS, *[rounded(c).alias(c) for c in SAR])


_DB = {c: f"CASE WHEN {c} > 0 THEN 10*log10(CASE WHEN {c} > 0 THEN {c} END) END" for c in SAR}
_OPT = [c for cs in OPTICAL_GROUPS.values() for c in cs]
_GROUP_OF = {c: g for gs in (SAR_GROUPS, OPTICAL_GROUPS) for g, cs in gs.items() for c in cs}


def _norm_cols():
    out = []
    for c in SAR + _OPT:
        g = _GROUP_OF[c]
        x = f"({c}-(SELECT mean FROM s WHERE band_group = '{g}'))/(SELECT std FROM s WHERE band_group = '{g}')*{0.5 if c in SAR else 0.2}e0"
        if c in _OPT:
            x = f"least(greatest({x}, -1e0), 1e0)"
        out.append(f"{rd(x, 5)} AS {c}")
    return ", ".join(out)


SQL_NORMALISED = f"""{SQL_PIXELS.replace('pixels AS (', 'raw AS (', 1)}, {_knn_sql().replace('FROM pixels', 'FROM raw')},
  pixels AS (SELECT raw.tile_id, raw."row", raw.col, {', '.join(e.replace(c, 'filled.' + c) + f' AS {c}' for c, e in _DB.items())}, {', '.join('raw.' + c for c in _OPT)}
    FROM raw JOIN filled ON filled.tile_id = raw.tile_id AND filled.rw = raw."row" AND filled.col = raw.col),
  s AS ({_group_sql(SAR_GROUPS, 0.5)} UNION ALL {_group_sql(OPTICAL_GROUPS, 0.2)})"""


@query("normalise_dataset", f"WITH {SQL_NORMALISED} SELECT {KEYS_SQL}, {_norm_cols()} FROM pixels")
def normalise_dataset(spark, sf):
    """The whole normaliser: gap filling, decibels, group scalers fitted on input and label, clipping."""
    out, _ = nm.normalise_dataset(pixels(spark, sf), stage=f"{shared_folder(spark)}/filled-{uuid.uuid4().hex}")
    return out.select(*KEYS, *[rounded(c, 5).alias(c) for c in SAR + _OPT])


@query("dataset_scalers", f"WITH {SQL_NORMALISED} SELECT band_group, {rd('mean', 5)} AS mean, {rd('std', 5)} AS std, factor, n FROM s")
def dataset_scalers(spark, sf):
    _, scalers = nm.normalise_dataset(pixels(spark, sf))  # only the fit reads the filled table: nothing to store
    return scalers.select("band_group", rounded("mean", 5).alias("mean"), rounded("std", 5).alias("std"), "factor", "n")


@query("join_tile_stats", f"""WITH {SQL_PIXELS}, s AS (SELECT tile_id, MIN(r_t0)*10000 AS lo, MAX(r_t0)*10000 AS hi FROM pixels GROUP BY tile_id)
  SELECT p.tile_id, p."row", p.col, {rd('lo/10000e0')} AS r_t0_min, {rd('hi/10000e0')} AS r_t0_max FROM pixels p JOIN s USING (tile_id)""")
def join_tile_stats(spark, sf):
    px = pixels(spark, sf)
    stats = px.groupBy("tile_id").agg((F.min("r_t0") * 10000).alias("r_t0_min"), (F.max("r_t0") * 10000).alias("r_t0_max"))
    return nm.join_tile_stats(px, stats, ["r_t0"]).select(*KEYS, rounded("r_t0_min").alias("r_t0_min"), rounded("r_t0_max").alias("r_t0_max"))


@query("override_stats", f"""WITH {SQL_LONG} SELECT tile_id, band, {rd("CASE WHEN band = 'R' AND tile_id % 2 = 0 THEN 0e0 ELSE lo END")} AS s1,
  {rd("CASE WHEN band = 'R' AND tile_id % 2 = 0 THEN 1e0 ELSE hi END")} AS s2 FROM stats""")
def override_stats(spark, sf):
    """Every second tile has a stored range for one band."""
    computed = st.band_stats(pixels(spark, sf), POOLED, "min_max").drop("n")
    given = computed.filter((F.col("band") == "R") & (F.col("tile_id") % 2 == 0)).select(
        "tile_id", "band", F.lit(0.0).alias("s1"), F.lit(1.0).alias("s2"))
    return nm.override_stats(computed, given).select("tile_id", "band", rounded("s1").alias("s1"), rounded("s2").alias("s2"))


@query("tile_band_minmax", f"""WITH {SQL_FLAT} SELECT tile_id, {', '.join(f"{rd(f'MIN({b})')} AS {b}_min, {rd(f'MAX({b})')} AS {b}_max" for b in ('r_t0', 'nir_t0', 'b_t0'))}
  FROM pix_flat GROUP BY tile_id""")
def tile_band_minmax(spark, sf):
    out = st.tile_band_minmax(pix_flat(spark, sf), ["r_t0", "nir_t0", "b_t0"])
    return out.select("tile_id", *[rounded(c).alias(c) for c in out.columns if c != "tile_id"])


def _n(c):
    return f"least(greatest(({c}-{c}_lo)/NULLIF({c}_hi-{c}_lo,0), 0e0), 1e0)"


@query("tile_vi_minmax", f"""WITH {SQL_PIXELS}, s AS (SELECT tile_id, {', '.join(f'MIN({c}) AS {c}_lo, quantile_cont({c}, 0.9) AS {c}_hi' for c in ('r_t0', 'nir_t0', 'b_t0'))}
    FROM pixels GROUP BY tile_id), v AS (SELECT tile_id, {', '.join(f'{_n(c)} AS {c}' for c in ('r_t0', 'nir_t0', 'b_t0'))} FROM pixels JOIN s USING (tile_id))
  SELECT tile_id, {rd(f"MIN({ndvi_sql('r_t0', 'nir_t0')})")} AS ndvi_min, {rd(f"MAX({ndvi_sql('r_t0', 'nir_t0')})")} AS ndvi_max,
    {rd(f"MIN({evi_sql('r_t0', 'nir_t0', '(b_t0/10e0)')})")} AS evi_min, {rd(f"MAX({evi_sql('r_t0', 'nir_t0', '(b_t0/10e0)')})")} AS evi_max FROM v GROUP BY tile_id""")
def tile_vi_minmax(spark, sf):
    px = pixels(spark, sf)
    bands = {"R": "r_t0", "NIR": "nir_t0", "B": "b_t0"}
    stats = px.groupBy("tile_id").agg(*[a for c in bands.values() for a in (
        F.min(c).alias(f"{c}_min"), F.percentile(c, 0.9).alias(f"{c}_max"))])
    nd = st.tile_vi_minmax(px, stats, "ndvi", {b: bands[b] for b in ("R", "NIR")})
    joined = nm.join_tile_stats(px, stats, list(bands.values()), divide_by=1)
    for b, c in bands.items():
        joined = joined.withColumn(f"n_{b}", clip(rs.rescale("normalization", c, f"{c}_min", f"{c}_max"), 0.0, 1.0))
    from swathframe.functions.indices import evi
    ev = joined.withColumn("evi", evi({"R": "n_R", "NIR": "n_NIR", "B": F.col("n_B") / 10})).groupBy("tile_id").agg(
        F.min("evi").alias("evi_min"), F.max("evi").alias("evi_max"))
    return nd.join(ev, "tile_id").select("tile_id", *[rounded(c).alias(c) for c in ("ndvi_min", "ndvi_max", "evi_min", "evi_max")])


@query("value_frequency", f"SELECT l_quantity AS value, COUNT(*) AS n, {rd('COUNT(*) / CAST((SELECT COUNT(*) FROM lineitem) AS DOUBLE)')} AS share FROM lineitem GROUP BY 1")
def value_frequency(spark, sf):
    from queries.fixtures import table
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("value"))
    return st.value_frequency(li, "value").select("value", "n", rounded("share").alias("share"))


@query("histogram", f"""WITH {SQL_FLAT} SELECT tile_id, CAST(least(floor((nir_t0-0.3e0)/((0.71e0-0.3e0)/256)), 255) AS INT) AS bin, COUNT(*) AS n
  FROM pix_flat WHERE nir_t0 >= 0.3e0 AND nir_t0 <= 0.71e0 GROUP BY ALL""")
def histogram(spark, sf):
    return st.histogram(pix_flat(spark, sf), "nir_t0", 256, 0.3, 0.71, keys=("tile_id",))


@query("class_histogram", f"""WITH {SQL_FLAT}, w AS (SELECT class_id, AVG(b_t0) AS weight FROM pix_flat GROUP BY 1)
  SELECT CAST(c.i AS INT) AS class_id, COUNT(p.class_id) AS n, {rd('COUNT(p.class_id) / CAST((SELECT COUNT(*) FROM pix_flat) AS DOUBLE) / NULLIF(MAX(w.weight), 0)')} AS share
  FROM range(24) c(i) LEFT JOIN pix_flat p ON p.class_id = c.i LEFT JOIN w ON w.class_id = c.i GROUP BY c.i""")
def class_histogram(spark, sf):
    px = pix_flat(spark, sf)
    weights = px.groupBy("class_id").agg(F.avg("b_t0").alias("weight"))
    return st.class_histogram(px, "class_id", 24, weights).select("class_id", "n", rounded("share").alias("share"))


@query("cluster_summary", f"WITH {SQL_FLAT} SELECT class_id, COUNT(*) AS n, {rd('AVG(r_t0)', 9)} AS mean_value, {rd('MIN(r_t0)')} AS min_value, {rd('MAX(r_t0)')} AS max_value, {rd('(SELECT AVG(r_t0) FROM pix_flat)', 9)} AS overall_mean FROM pix_flat GROUP BY class_id")
def cluster_summary(spark, sf):
    out = st.cluster_summary(pix_flat(spark, sf), "class_id", "r_t0")
    return out.select("class_id", "n", rounded("mean_value", 9).alias("mean_value"), rounded("min_value").alias("min_value"),
                      rounded("max_value").alias("max_value"), rounded("overall_mean", 9).alias("overall_mean"))


@query("band_info", f"WITH {SQL_FLAT} " + " UNION ALL ".join(f"SELECT '{b}' AS band, 'double' AS data_type, COUNT({b}) AS n, {rd(f'MIN({b})')} AS min_value, {rd(f'MAX({b})')} AS max_value, COUNT(*) FILTER (WHERE {b} = 0.05e0) AS n_missing FROM pix_flat" for b in ("r_t0", "nir_t0", "b_t0")))
def band_info(spark, sf):
    out = st.band_info(pix_flat(spark, sf), ["r_t0", "nir_t0", "b_t0"], nodata=0.05)
    return out.select("band", "data_type", "n", rounded("min_value").alias("min_value"), rounded("max_value").alias("max_value"), "n_missing")


@query("scale_array", f"""WITH {SQL_PIXELS}, m AS (SELECT tile_id, MAX(g_t0) AS top FROM pixels GROUP BY tile_id)
  SELECT p.tile_id, p."row", p.col, {rd('r_t0/10000e0', 9)} AS optical, {rd('vv_t0/1e0')} AS sar, {rd('((p."row"*8+col+p.tile_id)%4)/5e0')} AS mask, {rd('g_t0/NULLIF(top,0)')} AS other
  FROM pixels p JOIN m USING (tile_id)""")
def scale_array(spark, sf):
    from swathframe.operators.grid import scale_to_max
    px = scale_to_max(pixels(spark, sf), "g_t0", name="other")
    mask = ((F.col("row") * 8 + F.col("col") + F.col("tile_id")) % 4).cast("double")
    return px.select(*KEYS, rounded(rs.scale_array("r_t0", "optical"), 9).alias("optical"), rounded(rs.scale_array("vv_t0", "sar")).alias("sar"),
                     rounded(rs.scale_array(mask, "mask")).alias("mask"), rounded("other").alias("other"))


@query("scene_value_union", f"WITH {SQL_SCENES} SELECT sensor, COUNT(*) AS n FROM (SELECT * FROM scenes UNION ALL SELECT * FROM scenes WHERE cloud_pct < 5) GROUP BY sensor")
def scene_value_union(spark, sf):
    """Merged collections keep duplicates."""
    sc = scenes(spark, sf)
    return st.union_all([sc, sc.filter(F.col("cloud_pct") < 5)]).groupBy("sensor").agg(F.count(F.lit(1)).alias("n"))


@query("silhouette_points", f"""WITH {SQL_PIXELS}, t AS (SELECT tile_id, tile_id % 3 AS grp, AVG(r_t0) AS x, AVG(nir_t0) AS y FROM pixels GROUP BY tile_id),
  d AS (SELECT a.tile_id, a.grp, b.grp AS other, SUM(power(a.x-b.x, 2) + power(a.y-b.y, 2)) AS s, COUNT(*) AS n FROM t a, t b GROUP BY ALL),
  m AS (SELECT tile_id, grp, MAX(CASE WHEN other = grp THEN s/(n-1) END) AS a, MIN(CASE WHEN other <> grp THEN s/n END) AS b FROM d GROUP BY ALL)
  SELECT tile_id, grp, {rd('(b-a)/greatest(a, b)')} AS silhouette FROM m""")
def silhouette_points(spark, sf):
    """Tiles as points (mean red and infrared) in three groups; the SQL compares all pairs."""
    means = pixels(spark, sf).groupBy("tile_id").agg(F.avg("r_t0").alias("x"), F.avg("nir_t0").alias("y")).withColumn("grp", F.col("tile_id") % 3)
    return st.silhouette_points(means, ["x", "y"], "grp").select("tile_id", "grp", rounded("silhouette").alias("silhouette"))
