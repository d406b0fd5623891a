"""Severity, land-cover, slope and aspect classes; confusion and class statistics."""

from pyspark.sql import functions as F

from queries.fixtures import SQL_FLAT, SQL_PIXELS, SQL_PREDICTIONS, pix_flat, pixels, predictions, rd, rounded
from queries.indices import KEYS, KEYS_SQL, ndvi_sql
from queries.registry import query
from swathframe.functions import classes as cl
from swathframe.functions.indices import vi_difference
from swathframe.operators import confusion as cf
from swathframe.plans.burn_severity import POST, PRE, PREDICTED, landclass_error_rates, severity_confusion, severity_report

D_TRUE = f"({ndvi_sql('r_t0', 'nir_t0')}-{ndvi_sql('r_t1', 'nir_t1')})"
D_PRED = f"({ndvi_sql('r_t0', 'nir_t0')}-{ndvi_sql('r_pred', 'nir_pred')})"


def severity_sql(d):
    v = f"round_even({d}, 4)"
    ranges = ((0, -1, .09), (1, .09, .14), (2, .14, .22), (3, .22, .34), (4, .34, .44), (5, .44, 2))
    return "CASE " + " ".join(f"WHEN {v} >= {lo}e0 AND {v} < {hi}e0 THEN {i}" for i, lo, hi in ranges) + " ELSE -1 END"


SQL_MAPS = f"{SQL_FLAT}, maps AS (SELECT tile_id, class_id, {severity_sql(D_TRUE)} AS truth, {severity_sql(D_PRED)} AS predicted FROM pix_flat)"
SQL_MATRIX = SQL_MAPS + """, labels AS (SELECT truth AS l FROM maps UNION SELECT predicted FROM maps),
  matrix AS (SELECT a.l AS truth, b.l AS predicted, COUNT(m.tile_id) AS n FROM labels a CROSS JOIN labels b
    LEFT JOIN maps m ON m.truth = a.l AND m.predicted = b.l GROUP BY a.l, b.l)"""


def flat_maps(spark, sf):
    return cf.severity_maps(pix_flat(spark, sf), PRE, POST, PREDICTED, keep=("tile_id", "class_id"))


@query("fire_severity", f"WITH {SQL_PIXELS} SELECT {KEYS_SQL}, {severity_sql(D_TRUE)} AS severity FROM pixels")
def fire_severity(spark, sf):
    return pixels(spark, sf).select(*KEYS, cl.fire_severity(vi_difference("ndvi", PRE, POST)).alias("severity"))


@query("severity_maps", f"""WITH {SQL_PREDICTIONS} SELECT {KEYS_SQL}, {severity_sql(D_TRUE)} AS truth, {severity_sql(D_PRED)} AS predicted FROM predictions""")
def severity_maps(spark, sf):
    return cf.severity_maps(predictions(spark, sf), PRE, POST, PREDICTED)


@query("confusion_matrix", f"WITH {SQL_MATRIX} SELECT truth, predicted, n FROM matrix")
def confusion_matrix(spark, sf):
    return severity_confusion(pix_flat(spark, sf))


@query("confusion_wide", f"""WITH {SQL_MATRIX} SELECT truth, {', '.join(
    f"CAST(COALESCE(SUM(CASE WHEN predicted = {c} THEN n END), 0) AS BIGINT) AS pred_{c if c >= 0 else 'm1'}" for c in range(-1, 6))}
  FROM matrix GROUP BY truth""")
def confusion_wide(spark, sf):
    return cf.confusion_wide(severity_confusion(pix_flat(spark, sf)), range(-1, 6))


@query("normalize_confusion", f"""WITH {SQL_MATRIX} SELECT truth, predicted, n,
    {rd('n / NULLIF(CAST(SUM(n) OVER (PARTITION BY predicted) AS DOUBLE), 0)')} AS column_share,
    {rd('n / NULLIF(CAST(SUM(n) OVER (PARTITION BY truth) AS DOUBLE), 0)')} AS row_share FROM matrix""")
def normalize_confusion(spark, sf):
    m = severity_confusion(pix_flat(spark, sf))
    by_col = cf.normalize_confusion(m, 0).withColumnRenamed("share", "column_share")
    return cf.normalize_confusion(by_col, 1).select("truth", "predicted", "n", rounded("column_share").alias("column_share"),
                                                    rounded("share").alias("row_share"))


@query("severity_report", f"""WITH {SQL_MATRIX} SELECT truth, predicted, n,
    {rd('n / NULLIF(CAST(SUM(n) OVER (PARTITION BY truth) AS DOUBLE), 0)')} AS share FROM matrix""")
def severity_report_q(spark, sf):
    return severity_report(pix_flat(spark, sf)).select("truth", "predicted", "n", rounded("share").alias("share"))


@query("confusion_summary", f"""WITH {SQL_MATRIX}, s AS (SELECT *, n/NULLIF(CAST(SUM(n) OVER (PARTITION BY truth) AS DOUBLE), 0) r,
    n/NULLIF(CAST(SUM(n) OVER (PARTITION BY predicted) AS DOUBLE), 0) p FROM matrix)
  SELECT {rd('AVG(r)')} AS macro_recall, {rd('AVG(p)')} AS macro_precision FROM s WHERE truth = predicted""")
def confusion_summary(spark, sf):
    out = cf.confusion_summary(severity_confusion(pix_flat(spark, sf)))
    return out.select(rounded("macro_recall").alias("macro_recall"), rounded("macro_precision").alias("macro_precision"))


@query("truth_shares", f"WITH {SQL_MAPS} SELECT truth, COUNT(*) AS n, {rd('COUNT(*) / CAST((SELECT COUNT(*) FROM maps) AS DOUBLE)')} AS share FROM maps GROUP BY truth")
def truth_shares(spark, sf):
    return cf.class_shares(flat_maps(spark, sf)).select("truth", "n", rounded("share").alias("share"))


@query("landclass_shares", f"""WITH {SQL_FLAT} SELECT tile_id, {', '.join(
    rd(f"COUNT(*) FILTER (WHERE class_id = {i}) / CAST(COUNT(*) AS DOUBLE)") + f" AS class_{i}" for i in range(24))}
  FROM pix_flat GROUP BY tile_id""")
def landclass_shares(spark, sf):
    out = cf.landclass_shares(pix_flat(spark, sf))
    return out.select("tile_id", *[rounded(f"class_{i}").alias(f"class_{i}") for i in range(24)])


@query("top_landclasses", f"""WITH {SQL_FLAT}, t AS (SELECT tile_id, COUNT(*) tot FROM pix_flat GROUP BY tile_id),
  g AS (SELECT t.tile_id, CAST(c.i AS INT) AS class_id, COUNT(p.class_id) / CAST(MAX(tot) AS DOUBLE) AS share FROM t
        CROSS JOIN range(24) c(i) LEFT JOIN pix_flat p ON p.tile_id = t.tile_id AND p.class_id = c.i GROUP BY t.tile_id, c.i)
  SELECT tile_id, CAST(rk AS INT) AS "rank", class_id, {rd('share', 3)} AS share FROM (
    SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY share DESC, class_id) AS rk FROM g) WHERE rk <= 3""")
def top_landclasses(spark, sf):
    out = cf.top_landclasses(cf.landclass_shares(pix_flat(spark, sf)))
    return out.select("tile_id", "rank", "class_id", rounded("share", 3).alias("share"))


@query("agreement", f"WITH {SQL_MAPS} SELECT tile_id, COUNT(*) FILTER (WHERE abs(truth-predicted) < 1) AS n_agree, COUNT(*) FILTER (WHERE abs(truth-predicted) < 2) AS n_near FROM maps GROUP BY tile_id")
def agreement(spark, sf):
    return flat_maps(spark, sf).groupBy("tile_id").agg(
        F.count_if(cl.agreement("truth", "predicted")).alias("n_agree"),
        F.count_if(cl.agreement("truth", "predicted", 2)).alias("n_near"))


@query("precise_confusion", f"WITH {SQL_MAPS} SELECT tile_id, COUNT(*) FILTER (WHERE truth = 0 AND predicted = 1) AS n_confused, COUNT(*) FILTER (WHERE truth <> 0 OR predicted <> 1) AS n_other FROM maps GROUP BY tile_id")
def precise_confusion(spark, sf):
    ok = cl.not_confused("truth", "predicted", 0, 1)
    return flat_maps(spark, sf).groupBy("tile_id").agg(F.count_if(~ok).alias("n_confused"), F.count_if(ok).alias("n_other"))


@query("recode_where", f"WITH {SQL_MAPS} SELECT CASE WHEN abs(truth-predicted) < 1 THEN 24 ELSE class_id END AS code, COUNT(*) AS n FROM maps GROUP BY 1")
def recode_where(spark, sf):
    return flat_maps(spark, sf).groupBy(cl.recode_where(cl.agreement("truth", "predicted"), "class_id").alias("code")).agg(
        F.count(F.lit(1)).alias("n"))


@query("mask_values", f"WITH {SQL_MAPS} SELECT tile_id, class_id, COUNT(*) AS n FROM maps WHERE abs(truth-predicted) < 1 GROUP BY 1, 2")
def mask_values(spark, sf):
    kept = cf.mask_values(flat_maps(spark, sf), cl.agreement("truth", "predicted"))
    return kept.groupBy("tile_id", "class_id").agg(F.count(F.lit(1)).alias("n"))


@query("slope_class", """WITH s AS (SELECT l_quantity * 1.9e0 - 3e0 AS slope FROM lineitem)
  SELECT CASE WHEN slope >= 0 AND slope < 10 THEN 0 WHEN slope >= 10 AND slope < 25 THEN 1 WHEN slope >= 25 AND slope < 35 THEN 2
    WHEN slope >= 35 AND slope < 90 THEN 3 ELSE 1 END AS slope_class, COUNT(*) AS n FROM s GROUP BY 1""")
def slope_class(spark, sf):
    from queries.fixtures import table
    s = table(spark, sf, "lineitem").select((F.col("l_quantity") * 1.9 - 3.0).alias("slope"))
    return s.groupBy(cl.slope_class("slope").alias("slope_class")).agg(F.count(F.lit(1)).alias("n"))


@query("aspect_class", """WITH s AS (SELECT CASE WHEN l_linenumber = 1 THEN -1e0 ELSE (l_partkey * 7 + l_quantity) % 365 END AS a FROM lineitem)
  SELECT CASE WHEN a = -1 THEN 0 WHEN a >= 0 AND a < 22.5e0 THEN 1 WHEN a >= 22.5e0 AND a < 67.5e0 THEN 2 WHEN a >= 67.5e0 AND a < 112.5e0 THEN 3
    WHEN a >= 112.5e0 AND a < 157.5e0 THEN 4 WHEN a >= 157.5e0 AND a < 202.5e0 THEN 5 WHEN a >= 202.5e0 AND a < 247.5e0 THEN 6
    WHEN a >= 247.5e0 AND a < 292.5e0 THEN 7 WHEN a >= 292.5e0 AND a < 337.5e0 THEN 8 WHEN a >= 337.5e0 AND a < 360 THEN 1 ELSE 1 END AS aspect_class,
    COUNT(*) AS n FROM s GROUP BY 1""")
def aspect_class(spark, sf):
    from queries.fixtures import table
    a = F.when(F.col("l_linenumber") == 1, -1.0).otherwise((F.col("l_partkey") * 7 + F.col("l_quantity")) % 365)
    return table(spark, sf, "lineitem").select(a.alias("aspect")).groupBy(
        cl.aspect_class("aspect").alias("aspect_class")).agg(F.count(F.lit(1)).alias("n"))


@query("class_error_rate", f"""WITH {SQL_MAPS} SELECT CAST(c.i AS INT) AS class_id, COUNT(m.class_id) AS n,
    COUNT(*) FILTER (WHERE m.truth <> m.predicted) AS n_error,
    {rd('COALESCE(COUNT(*) FILTER (WHERE m.truth <> m.predicted) / NULLIF(CAST(COUNT(m.class_id) AS DOUBLE), 0), 0)')} AS error_rate
  FROM range(24) c(i) LEFT JOIN maps m ON m.class_id = c.i GROUP BY c.i""")
def class_error_rate(spark, sf):
    out = landclass_error_rates(flat_maps(spark, sf), "class_id")
    return out.select("class_id", "n", "n_error", rounded("error_rate").alias("error_rate"))


@query("class_error_lift", f"""WITH {SQL_MAPS}, t AS (SELECT c.i, COUNT(m.class_id) AS n, COUNT(*) FILTER (WHERE m.truth <> m.predicted) AS e
    FROM range(24) c(i) LEFT JOIN maps m ON m.class_id = c.i GROUP BY c.i)
  SELECT CAST(i AS INT) AS class_id, {rd('(e / CAST((SELECT SUM(e) FROM t) AS DOUBLE)) / NULLIF(n / CAST((SELECT SUM(n) FROM t) AS DOUBLE), 0)')} AS lift FROM t""")
def class_error_lift(spark, sf):
    maps = flat_maps(spark, sf)
    return cf.class_error_lift(maps, "class_id", F.col("truth") != F.col("predicted")).select("class_id", rounded("lift").alias("lift"))
