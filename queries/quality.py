"""Image quality, score losses, joins of prediction and truth, tile scoring."""

from pyspark.sql import functions as F

from queries.fixtures import SQL_FLAT, SQL_PLACED, SQL_PREDICTIONS, pix_flat, placed, predictions, rd, rounded
from queries.indices import KEYS, KEYS_SQL
from queries.registry import query
from swathframe.operators import image_quality as iq
from swathframe.operators.layout import join_predictions
from swathframe.operators.normalise import fit_scaler
from swathframe.operators.scoring import pack_tiles, score_pixels, score_tiles, unpack_tiles
from swathframe.plans.prediction import predict_mosaic

BANDS = ["r", "g", "b", "nir"]


def pairs(spark, sf):
    """Truth and prediction as two tables, joined per pixel."""
    both = predictions(spark, sf)
    truth = both.select(*KEYS, *[F.col(f"{b}_t1").alias(b) for b in BANDS])
    pred = both.select(*KEYS, *[F.col(f"{b}_pred").alias(b) for b in BANDS])
    return join_predictions(truth, pred, BANDS)


def flat_pairs(spark, sf):
    return pix_flat(spark, sf).select("tile_id", F.col("r_t1").alias("r_true"), F.col("r_pred"),
                                      F.col("nir_t1").alias("nir_true"), F.col("nir_pred"))


@query("join_predictions", f"""WITH {SQL_PREDICTIONS} SELECT {KEYS_SQL}, {', '.join(
    rd(f'{b}_t1') + f' AS {b}_true, ' + rd(f'{b}_pred') + f' AS {b}_pred' for b in BANDS)} FROM predictions""")
def join_predictions_q(spark, sf):
    return pairs(spark, sf).select(*KEYS, *[rounded(c).alias(c) for b in BANDS for c in (f"{b}_true", f"{b}_pred")])


def psnr_sql(table, bands, truth, pred, top):
    mse = ", ".join(f"AVG((CAST(CAST({b}_{truth} AS FLOAT) AS DOUBLE)-CAST(CAST({b}_{pred} AS FLOAT) AS DOUBLE))**2) AS m_{b}" for b in bands)
    val = [f"(CASE WHEN m_{b} = 0 THEN 100e0 ELSE 20*log10({top}e0/sqrt(CASE WHEN m_{b} > 0 THEN m_{b} END)) END)" for b in bands]
    return (f"p AS (SELECT tile_id, {mse} FROM {table} GROUP BY tile_id), "
            f"psnr AS (SELECT tile_id, {', '.join(f'{v} AS psnr_{b}' for v, b in zip(val, bands))}, ({'+'.join(val)})/{len(bands)} AS psnr FROM p)")


@query("psnr", f"WITH {SQL_PREDICTIONS}, {psnr_sql('predictions', BANDS, 't1', 'pred', 4095)} SELECT tile_id, {', '.join(rd(f'psnr_{b}', 4) + f' AS psnr_{b}' for b in BANDS)}, {rd('psnr', 4)} AS psnr FROM psnr")
def psnr(spark, sf):
    out = iq.psnr(pairs(spark, sf), BANDS)
    return out.select("tile_id", *[rounded(c, 4).alias(c) for c in [f"psnr_{b}" for b in BANDS] + ["psnr"]])


@query("psnr_flat", f"WITH {SQL_FLAT}, {psnr_sql('pix_flat', ['r', 'nir'], 't1', 'pred', '1.27')} SELECT tile_id, {rd('psnr_r', 4)} AS psnr_r, {rd('psnr_nir', 4)} AS psnr_nir, {rd('psnr', 4)} AS psnr FROM psnr")
def psnr_flat(spark, sf):
    """One band is predicted exactly: its ratio is 100."""
    out = iq.psnr(flat_pairs(spark, sf), ["r", "nir"], max_value=1.27)
    return out.select("tile_id", *[rounded(c, 4).alias(c) for c in ("psnr_r", "psnr_nir", "psnr")])


def sam_sql(bands, t, p):
    dot = "+".join(f"{b}_{t}*{b}_{p}" for b in bands)
    nt, np_ = "+".join(f"{b}_{t}*{b}_{t}" for b in bands), "+".join(f"{b}_{p}*{b}_{p}" for b in bands)
    return f"acos(greatest(least(({dot})/NULLIF(sqrt({nt})*sqrt({np_}), 0), 1e0), -1e0))"


@query("sam", f"WITH {SQL_PREDICTIONS} SELECT tile_id, {rd('AVG(' + sam_sql(BANDS, 't1', 'pred') + ')', 5)} AS sam FROM predictions GROUP BY tile_id")
def sam(spark, sf):
    return iq.sam(pairs(spark, sf), BANDS).select("tile_id", rounded("sam", 5).alias("sam"))


@query("sam_flat", f"WITH {SQL_FLAT} SELECT tile_id, {rd('AVG(' + sam_sql(['r', 'nir'], 't1', 'pred') + ')', 5)} AS sam FROM pix_flat GROUP BY tile_id")
def sam_flat(spark, sf):
    return iq.sam(flat_pairs(spark, sf), ["r", "nir"]).select("tile_id", rounded("sam", 5).alias("sam"))


def ssim_sql(table, bands, t, p, data_range, size=7):
    r, n = size // 2, size * size
    sums = ", ".join(f"SUM(b.{c}_{t}) sx_{c}, SUM(b.{c}_{p}) sy_{c}, SUM(b.{c}_{t}*b.{c}_{t}) sxx_{c}, "
                     f"SUM(b.{c}_{p}*b.{c}_{p}) syy_{c}, SUM(b.{c}_{t}*b.{c}_{p}) sxy_{c}" for c in bands)
    c1, c2, k = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2, n / (n - 1)

    def one(c):
        ux, uy = f"(sx_{c}/{n}e0)", f"(sy_{c}/{n}e0)"
        vx, vy, vxy = (f"({k!r}::DOUBLE*({s}_{c}/{n}e0-{a}*{b}))" for s, a, b in (("sxx", ux, ux), ("syy", uy, uy), ("sxy", ux, uy)))
        return (f"((2*{ux}*{uy}+{c1!r}::DOUBLE)*(2*{vxy}+{c2!r}::DOUBLE))/(({ux}*{ux}+{uy}*{uy}+{c1!r}::DOUBLE)*({vx}+{vy}+{c2!r}::DOUBLE))")

    return (f"""w AS (SELECT a.tile_id, a."row", a.col, {sums} FROM {table} a JOIN {table} b ON a.tile_id = b.tile_id
      AND b."row" BETWEEN a."row"-{r} AND a."row"+{r} AND b.col BETWEEN a.col-{r} AND a.col+{r}
      GROUP BY 1, 2, 3 HAVING COUNT(*) = {n}),
      ssim AS (SELECT tile_id, AVG(({'+'.join(one(c) for c in bands)})/{len(bands)}) AS ssim FROM w GROUP BY tile_id)""")


@query("ssim", f"WITH {SQL_PREDICTIONS}, {ssim_sql('predictions', BANDS, 't1', 'pred', 1.0)} SELECT tile_id, {rd('ssim', 5)} AS ssim FROM ssim")
def ssim(spark, sf):
    return iq.ssim(pairs(spark, sf), BANDS, data_range=1.0).select("tile_id", rounded("ssim", 5).alias("ssim"))


@query("quality_report", f"""WITH {SQL_PREDICTIONS}, {psnr_sql('predictions', BANDS, 't1', 'pred', 4095)}, {ssim_sql('predictions', BANDS, 't1', 'pred', 1.0)},
  s AS (SELECT tile_id, AVG({sam_sql(BANDS, 't1', 'pred')}) AS sam FROM predictions GROUP BY tile_id)
  SELECT 'psnr' AS name, {rd('AVG(psnr)', 4)} AS value FROM psnr UNION ALL SELECT 'ssim', {rd('AVG(ssim)', 4)} FROM ssim
  UNION ALL SELECT 'sam', {rd('AVG(sam)', 4)} FROM s""")
def quality_report(spark, sf):
    out = iq.quality_report(pairs(spark, sf), BANDS, data_range=1.0, with_sam=True)
    return out.select("name", rounded("value", 4).alias("value"))


def _bce(x, z):
    return f"AVG(greatest({x}, 0e0)-{x}*{z}+ln(1+exp(-abs({x}))))"


@query("score_losses", f"""WITH {SQL_FLAT}, s AS (SELECT r_t0*4e0-1e0 AS r, nir_t0*3e0-1.5e0 AS f, r_t1 AS truth, r_pred AS pred FROM pix_flat)
  SELECT {rd('AVG(abs(truth-pred))*100', 9)} AS l1, {rd(_bce('r', '1e0'), 9)} AS bce_real, {rd(_bce('f', '0e0'), 9)} AS bce_fake,
    {rd(_bce('f', '1e0'), 9)} AS bce_generator, {rd(_bce('r', '0.9e0'), 9)} AS bce_real_smoothed,
    {rd('-AVG(ln(1/(1+exp(-r))))', 9)} AS log_real, {rd('-AVG(ln(1-1/(1+exp(-f))))', 9)} AS log_fake, {rd('-AVG(ln(1/(1+exp(-f))))', 9)} AS log_generator,
    {rd('AVG(f)-AVG(r)', 9)} AS wasserstein_critic, {rd('-AVG(f)', 9)} AS wasserstein_generator FROM s""")
def score_losses(spark, sf):
    s = pix_flat(spark, sf).select((F.col("r_t0") * 4 - 1).alias("real_score"), (F.col("nir_t0") * 3 - 1.5).alias("fake_score"),
                                   F.col("r_t1").alias("truth"), F.col("r_pred").alias("pred"))
    out = iq.score_losses(s, smoothing=0.1)
    return out.select(*[rounded(c, 9).alias(c) for c in out.columns])


def _stand_in_model():
    """A stand-in model with two output channels, exact in single precision."""
    import numpy as np
    return lambda cube: np.stack([cube[:, :, 0] * 0.5, cube[:, :, 1:3].max(axis=2)], axis=2)


@query("score_tiles", f"""WITH {SQL_PREDICTIONS} SELECT {KEYS_SQL}, {rd('CAST(CAST(r_t0 AS FLOAT) AS DOUBLE)*0.5e0')} AS p0,
  {rd('CAST(greatest(CAST(g_t0 AS FLOAT), CAST(b_t0 AS FLOAT)) AS DOUBLE)')} AS p1 FROM predictions""")
def score_tiles_q(spark, sf):
    packed = pack_tiles(predictions(spark, sf), ["r_t0", "g_t0", "b_t0", "nir_t0"])
    out = unpack_tiles(score_tiles(packed, _stand_in_model), ["p0", "p1"])
    return out.select(*KEYS, rounded("p0").alias("p0"), rounded("p1").alias("p1"))


@query("score_pixels", f"""WITH {SQL_PREDICTIONS} SELECT {KEYS_SQL}, {rd('CAST(CAST(r_t0 AS FLOAT) AS DOUBLE)*0.5e0')} AS p0,
  {rd('CAST(greatest(CAST(g_t0 AS FLOAT), CAST(b_t0 AS FLOAT)) AS DOUBLE)')} AS p1 FROM predictions""")
def score_pixels_q(spark, sf):
    """Tiles cut into blocks of 5 pixels with a margin of 2."""
    out = score_pixels(predictions(spark, sf), ["r_t0", "g_t0", "b_t0", "nir_t0"], _stand_in_model, ["p0", "p1"], 5, 2)
    return out.select(*KEYS, rounded("p0").alias("p0"), rounded("p1").alias("p1"))


_FIT = "(SELECT AVG(v) AS m, stddev_pop(v) AS s FROM (SELECT r_t0 AS v FROM placed UNION ALL SELECT r_t1 FROM placed)) f"


@query("predict_mosaic", f"""WITH {SQL_PLACED}, p AS (SELECT *, (r_t0-f.m)/f.s AS a, (r_t1-f.m)/f.s AS b FROM placed, {_FIT}),
  q AS (SELECT x, y, source_order, CAST(CAST(a AS FLOAT) AS DOUBLE)*0.5e0*s+m AS p0, CAST(CAST(greatest(a, b) AS FLOAT) AS DOUBLE)*s+m AS p1 FROM p)
  SELECT x*10e0 AS x, 6000000e0-y*10e0 AS y, {rd('arg_max(p0, source_order)', 3)} AS p0, {rd('arg_max(p1, source_order)', 3)} AS p1 FROM q GROUP BY 1, 2""")
def predict_mosaic_q(spark, sf):
    """Stored scalers, model, inverse scaling, map position and mosaic in one plan."""
    px = placed(spark, sf)
    scalers = fit_scaler(px, {"R": ["r_t0", "r_t1"]})
    tiles = px.groupBy("tile_id").agg((F.min("x") * 10.0).alias("x0"), (F.lit(6000000.0) - F.min("y") * 10.0).alias("y0"),
                                      F.min("source_order").alias("source_order"))
    out = predict_mosaic(px, scalers, {"R": ["r_t0", "r_t1"]}, ["r_t0", "r_t0", "r_t1"], _stand_in_model, ["p0", "p1"],
                         {"R": ["p0", "p1"]}, tiles, 10.0, block=5, margin=1)
    return out.select("x", "y", rounded("p0", 3).alias("p0"), rounded("p1", 3).alias("p1"))
