"""Edge cases against NumPy or hand-worked values."""

import datetime as dt

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from swathframe.functions import classes as cl
from swathframe.functions import geometry as ge
from swathframe.functions import indices as vi
from swathframe.functions import names as nm
from swathframe.functions import projection as pr
from swathframe.functions import rescale as rs
from swathframe.operators import change, confusion, focal, grid, image_quality, layout, matching, normalise, scoring
from swathframe.operators import statistics as st
from swathframe.operators import tile_checks as tc
from swathframe.operators import knn_fill as knn_module
from swathframe.operators.knn_fill import knn_fill


def image(spark, array, tile=1, name="v"):
    rows = [(tile, i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(np.asarray(array, float))]
    return spark.createDataFrame(rows, f"tile_id int, row int, col int, {name} double")


def back(df, shape, name):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r.row, r.col] = r[name]
    return out


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_index_edges(spark):
    bands = {"R": F.lit(0.0), "NIR": F.lit(0.0), "B": F.lit(2 / 15)}
    r = one(spark, ndvi=vi.ndvi(bands), evi=vi.evi({**bands, "B": F.lit(1 / 7.5)}), nd=vi.normalized_difference(F.lit(0.0), F.lit(0.0)),
            bai=vi.bai({"R": F.lit(0.1), "NIR": F.lit(0.5)}), rel=vi.vi_relative_difference("ndvi", bands, bands),
            msavi=vi.msavi({"R": F.lit(0.0), "NIR": F.lit(0.5)}))
    assert r.ndvi == 0 and r.evi is None and r.nd is None and r.bai is None and r.rel is None
    assert r.msavi == pytest.approx((2 - np.sqrt(4 - 4)) / 2)
    assert one(spark, m=vi.msavi({"R": F.lit(-1.0), "NIR": F.lit(0.5)})).m is None
    with pytest.raises(ValueError):
        vi.vegetation_index("nope", {})


def test_severity_boundaries(spark):
    values = [-1.0, -1.0001, 0.0899, 0.09, 0.08996, 0.14, 0.22, 0.34, 0.44, 1.9999, 2.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.c for r in df.select("i", cl.fire_severity("v").alias("c")).orderBy("i").collect()]
    assert got == [0, -1, 0, 1, 1, 2, 3, 4, 5, 5, -1, -1]


def test_severity_equals_rounding_first(spark):
    """The comparison form against decimal half-even rounding, on ties and their neighbours, also for odd bounds."""
    classes = [("a", -1.0, 0.0901), ("b", 0.0901, 0.14), ("c", 0.14, 0.34005), ("d", 0.34005, 2.0)]
    values = [b + d for b in (0.09, 0.0901, 0.14, 0.34, 0.34005, -1.0, 2.0) for d in (-1.5e-4, -1e-4, -5e-5, -4.9999e-5, 0.0, 5e-5, 1e-4)]
    values += [0.09005, 0.09015, 0.13995, 0.33995, 0.34005, 0.34015, -1.00005, 1.99995, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rounded = F.bround("v", 4)
    want = cl.range_class(rounded, [(i, lo, hi) for i, (_, lo, hi) in enumerate(classes)], -1)
    assert df.filter(cl.fire_severity("v", classes) != want).collect() == []
    want = cl.range_class(rounded, [(i, lo, hi) for i, (_, lo, hi) in enumerate(cl.SEVERITY_CLASSES)], -1)
    assert df.filter(cl.fire_severity("v") != want).collect() == []


def test_slope_and_aspect(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 10.0, 25.0, 35.0, 90.0, -1.0])], "i int, v double")
    assert [r.c for r in df.select("i", cl.slope_class("v").alias("c")).orderBy("i").collect()] == [0, 1, 2, 3, 1, 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-1.0, 0.0, 22.5, 337.5, 337.4, 360.0])], "i int, v double")
    assert [r.c for r in df.select("i", cl.aspect_class("v").alias("c")).orderBy("i").collect()] == [0, 1, 2, 1, 8, 1]


def test_confusion_completes_missing_labels(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (2, 2), (0, 0)], "truth int, predicted int")
    m = {(r.truth, r.predicted): r.n for r in confusion.confusion_matrix(df).collect()}
    assert m == {(0, 0): 2, (0, 2): 1, (2, 0): 0, (2, 2): 1}
    only_truth = spark.createDataFrame([(0, 1), (0, 1)], "truth int, predicted int")
    norm = {(r.truth, r.predicted): r.share for r in confusion.normalize_confusion(confusion.confusion_matrix(only_truth), 0).collect()}
    assert norm[(0, 0)] is None and norm[(0, 1)] == 1.0


@pytest.mark.parametrize("values,expected", [
    ([0.1, 0.13], False), ([0.1, 0.2], True), ([0.1, 0.1, 0.9], False), ([0.1, 0.2, 0.9], True),
    ([0.1, 0.14], False), ([float("nan"), 0.0, 0.0], True), ([None, 0.0, 0.0], True), ([0.14], True)])
def test_changed_equals_median(spark, values, expected):
    df = spark.createDataFrame([(1, v) for v in values], "tile_id int, d double")
    assert confusion.changed_tiles(df, F.col("d")).first().changed is expected


def test_psnr_and_sam_edges(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 1.0, 0.0, 1.0), (1, 0, 1, 2.0, 2.0, 0.0, 3.0)],
                               "tile_id int, row int, col int, a_true double, a_pred double, b_true double, b_pred double")
    r = image_quality.psnr(df, ["a", "b"], max_value=10).first()
    assert r.psnr_a == 100 and r.psnr_b == pytest.approx(20 * np.log10(10 / np.sqrt(5)))
    zero = df.withColumn("a_true", F.lit(0.0)).withColumn("b_true", F.lit(0.0))
    assert image_quality.sam(zero, ["a", "b"]).first().sam is None
    same = df.withColumn("b_pred", F.col("b_true"))
    assert image_quality.sam(same, ["a", "b"]).first().sam == pytest.approx(0, abs=1e-7)


@pytest.mark.parametrize("block", [4, 8, 256])
def test_focal_on_random_image_with_gaps(spark, block):
    rng = np.random.default_rng(1)
    a = rng.random((13, 11))
    keep = rng.random(a.shape) > 0.25
    df = image(spark, np.where(keep, a, 0)).join(
        image(spark, keep.astype(float), name="k").filter("k = 1"), ["tile_id", "row", "col"]).drop("k")
    padded = np.pad(np.where(keep, a, np.nan), 2, constant_values=np.nan)
    windows = np.array([[padded[i:i + 5, j:j + 5] for j in range(11)] for i in range(13)])
    for agg, fn in (("mean", np.nanmean), ("min", np.nanmin), ("max", np.nanmax), ("sum", np.nansum)):
        got = back(focal.focal_square(df, {"f": F.col("v")}, agg, 2, block=block), a.shape, "f")
        want = np.where(keep, fn(windows.reshape(13, 11, 25), axis=2), np.nan)
        np.testing.assert_allclose(got, want)
    runs = focal.diamond_runs(2)
    mask = np.array([[abs(i) + abs(j) <= 2 for j in range(-2, 3)] for i in range(-2, 3)])
    got = back(focal.focal_runs(df, {"f": F.col("v")}, "min", runs, block=block), a.shape, "f")
    np.testing.assert_allclose(got, np.where(keep, np.nanmin(np.where(mask, windows, np.nan).reshape(13, 11, 25), axis=2), np.nan))


@pytest.mark.parametrize("block", [4, 256])
def test_mirrored_median_and_neighbourhoods(spark, block):
    a = np.random.default_rng(2).random((8, 5))
    df = image(spark, a)
    p = np.pad(a, 1, mode="symmetric")
    want = np.array([[np.median(p[i:i + 3, j:j + 3]) for j in range(5)] for i in range(8)])
    out = focal.focal_runs(df, {"m": F.col("v")}, "median", focal.square_runs(1), block=block, mirror=True)
    np.testing.assert_allclose(back(out, a.shape, "m"), want)
    p = np.pad(a, ((2, 1), (2, 1)), mode="symmetric")
    for r in change.neighbourhoods(df, ["v"], 4).collect():
        np.testing.assert_allclose(r.vector, p[r.row:r.row + 4, r.col:r.col + 4].ravel())


def test_mirror_wider_than_image(spark):
    a = np.arange(6.0).reshape(2, 3)
    p = np.pad(a, 5, mode="symmetric")
    out = focal.focal_runs(image(spark, a), {"c": F.col("v")}, "collect", focal.square_runs(5), mirror=True)
    for r in out.collect():
        np.testing.assert_allclose(r.c, p[r.row:r.row + 11, r.col:r.col + 11].ravel())


def test_ssim_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((12, 10)), rng.random((12, 10))
    df = image(spark, x, name="b_true").join(image(spark, y, name="b_pred"), ["tile_id", "row", "col"])
    vals = []
    for i in range(3, 9):
        for j in range(3, 7):
            u, v = x[i - 3:i + 4, j - 3:j + 4], y[i - 3:i + 4, j - 3:j + 4]
            c = np.cov(u.ravel(), v.ravel())
            vals.append((2 * u.mean() * v.mean() + 1e-4) * (2 * c[0, 1] + 9e-4)
                        / ((u.mean() ** 2 + v.mean() ** 2 + 1e-4) * (c[0, 0] + c[1, 1] + 9e-4)))
    assert image_quality.ssim(df, ["b"], data_range=1.0, block=8).first().ssim == pytest.approx(np.mean(vals))


def knn_reference(a, k):
    out = a.copy()
    for i, j in zip(*np.where(np.isnan(a))):
        donors = np.flatnonzero(~np.isnan(a[:, j]))
        if len(donors) == 0:
            continue
        d = []
        for r in donors:
            both = ~np.isnan(a[i]) & ~np.isnan(a[r])
            d.append(np.sqrt(((a[i, both] - a[r, both]) ** 2).sum() * a.shape[1] / both.sum()) if both.any() else np.nan)
        d = np.array(d)
        order = np.lexsort((donors, d))[:k]
        out[i, j] = a[donors, j].mean() if np.isnan(d).all() else a[donors[order], j].mean()
    return out


@pytest.mark.parametrize("chunk", [3, 256])
def test_knn_fill(spark, chunk):
    rng = np.random.default_rng(4)
    a = rng.random((10, 6))
    a[rng.random(a.shape) < 0.3] = np.nan
    a[4] = np.nan          # a row without any value takes the column mean
    a[:, 5] = np.nan       # a column without any value stays missing
    got = back(knn_fill(image(spark, a), ["v"], 3, chunk), a.shape, "v")
    np.testing.assert_allclose(got, knn_reference(a, 3))


@pytest.mark.parametrize("width", [4, 7])
def test_knn_fill_of_an_image_wider_than_a_block(spark, width):
    """Column blocks give the distances of whole rows; equal rows tie exactly; the last block is narrower."""
    rng = np.random.default_rng(6)
    a = rng.random((9, 17)).round(1)
    a[3] = a[5] = a[7]
    a[rng.random(a.shape) < 0.15] = np.nan
    got = back(knn_fill(image(spark, a), ["v"], 2, 4, width), a.shape, "v")
    np.testing.assert_allclose(got, knn_reference(a, 2))


def test_knn_fill_tasks_hold_blocks(spark, monkeypatch):
    """The largest array that a task sees depends on the block, not on the image's width."""
    rng = np.random.default_rng(7)
    a = rng.random((6, 40))
    a[2, 3] = a[4, 33] = np.nan
    seen = knn_module._blocks(image(spark, a), ["v"], 4, 5).collect()
    assert len(seen) == 2 * 8 and max(len(r["values"]) for r in seen) == 4 * 5 * 8
    np.testing.assert_allclose(back(knn_fill(image(spark, a), ["v"], 2, 4, 5), a.shape, "v"), knn_reference(a, 2))


def test_knn_fill_leaves_complete_tiles(spark):
    a = np.random.default_rng(5).random((4, 4))
    np.testing.assert_allclose(back(knn_fill(image(spark, a), ["v"]), a.shape, "v"), a)


def test_scaler_population_std_and_zero_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    s = {r.band_group: r for r in normalise.fit_scaler(df, {"A": ["a"], "B": ["b"]}, 0.5).collect()}
    assert s["A"].std == pytest.approx(np.std([1, 2, 4])) and s["B"].std == 1.0
    with pytest.raises((PySparkException, Py4JJavaError)):
        normalise.apply_scaler(df, normalise.fit_scaler(df, {"A": ["a"]}), {"C": ["a"]}).collect()


def test_join_tile_stats_needs_one_row(spark):
    px = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "tile_id int, row int, col int")
    good = spark.createDataFrame([(1, 0.0, 1e4), (2, 0.0, 2e4)], "tile_id int, r_min double, r_max double")
    assert {r.r_max for r in normalise.join_tile_stats(px, good, ["r"]).collect()} == {1.0, 2.0}
    with pytest.raises(PySparkException):
        normalise.join_tile_stats(px, good.filter("tile_id = 1"), ["r"]).collect()
    with pytest.raises(PySparkException):
        normalise.join_tile_stats(px, good.union(good), ["r"]).collect()


def test_override_rejects_unknown_band(spark):
    computed = spark.createDataFrame([(1, "R", 0.0, 1.0)], "tile_id int, band string, s1 double, s2 double")
    given = spark.createDataFrame([(1, "X", 0.0, 1.0)], "tile_id int, band string, s1 double, s2 double")
    with pytest.raises(PySparkException):
        normalise.override_stats(computed, given).collect()


def test_rescale_table():
    assert rs.statistic_for("normalization11") == "min_max"
    for bad in (lambda: rs.statistic_for("x"), lambda: rs.reverse_rescale("normalization", "a", "b", "c")):
        with pytest.raises(ValueError):
            bad()


def test_combine_bands_rejects_duplicates(spark):
    df = spark.createDataFrame([(0, 0, "a", 1.0), (0, 0, "a", 2.0), (0, 0, "b", 3.0)], "x int, y int, band string, value double")
    with pytest.raises(PySparkException):
        grid.combine_bands(df, ["a", "b"]).collect()


def test_retile_edges(spark):
    df = spark.range(10 * 13).select(F.floor(F.col("id") / 13).cast("int").alias("row"), (F.col("id") % 13).cast("int").alias("col"))
    sizes = {r.tile_id: r.n for r in grid.retile(df, 8).groupBy("tile_id").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"01_01": 64, "01_02": 40, "02_01": 16, "02_02": 10}
    over = {r.tile_id: r.n for r in grid.retile(df, 8, overlap=3).groupBy("tile_id").agg(F.count("*").alias("n")).collect()}
    assert over == {"01_01": 64, "01_02": 64, "02_01": 40, "02_02": 40}  # 5-pixel stride, both directions covered


def test_split_sizes(spark):
    ids = spark.range(103).select(F.col("id").alias("tile_id"))
    n = {r.split: r["count"] for r in tc.split_train_val_test(ids, 0.7, 0.2, 0.1).groupBy("split").count().collect()}
    assert n == {"test": 11, "val": 21, "train": 71}
    with pytest.raises(ValueError):
        tc.split_train_val_test(ids, 0.5, 0.2, 0.1)


def brute_match(s2, s1, days, factor=1.0):
    """Widen the window day by day, as the search describes it."""
    day = dt.timedelta(days=1)
    out = {}
    for sid, t, need in s2:
        best, found = None, False
        for i in range(1, days + 1):
            seen = [(-a, x) for x, u, a in s1 if t - i * day <= u < t + i * day]
            if seen:
                best = max(-a for a, _ in seen)
                if best >= factor * need:
                    found = True
                    break
        if best is not None:
            out[sid] = (best, found)
    return out


def test_nearest_scene_against_widening_search(spark):
    rng = np.random.default_rng(6)
    base = dt.datetime(2024, 1, 10)
    s1 = [(i, base + dt.timedelta(hours=float(h)), float(a)) for i, (h, a) in enumerate(zip(rng.integers(-150, 150, 40), rng.integers(1, 30, 40)))]
    s2 = [(100 + i, base + dt.timedelta(hours=float(h)), float(a)) for i, (h, a) in enumerate(zip(rng.integers(-150, 150, 30), rng.integers(5, 35, 30)))]
    d1 = spark.createDataFrame([(*r, 1) for r in s1], "scene_id long, acquired_at timestamp, area double, tile_no int")
    d2 = spark.createDataFrame([(*r, 1) for r in s2], "scene_id long, acquired_at timestamp, zone_area double, tile_no int")
    got = {r.s2_id: (r.s1_area, r.all_found) for r in matching.nearest_scene_join(d2, d1, 4).collect()}
    assert got == brute_match(s2, s1, 4)


def test_nearest_scene_exact_time_and_one_day(spark):
    t = dt.datetime(2024, 1, 10, 12)
    s2 = spark.createDataFrame([(1, t, 5.0, 1)], "scene_id long, acquired_at timestamp, zone_area double, tile_no int")
    s1 = spark.createDataFrame([(10, t, 6.0, 1), (11, t - dt.timedelta(days=1), 7.0, 1), (12, t + dt.timedelta(days=1), 9.0, 1)],
                               "scene_id long, acquired_at timestamp, area double, tile_no int")
    r = matching.nearest_scene_join(s2, s1, 3).first()
    assert (r.s1_id, r.ring, r.all_found) == (11, 1, True)   # exactly one day before lies in the first window
    after = matching.nearest_scene_join(s2, s1, 3, "after").first()
    assert (after.s1_id, after.ring) == (10, 1)              # exactly one day after lies in the second
    before = matching.nearest_scene_join(s2, s1.filter("scene_id <> 11"), 3, "before").collect()
    assert [(r.s2_id, r.s1_id, r.ring, r.all_found) for r in before] == [(1, None, None, False)]  # no match, but a row


BOX = "xmin double, ymin double, xmax double, ymax double"


def test_nearest_scene_by_footprint_against_widening_search(spark):
    """Boxes anywhere, also across cell borders and below zero; a scene without corners meets nothing."""
    rng = np.random.default_rng(8)
    base = dt.datetime(2024, 1, 10)

    def boxes(n):
        x, y, w, h = rng.uniform(-2, 2, n), rng.uniform(-2, 2, n), rng.uniform(0, 1.5, n), rng.uniform(0, 1.5, n)
        return [tuple(map(float, b)) for b in zip(x, y, x + w, y + h)]
    s1 = [(i, base + dt.timedelta(hours=float(h)), (b[2] - b[0]) * (b[3] - b[1]), *b)
          for i, (h, b) in enumerate(zip(rng.integers(-100, 100, 60), boxes(60)))] + [(90, base, 9.0, None, 0.0, 1.0, 1.0)]
    s2 = [(100 + i, base + dt.timedelta(hours=float(h)), float(a), *b)
          for i, (h, a, b) in enumerate(zip(rng.integers(-100, 100, 40), rng.uniform(0, 2, 40), boxes(40)))] + [
        (200, base, 1.0, None, None, None, None)]
    d1 = spark.createDataFrame(s1, "scene_id long, acquired_at timestamp, area double, " + BOX)
    d2 = spark.createDataFrame(s2, "scene_id long, acquired_at timestamp, zone_area double, " + BOX)
    want = {}
    for sid, t, need, *b in s2:
        near = [r[:3] for r in s1 if None not in r and None not in b and r[3] <= b[2] and r[5] >= b[0] and r[4] <= b[3] and r[6] >= b[1]]
        want[sid] = brute_match([(sid, t, need)], near, 3).get(sid, (None, False))
    for cell in (0.3, 1.0, 7.0):
        got = {r.s2_id: (r.s1_area, r.all_found) for r in matching.nearest_scene_by_footprint(d2, d1, 3, cell=cell).collect()}
        assert got == want


def test_radar_scene_of_another_tile_and_ring_test(spark):
    t = dt.datetime(2024, 1, 10, 12)
    square = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    schema = f"scene_id long, acquired_at timestamp, {{}} double, tile_no int, {BOX}, ring array<struct<lon:double,lat:double>>"
    s2 = spark.createDataFrame([(1, t, 1.0, 7, 0.0, 0.0, 1.0, 1.0, square(0.0, 0.0, 1.0, 1.0))], schema.format("zone_area"))
    slanted = [(0.5, 3.0), (3.0, 0.5), (3.0, 3.0)]  # its box meets the square, its ring does not
    s1 = spark.createDataFrame([(10, t, 1.1, 7, 0.0, 0.0, 1.0, 1.1, square(0.0, 0.0, 1.0, 1.1)),
                                (11, t, 4.0, 8, 0.9, 0.0, 2.9, 2.0, square(0.9, 0.0, 2.9, 2.0)),
                                (12, t, 9.0, 9, 0.5, 0.5, 3.0, 3.0, slanted)], schema.format("area"))
    assert matching.nearest_scene_join(s2, s1, 2).first().s1_id == 10
    assert matching.nearest_scene_by_footprint(s2, s1, 2).first().s1_id == 12
    assert matching.nearest_scene_by_footprint(s2, s1, 2, ring="ring").first().s1_id == 11


def test_search_by_place_pairs_no_scenes_of_one_place(spark):
    """900 scenes a side in one place: the wanted place of a day meets a handful of radar scenes, and results are those by key."""
    rng, base = np.random.default_rng(4), dt.datetime(2024, 1, 10)
    at = lambda: base + dt.timedelta(minutes=int(rng.integers(0, 3 * 1440)))
    where = (1, 0.1, 0.1, 0.6, 0.6)
    s1 = spark.createDataFrame([(i, at(), float(rng.integers(1, 50)), *where) for i in range(900)] + [(900, None, 99.0, *where), (901, base, None, *where)],
                               f"scene_id long, acquired_at timestamp, area double, tile_no int, {BOX}")
    s2 = spark.createDataFrame([(1000 + i, at(), float(rng.integers(1, 60)), *where) for i in range(900)],
                               f"scene_id long, acquired_at timestamp, zone_area double, tile_no int, {BOX}")
    for direction in ("before", "after", "both"):
        by_place = matching.nearest_scene_by_footprint(s2, s1, 2, direction)
        assert sorted(by_place.collect()) == sorted(matching.nearest_scene_join(s2, s1.dropna(), 2, direction).collect())
    text = by_place._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in text[:text.index("Join Inner")]  # the search itself comes after the meeting of places
    radar = s1.dropna().selectExpr("1 AS place", "acquired_at AS _time", "CAST(acquired_at AS DATE) AS _day", "struct(-area, scene_id) AS _best")
    assert matching._useful(radar, ["place"]).count() < 90


def test_grid_cell_names(spark):
    r = one(spark, a=nm.gridcell_name(F.lit(147.0), F.lit(-7.0), F.lit(5)), b=nm.gridcell_name(F.lit(-5.0), F.lit(-5.0), F.lit(5)),
            c=nm.gridcell_name(F.lit(10.0), F.lit(50.0), F.lit(40)))
    assert r.a == "05S145E-10S150E" and r.b == "05S010W-10S005W" and r.c == "80N000E-40N040E"
    b = one(spark, b=nm.gridcell_bounds(F.lit("05S145E-10S150E"))).b
    assert (b.north, b.west, b.south, b.east) == (-5, 145, -10, 150)


def test_projection_known_points(spark):
    # Published values: false origin on the central meridian; a point in zone 55 south.
    r = one(spark, o=pr.to_utm(F.lit(147.0), F.lit(0.0), F.lit(32655)), s=pr.to_utm(F.lit(149.1244), F.lit(-35.3081), F.lit(32755)))
    assert r.o.easting == pytest.approx(500000) and r.o.northing == pytest.approx(0, abs=1e-6)
    assert 690000 < r.s.easting < 695000 and 6088000 < r.s.northing < 6093000
    sq = one(spark, q=pr.mgrs_square(F.lit(32755), F.lit(600000.0), F.lit(6050000.0)), n=pr.mgrs_square(F.lit(3577), F.lit(0.0), F.lit(0.0)))
    assert sq.q == "55HFA" and sq.n is None


def test_geometry_polygons(spark):
    tri = F.array(ge.point(0, 0), ge.point(4, 0), ge.point(0, 4))
    square = ge.box_ring(F.lit(1.0), F.lit(1.0), F.lit(5.0), F.lit(5.0))
    far_ = ge.box_ring(F.lit(3.0), F.lit(3.0), F.lit(5.0), F.lit(5.0))  # boxes meet, polygons do not
    r = one(spark, area=ge.polygon_area(tri), cut=ge.polygon_area(ge.clip_convex(tri, square)), hit=ge.polygons_intersect(tri, square),
            miss=ge.polygons_intersect(tri, far_), inside=ge.polygon_contains(tri, F.array(ge.point(0, 0), ge.point(1, 0), ge.point(0, 1))),
            bigger=ge.polygon_contains(F.array(ge.point(0, 0), ge.point(1, 0), ge.point(0, 1)), tri))
    assert r.area == 8 and r.cut == pytest.approx(2.0) and r.hit and not r.miss and r.inside and not r.bigger


def test_footprint_across_the_date_line(spark):
    ring = F.array(ge.point(179, -10), ge.point(-179, -10), ge.point(-179, -8), ge.point(179, -8), ge.point(179, -10))
    parts = {r.part: r.ring for r in spark.range(1).select(F.inline(ge.dateline_parts(ring))).collect()}
    assert set(parts) == {"east", "west"}
    assert {p.lon for p in parts["east"]} == {179.0, 180.0} and {p.lon for p in parts["west"]} == {-180.0, -179.0}
    assert one(spark, e=ge.utm_epsg(F.array(ge.point(0, -85), ge.point(1, -84), ge.point(1, -84)))).e == 32761
    assert one(spark, e=ge.utm_epsg(F.array(ge.point(0, -60), ge.point(1, 60), ge.point(1, 0)))).e is None


def test_tile_arrays_refuse_oversized_tiles(spark):
    df = image(spark, np.zeros((4, 4))).withColumnRenamed("v", "value").withColumn("band", F.lit("b"))
    assert layout.pixels_to_tiles(df).first()["values"] == [0.0] * 16
    with pytest.raises(PySparkException):
        layout.pixels_to_tiles(df, max_pixels=9).collect()
    with pytest.raises(PySparkException):
        scoring.pack_tiles(df, ["value"], max_pixels=9).collect()


def test_score_tiles_reuses_existing(spark):
    packed = scoring.pack_tiles(image(spark, np.ones((2, 2))).union(image(spark, np.ones((2, 2)), tile=2)), ["v"])

    def build():
        return lambda cube: cube * 3

    first = scoring.score_tiles(packed.filter("tile_id = 1"), build).withColumn("values", F.transform("values", lambda v: v * 0 + 7).cast("array<float>"))
    out = {r.tile_id: r["values"] for r in scoring.score_tiles(packed, build, existing=first).collect()}
    assert out == {1: [7.0] * 4, 2: [3.0] * 4}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 1.0, -0.1, 1.1)], "v double")
    assert {r.bin: r.n for r in st.histogram(df, "v", 4, 0, 1).collect()} == {0: 1, 2: 1, 3: 2}


def _pair_reference(image, k, n_components, rounds):
    """Changed pixels of one difference image (rows, cols, channels), step by step in NumPy."""
    n, m, ch = image.shape
    blocks = np.array([image[i:i + k, j:j + k].transpose(2, 0, 1).ravel() for i in range(0, n, k) for j in range(0, m, k)])
    mean = blocks.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(blocks.T))
    comps = vectors[:, np.argsort(-values, kind="stable")[:n_components]].T
    comps *= np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(axis=1)])[:, None]
    wide = np.pad(image, ((k // 2, (k - 1) // 2), (k // 2, (k - 1) // 2), (0, 0)), mode="symmetric")
    p = np.array([[comps @ (wide[i:i + k, j:j + k].transpose(2, 0, 1).ravel() - mean) for j in range(m)] for i in range(n)]).reshape(n * m, -1)
    centres = np.zeros((2, p.shape[1]))
    lo, hi = p[:, 0].min(), p[:, 0].max()
    centres[:, 0] = lo + (np.arange(2) + 0.5) / 2 * (hi - lo)
    for _ in range(rounds + 1):
        at = ((p[:, None, :] - centres) ** 2).sum(-1).argmin(axis=1)
        centres = np.array([p[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(2)])
    sizes = np.bincount(at, minlength=2)
    return values, (at == min((s, c) for c, s in enumerate(sizes) if s)[1]).reshape(n, m)


def test_every_pair_has_its_own_model(spark):
    """In one pair a corner changes, in the other all but a corner; pooled, one of them would come out inverted."""
    rng = np.random.default_rng(12)
    rows, images = [], {}
    for tile, much in ((1, False), (2, True)):
        image = rng.normal(0.1, 0.02, (16, 16, 2))
        part = np.zeros((16, 16), bool)
        part[10:, 10:] = True
        image[part != much] += (0.8, 0.5)
        images[tile] = image
        rows += [(tile, i, j, *map(float, image[i, j])) for i in range(16) for j in range(16)]
    diff = spark.createDataFrame(rows, "tile_id long, row int, col int, a double, b double").repartition(5)
    models = {r.tile_id: r for r in change.fit_pair_models(diff, ["a", "b"], 4, 3).collect()}
    got = change.detect_pair_changes(diff, ["a", "b"], 4, 3).collect()
    for tile, image in images.items():
        values, want = _pair_reference(image, 4, 3, 20)
        assert models[tile].n_blocks == 16 and abs(models[tile].trace - values.sum()) < 1e-9
        assert np.allclose(models[tile].variances, sorted(values, reverse=True)[:3])
        marked = np.zeros((16, 16), bool)
        for r in got:
            if r.tile_id == tile:
                marked[r.row, r.col] = r.change == 255
        assert (marked == want).all()


def test_pair_models_of_odd_tables(spark):
    schema = "tile_id long, row int, col int, a double"
    none = spark.createDataFrame([], schema)
    assert change.fit_pair_models(none, ["a"], 2, 2).collect() == []
    assert change.detect_pair_changes(none, ["a"], 2, 2).collect() == []
    flat = spark.createDataFrame([(1, i, j, 0.5) for i in range(2) for j in range(2)], schema)  # one block, all equal
    assert [r.variances for r in change.fit_pair_models(flat, ["a"], 2, 2).collect()] == [[0.0, 0.0]]
    assert {r.change for r in change.detect_pair_changes(flat, ["a"], 2, 2).collect()} == {255}  # the only cluster is the rarest


def test_change_map_finds_the_changed_corner(spark, tmp_path):
    a = np.zeros((16, 16))
    b = a.copy()
    b[10:, 10:] = 5.0
    df = image(spark, a, name="x").join(image(spark, b, name="y"), ["tile_id", "row", "col"])
    diff = change.absolute_difference(df, {"d": ("x", "y")})
    model = change.fit_change_model(diff, ["d"], k=4, n_components=2)
    change.save_change_model(model, str(tmp_path / "m"))
    for m in (model, change.load_change_model(str(tmp_path / "m"))):
        got = back(change.change_map(change.change_clusters(diff, ["d"], m)), a.shape, "change")
        assert got[15, 15] == 255 and got[0, 0] == 0 and set(np.unique(got)) == {0, 255}
    with_clean = change.change_map(change.change_clusters(diff, ["d"], model))
    clean = back(with_clean, a.shape, "clean")
    assert (clean <= got).all() and clean[15, 15] == 255


def test_filter_params_needs_its_columns(spark):
    from swathframe.operators import scenes as sc
    with pytest.raises(ValueError, match="instrument"):
        sc.filter_params(spark.createDataFrame([(1, "GRD", "IW")], "scene_id int, product_type string, mode string"), {}, 1)


def test_scene_without_pixels_has_no_cloud(spark):
    from swathframe.operators import clouds
    box = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"
    zones = spark.createDataFrame([(1, (0.0, 0.0, 2.0, 2.0), (0.0, 0.0, 1.0, 1.0)), (2, (5.0, 5.0, 6.0, 6.0), (0.0, 0.0, 1.0, 1.0))],
                                  f"scene_id int, footprint {box}, zone {box}")
    scored = spark.createDataFrame([(1, 0.9)], "scene_id int, cloud_score double")
    got = {r.scene_id: (r.zone_cloud_pct, r.zone_coverage_pct) for r in clouds.cloud_stats(scored, zones, 1.0).collect()}
    assert got == {1: (100.0, 100.0), 2: (0.0, 0.0)}


@pytest.mark.parametrize("name", ["cloud_stats", "filter_clouds"])
def test_last_scene_without_zone_pixels_is_as_in_sql(spark, sf_dir, tmp_path, name):
    """The last scene has its first two rows only, all outside the zone."""
    import duckdb
    from queries.registry import all_oracles, all_queries
    from tests.compare import compare
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_orderkey < 1024 + 64").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    ok, message, _ = compare(all_queries()[name](spark, str(tmp_path)), con, all_oracles()[name])
    assert ok, message


def test_classes_beyond_the_list_are_counted(spark):
    df = spark.createDataFrame([(0, True), (30, False), (None, True)], "class_id int, wrong boolean")
    from swathframe.operators import confusion
    got = {r.class_id: (r.n, r.n_error) for r in confusion.class_errors(df, "class_id", "wrong", 2).collect()}
    assert got == {0: (1, 1), 1: (0, 0), 30: (1, 0), None: (1, 1)}


def test_hull_of_random_points(spark):
    import random
    rng = random.Random(1)
    rows = [(k, [(float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(rng.randint(0, 14))]) for k in range(200)] + [(200, None)]

    def half(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    def hull(ring):
        points = None if ring is None else sorted(set(ring))
        if points is None or len(points) < 3:
            return points
        corners = half(points) + half(points[::-1])
        return corners + corners[:1]
    df = spark.createDataFrame(rows, "k int, ring array<struct<lon: double, lat: double>>")
    got = {r.k: r.hull and [tuple(p) for p in r.hull] for r in df.select("k", ge.convex_hull("ring").alias("hull")).collect()}
    assert got == {k: hull(ring) for k, ring in rows}


def test_blocks_with_margin_score_like_whole_tiles(spark):
    rng = np.random.default_rng(3)
    image = rng.normal(size=(11, 14)).astype("float32")
    df = spark.createDataFrame([("t", r, c, float(image[r, c])) for r in range(11) for c in range(14)],
                               "tile_id string, row int, col int, v double")

    def build():
        def blur(cube):  # looks one pixel around; outside is zero
            p = np.pad(cube[:, :, 0], 1)
            return sum(p[i:i + cube.shape[0], j:j + cube.shape[1]] for i in range(3) for j in range(3))[:, :, None]
        return blur
    got = {(r.row, r.col): r.p for r in scoring.score_pixels(df, ["v"], build, ["p"], block=4, margin=1).collect()}
    whole = build()(image[:, :, None])[:, :, 0]
    assert len(got) == image.size and all(abs(got[r, c] - whole[r, c]) < 1e-5 for r, c in got)


def test_silhouette_of_every_point(spark):
    """Against all pairs, far from the origin; single members, nulls and one cluster alone."""
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1.0, (60, 3))
    label = rng.integers(0, 3, 60)
    x[label == 1] += 4
    rows = [(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, label))] + [(90, 1e6, 1e6, 1e6, 7), (91, None, 1.0, 1.0, 0), (92, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, g int")
    got = {r.id: r.silhouette for r in st.silhouette_points(df, ["a", "b", "c"], "g").collect()}
    assert got[90] == 0.0 and got[91] is None and got[92] is None
    points, groups = np.vstack([x, [[1e6] * 3]]), np.append(label, 7)
    d = ((points[:, None] - points[None]) ** 2).sum(-1)
    for i in range(60):
        own = (groups == groups[i]) & (np.arange(61) != i)
        a, b = d[i, own].mean(), min(d[i, groups == g].mean() for g in set(groups.tolist()) - {groups[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-6)
    one = st.silhouette_points(df.filter("g = 0 and a is not null"), ["a", "b", "c"], "g").collect()
    assert one and all(r.silhouette == 0.0 for r in one)
    assert st.silhouette_points(df.limit(0), ["a"], "g").collect() == []
