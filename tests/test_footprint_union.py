"""Area of a union of footprints against hand-worked and rasterised values."""

import math

import numpy as np

from swathframe.operators.footprint_union import union_area

RINGS = "g string, ring array<struct<lon double, lat double>>"


def areas(spark, rows, zone, **more):
    return {r.g: (r.area, r.covers) for r in union_area(spark.createDataFrame(rows, RINGS), zone, keys=("g",), **more).collect()}


def test_known_unions(spark):
    triangle, turned = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)], [(4.0, 4.0), (0.0, 4.0), (4.0, 0.0), (4.0, 4.0)]
    notch = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]  # concave: 16 - 6
    square = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    rows = [("touch", triangle), ("touch", turned), ("touch", triangle), ("notch", notch), (None, square), ("over", triangle),
            ("over", square), ("none", None), ("none", [(0.0, 0.0), (1.0, 1.0)]), ("outside", [(9.0, 0.0), (9.5, 0.0), (9.0, 1.0)])]
    for strips in (1, 3, 16):
        got = areas(spark, rows, (0, 0, 4, 4), strips=strips, factor=0.9)
        want = {"touch": 16, "notch": 10, None: 4, "over": 10, "none": 0, "outside": 0}
        assert set(got) == set(want)
        for k, v in want.items():
            assert math.isclose(got[k][0], v, abs_tol=1e-9), (k, strips, got[k])
            assert got[k][1] == (v >= 0.9 * 16)
    assert math.isclose(areas(spark, rows, (1, 1, 2, 5))["over"][0], 2.0, abs_tol=1e-9)  # the zone cuts the shapes
    assert areas(spark, [], (0, 0, 1, 1)) == {}


def test_random_triangles_against_a_raster(spark):
    rng = np.random.default_rng(4)
    shapes = rng.random((25, 3, 2)) * 0.4 + rng.random((25, 1, 2)) * 0.6
    got = areas(spark, [("t", [tuple(map(float, p)) for p in s]) for s in shapes], (0, 0, 1, 1), strips=8)["t"][0]
    axis = (np.arange(2000) + 0.5) / 2000
    x, y = np.meshgrid(axis, axis)
    covered = np.zeros(x.shape, bool)
    for a, b, c in shapes:
        side = [(q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) for p, q in ((a, b), (b, c), (c, a))]
        covered |= np.all([s >= 0 for s in side], axis=0) | np.all([s <= 0 for s in side], axis=0)
    assert abs(got - covered.mean()) < 1e-3
