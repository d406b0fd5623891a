"""Block arrays: passes against the pixel operator, displacement against plain sums, and what is shuffled."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathframe.operators import block_arrays as ba
from swathframe.operators import clouds, focal

ERODE, DILATE = focal.circle_runs(1.5), focal.circle_runs(3.0)
PASSES = [("min", focal.run_offsets(ERODE))] * 2 + [("max", focal.run_offsets(DILATE))] * 2


def _pixels(spark, size=23, keys=("a", None)):
    """Two images, one with a null key, with absent pixels and null values, and columns that ride along."""
    rng = np.random.default_rng(4)
    rows = [(key, i, j, None if rng.random() < 0.1 else float(rng.normal()), f"{key}{i}", [i, j])
            for key in keys for i in range(size) for j in range(size + 5) if rng.random() < 0.8]
    return rows, spark.createDataFrame(rows, "scene string, row int, col int, v double, name string, at array<int>").repartition(6)


@pytest.mark.parametrize("block", [5, 64])
def test_passes_equal_the_pixel_operator(spark, block):
    rows, df = _pixels(spark, keys=("a", "b"))
    want = focal.opened(df, "v", 1.5, 3.0, 2, ("scene",), "out", block).collect()
    reach = 2 * (focal.runs_reach(ERODE) + focal.runs_reach(DILATE))
    got = ba.focal_passes(df, "v", PASSES, reach, ("scene",), "out", block).collect()
    assert len(rows) == len(got) and sorted(map(repr, got)) == sorted(map(repr, want))


def test_passes_keep_null_keys_apart(spark):
    rows, df = _pixels(spark)
    got = ba.focal_passes(df, "v", [("min", [(0, 0)])], 0, ("scene",), "out", 8).collect()
    assert sorted(map(repr, [tuple(r)[:-1] for r in got])) == sorted(map(repr, rows))
    assert all(r.out == r.v for r in got)


@pytest.mark.parametrize("block", [6, 256])
def test_displacement_equals_plain_sums(spark, block):
    rows, df = _pixels(spark, 14, ("a", "b"))
    moves = {"a": [(-9, 4, 2), (0, 0, 1), (3, -20, 1)], "b": [(5, 5, 3)]}
    shifts = spark.createDataFrame([(k, [dict(zip(("dr", "dc", "w"), s)) for s in v]) for k, v in moves.items()],
                                   "scene string, shifts array<struct<dr:int,dc:int,w:bigint>>")
    total = collections.defaultdict(lambda: [0.0, 0, 0])
    for key, i, j, v, *_ in rows:
        for dr, dc, w in moves[key]:
            t = total[key, i + dr, j + dc]
            t[0], t[1], t[2] = t[0] + w * (v or 0.0), t[1] + w, t[2] + (v is not None)
    want = {k: None if not n else s / w for k, (s, w, n) in total.items()}
    parts = ba.displaced_parts(df, "v", shifts, ("scene",), block)
    got = {(r.scene, r.row, r.col): r.m for r in ba.displaced_mean(parts, ("scene",), "m", block).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-12) for k in want)
    on = ba.with_displaced_mean(df, parts, ("scene",), "m", block).collect()
    assert len(on) == len(rows)
    for r in on:
        w = want.get((r.scene, r.row, r.col))
        assert (r.m is None) == (w is None) and (w is None or abs(r.m - w) < 1e-12)


def test_empty_images(spark):
    _, df = _pixels(spark)
    none = df.limit(0)
    shifts = spark.createDataFrame([], "scene string, shifts array<struct<dr:int,dc:int,w:bigint>>")
    assert ba.focal_passes(none, "v", PASSES, 8, ("scene",), "out").collect() == []
    parts = ba.displaced_parts(none, "v", shifts, ("scene",))
    assert ba.displaced_mean(parts, ("scene",), "m").collect() == [] and ba.with_displaced_mean(none, parts, ("scene",), "m").collect() == []


def test_shadows_shuffle_blocks(spark):
    """64 x 64 pixels in blocks of 16: 16 blocks; 40 heights reach few blocks, where pixels would send 40 rows each."""
    df = spark.range(64 * 64).selectExpr("1L as scene_id", "cast(id div 64 as int) as row", "cast(id % 64 as int) as col",
                                         "cast(id % 7 as double) as cloud_score", "30.0D as azimuth", "25.0D as zenith")
    parts = ba.displaced_parts(df, "cloud_score", clouds.sun_shifts(df, 100.0), ("scene_id",), 16)
    assert parts.count() <= 16 * 12 < 64 * 64
    seen = parts.agg(F.min("_block_row"), F.max("_block_row")).first()
    assert seen[0] != seen[1]


def test_cloud_score_is_computed_once(spark):
    from queries.registry import all_queries
    text = all_queries()["project_shadows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "b11" in text and "lineitem" not in text  # the scored pixels are a stored table, read for pixels and shadows
    assert "FlatMapCoGroupsInArrow" in text and "SortMergeJoin" not in text
