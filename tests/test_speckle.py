"""Edge-directed speckle filter: steps stay sharp, large values with a small spread keep their digits, gaps are absent."""

import numpy as np

from swathframe.operators.speckle import half_window, lee_filter, lee_sigma_filter, refine, refined_lee_filter, smooth


def filtered(spark, array, looks, block=256):
    rows = [(1, i, j, None if np.isnan(v) else float(v), "x") for (i, j), v in np.ndenumerate(array)]
    df = spark.createDataFrame(rows, "tile_id int, row int, col int, v double, note string")
    out = np.full(array.shape, np.nan)
    got = refined_lee_filter(df, "v", looks, block=block).collect()
    assert len(got) == len(rows) and all(r.note == "x" for r in got)
    for r in got:
        out[r["row"], r["col"]] = np.nan if r.filtered is None else r.filtered
    return out


def test_halves_share_the_line_through_the_centre():
    for side in ((0, 1), (-1, 1), (-1, 0), (-1, -1)):
        own, other = set(half_window(side)), set(half_window((-side[0], -side[1])))
        assert len(own) == len(other) == 28 and len(own & other) == 7 and len(own | other) == 49


def test_steps_and_blocks(spark):
    rng = np.random.default_rng(3)
    image = np.where(np.arange(24)[None, :] < 12, 10.0, 100.0) * (1 + 0.05 * rng.normal(size=(24, 24)))
    whole, cut = filtered(spark, image, 400.0), filtered(spark, image, 400.0, block=7)
    assert np.allclose(whole, cut, rtol=1e-12)
    inner = np.s_[3:-3, 3:-3]
    assert np.abs(whole[inner] / np.where(np.arange(24)[None, :] < 12, 10.0, 100.0)[:, 3:-3].repeat(18, 0)[:18] - 1).max() < 0.2
    assert whole[3:-3, 3:9].std() < 0.6 * image[3:-3, 3:9].std()  # smoother away from the step


def test_large_values_with_a_small_spread():
    rng = np.random.default_rng(5)
    small = 1e-3 * rng.normal(size=(16, 16))
    z = 1e6 + small
    # Noise far below the spread: the filter must return the pixel itself, which needs the variance to its digits.
    got = refine(z, 1e24)
    assert np.abs(got - z[3:-3, 3:-3]).max() < 1e-6
    # Noise as large as the spread: the mean of the chosen half, within the spread.
    assert np.abs(refine(z, (1e6 / 1e-3) ** 2) - 1e6).max() < 3e-3


def test_absent_pixels(spark):
    image = np.full((9, 9), 5.0)
    image[4, 4] = np.nan
    for looks in (1.0, None):
        got = filtered(spark, image, looks)
        assert np.isnan(got[4, 4])
        assert np.allclose(got[~np.isnan(got)], 5.0) and np.isnan(got).sum() == 1
    none = spark.createDataFrame([], "tile_id int, row int, col int, v double")
    assert refined_lee_filter(none, "v").count() == 0


def test_plain_and_sigma_filters_keep_digits(spark):
    rng = np.random.default_rng(6)
    image = 1e6 + 1e-3 * rng.normal(size=(12, 12))
    assert np.abs(smooth(np.pad(image, 4, constant_values=np.nan), 9, 1e24, 4) - image).max() < 1e-6
    df = spark.createDataFrame([(1, i, j, float(v)) for (i, j), v in np.ndenumerate(image)], "tile_id int, row int, col int, v double")
    for out in (lee_filter(df, "v", 9, 1e24), lee_filter(df, "v", 9, 1e24, block=5),
                lee_sigma_filter(df, "v", looks=1e24, low=0.5, high=2.0, std=1e-12, block=5)):
        got = {(r["row"], r["col"]): r.filtered for r in out.collect()}
        assert max(abs(got[i, j] - v) for (i, j), v in np.ndenumerate(image)) < 1e-6
