"""Physical plans: few exchanges, pruned scans, no joins where none are needed."""

import pytest

from queries.registry import all_queries

QUERIES = all_queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["focal_mean", "erode_diamond", "dilated_erosion", "lee_filter"])
def test_focal_shuffles_pixels_once(spark, sf_dir, name):
    """One exchange derives the raster from its source, one more serves all neighbourhood passes."""
    assert plan_of(QUERIES[name](spark, sf_dir)).count("Exchange hashpartitioning") == 2


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan_of(QUERIES["filter_cloud"](spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text
    text = plan_of(QUERIES["filter_product_id"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,123)]" in text


def test_pixel_aggregates_combine_before_the_shuffle(spark, sf_dir):
    text = plan_of(QUERIES["psnr_flat"](spark, sf_dir))
    assert "partial_avg" in text and text.count("Exchange hashpartitioning") == 1


def test_scaler_needs_no_join(spark, sf_dir):
    text = plan_of(QUERIES["apply_scaler"](spark, sf_dir))
    assert "Join" not in text and "Subquery" in text


def test_scene_matching_forms_no_pairs(spark, sf_dir):
    """Matching is windows over one union, without a join of optical and radar scenes."""
    text = plan_of(QUERIES["nearest_scene_join"](spark, sf_dir))
    assert "Join" not in text and "Window" in text


def test_search_by_place_forms_no_product(spark, sf_dir):
    """Scenes meet by cell and day, and pairs shrink to the best of each window before they are shuffled."""
    text = plan_of(QUERIES["nearest_scene_by_footprint"](spark, sf_dir))
    assert "Cartesian" not in text and "NestedLoop" not in text
    joins = [line for line in text.splitlines() if "Join" in line]
    assert len(joins) == 1 and all(k in joins[0] for k in ("_cx", "_cy", "_day")) and "partial_min" in text


def test_filter_on_classes_computes_each_difference_once(spark, sf_dir):
    """Two differences of two indices, each band read twice; it was that for each of twelve bounds."""
    text = QUERIES["mask_values"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in text.splitlines() if "Filter" in line)
    assert condition.count("l_discount") <= 24
