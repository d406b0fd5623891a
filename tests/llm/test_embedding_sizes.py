"""Vectors of any finite length are compared by direction."""

import math

from swathframe.llm.embedding_dedup import link_vectors


def test_very_long_and_very_short_vectors(spark):
    rows = [(1, [1e200, 1e200, 0.0]), (2, [2e200, 2e200, 1e190]), (3, [1e-200, 1e-200, 0.0]), (4, [5e-324, 5e-324, 0.0]),
            (5, [1e308, 1e308, 1e308]), (6, [0.0, 0.0, 0.0]), (7, [math.nan, 1.0, 1.0]), (8, [math.inf, 1.0, 0.0]), (9, [-1e200, 1e200, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[k] == (3, 1) for k in (1, 2, 3, 4))
    assert all(got[k] == (0, k) for k in (5, 6, 7, 8, 9))
