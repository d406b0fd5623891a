"""Whole-number clustering against plain Python."""

import hashlib
import math
import random

import numpy as np

from swathframe.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, x string, far int, cluster string, h int, c int"


def _plain(rows, clusters=8, rounds=10):
    def whole(v):
        top, bottom = v.as_integer_ratio()
        return top * 1024 // bottom
    kept = [(i, [whole(v) for v in e]) for i, e in rows
            if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in start[:clusters]]

    def far(v, c):
        return sum((a - b) ** 2 for a, b in zip(v, c))

    def assign():
        return [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for c in range(len(centres)):
            if own := [v for (_, v), x in zip(kept, at) if x == c]:
                centres[c] = [sum(z) // len(own) for z in zip(*own)]
    at = assign()
    d = [far(v, centres[c]) for (_, v), c in zip(kept, at)]

    def fits(v):
        return v if v < 1 << 63 else None
    return sorted(((i, c, fits(x), fits(sum(y for y, z in zip(d, at) if z == c)), fits(sum(d)),
                    hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
                   for (i, _), c, x in zip(kept, at, d)), key=repr)


def _vectors():
    rng = random.Random(2)
    rows = [(k, [rng.gauss((k % 9) * 0.1, 0.2) for _ in range(64)]) for k in range(150)]
    return rows + [(5, [0.1] * 64)] * 30 + [
        (None, [0.2] * 64), (1000, None), (1001, [1.0] * 63), (1002, [math.nan] + [0.0] * 63), (1003, [math.inf] + [0.0] * 63),
        (1004, [None] + [0.0] * 63), (1005, [0.0] * 64), (1006, [])]


def _run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in centroids.cluster_vectors(df, **more).collect()), key=repr)


def test_equals_plain_python(spark):
    assert _run(spark, _vectors()) == _plain(_vectors())


def test_components_beyond_64_bits(spark):
    rows = _vectors() + [(2000, [1e200] * 64), (2001, [-1e308] * 64), (2002, [1e7] * 64)]
    assert _run(spark, rows, rounds=3) == _plain(rows, rounds=3)


def test_few_equal_and_no_vectors(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(None, [1.0] * 64)]) == []
    rows = [(k, [0.5] * 64) for k in range(12)] + [(40, [0.25] * 64)]
    assert _run(spark, rows) == _plain(rows)
    assert _run(spark, rows[:2]) == _plain(rows[:2])


def test_bounds_never_exceed_and_spare_distances():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(10, 64)) * 400
    x = np.floor(middle[rng.integers(0, 10, 4000)] + rng.normal(size=(4000, 64)) * 20).astype(np.int64)
    centres = np.floor(middle[:8]).astype(np.int64)
    pivots = x[:8]
    far = np.stack([centroids._roots(centroids.squared(x, p)) for p in pivots], axis=1)
    bounds = centroids.Bounds(pivots, centres)
    exact = np.stack([centroids.squared(x, c) for c in centres], axis=1)
    assert (bounds.squares(far) <= exact).all()
    at, best, spent = centroids.nearest(x, far, centres, bounds)
    assert (at == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert spent < 0.5 * exact.size
