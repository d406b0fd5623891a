"""Clustering of vectors around centroids, exact in whole numbers, with Ptolemaic lower bounds.

For any four points d(x,c) d(p,q) >= |d(x,p) d(q,c) - d(x,q) d(p,c)|.  Pivots p
are fixed vectors, so d(x,p) is stored with each vector once; a round needs the
few distances between pivots and centroids only.  Centroids whose lower bound,
rounded down, exceeds the distance to another one are left out; the rest is
measured exactly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.llm.common import dealt, slices

#: Pivots (starting centroids); their pairs give the bounds.
PIVOTS = 8
#: Largest component whose squared distances stay exact in 64 bits (64 components, or fewer); beyond it Python's integers count.
SMALL = 1 << 27
#: Sums travel in parts of so many bits.
_LIMB = 40
_LONG = (1 << 63) - 1
_SLACK = 1e-12


def _fits(largest: float, dimension: int) -> bool:
    return largest <= SMALL * math.sqrt(64 / max(dimension, 64))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where squares fit, else as Python integers."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if _fits(np.abs(v).max(initial=0), x.shape[1]):
        return v.astype(np.int64)
    out = np.empty(x.shape, object)
    for k, value in enumerate(x.ravel().tolist()):
        top, bottom = value.as_integer_ratio()
        out.flat[k] = top * scale // bottom
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``a`` and of ``b`` (or the one row ``b``)."""
    d = a - b
    return (d * d).sum(axis=-1)


def _roots(d: np.ndarray) -> np.ndarray:
    """Distances as doubles; infinite where they do not fit."""
    if d.dtype != object:
        return np.sqrt(d.astype(float))
    return np.array([math.sqrt(v) if v < 1 << 1000 else math.inf for v in d.ravel().tolist()]).reshape(d.shape)


class Bounds:
    """Lower bounds of squared distances to the centroids of one round."""

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray):
        self.count = len(centroids)
        self.to_centroid = _roots(np.stack([squared(centroids, p) for p in pivots]))
        apart = _roots(np.stack([squared(pivots, p) for p in pivots]))
        self.pairs = [(p, q, apart[p, q]) for p in range(len(pivots)) for q in range(p) if 0 < apart[p, q] < math.inf]

    def squares(self, to_pivot: np.ndarray) -> np.ndarray:
        """(vector, centroid); every step rounds to the safe side, so none exceeds the true value."""
        low = np.zeros((len(to_pivot), self.count))
        with np.errstate(invalid="ignore", over="ignore"):
            for p, q, apart in self.pairs:
                a = to_pivot[:, p, None] * self.to_centroid[None, q]
                b = to_pivot[:, q, None] * self.to_centroid[None, p]
                bound = (np.abs(a - b) - (a + b) * _SLACK) / apart * (1 - _SLACK)
                low = np.fmax(low, bound)  # a bound that is not a number says nothing
            return low * low * (1 - _SLACK)


def nearest(x: np.ndarray, to_pivot: np.ndarray, centroids: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid of each vector, exact squared distance, distances computed); ties go to the smaller number."""
    low = bounds.squares(to_pivot)
    best_at = low.argmin(axis=1)
    best, spent = squared(x, centroids[best_at]), len(x)
    first = best_at.copy()
    for c in range(len(centroids)):
        able = low[:, c] * (1 - _SLACK) <= best.astype(float) if best.dtype != object else np.ones(len(x), bool)
        rows = np.flatnonzero(able & (first != c))
        d = squared(x[rows], centroids[c])
        spent += len(rows)
        nearer = ((d < best[rows]) | ((d == best[rows]) & (c < best_at[rows]))).astype(bool)
        best[rows[nearer]], best_at[rows[nearer]] = d[nearer], c
    return best_at, best, spent


def _limbs(value: int):
    """(number, part) of a whole number, parts of ``_LIMB`` bits with its sign."""
    sign, rest, k = (1, value, 0) if value >= 0 else (-1, -value, 0)
    while rest:
        yield k, sign * (rest & ((1 << _LIMB) - 1))
        rest, k = rest >> _LIMB, k + 1


def _common(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers, or both as Python's."""
    if x.dtype == centroids.dtype:
        return x, centroids
    return x.astype(object), centroids.astype(object)


def _table(rows: list[list[int]]) -> np.ndarray:
    return np.array(rows, np.int64 if _fits(max(abs(v) for r in rows for v in r), len(rows[0])) else object)


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024,
                    seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each vector kept.

    Kept are vectors with exactly ``dimension`` components, none null or not
    finite; each component becomes floor(scale * x).  The first centroids are
    the vectors with the least sha256 of ``seed:vec_id`` (repeated ids: the
    lesser vector first); with fewer vectors there are fewer centroids.  A row
    without id is clustered but never a first centroid; repeated rows count
    each; other columns are left out; with an empty table, or no vector with an
    id, there are no rows.  Sums are exact at any size of the components; a distance or inertia beyond 64
    bits is null.  A task returns one sum per centroid and component, so what
    reaches the driver does not grow with the vectors.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = (vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding")
            .filter((F.size("embedding") == dimension) & finite))
    first = (kept.filter("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
             .orderBy("h", "embedding").limit(clusters).collect())
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = whole(np.array([r["embedding"] for r in first]), scale)
    pivots = centroids[:PIVOTS]

    def cache(batches):
        for batch in slices(batches, 10_000):
            x = batch.column(1).flatten().to_numpy().reshape(-1, dimension)
            own, fixed = _common(whole(x, scale), pivots)
            far = np.stack([_roots(squared(own, p)) for p in fixed], axis=1) if len(x) else np.zeros((0, len(fixed)))
            yield pa.record_batch([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()),
                                   pa.array([v.tobytes() for v in far], pa.binary())], names=["vec_id", "x", "far"])

    stored = dealt(kept.select("vec_id", "embedding").mapInArrow(cache, "vec_id long, x binary, far binary"))

    def assigned(batches, centroids):
        bounds = {}
        for batch in slices(batches, 10_000):
            if not batch.num_rows:
                continue
            raw, far = (np.frombuffer(b"".join(batch.column(c).to_pylist())).reshape(batch.num_rows, -1) for c in (1, 2))
            x, own = _common(whole(raw, scale), centroids)
            if own.dtype not in bounds:
                bounds[own.dtype] = Bounds(pivots.astype(own.dtype), own)
            at, distance, _ = nearest(x, far, own, bounds[own.dtype])
            yield batch.column(0), x, at, distance

    for _ in range(rounds):
        def add(batches, centroids=centroids):
            total, n = None, np.zeros(len(centroids), np.int64)
            for _, x, at, _ in assigned(batches, centroids):
                own = np.zeros((len(centroids), dimension), x.dtype)
                np.add.at(own, at, x)
                total = own if total is None else total + own
                n += np.bincount(at, minlength=len(centroids))
            if total is None:
                return
            rows = [(c, -1, 0, int(n[c])) for c in np.flatnonzero(n)]
            rows += [(c, j, k, part) for c in np.flatnonzero(n) for j in range(dimension) for k, part in _limbs(int(total[c, j]))]
            yield pa.record_batch([pa.array(column, pa.int64()) for column in zip(*rows)], names=["c", "j", "k", "s"])

        sums = (stored.mapInArrow(add, "c long, j long, k long, s long").groupBy("c", "j", "k").agg(F.sum("s").alias("s"))
                .collect())
        n = {r["c"]: r["s"] for r in sums if r["j"] < 0}
        total = {c: [0] * dimension for c in n}
        for r in sums:
            if r["j"] >= 0:
                total[r["c"]][r["j"]] += r["s"] << (_LIMB * r["k"])
        centroids = _table([[s // n[c] for s in total[c]] if c in n else [int(v) for v in own]
                            for c, own in enumerate(centroids)])

    def last(batches):
        for ids, _, at, distance in assigned(batches, centroids):
            yield pa.record_batch([ids, pa.array(at.astype(np.int32)),
                                   pa.array([d if d <= _LONG else None for d in distance.tolist()], pa.int64())],
                                  names=["vec_id", "cluster", "distance"])

    final = dealt(stored.mapInArrow(last, "vec_id long, cluster int, distance long"))
    spent = {r["cluster"]: (int(r["s"]) if r["all"] else None) for r in final.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), (F.count("distance") == F.count("*")).alias("all")).collect()}
    inertia = None if None in spent.values() else sum(spent.values())

    def fits(v):
        return v if v is not None and v <= _LONG else None
    digests = [(c, fits(s), hashlib.sha256(",".join(str(int(v)) for v in centroids[c]).encode()).hexdigest())
               for c, s in sorted(spent.items())]
    about = vectors.sparkSession.createDataFrame(digests, "cluster int, cluster_inertia long, centroid_sha256 string")
    return (final.join(F.broadcast(about), "cluster")  # a row for each centroid
            .select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(fits(inertia)).cast("long").alias("inertia"),
                    "centroid_sha256"))
