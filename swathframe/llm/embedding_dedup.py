"""Embedding near-duplicates with a forest of random-projection trees.

A tree splits at the median of a random projection, again and again; a vector
near the cut goes to both sides (spill).  Vectors that share a leaf in any of
the trees are compared by their cosine in double precision.  The forest is fit
on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.llm.common import components, dealt
from swathframe.llm.near_dup import spanning

COSINE = 0.95
#: Vectors the forest is fit on (the least hashes of their id); the rest only passes through the trees.
SAMPLE = 32_768
LEAF, TREES, SPILL = 256, 8, 0.5


class Forest:
    """Trees over unit vectors of one dimension; node k's children are ``left[k]`` and ``left[k] + 1``."""

    def __init__(self, sample: np.ndarray, total: int, cosine: float = COSINE, leaf: int = LEAF, trees: int = TREES,
                 spill: float = SPILL, seed: int = 7):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        # A linked pair differs by this much at most along a random direction, as a standard deviation.
        self.margin = spill * np.sqrt((2 - 2 * cosine) / dim)
        share = max(total / max(len(sample), 1), 1.0)
        self.trees = [self._grow(sample, rng, max(leaf / share, 16)) for _ in range(trees)]

    def _grow(self, sample, rng, least):
        direction, cut, left = [None], [0.0], [-1]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= least:
                continue
            d = rng.normal(size=sample.shape[1])
            d /= np.linalg.norm(d)
            p = sample[rows] @ d
            middle = float(np.median(p))
            if (p <= middle).all() or (p > middle).all():
                continue  # the sample does not split here
            direction[node], cut[node], left[node] = d, middle, len(cut)
            for side in (rows[p <= middle], rows[p > middle]):
                direction.append(None), cut.append(0.0), left.append(-1)
                todo.append((len(cut) - 1, side))
        return direction, cut, left

    def leaves(self, vectors: np.ndarray) -> list[list[int]]:
        """For each vector its leaves over all trees, ascending; a leaf's number holds its tree."""
        out = [[] for _ in vectors]
        for t, (direction, cut, left) in enumerate(self.trees):
            todo = [(0, np.arange(len(vectors)))]
            while todo:
                node, rows = todo.pop()
                if left[node] < 0:
                    for r in rows.tolist():
                        out[r].append((t << 32) + node)
                    continue
                p = vectors[rows] @ direction[node] - cut[node]
                for child, side in ((left[node], rows[p <= self.margin]), (left[node] + 1, rows[p > -self.margin])):
                    if len(side):
                        todo.append((child, side))
        return [sorted(x) for x in out]


def _units(batches):
    """Unit vectors in double precision; null for those that link with nothing."""
    for batch in batches:
        units, keys = [], []
        for vec, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            v = None
            if vec is not None and values and not any(x is None for x in values):
                v = np.array(values, float)
                most = np.abs(v).max()
                # A power of two brings the largest component near 1, so that no square over- or underflows.
                v = np.ldexp(v, -int(np.frexp(most)[1])) if np.isfinite(most) and most > 0 else None
                v = None if v is None else v / np.sqrt(v @ v)
            units.append(None if v is None else v.tobytes())
            keys.append(None if v is None else hashlib.blake2b(np.array(values, float).tobytes(), digest_size=16).digest())
        yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())],
                              names=["vec_id", "key", "unit"])


def _compare(cosine: float):
    """Links inside one block, or between two, of a leaf; each pair counts in its first common leaf only."""
    def solve(leaf, ids, sides, times, units, leaves):
        v = np.frombuffer(b"".join(units)).reshape(len(ids), -1)
        near = v @ v.T >= cosine
        side = np.array(sides)
        if side.max():
            near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, False)
        if not near.any():
            return []
        earlier = {x: k for k, x in enumerate(dict.fromkeys(x for own in leaves for x in own if x < leaf))}
        if earlier:
            member = np.zeros((len(ids), len(earlier)), np.float32)
            for r, own in enumerate(leaves):
                member[r, [earlier[x] for x in own if x < leaf]] = 1
            near &= member @ member.T == 0
        order = np.argsort(np.array(ids))
        near = near[np.ix_(order, order)]
        n = near @ np.array(times)[order]
        a, b = np.nonzero(np.triu(near))
        root = spanning(zip(a.tolist(), b.tolist()), len(ids))
        return [(ids[order[k]], int(n[k]), ids[order[root[k]]]) for k in range(len(ids)) if n[k]]

    def run(batches):
        key, own = None, None

        def rows(found):
            return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], names=["rep", "n", "root"])
        for batch in batches:
            for dim, leaf, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (dim, leaf, i, j) != key:
                    if own and len(own[0]) > 1 and (found := solve(key[1], *own)):
                        yield rows(found)
                    key, own = (dim, leaf, i, j), ([], [], [], [], [])
                for column, x in zip(own, row):
                    column.append(x)
        if own and len(own[0]) > 1 and (found := solve(key[1], *own)):
            yield rows(found)
    return run


def link_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Equal vectors are one class and linked with each other.  Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without
    id, link with nothing (component: their own id; without id null, kept).
    Vectors of different dimension never link; rows that share an id share a
    component.  Other columns are left out.

    A leaf is compared in blocks of at most 1024 classes (256 in small leaves'
    place), pair of blocks by pair of blocks, so a crowded leaf spreads over
    many tasks; tasks return a count and one link per class, not pairs.
    """
    rows = dealt(vectors.selectExpr("cast(vec_id as long) vec_id", "embedding")
                 .mapInArrow(_units, "vec_id long, key binary, unit binary"))
    classes = dealt(rows.filter("key is not null").groupBy("key")
                    .agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("unit").alias("unit")))
    sample = (classes.select("unit", F.length("unit").alias("size")).orderBy(F.xxhash64("unit")).limit(SAMPLE).collect())
    total = {r["size"]: r["n"] for r in classes.groupBy(F.length("unit").alias("size")).agg(F.count("*").alias("n"))
             .orderBy(F.desc("n")).limit(64).collect()}
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(r["size"], []).append(np.frombuffer(r["unit"]))
    forests = {size: Forest(np.stack(own), total.get(size, len(own)), cosine) for size, own in by_size.items()}

    def route(batches):
        for batch in batches:
            reps, times, units = (c.to_pylist() for c in batch.columns)
            leaves = [[0]] * len(units)  # a dimension that the sample does not hold is one leaf
            for size in {len(u) for u in units}:
                at = [k for k, u in enumerate(units) if len(u) == size]
                if size in forests:
                    v = np.frombuffer(b"".join(units[k] for k in at)).reshape(len(at), -1)
                    for k, own in zip(at, forests[size].leaves(v)):
                        leaves[k] = own
            yield pa.record_batch([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))],
                                  names=["rep", "times", "unit", "leaves"])

    routed = dealt(classes.select("rep", "times", "unit").mapInArrow(
        route, "rep long, times long, unit binary, leaves array<long>"))
    seats = routed.select(F.length("unit").alias("dim"), F.explode("leaves").alias("leaf"), "*")
    block = F.greatest(F.lit(256.0), F.least(F.lit(1024.0), F.col("n") / 16))
    sizes = dealt(seats.groupBy("dim", "leaf").agg(F.count("*").alias("n"))
                  .select("dim", "leaf", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    spread = (seats.join(sizes, ["dim", "leaf"]).withColumn("mine", mine)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("dim", "leaf", F.least("other", "mine").alias("i"), F.greatest("other", "mine").alias("j"), "rep",
                      (F.col("mine") > F.least("other", "mine")).cast("int").alias("side"), "times", "unit", "leaves"))
    found = dealt(spread.repartition("dim", "leaf", "i", "j").sortWithinPartitions("dim", "leaf", "i", "j")
                  .mapInArrow(_compare(cosine), "rep long, n long, root long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    label = components(found.filter("rep <> root").select(F.col("root").alias("a"), F.col("rep").alias("b")).distinct())
    by_class = dealt(classes.select("key", "rep", "times").join(counts, "rep", "left")
                     .join(label, F.col("rep") == F.col("v"), "left")
                     .select("key", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                             F.coalesce("label", "rep").alias("component")))
    component = F.coalesce("component", "vec_id")
    return (rows.select("vec_id", "key").join(by_class, "key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")))
