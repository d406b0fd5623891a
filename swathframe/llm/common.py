"""Words, hashes and Spark helpers that the text operators share."""

from __future__ import annotations

import re

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathframe.session import write_once

_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: White space before a space: there a text must not be cut at that space.
_SPACE_RUN = re.compile(r"\s ")


def words(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def folded_words(text: str | None) -> list[bytes]:
    """``words`` with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def space_chunks(text: str) -> list[str] | None:
    """Cut before single spaces; the first piece stands at the start, every other one follows a space.

    None where white space precedes a space: cut there, a pre-tokenizer would
    see other runs of white space than in the whole text.
    """
    return None if _SPACE_RUN.search(text) else text.split(" ")


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        have = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, base, _U)]), dtype=_U)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the input reaches every bit of the result."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``data`` begins and ends."""
    a = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], (a != 32) & ((a < 9) | (a > 13)), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of ``data``, in order, without a Python loop over words."""
    if not data:
        return np.zeros(0, _U)
    a = np.frombuffer(data, np.uint8)
    start, end = word_places(data)
    total = np.concatenate([np.zeros(1, _U), np.cumsum((a.astype(_U) + _U(1)) * _power(_BASE, len(a)), dtype=_U)])
    return mix((total[end] - total[start]) * _power(_INVERSE, len(a) + 1)[start])


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of ``n`` word hashes."""
    if len(w) < n:
        return np.zeros(0, _U)
    g = np.zeros(len(w) - n + 1, _U)
    for j in range(n):
        g = g * _U(_STEP) + w[j:len(w) - n + 1 + j]
    return mix(g)


def minimisers(g: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` grams the position of its least one, the first among equals."""
    if len(g) < window:
        return np.zeros(0, np.int64)
    out = np.empty(len(g) - window + 1, np.int64)
    block = 1 << 18  # bounds the memory of a very long text
    for lo in range(0, len(out), block):
        hi = min(len(out), lo + block)
        out[lo:hi] = sliding_window_view(g[lo:hi + window - 1], window).argmin(axis=1) + np.arange(lo, hi)
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def slices(batches, rows: int = 1000):
    """The rows in smaller batches, so that fewer of them are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def fold_of(key: str, k: int) -> Column:
    """crc32 of the key as text, modulo ``k``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % k


def dealt(df: DataFrame, rows: int | None = None, per_file: int = 20_000) -> DataFrame:
    """The rows stored once, for several later plans.

    With a bound on the number of ``rows`` a small table does not become a file
    for each shuffle partition; a large one keeps its partitions.
    """
    return write_once(df if rows is None else df.coalesce(max(8, rows // per_file)))


def components(edges: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """(v, label): for each vertex of ``edges`` the least vertex it reaches.

    The graph is contracted: each vertex moves to the first of its neighbours and itself in the order
    of their hashes, edges follow their ends, and equal ones meet.  In this order about half of the vertices
    of even a path go in a round, so tables shrink geometrically; the moves are
    put together backwards.  Each round is a stored table: neither lineage nor
    the driver grows, and a hub's many links combine before the shuffle.
    """
    def undirected(df, x, y):
        return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a < b").distinct()

    def rank(v):
        return F.struct(F.xxhash64(v).alias("h"), F.col(v).alias("v"))

    rest, moves = dealt(undirected(edges, low, high)), []
    alone = edges.filter(F.col(low) == F.col(high)).select(F.col(low).alias("x"), F.col(low).alias("to")).distinct()
    while n := rest.count():
        ends = rest.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
            rest.select(F.col("b").alias("x"), F.col("a").alias("y")))
        first = ends.groupBy("x").agg(F.min(rank("y")).alias("y"))
        moves.append(dealt(first.select("x", F.least("y", rank("x"))["v"].alias("to")), n))
        to_a, to_b = (moves[-1].select(F.col("x").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        rest = dealt(undirected(rest.join(to_a, "a").join(to_b, "b"), "to_a", "to_b"), n)
    if not moves:
        return alone.select(F.col("x").alias("v"), F.col("to").alias("label"))
    out = moves.pop()
    while moves:
        later = out.select(F.col("x").alias("to"), F.col("to").alias("end"))
        own = moves.pop()
        out = dealt(own.join(later, "to", "left").select("x", F.coalesce("end", "to").alias("to")), own.count())
    out = out.unionByName(alone.join(out, "x", "left_anti"))
    return (out.join(out.groupBy("to").agg(F.min("x").alias("label")), "to")
            .select(F.col("x").alias("v"), "label"))
