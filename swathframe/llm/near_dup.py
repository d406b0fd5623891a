"""MinHash near-duplicate removal with fast similarity sketches, banding and exact verification.

A sketch has one coordinate per bin.  In each round every element is hashed to
a bin; after as many rounds as bins, round i fills bin i, so every coordinate
fills, and the share of equal coordinates concentrates around the Jaccard
similarity as if the coordinates were independent.  Documents that agree in a
band become candidates, candidates are gathered in components, and inside a
component the full shingle sets decide every pair.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.llm.common import components, dealt, gram_hashes, mix, signed, word_hashes

SHINGLE, PERCENT = 5, 85
#: A pair at 0.85 misses all bands with probability (1 - 0.85 ** 6) ** 36 < 5e-8, one at 0.8 with about 2e-5.
BANDS, ROWS = 36, 6
#: Shingles of a block of candidates: 32 MB of hashes.
BLOCK_SHINGLES = 4 << 20
_U = np.uint64


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles; of the whole sequence if it is shorter; empty without words."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    return np.unique(gram_hashes(w, min(SHINGLE, len(w)))) if len(w) else np.zeros(0, _U)


@cache
def _seeds(rounds: int) -> np.ndarray:
    return mix(np.arange(1, rounds + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def sketch(items: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes; a coordinate holds its round and hash."""
    out, filled = np.full(bins, ~_U(0)), False
    seeds, done = _seeds(2 * bins), 0
    low = _U((1 << 50) - 1)
    while done < 2 * bins and not filled:
        n = min(max(1, 4096 // len(items)), (bins if done < bins else 2 * bins) - done)
        h = mix(items[None, :] ^ seeds[done:done + n, None])
        rounds = np.arange(done, done + n, dtype=_U)[:, None]
        at = (h % _U(bins)).astype(np.int64) if done < bins else np.broadcast_to((rounds - _U(bins)).astype(np.int64), h.shape)
        np.minimum.at(out, at.ravel(), ((rounds << _U(50)) | ((h >> _U(9)) & low)).ravel())
        done += n
        filled = not (out == ~_U(0)).any()
    return out


def band_hashes(coordinates: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per band; the band's number is part of it."""
    rows = coordinates.reshape(bands, -1)
    h = mix(np.arange(1, bands + 1, dtype=_U))
    for k in range(rows.shape[1]):
        h = mix(h ^ rows[:, k]) + _U(k)
    return h


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, key, bands): ``key`` is a digest of the whole set, null without words or without id."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                ids = batch.column(0).slice(lo, 2000)
                sizes, keys, bands = [], [], []
                for doc, text in zip(ids.to_pylist(), batch.column(1).slice(lo, 2000).to_pylist()):
                    s = shingle_set(text)
                    sizes.append(len(s))
                    linked = len(s) and doc is not None
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if linked else None)
                    bands.append(signed(band_hashes(sketch(s))) if linked else None)
                yield pa.record_batch([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                                       pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "key", "bands"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, key binary, bands array<long>")


def link_pairs(sets: list[np.ndarray], first: int, percent: int = PERCENT, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Linked pairs (i, j), i < j, of a bounded block; pairs with both or none of them before ``first`` are wanted
    only if ``first`` is 0 (one block), else exactly the pairs across.  Pairs with equal ``known`` are left out.

    Every shingle's list of documents is walked for each document that has it,
    so only pairs that share something cost anything.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    held = owner[order]
    begin = np.searchsorted(shingle[order], np.arange(shingle.max() + 2))
    ends, out = np.cumsum(sizes), []
    for i in range(len(sets) if not first else first):
        if known is not None and (known[max(i + 1, first):] == known[i]).all():
            continue
        own = shingle[ends[i] - sizes[i]:ends[i]]
        lo, n = begin[own], begin[own + 1] - begin[own]
        flat = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(held[flat], minlength=len(sets))
        linked = 100 * shared >= percent * (sizes[i] + sizes - shared)
        linked[:max(i + 1, first)] = False
        if known is not None:
            linked &= known != known[i]
        out += [(i, int(j)) for j in np.flatnonzero(linked)]
    return out


def spanning(pairs, n: int) -> np.ndarray:
    """For each of ``n`` items the least item it is connected to by ``pairs``."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def _verify(batches, percent: int):
    """(a, b): least root and other root of each set of roots that (component, block, block) links.

    The rows of one come together and are bounded; what is known to be
    connected has one root already, so at most as many links as roots return.
    """
    expand = zstandard.ZstdDecompressor()

    def solve(roots, sides, texts):
        if len(set(roots)) == 1:
            return []
        order = sorted(range(len(roots)), key=lambda k: sides[k])
        sets = [shingle_set(expand.decompress(texts[k]).decode("utf-8", "surrogatepass")) for k in order]
        first = sum(s == 0 for s in sides) if 1 in sides else 0
        names, known = np.unique([roots[k] for k in order], return_inverse=True)
        pairs = link_pairs(sets, first, percent, known)
        to = spanning([(int(known[i]), int(known[j])) for i, j in pairs], len(names))
        return [(int(names[r]), int(names[k])) for k, r in enumerate(to) if r != k]

    key, own, out = None, ([], [], []), []
    for batch in batches:
        for c, i, j, side, root, text in zip(*(x.to_pylist() for x in batch.columns)):
            if (c, i, j) != key:
                if len(own[0]) > 1:
                    out += solve(*own)
                key, own = (c, i, j), ([], [], [])
            own[0].append(root), own[1].append(side), own[2].append(text)
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
            out = []
    if len(own[0]) > 1 and (out := solve(*own)):
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])


def _compress(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(
            [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.binary())],
            names=["doc", "packed"])


def _candidates(reps: DataFrame, n: int) -> DataFrame:
    """(v, label): documents that agree in a band with another one, by component.

    A document's buckets are known by their least members.  The document joins
    the least of these, and only the distinct pairs of bucket leasts are a
    graph, which hardly grows with the copies in a bucket.
    """
    buckets = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = dealt(buckets.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
                   .filter("a < z").select("bucket", "a"), n)
    near = dealt(buckets.join(shared, "bucket").groupBy("doc_id")
                 .agg(F.min("a").alias("m"), F.collect_set("a").alias("all")), n)  # one for each band at most
    graph = components(near.select(F.col("m").alias("a"), F.explode("all").alias("b")).filter("a < b").distinct())
    return (near.join(graph, near.m == graph.v, "left")
            .select(F.col("doc_id").alias("v"), F.coalesce("label", "m").alias("label")))


def _blocks(groups: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(doc, label, blocks, block, root): every member's block, bounded in documents and in shingles."""
    size = rows.filter("key is not null").groupBy(F.col("doc_id").alias("v")).agg(F.sum("n_shingles").alias("s"))
    sizes = groups.join(size, "v").groupBy("label").agg(F.count("*").alias("n"), F.sum("s").alias("s"))
    block = F.greatest(F.lit(64.0), F.least(F.lit(4096.0), F.col("n") / 64))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.least("n", F.col("s") / BLOCK_SHINGLES))).cast("int")
    return (groups.join(dealt(sizes.select("label", blocks.alias("blocks")), n), "label")
            .select(F.col("v").alias("doc"), "label", "blocks",
                    F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), F.col("v").alias("root")))


def verified_links(members: DataFrame, packed: DataFrame, percent: int, n: int):
    """Yields (a, b) of every level of verification, links between the roots known so far, and at last (doc, root).

    Level 0 compares each block alone; level k the two halves of each run of
    2 ** k blocks, block pair by block pair.  Every pair of documents without a
    common root meets once.  Groups with one root left are done.
    """
    def compare(rows):
        return dealt(rows.select("label", "i", "j", "side", "root", "packed").repartition("label", "i", "j")
                     .sortWithinPartitions("label", "i", "j").mapInArrow(lambda b: _verify(b, percent), "a long, b long"), n)

    alone = members.join(packed, "doc").select("*", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"))
    links = compare(alone)
    yield links
    level = 0
    while True:
        to = links.select(F.col("b").alias("root"), F.col("a").alias("to")) if not level else (
            components(links).select(F.col("v").alias("root"), F.col("label").alias("to")))
        members = dealt(members.join(to, "root", "left")
                        .select("doc", "label", "blocks", "block", F.coalesce("to", "root").alias("root")), n)
        level, half = level + 1, 1 << level
        open_ = dealt(members.groupBy("label").agg(F.max("blocks").alias("most"), F.min("root").alias("x"), F.max("root").alias("y"))
                      .filter((F.col("x") < F.col("y")) & (F.col("most") > half)).select("label"), n)
        if open_.isEmpty():
            break
        side = F.shiftrightunsigned("block", level - 1).bitwiseAND(F.lit(1))
        begin = F.shiftleft(F.shiftrightunsigned("block", level), level) + F.when(side == 0, half).otherwise(0)
        end = F.least(begin + half, F.col("blocks")) - 1  # of the half across
        across = (members.join(open_, "label").filter(begin <= end).withColumn("side", side)
                  .withColumn("other", F.explode(F.sequence(begin, end))))
        links = compare(across.join(packed, "doc").select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
        yield links
    yield members.select("doc", "root")


def link_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents whose shingle sets have a Jaccard similarity of at least
    ``percent`` in a hundred are linked; the bands are made for 80 and more.

    Equal sets are one class, represented by its least id; only representatives
    are sketched into buckets.  Candidates form components; a component is cut
    into blocks, and pairs of blocks are compared on full sets, level by level.
    Blocks hold 64 to 4096 documents (more as the component grows) and a
    bounded number of shingles, so a task holds two bounded blocks and a large
    group spreads over many tasks.  A level returns links between the roots of
    what is connected so far, so the links of all levels grow with the
    documents of a group, not with its block pairs.

    Null and empty texts have an empty set and are linked with nothing; so are
    rows without id (component null, kept).  Rows that share an id are one
    vertex and stay or go together.  Other columns are left out.
    """
    rows = dealt(describe(docs))
    n = rows.count()
    classes = dealt(rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep")), n)
    reps = dealt(rows.join(classes, (rows.key == classes.key) & (rows.doc_id == classes.rep))
                 .select("doc_id", "bands"), n, 4_000)
    members = dealt(_blocks(_candidates(reps, n), rows, n), n)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_compress, "doc long, packed binary")
    packed = dealt(members.select("doc").join(texts, "doc"), n, 4_000)
    for found in verified_links(members, packed, percent, n):
        pass
    by_class = dealt(classes.join(found, classes.rep == found.doc, "left")
                     .select("key", F.coalesce("root", "rep").alias("component")), n)
    component = F.coalesce("component", "doc_id")
    return (rows.select("doc_id", "n_shingles", "key").join(by_class, "key", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents whose group has a smaller id, all columns as they are, whatever their names.

    Rows with null or empty text or without id stay; of repeated rows (one id)
    all stay or all go; an empty table stays empty.
    """
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = link_documents(docs, percent).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs.doc_id.cast("long") == F.col(name), "left_anti")
