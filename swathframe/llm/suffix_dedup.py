"""Repeated passages by sparse suffix arrays.

Only suffixes at content-selected places (minimisers of eight-word grams) are
kept, so two copies of a passage keep the same suffixes.  Suffixes with equal
first ``KEY`` words are sorted across all tasks in two orders: by the words that
follow, and by the words before, backwards.  Each is compared with its
neighbours in both, and the match is extended word by word to the left and to
the right.

Any repeat of at least ``LENGTH`` words holds a kept suffix in its first
``LENGTH - KEY + 1`` words.  Of all suffixes with the same ``KEY`` words a
neighbour in the first order shares the most words to the right, one in the
second the most to the left, so both together cover every word of the repeat;
nothing shorter than ``KEY`` words is reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathframe.llm.common import dealt, gram_hashes, minimisers, signed, slices, word_hashes, words
from swathframe.llm.substring_dedup import packed, runs, text_key

#: Words of a repeat that is surely found; words of a suffix that it is sorted by; words of a gram.
LENGTH, KEY, GRAM = 50, 29, 8
#: Words beyond the first ``KEY``, and before them, that suffixes are ordered by: no window of ``LENGTH`` has more.
BEYOND = LENGTH - KEY
#: Words on both sides of a match that its text carries: a longer extension meets a further kept suffix.
MARGIN = LENGTH + KEY


def kept_suffixes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept suffixes of a text and the hash of the ``KEY`` words from there."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    at = np.unique(minimisers(gram_hashes(w, GRAM), LENGTH - KEY + 1))
    at = at[at + KEY <= len(w)]
    return signed(gram_hashes(w, KEY)[at]), at


def _orders(batches):
    """Each suffix for both orders: the hashes of the words after its first ``KEY``, and of those before it, backwards."""
    expand = zstandard.ZstdDecompressor()
    for batch in slices(batches):
        for tid, text, found in zip(*(c.to_pylist() for c in batch.columns)):
            w = word_hashes(expand.decompress(text))
            for lo in range(0, len(found), 5000):
                part = found[lo:lo + 5000]
                h, at = np.array([x["h"] for x in part], np.int64), [x["at"] for x in part]
                near = [w[k + KEY:k + KEY + BEYOND].tobytes() for k in at] + [w[max(0, k - BEYOND):k][::-1].tobytes() for k in at]
                yield pa.record_batch([pa.array(np.concatenate([h, ~h])), pa.array(near, pa.binary()),
                                       pa.array([tid] * (2 * len(at)), pa.int64()), pa.array(at + at, pa.int32())],
                                      names=["h", "near", "tid", "at"])


def _identify(batches):
    for batch in slices(batches):
        texts = batch.column(1).to_pylist()
        yield pa.record_batch([batch.column(0), pa.array(map(text_key, texts), pa.binary()),
                               pa.array([len(words(t)) for t in texts], pa.int64())], names=["doc_id", "key", "n_words"])


def _suffixes(batches):
    for batch in slices(batches):
        texts = batch.column(0).to_pylist()
        found = [kept_suffixes(t) for t in texts]
        yield pa.record_batch([pa.array(map(text_key, texts), pa.binary()),
                               pa.array([f[0] for f in found], pa.list_(pa.int64())),
                               pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=["key", "h", "at"])


def _neighbours(batches):
    """Each suffix beside the one before it, if their first words agree; the first and last one of the part for the seams."""
    last, first = None, None
    for batch in slices(batches):
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if last is None:
                first = row
            elif last[0] == row[0]:
                out += [(row[0], None, row[2], row[3], last[2], last[3], 0), (row[0], None, last[2], last[3], row[2], row[3], 0)]
            last = row
        if out:
            yield _beside(out)
    if first is not None:
        yield _beside([(*r, None, None, 1) for r in dict.fromkeys((first, last))])


_BESIDE = "h long, near binary, tid long, at int, other long, place int, seam int"


def _beside(rows):
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                           names=["h", "near", "tid", "at", "other", "place", "seam"])


def _extend(batches):
    """Extends each match of two texts word by word; a text's matched words as (first, last)."""
    expand = zstandard.ZstdDecompressor()
    for batch in slices(batches):
        out = []
        for tid, text, matches in zip(*(c.to_pylist() for c in batch.columns)):
            w = expand.decompress(text).split()
            found = []
            for m in matches:
                other, shift = m["words"].split(), m["start"]
                done = -1
                for at in sorted(m["at"]):
                    if at <= done:
                        continue  # inside the match before
                    a, b = at, at - m["diagonal"] - shift
                    if w[a:a + KEY] != other[b:b + KEY]:
                        continue  # equal hashes only
                    left = 0
                    while left < min(a, b) and w[a - left - 1] == other[b - left - 1]:
                        left += 1
                    right = KEY
                    while a + right < len(w) and b + right < len(other) and w[a + right] == other[b + right]:
                        right += 1
                    found.append((a - left, a + right))
                    done = a + right - KEY
            if found:
                mark = np.zeros(len(w), bool)
                for lo, hi in found:
                    mark[lo:hi] = True
                out.append((tid, int(mark.sum()), [{"start": a, "length": b - a + 1} for a, b in runs(mark)]))
        span = pa.struct([("start", pa.int32()), ("length", pa.int32())])
        yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                               pa.array([o[2] for o in out], pa.list_(span))], names=["tid", "n_repeated", "spans"])


def _pieces(batches):
    """The words of the other text that its matches need."""
    expand = zstandard.ZstdDecompressor()
    for batch in slices(batches):
        out = []
        for other, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            w = expand.decompress(text).split()
            for m in wanted:
                first = min(m["at"]) - m["diagonal"]
                last = max(m["at"]) - m["diagonal"] + KEY
                start = max(0, first - MARGIN)
                out.append((m["tid"], {"other": other, "diagonal": m["diagonal"], "at": m["at"], "start": start,
                                       "words": b" ".join(w[start:last + MARGIN])}))
        match = pa.struct([("other", pa.int64()), ("diagonal", pa.int32()), ("at", pa.list_(pa.int32())),
                           ("start", pa.int32()), ("words", pa.binary())])
        yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], match)],
                              names=["tid", "match"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_repeated, spans): one row for each row of ``docs`` with a repeated passage.

    ``spans`` are (start, length) in words.  Equal texts repeat each other whole
    if they have ``KEY`` words.  Null and short texts have no passage; rows
    without id count, and are returned, like others; columns beside id and text
    are left out.  Documents without a repeat do not appear.

    A suffix meets two neighbours in each order only, so what is gathered for a
    text is bounded by its length, also in a large group of copies; and the sort
    goes on by words, text and place, so a common passage spreads over many tasks.
    """
    own = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    rows = dealt(own.mapInArrow(_identify, "doc_id long, key binary, n_words long"))
    n = rows.count()
    names = dealt(rows.filter(F.col("n_words") >= KEY).groupBy("key")
                  .agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.max("n_words").alias("n"))
                  .withColumn("tid", F.monotonically_increasing_id()), n)
    suffixes = own.select("text").mapInArrow(_suffixes, "key binary, h array<long>, at array<int>").filter(F.size("h") > 0)
    each = suffixes.groupBy("key").agg(F.first("h").alias("h"), F.first("at").alias("at")).join(names.select("key", "tid"), "key")
    places = dealt(each.select("tid", F.explode(F.arrays_zip("h", "at")).alias("x")).select("x.h", "tid", "x.at"))
    shared = dealt(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    bodies = packed(own.select("text")).groupBy("_key").agg(F.first("text").alias("body"))
    bodies = dealt(bodies.join(names.select(F.col("key").alias("_key"), "tid"), "_key").select("tid", "body"))
    found = places.join(shared, "h").groupBy("tid").agg(F.collect_list(F.struct("h", "at")).alias("found"))  # of one text
    order = ["h", "near", "tid", "at"]
    candidates = dealt(bodies.join(found, "tid").select("tid", "body", "found")
                       .mapInArrow(_orders, "h long, near binary, tid long, at int"))
    beside = dealt(candidates.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, _BESIDE))
    # The seams between parts: two rows for each part, sorted together.
    seam = beside.filter("seam = 1").select(*order).coalesce(1).sortWithinPartitions(*order).mapInArrow(
        _neighbours, _BESIDE).filter("seam = 0")
    pairs = beside.filter("seam = 0").unionByName(seam).select("tid", "at", "other", "place")
    matches = pairs.groupBy("tid", "other", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("at").alias("at"))
    wanted = matches.groupBy("other").agg(F.collect_list(F.struct("tid", "diagonal", "at")).alias("wanted"))
    pieces = (wanted.join(bodies.withColumnRenamed("tid", "other"), "other").select("other", "body", "wanted")
              .mapInArrow(_pieces, T.StructType.fromDDL(
                  "tid long, match struct<other: long, diagonal: int, at: array<int>, start: int, words: binary>")))
    extended = (pieces.groupBy("tid").agg(F.collect_list("match").alias("matches")).join(bodies, "tid")
                .select("tid", "body", "matches").mapInArrow(_extend, T.StructType.fromDDL(
                    "tid long, n_repeated long, spans array<struct<start: int, length: int>>")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("length")))
    copied = F.col("copies") > 1
    result = dealt(names.join(extended, "tid", "left").filter(copied | F.col("n_repeated").isNotNull())
                   .select("key", F.when(copied, F.col("n")).otherwise(F.col("n_repeated")).alias("n_repeated"),
                           F.when(copied, whole).otherwise(F.col("spans")).alias("spans")), n)
    return rows.join(result, "key").select("doc_id", "n_words", "n_repeated", "spans")
