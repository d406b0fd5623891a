"""Resampling of documents toward a target text by hashed word features.

A feature's bucket comes from its CRC-32.  The sum is affine: a byte adds a
value that depends on itself and on its distance from the end only, and the
length adds a constant.  So the checksums of all features of many texts are
one table lookup for all bytes and one XOR over each feature's span; a span
longer than the table is cut into blocks, and each block's value is moved on
over the bytes behind it.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.llm.common import dealt, slices

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes that the position table reaches back from a span's end; lengths with a ready constant; blocks taken at a time.
SPAN, LENGTHS, BLOCKS = 64, 1024, 1 << 14
_U = np.uint32
_ONES = _U(0xFFFFFFFF)
_CHUNK = 1 << 20


# --- checksums ----------------------------------------------------------------------------------------------------

@cache
def _step() -> np.ndarray:
    """The checksum register after one byte, from zero."""
    c = np.arange(256, dtype=_U)
    for _ in range(8):
        c = np.where(c & _U(1), (c >> _U(1)) ^ _U(POLYNOMIAL), c >> _U(1))
    return c


@cache
def _position_table() -> np.ndarray:
    """What a byte adds, by its distance from the end and its value."""
    rows = [_step()]
    for _ in range(SPAN - 1):
        rows.append((rows[-1] >> _U(8)) ^ _step()[rows[-1] & _U(255)])
    return np.concatenate(rows)


@cache
def _mover(power: int) -> np.ndarray:
    """Four tables, one for each byte of a register, that move it on over 2 ** power zero bytes."""
    if power == 0:
        byte = np.arange(256, dtype=_U)
        return np.stack([_step(), byte, byte << _U(8), byte << _U(16)])
    return _moved(_mover(power - 1), _mover(power - 1))


def _moved(by: np.ndarray, register: np.ndarray) -> np.ndarray:
    return (by[0][register & _U(255)] ^ by[1][(register >> _U(8)) & _U(255)]
            ^ by[2][(register >> _U(16)) & _U(255)] ^ by[3][register >> _U(24)])


def _move(register: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each register moved on over its own number of zero bytes."""
    out = register.copy()
    for power in range(int(zeros.max(initial=0)).bit_length()):
        at = np.flatnonzero((zeros >> power) & 1)
        out[at] = _moved(_mover(power), out[at])
    return out


@cache
def _short_lengths() -> np.ndarray:
    return _move(np.full(LENGTHS, _ONES), np.arange(LENGTHS)) ^ _ONES


def length_constants(size: np.ndarray) -> np.ndarray:
    """The checksum of as many zero bytes."""
    if size.max(initial=0) < LENGTHS:
        return _short_lengths()[size]
    own, inverse = np.unique(size, return_inverse=True)
    return (_move(np.full(len(own), _ONES), own) ^ _ONES)[inverse]


def span_crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each non-empty span of ``data`` (bytes); spans may overlap."""
    if not len(start):
        return np.zeros(0, _U)
    blocks = -(-(end - start) // SPAN)
    owner = np.repeat(np.arange(len(start)), blocks)
    behind = np.cumsum(blocks)[owner] - 1 - np.arange(len(owner))  # blocks between this one and the span's end
    high = end[owner] - behind * SPAN
    low = np.maximum(high - SPAN, start[owner])
    table, part = _position_table(), np.empty(len(owner), _U)
    for lo in range(0, len(owner), BLOCKS):  # bounds the memory
        h, size = high[lo:lo + BLOCKS], (high - low)[lo:lo + BLOCKS]
        first = np.cumsum(size) - size
        back = np.repeat(first + size - 1, size) - np.arange(int(size.sum()))
        at = np.repeat(h - 1, size) - back
        part[lo:lo + BLOCKS] = np.bitwise_xor.reduceat(table[back * 256 + data[at]], first)
    return (np.bitwise_xor.reduceat(_move(part, behind * SPAN), np.cumsum(blocks) - blocks)
            ^ length_constants(end - start))


# --- features -----------------------------------------------------------------------------------------------------

#: Bytes of a word: digits, lower-case ASCII letters, and all of characters beyond ASCII.
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b > 127 for b in range(256)])


def features(texts: list[str | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text, words of each text), features of one length after the other."""
    folded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(folded), np.uint8)
    edge = np.flatnonzero(np.diff(_WORD[data], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    text_start = np.cumsum([0, *(len(t) + 1 for t in folded)])
    text = np.searchsorted(text_start, start, side="right") - 1
    words = np.bincount(text, minlength=len(texts))
    if longest > 1:  # the words alone, a space after each
        size = end - start
        begin = np.cumsum(size + 1) - size - 1
        flat = np.full(int((size + 1).sum()), 32, np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(begin, size) + inner] = data[np.repeat(start, size) + inner]
        data, start, end = flat, begin, begin + size
    bucket, owner = [], []
    for n in range(1, longest + 1):
        at = np.flatnonzero(text[:len(text) - n + 1] == text[n - 1:]) if len(text) >= n else np.zeros(0, np.int64)
        bucket.append(span_crc32(data, start[at], end[at + n - 1]) % _U(buckets))
        owner.append(text[at])
    return np.concatenate(bucket).astype(np.int64), np.concatenate(owner), words


def _groups(texts: list[str | None]):
    """(first, texts) of consecutive texts of about ``_CHUNK`` characters."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size > _CHUNK:
            yield lo, texts[lo:k + 1]
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def count_buckets(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; tasks add up first, so ``buckets`` rows at most reach the driver."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for _, texts in _groups(batch.column(0).to_pylist()):
                total += np.bincount(features(texts, longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier a bucket is in the target, smoothed by one and floored."""
    whole, wanted, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (whole + k) / ((s + 1) * (wanted + k))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def luck(doc_id: int, seed: int) -> int:
    """A document's own Gumbel draw in thousandths, from a hash of its id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


# --- resampling ---------------------------------------------------------------------------------------------------

def score_documents(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score), one row for each of ``docs``; ``row`` numbers them."""
    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            for lo, texts in _groups(batch.column(1).to_pylist()):
                bucket, owner, words = features(texts, longest, len(gain))
                n = np.bincount(owner, minlength=len(texts))
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, owner, gain[bucket])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = batch.column(0).slice(lo, len(texts))
                score = [None if d is None else int(w) + luck(d, seed) for d, w in zip(ids.to_pylist(), weight)]
                yield pa.record_batch([pa.array(row + np.arange(len(texts))), ids, pa.array(words.astype(np.int64)),
                                       pa.array(n.astype(np.int64)), pa.array(weight), pa.array(score, pa.int64())],
                                      names=["row", "doc_id", "n_words", "n_features", "weight", "score"])
                row += len(texts)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "row long, doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10,
             least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for each row of ``docs``; ``rank`` is null where not drawn.

    ``target`` holds the texts to come close to.  Drawn are the highest scores
    among documents of ``least_words`` or more, ``percent`` in a hundred of
    these, ties to the smaller id.

    Null and empty texts have no feature and weight 0; an empty target gives
    gains from the counts of ``docs`` alone.  Rows without id have no score and
    are neither counted nor drawn.  Repeated rows score alike and are ranked
    one after the other.  Other columns are left out; an empty table gives no
    rows.  Scores are whole thousandths of logs, so their histogram has some
    hundred thousand values at most at any size of input; it tells the least
    score that can be drawn, and only rows from there on are sorted, by ranges.
    """
    gain = gains(count_buckets(docs, longest, buckets), count_buckets(target, longest, buckets))
    scored = dealt(score_documents(docs, gain, longest, seed))
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    steps = sorted(scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["score"])
    drawn = percent * sum(r["n"] for r in steps) // 100
    above, least = 0, None
    for r in steps:
        if above >= drawn:
            break
        above, least = above + r["n"], r["score"]
    out = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    high = able & (F.col("score") >= least)
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(at + np.arange(n))],
                                  names=[*out, "part", "at"])
            at += n

    placed = dealt(scored.filter(high).repartitionByRange(*order).sortWithinPartitions(*order).select(*out)
                   .mapInArrow(number, "doc_id long, n_features long, weight long, score long, part long, at long"))
    before, offsets = 0, []
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"]):
        offsets.append((r["part"], before))  # one for each task
        before += r["n"]
    rank = F.col("before") + F.col("at") + 1
    ranked = (placed.join(F.broadcast(docs.sparkSession.createDataFrame(offsets, "part long, before long")), "part")
              .select(*out, F.when(rank <= drawn, rank).alias("rank")))
    rest = scored.filter(~F.coalesce(high, F.lit(False))).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)
