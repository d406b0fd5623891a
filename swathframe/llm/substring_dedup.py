"""Substring removal with suffix automata of reference shards and matching statistics.

A window is a run of ``WINDOW`` words.  Its anchor is the least of the
eight-word grams inside it, so equal windows have equal anchors.  The first
place of a repeated anchor is its reference; all others are streamed past it.

* A shard is a block of one text's reference windows.  Its suffix automaton is
  built where it is needed and goes to as many tasks as its stream requires;
  broadcasting all shards to all tasks would cost shards times documents.
* A streamed window that the matching statistics find in the shard is repeated,
  and so is the reference window it equals.
* A streamed window that is not in its shard may still equal another streamed
  one; such windows are counted by digest.

An occurrence is either reference or streamed, so nothing matches itself, and
every pair of equal windows is met in one of the last two steps.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathframe.llm.common import dealt, gram_hashes, minimisers, signed, slices, word_hashes

WINDOW, GRAM = 35, 8
#: Reference windows in a shard, and streamed anchors that one copy of a shard serves.
SHARD, STREAM = 16_384, 64
_PIECE = "shard long, block int, salt int, kind int, tid long, start int, text binary"
_FOUND = "tid long, s int, e int, digest binary"


def text_key(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()


def anchors(text: str | None, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes with the first and last window start of each, in order of place."""
    g = gram_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass")), GRAM)
    at = minimisers(g, window - GRAM + 1)
    if not len(at):
        return signed(g[:0]), at, at
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return signed(g[at[lo]]), lo, np.append(lo[1:], len(at)) - 1


class SuffixAutomaton:
    """Suffix automaton of a sequence of words; each state knows where its strings first end."""

    def __init__(self, sequence):
        self.next, self.link, self.length, self.end = [{}], [-1], [0], [-1]
        last = 0
        nxt, link, length, end = self.next, self.link, self.length, self.end
        for at, w in enumerate(sequence):
            new = len(nxt)
            nxt.append({}), link.append(0), length.append(length[last] + 1), end.append(at)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1), end.append(end[q])
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def statistics(self, sequence) -> tuple[list[int], list[int]]:
        """For each place the length of the longest match that ends there, and where that match first ends."""
        nxt, link, length, end = self.next, self.link, self.length, self.end
        v = n = 0
        lengths, ends = [], []
        for w in sequence:
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(w)
            if to is not None:
                v, n = to, n + 1
            lengths.append(n), ends.append(end[v])
        return lengths, ends


def runs(flags) -> list[tuple[int, int]]:
    """First and last place of each run of true values."""
    f = np.concatenate([[False], flags, [False]]).astype(np.int8)
    edge = np.flatnonzero(np.diff(f))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _describe(batches):
    for batch in slices(batches):
        keys, found = [], []
        for text in batch.column(0).to_pylist():
            keys.append(text_key(text))
            found.append(anchors(text))
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array([f[0] for f in found], pa.list_(pa.int64())),
                               pa.array([f[1] for f in found], pa.list_(pa.int32())),
                               pa.array([f[2] for f in found], pa.list_(pa.int32()))], names=["key", "h", "lo", "hi"])


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with the text compressed in place, and its key as last column; this is what a shuffle carries."""
    names = docs.columns
    at = names.index("text")
    fields = [T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in docs.schema]

    def run(batches):
        small = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else small.compress(t.encode("utf-8", "surrogatepass"))
                                    for t in texts], pa.binary())
            yield pa.record_batch([*columns, pa.array(map(text_key, texts), pa.binary())],
                                  names=[*names, "_key"])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("_key", T.BinaryType())]))


def _cut(batches, window: int = WINDOW):
    """A text's windows with repeated anchors, as pieces for the shards of their references."""
    expand = zstandard.ZstdDecompressor()
    for batch in slices(batches):
        out = []
        for tid, text, wants in zip(*(c.to_pylist() for c in batch.columns)):
            w = expand.decompress(text).split()
            groups, own = [], {}
            for x in sorted(wants, key=lambda x: x["lo"]):
                kind = int(not (x["shard"] == tid and x["at"] == x["lo"]))
                place = (x["shard"], x["at"] // SHARD, kind)
                if groups and groups[-1][0] == place and groups[-1][2] + 1 == x["lo"]:
                    groups[-1][2:] = x["hi"], max(groups[-1][3], x["n"])
                else:
                    groups.append([place, x["lo"], x["hi"], x["n"]])
                if not kind:
                    own[place] = max(own.get(place, 0), x["n"])
            for place, lo, hi, n in groups:
                piece = b" ".join(w[lo:hi + window])
                if place[2]:
                    out.append((*place[:2], tid % -(-n // STREAM), 1, tid, lo, piece))
                else:
                    out += [(*place[:2], salt, 0, tid, lo, piece) for salt in range(-(-own[place] // STREAM))]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)],
                              names=[x.split()[0] for x in _PIECE.split(", ")])


class _Shard:
    """Automaton over the reference pieces of one shard, and which of their windows were met."""

    def __init__(self, window: int):
        self.window, self.words, self.first, self.pieces, self.automaton = window, [], [], [], None

    def add(self, tid: int, start: int, w: list[bytes]):
        self.first.append(len(self.words))
        self.pieces.append((tid, start, bytearray(len(w) - self.window + 1)))
        self.words += w
        self.words.append(len(self.words))  # a separator that no text holds

    def stream(self, tid: int, start: int, w: list[bytes]):
        if self.automaton is None:
            self.automaton = SuffixAutomaton(self.words)
        size = self.window
        lengths, ends = self.automaton.statistics(w)
        met = [n >= size for n in lengths[size - 1:]]
        for hit, end in zip(met, ends[size - 1:]):
            if hit:
                begin = end - size + 1
                k = bisect_right(self.first, begin) - 1
                self.pieces[k][2][begin - self.first[k]] = 1
        yield from ((tid, start + s, start + e, None) for s, e in runs(met))
        for s, hit in enumerate(met):
            if not hit:
                digest = hashlib.blake2b(b" ".join(w[s:s + size]), digest_size=16).digest()
                yield tid, start + s, start + s, digest

    def references(self):
        for tid, start, met in self.pieces:
            yield from ((tid, start + s, start + e, None) for s, e in runs(np.frombuffer(met, np.uint8)))


def _match(batches, window: int = WINDOW):
    """Rows come sorted by (shard, block, salt), references first: one shard in memory, its stream row by row."""
    key, shard, out = None, None, []

    def flush():
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["tid", "s", "e", "digest"])

    for batch in batches:
        for a, b, c, kind, tid, start, text in zip(*(x.to_pylist() for x in batch.columns)):
            if (a, b, c) != key:
                if shard:
                    out.extend(shard.references())
                key, shard = (a, b, c), _Shard(window)
            (out.extend(shard.stream(tid, start, text.split())) if kind else shard.add(tid, start, text.split()))
            if len(out) > 20_000:
                yield flush()
                out = []
    if shard:
        out.extend(shard.references())
    if out:
        yield flush()


def find_repeats(docs: DataFrame) -> DataFrame:
    """(key, copies, spans): for each distinct text with a repeated window, its repeated window starts as (s, e) runs.

    ``copies`` counts the rows with that text; with two or more every window of
    the text is repeated and ``spans`` may be null.
    """
    seen = docs.select("text").mapInArrow(_describe, "key binary, h array<long>, lo array<int>, hi array<int>")
    texts = dealt(seen.filter(F.size("h") > 0).groupBy("key")
                  .agg(F.count("*").alias("copies"), F.first("h").alias("h"), F.first("lo").alias("lo"),
                       F.first("hi").alias("hi")).withColumn("tid", F.monotonically_increasing_id()))
    places = (texts.select("tid", F.explode(F.arrays_zip("h", "lo", "hi")).alias("x")).select("tid", "x.h", "x.lo", "x.hi"))
    repeated = dealt(places.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("tid", "lo")).alias("first"))
                     .filter("n > 1").select("h", "n", F.col("first.tid").alias("shard"), F.col("first.lo").alias("at")))
    wants = (places.join(repeated, "h").groupBy("tid")
             .agg(F.collect_list(F.struct("lo", "hi", "n", "shard", "at")).alias("wants")))
    keyed = wants.join(texts.select("tid", "key"), "tid")
    bodies = packed(docs.select("text")).groupBy("_key").agg(F.first("text").alias("text"))
    pieces = keyed.join(bodies, F.col("key") == F.col("_key")).select("tid", "text", "wants").mapInArrow(_cut, _PIECE)
    found = dealt(pieces.repartition("shard", "block", "salt").sortWithinPartitions("shard", "block", "salt", "kind")
                  .mapInArrow(_match, _FOUND))
    rest = found.filter("digest is not null")
    again = dealt(rest.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"))
    marks = (found.filter("digest is null").select("tid", "s", "e")
             .unionByName(rest.join(again, "digest").select("tid", "s", "e")).distinct()
             .groupBy("tid").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    return (texts.select("tid", "key", "copies").join(marks, "tid", "left").filter("copies > 1 or spans is not null")
            .select("key", "copies", "spans"))


def cut_words(w: list[bytes], copies: int | None, spans, window: int = WINDOW) -> list[bytes]:
    """The words that no repeated window covers."""
    if copies is None or len(w) < window:
        return w
    if copies > 1:
        return []
    covered = np.zeros(len(w) + 1, np.int32)
    for x in spans:
        covered[x["s"]] += 1
        covered[min(x["e"] + window, len(w))] -= 1
    return [x for x, c in zip(w, np.cumsum(covered[:-1])) if not c]


def _with_repeats(docs: DataFrame) -> DataFrame:
    repeats = dealt(find_repeats(docs))
    return packed(docs).join(repeats, F.col("_key") == F.col("key"), "left").drop("key", "_key")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each row of ``docs``.

    Null and empty texts have no words; texts shorter than a window lose none.
    Rows with equal texts lose every word (if there are enough for a window),
    also under one id or none.  Other columns are left out.
    """
    def run(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            out = []
            for text, copies, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                w = expand.decompress(text).split() if text else []
                kept = cut_words(w, copies, spans)
                out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, types))],
                                  names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = _with_repeats(docs.selectExpr("cast(doc_id as long) doc_id", "text"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: str = "n_chars") -> DataFrame:
    """``docs`` with repeated words cut from the text; a text that loses nothing stays as it is.

    What is left is joined by single blanks; a column ``length``, if there is
    one, counts the characters of the new text.  No row goes.
    """
    names = docs.columns
    at, n_at = names.index("text"), names.index(length) if length in names else None
    own = docs.toDF(*("text" if k == at else f"c{k}" for k in range(len(names))))  # no clash with names used here

    def run(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            columns, texts, sizes = list(batch.columns[:len(names)]), [], []
            for text, copies, spans in zip(*(batch.column(k).to_pylist() for k in (at, len(names), len(names) + 1))):
                data = None if text is None else expand.decompress(text)
                w = (data or b"").split()
                kept = cut_words(w, copies, spans)
                if len(kept) < len(w):
                    data = b" ".join(kept)
                texts.append(None if data is None else data.decode("utf-8", "surrogatepass"))
                sizes.append(len(texts[-1] or "") if len(kept) < len(w) else None)
            columns[at] = pa.array(texts, pa.string())
            if n_at is not None:
                old = columns[n_at].to_pylist()
                columns[n_at] = pa.array([o if s is None else s for o, s in zip(old, sizes)], columns[n_at].type)
            yield pa.record_batch(columns, names=names)

    return _with_repeats(own).select(*own.columns, "copies", "spans").mapInArrow(run, docs.schema)
