"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from swathframe.llm import importance

SCHEMA = "doc_id long, text string, row long, n_words string, part int, at string, before int, bucket string"
CLASH = (1, "x", 2, "y", 3, "z")


def test_checksums_equal_zlib():
    rng = random.Random(4)
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(200_000)), np.uint8)
    start = np.array([0, 5, 10, 100, 64, 0, 1, 7, 3] + [rng.randrange(100_000) for _ in range(200)])
    end = start + np.array([1, 64, 65, 4900, 128, 63, 200, 199_993, 150_000] + [rng.randrange(1, 3000) for _ in range(200)])
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]
    assert importance.span_crc32(data, start, end).tolist() == want
    assert len(importance.span_crc32(data, start[:0], end[:0])) == 0


def _words(text):
    folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def _plain(rows, target, longest, buckets, percent, least):
    def own(text):
        w = _words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in rows:
        np.add.at(s, own(text), 1)
    for text in target:
        np.add.at(t, own(text), 1)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + buckets) / ((int(a) + 1) * (int(t.sum()) + buckets))))
            for a, b in zip(s, t)]
    out = []
    for doc, text in rows:
        f = own(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None])
    able = [k for k, (doc, text) in enumerate(rows) if doc is not None and len(_words(text)) >= least]
    for rank, k in enumerate(sorted(able, key=lambda k: (-out[k][3], out[k][0]))[:percent * len(able) // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 60), (2, 100)])
def test_equals_plain_python(spark, longest, percent):
    rng = random.Random(longest)
    vocabulary = ["sun", "Moon", "l'été", "日本", "x9", "data-set", "ÜBER"] + [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for k in range(250)]
    rows += [(7, rows[7][1])] * 40 + [(None, rows[8][1]), (900, None), (901, ""), (902, "..."), (903, "w1 " * 60_000), (904, "q" * 90_000)]
    target = [" ".join(rng.choice(vocabulary[:9]) for _ in range(50)) for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(5)
    got = importance.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, gain int"), longest, 500, percent, 20)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _plain(rows, target, longest, 500, percent, 20)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert importance.resample(docs, docs).collect() == []
    one = spark.createDataFrame([(1, "a b", *CLASH)], SCHEMA)
    assert [r["rank"] for r in importance.resample(one, docs).collect()] == [None]
