"""The stages of the pipeline against brute force on what the stage before kept."""

import collections
import random

import corpus_pipeline

from tests.llm.test_operators import repeated_windows, split


def linked(rows, percent):
    """Least id that each document reaches over pairs of at least ``percent`` similarity, all pairs compared."""
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            shared = len(s & t)
            if shared and 100 * shared >= percent * (len(s) + len(t) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def between(rng, low, high):
    """Two texts whose similarity in percent is in [low, high)."""
    while True:
        a = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(200)]
        b = list(a)
        for k in rng.sample(range(200), rng.randint(1, 8)):
            b[k] = f"c{rng.random()}"
        s, t = ({tuple(w[k:k + 5]) for k in range(196)} for w in (a, b))
        if low * len(s | t) <= 100 * len(s & t) < high * len(s | t):
            return " ".join(a), " ".join(b)


def test_near_duplicates_from_80_percent(spark):
    rng = random.Random(8)
    pairs = [between(rng, 80, 85) for _ in range(20)] + [between(rng, 85, 101) for _ in range(5)] + [between(rng, 70, 80) for _ in range(10)]
    rows = [(10 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = {r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {d for d, c in linked(rows, 80).items() if c == d} and len(rows) - len(got) == 25


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        out[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
        if name == "near_duplicates":
            root = linked([(r["doc_id"], r["text"]) for r in before.collect()], 80)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(d for d, c in root.items() if c == d)
        if name == "substring_dedup":
            rows = [(r["doc_id"], split(r["text"])) for r in before.collect()]
            want = {d: [x for x, m in zip(w, mark) if not m] for (d, w), mark in zip(rows, repeated_windows([w for _, w in rows], 35))}
            assert {r["doc_id"]: split(r["text"]) for r in docs.collect()} == want
    pieces = collections.Counter({r["doc_id"]: r["n"] for r in out["packing"].groupBy("doc_id").sum("length").toDF("doc_id", "n").collect()})
    whole = corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").sum("length").toDF("doc_id", "n").collect()
    assert pieces and pieces == {r["doc_id"]: r["n"] for r in whole}
