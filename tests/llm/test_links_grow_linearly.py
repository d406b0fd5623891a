"""Components, and the number of links in a group of near copies."""

import random

import pytest

from swathframe.llm import near_dup
from swathframe.llm.common import components


def _least(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {v: find(v) for v in list(root)}


@pytest.mark.parametrize("shape", ["path", "star", "random", "loops", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {"path": [(k, k + 1) for k in range(400)], "star": [(900, k) for k in range(300)],
             "random": [(rng.randrange(500), rng.randrange(500)) for _ in range(350)],
             "loops": [(5, 5), (5, 5), (6, 7), (7, 7), (9, 9)], "none": []}[shape]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(got) == len({r["v"] for r in got}) and {r["v"]: r["label"] for r in got} == _least(edges)


def _near_copies(n):
    rng = random.Random(n)
    base = [f"w{k}" for k in range(150)]
    out = []
    for _ in range(n):
        own = base.copy()
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(own))
    return out


def _links(spark, n, monkeypatch):
    counts, plain = [], near_dup.verified_links

    def counted(*args):
        for df in plain(*args):
            if df.columns == ["a", "b"]:
                counts.append(df.count())
            yield df
    monkeypatch.setattr(near_dup, "verified_links", counted)
    docs = spark.createDataFrame(list(enumerate(_near_copies(n))), "doc_id long, text string")
    got = near_dup.link_documents(docs, 80).collect()
    monkeypatch.setattr(near_dup, "verified_links", plain)
    return sum(counts), got


def test_links_grow_linearly(spark, monkeypatch):
    few, _ = _links(spark, 300, monkeypatch)
    many, got = _links(spark, 600, monkeypatch)
    assert 0 < many <= 2.5 * few and many < 1200
    sets = [near_dup.shingle_set(t) for t in _near_copies(600)]
    root = near_dup.spanning(near_dup.link_pairs(sets, 0, 80), 600)
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root.tolist()))


def test_keep_one_with_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, 1, 2, 3), (2, text, 4, 5, 6), (3, "other", 7, 8, 9)],
                                 "doc_id long, text string, gone int, _gone int, gone_ int")
    assert sorted(tuple(r)[2:] for r in near_dup.keep_one(docs).collect()) == [(1, 2, 3), (7, 8, 9)]
