"""A training step works on a few windows at a time, and words are cut out only where they are asked for."""

import collections
import random
import tracemalloc

import numpy as np

from swathframe.llm import lm_scoring


def _step(kind=np.float32, n=lm_scoring.STEP):
    rng = np.random.default_rng(4)
    net = lm_scoring.Attention.fresh(70)
    net.p = {k: (v * 4).astype(kind) for k, v in net.p.items()}
    return (net, rng.integers(0, lm_scoring.INPUTS, (n, lm_scoring.CONTEXT + lm_scoring.SCORED)),
            rng.integers(-1, 70, (n, lm_scoring.SCORED)))


def test_a_step_holds_few_windows():
    net, window, target = _step()
    net.gradients(window, target)
    tracemalloc.start()
    net.gradients(window, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6  # 1 MB of it are the gradients themselves


def test_blocks_add_up_to_the_whole_step(monkeypatch):
    net, window, target = _step(np.float64, 150)
    got = [net.gradients(window, target)]
    net.p["c"] = net.p["c"] + 70  # beyond the bound, where maxima are taken off; the same for all classes
    got.append(net.gradients(window, target))
    monkeypatch.setattr(lm_scoring, "BLOCK", 1000)
    whole, loss = net.gradients(window, target)
    for g, own in got:
        assert np.isclose(own, loss)
        assert all(np.allclose(g[name], whole[name], atol=1e-12) for name in whole)


def test_words_are_counted_over_batches_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "_CHUNK", 50)
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["Sun", "sun", "ñ", "moon\n", "x" * 60], k=30)) for _ in range(40)] + [None, "", " \t"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {bytes(r["word"]): r["n"] for r in lm_scoring.count_words(docs).collect()}
    assert got == collections.Counter(w for t in texts for w in (t or "").encode().lower().split())
    words = lm_scoring._hashed([b"b a b", b"", b"c a"])[0]
    assert words.cut() == [b"b", b"a", b"c"] and words.cut(np.array([False, True, False])) == [b"a"]
