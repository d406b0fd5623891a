"""Every word of every repeat of ``LENGTH`` words in large groups that differ on both sides of their common words."""

import random

from swathframe.llm import suffix_dedup
from tests.llm.test_operators import repeated_windows


def test_whole_repeats_in_large_groups(spark):
    rng = random.Random(12)

    def fresh(n):
        return [f"w{rng.random()}" for _ in range(n)]
    base, passage, leads, tails = fresh(400), fresh(35), [fresh(15) for _ in range(100)], [fresh(15) for _ in range(100)]
    texts = []
    for _ in range(500):
        w = list(base)
        for k in rng.sample(range(400), rng.randint(0, 8)):
            w[k] = f"c{rng.random()}"
        texts.append(w)
    texts += [fresh(20) + rng.choice(leads) + passage + fresh(20) for _ in range(500)]
    texts += [fresh(20) + passage + rng.choice(tails) + fresh(20) for _ in range(200)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in suffix_dedup.repeated_passages(docs).collect()}
    for k, (long, short) in enumerate(zip(repeated_windows(texts, suffix_dedup.LENGTH), repeated_windows(texts, suffix_dedup.KEY))):
        got = {at for s in spans.get(k, []) for at in range(s["start"], s["start"] + s["length"])}
        assert {at for at, m in enumerate(long) if m} <= got <= {at for at, m in enumerate(short) if m}
