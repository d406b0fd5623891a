"""Every character counts as itself in the perplexity of op3, whatever the number of distinct trigrams."""

import random

import numpy as np

from swathframe.llm import quality_rules


def corpus():
    rng = random.Random(11)
    stems = ["".join(chr(0x430 + rng.randrange(32)) for _ in range(rng.randint(2, 7))) for _ in range(60)]
    texts = [" ".join(rng.choices(stems, k=150)) for _ in range(120)]
    # Each letter gives way to one 7, 14 or 21 places further: the same class of the former seven for all beyond ASCII.
    other = "".join(x if x == " " else chr(0x430 + (ord(x) - 0x430 + 7 * rng.randrange(1, 4)) % 28) for x in texts[0])
    capitals = " ".join("".join(chr(65 + rng.randrange(26)) for _ in w) for w in texts[1].split(" "))
    return [(k, t, "ru") for k, t in enumerate(texts)] + [(-1, other, "ru"), (-2, capitals, "ru"), (-3, None, None), (-4, "", "ru")]


def test_letters_of_other_scripts_are_told_apart(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.judge_documents(docs).collect()}
    assert not got[-1]["base_failed"] and not got[-1]["kept"] and not got[-2]["kept"]
    assert sum(got[k]["kept"] for k in range(120)) >= 118


def test_joined_trigrams_give_the_same_entropy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").repartition(3)
    whole, joined = (sorted(map(tuple, quality_rules.judge_documents(docs, n).collect())) for n in (10_000_000, 40))
    assert whole == joined
    kept = sorted(r["doc_id"] for r in quality_rules.keep_passing(docs, 40).collect())
    assert kept == [r[0] for r in whole if r[7]]


def test_table_of_logarithms_is_the_kneser_ney_model(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    table = quality_rules.fit_models(docs).table.filter("lang = 'ru'").orderBy("gram").toPandas()
    grams = np.concatenate([quality_rules.trigrams(t) for _, t, x in corpus() if x == "ru"])
    codes, counts = np.unique(grams, return_counts=True)
    assert table["gram"].tolist() == codes.tolist() and table["n"].tolist() == counts.tolist()
    model = quality_rules.KneserNey(codes, counts, 1 << quality_rules.BITS)
    assert np.allclose(table["log"] / quality_rules.UNIT, model.log_probability(codes), atol=1e-8)
