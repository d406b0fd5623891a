"""Limits of the perplexity bands against labelled rows and planted noise."""

import random

from swathframe.llm import quality_rules


def test_limits_follow_the_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    rng = random.Random(6)
    noise = []
    for lang in ("en",):  # in a language of a hundred documents a long shouted text would be a share of its own model
        text = docs.filter(docs.lang == lang).join(labels.filter("quality = 1"), "doc_id").orderBy("doc_id").filter("length(text) > 900").first()["text"]
        noise.append((text[:1500].upper(), lang))
    noise += [(" ".join("=" * (3 + k % 7) + "~" * (k % 5) for k in range(90)), "en"),
              (" ".join("".join(chr(0x400 + rng.randrange(256)) for _ in range(6)) for _ in range(100)), "de")]
    extra = spark.createDataFrame([(-k, t, x) for k, (t, x) in enumerate(noise, 1)], docs.schema)
    got = quality_rules.judge_documents(docs.unionByName(extra)).cache()
    assert [r["doc_id"] for r in got.filter("doc_id < 0 and kept").collect()] == []
    assert got.filter("high - low > 0.3 and low is not null").count() == 0
    clean = got.filter("not base_failed").join(labels.filter("quality = 1"), "doc_id")
    assert clean.filter("kept").count() >= 0.97 * clean.count()


def test_copies_do_not_narrow_the_band(spark):
    rows = [(k, 0.7 + 0.0002 * (k % 100), "en") for k in range(100)] + [(k, 0.705, "en") for k in range(100, 5000)]
    measured = spark.createDataFrame([(d, x, lang, False, 100, 500, 0) for d, x, lang in rows],
                                     "doc_id long, entropy double, lang string, base_failed boolean, n_words long, word_chars long, n_symbols long")
    r = quality_rules.bands(measured).first()
    assert r["low"] <= 0.7 and r["high"] >= 0.7198
