"""The attention model learns from every training row."""

import random

import numpy as np
import public_tokenizers

from swathframe.llm import lm_scoring


def test_every_row_trains(spark):
    rng = random.Random(7)
    # Chains of words: what follows a word is certain, which counts alone do not show.
    words = [a + b for a in ("sun", "moon", "star", "rain") for b in ("light", "set", "rise", "fall")]
    texts = [" ".join(words[(k + j) % 16] for j in range(60)) for k in (rng.randrange(16) for _ in range(900))] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ranks = lm_scoring.load_subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = lm_scoring.Subwords(ranks, public_tokenizers.PATTERN)
    ids, begin = lm_scoring._token_ids([(t or "").encode() for t in texts], coder)
    model = lm_scoring.LanguageModel.fit_counts(np.bincount(ids, minlength=coder.size), coder.opens)
    before = model.log10_texts(ids, begin).sum()
    assert lm_scoring.train_rows(docs, model, ranks, public_tokenizers.PATTERN, len(ids)) == len(ids)
    assert model.log10_texts(ids, begin).sum() > 0.5 * before
