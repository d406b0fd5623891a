"""Words, spellings and sums of the language model against plain loops."""

import random

import numpy as np
import public_tokenizers

from swathframe.llm import lm_scoring


def test_spelled_words_are_encoded_alike_and_not_again():
    rng = random.Random(5)
    coder = lm_scoring.Subwords(lm_scoring.load_subwords(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    vocabulary = ["sunset", "ñandú", "x y", "12,5%", "a", "don't", "漢字", "qzxwv"]
    texts = [b"", b" \n", *(" \t".join(rng.choices(vocabulary, k=k)).encode() for k in (1, 9, 40)), b" a a\n"]
    words, h, inverse, per_text = lm_scoring._hashed(texts)
    assert per_text.tolist() == [len(t.split()) for t in texts]
    assert [words[k] for k in inverse] == [w for t in texts for w in t.split()] and len(set(words)) == len(words)
    wanted = lm_scoring._token_ids(texts, coder)
    keys = lm_scoring.signed(h)
    some = np.sort(keys)[::2]
    ids, n = coder.of_words([words[int(np.flatnonzero(keys == x)[0])] for x in some])
    asked, encode = [], coder.of_words
    coder.of_words = lambda own: asked.extend(own) or encode(own)
    got = lm_scoring._token_ids(texts, coder, None, lm_scoring.Spellings(some, ids, n))
    assert all(np.array_equal(a, b) for a, b in zip(got, wanted))
    assert len(asked) == len(words) - len(some)


def test_rows_are_summed_by_place():
    rng = np.random.default_rng(1)
    for kind in (np.float32, np.float64):
        at, d, table = rng.integers(0, 9, (7, 5)), rng.normal(size=(35, 6)).astype(kind), np.zeros((11, 6), kind)
        want = np.zeros((11, 6))
        for k, row in zip(at.ravel(), d):
            want[k] += row
        assert np.allclose(lm_scoring._scatter(table, at.ravel(), d), want, atol=1e-5)
