"""The cache of encoded words is bounded in bytes and holds no long pieces; results do not depend on it."""

import hashlib
import random

import public_tokenizers

from swathframe.llm import byte_bpe


def test_cache_stays_small(monkeypatch):
    rng = random.Random(1)
    codec = byte_bpe.Codec(byte_bpe.build_model(byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))),
                           public_tokenizers.PATTERN)
    solid = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(2000)) for _ in range(20)]
    words = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 70))) for _ in range(200)) for _ in range(20)]
    texts = [x for pair in zip(solid, words) for x in pair] + ["", None, " ", "a  b"]

    def plain(t):
        ids = codec.encode(t)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
    want = [plain(t) for t in texts]
    assert codec.digests(texts) == want
    assert max(map(len, [*codec.first, *codec.later])) <= byte_bpe.LONGEST
    monkeypatch.setattr(byte_bpe, "CACHE", 10_000)
    for lo in range(0, len(texts), 4):  # the cache is emptied between calls
        assert codec.digests(texts[lo:lo + 4]) == want[lo:lo + 4]
    assert codec.held < 1_000_000 and len(codec.first) + len(codec.later) <= 800
    assert codec.digests(texts) == want
