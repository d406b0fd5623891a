"""Text operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from swathframe.llm import (byte_bpe, common, embedding_dedup, lm_scoring, near_dup, packing, quality_classifier,
                            quality_rules, substring_dedup, suffix_dedup, url_filters)

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")
#: Names that the operators use themselves.
CLASH = ("key", "copies", "n_words", "label", "score", "held_out", "h", "tid", "rep", "component_id", "host", "rule", "_key")


def split(text):
    return (text or "").encode().split()


def edge_texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice(["th", "er", "on", "ña", "ing", "a"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))
    passage, base = prose(60), prose(200)
    near = base.split(" ")
    near[50] = "changed"
    far = base.split(" ")
    far[::12] = ["other"] * len(far[::12])
    shared = base.split(" ")
    shared[50], shared[150] = "changed", "again"
    texts = [None, "", "   \n\t ", "one", "one two", "ONE two", base, base, " ".join(near), " ".join(far), " ".join(shared),
             prose(80) + " " + passage + " " + prose(70), passage + "\n" + prose(90), prose(40) + "  " + passage, passage,
             "a b c d e " * 60, "x " * 200, prose(120) + "\n" + prose(30) + "\n" + prose(30), "l\nl\n\nl \n l\n",
             "don't  we'll\u00a0x \u2003 y\x1cz <|endoftext|> 12345 #*$ 漢字かな 👍🏽 \r\n\r\n end ", prose(30_000), prose(34), prose(35),
             "SAME words " * 30, "same WORDS " * 30]
    return texts


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    base = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids = [*range(10_000, 10_000 + len(edge_texts()))]
    rows = base + [(i, t, "en", "e") for i, t in zip(ids, edge_texts())]
    rows += [(None, "no id at all", None, None), (None, edge_texts()[6], "xx", "e"), rows[5], rows[5], (10_006, edge_texts()[6], "en", "e")]
    columns = "doc_id long, text string, lang string, source string" + "".join(f", {c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *["?"] * len(CLASH)) for r in rows], columns).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_hashes_follow_words():
    data = "one two  one\tthrée\nthrée one".encode()
    h = common.word_hashes(data)
    assert len(h) == 6 and h[0] == h[2] == h[5] and h[3] == h[4] and len(set(h.tolist())) == 3
    assert list(common.minimisers(np.array([3, 1, 1, 5, 0], np.uint64), 3)) == [1, 1, 4]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, x) for x in range(200, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    same(got.collect(), list(root.items()))


@pytest.mark.parametrize("url,host,path", [
    ("http://A.Example.com/en/x?q#f", "a.example.com", "/en/x"), ("no scheme", "", ""), (None, "", ""), ("", "", ""),
    ("ftp://h.com", "h.com", ""), ("x://a.net?b=/c", "a.net", ""), ("x://a.net#b://c/d", "a.net", ""), ("://", "", ""),
    ("a://b://c/d", "b:", "//c/d"), ("http://ÄX.com:80/En/", "Äx.com:80", "/En/")])
def test_urls(spark, url, host, path):
    r = url_filters.apply_rules(spark.createDataFrame([(1, url, "?", "?")], "page_id int, url string, host string, rule string"), []).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, None, "allow")


def test_rules(spark):
    rules = [url_filters.Rule("com/", True), url_filters.Rule("example.com/en/", False), url_filters.Rule("www.example.com/en/", True),
             url_filters.Rule("net", False), url_filters.Rule("b.org/x", False), url_filters.Rule("b.org/x", True)]
    cases = {"http://www.example.com/en/1": ("www.example.com/en/", "allow"), "http://m.example.com/en/1": ("example.com/en/", "block"),
             "http://badexample.com/en/": ("com/", "allow"), "http://example.com/EN/": ("com/", "allow"), "http://a.com": (None, "allow"),
             "http://x.net": ("net", "block"), "http://x.net/y": ("net", "block"), "http://xnet/y": (None, "allow"),
             "http://b.org/xyz": ("b.org/x", "block"), "http://q.de/wp-admin/x": (None, "block"), None: (None, "allow")}
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id int, url string")
    url_filters.INDEX_RULES, old = 2, url_filters.INDEX_RULES  # several indexes
    try:
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.apply_rules(pages, rules).collect()}
    finally:
        url_filters.INDEX_RULES = old
    assert got == dict(enumerate(cases.values()))
    assert url_filters.apply_rules(pages.limit(0), rules).count() == 0


def repeated_windows(texts, n):
    counts = collections.Counter(tuple(w[k:k + n]) for w in texts for k in range(len(w) - n + 1))
    for w in texts:
        mark = bytearray(len(w))
        for k in range(len(w) - n + 1):
            if counts[tuple(w[k:k + n])] > 1:
                mark[k:k + n] = b"\1" * n
        yield mark


def test_substrings(docs, rows, none):
    texts = [split(t) for _, t in rows]
    kept = [[x for x, m in zip(w, mark) if not m] for w, mark in zip(texts, repeated_windows(texts, 35))]
    want = [(d, len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for (d, _), w, k in zip(rows, texts, kept)]
    same(substring_dedup.remove_repeats(docs).collect(), want)
    assert any(0 < x[2] < x[1] for x in want)
    cut = substring_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    same([(r["doc_id"], split(r["text"])) for r in cut.collect()], [(d, k) for (d, _), k in zip(rows, kept)])
    assert substring_dedup.remove_repeats(none).count() == 0


def test_hot_passage_in_several_copies_of_a_shard(spark):
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([f"w{rng.random()}" for _ in range(5)] + passage + [f"w{rng.random()}"]) for _ in range(700)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == 700 and {(r["n_words"], r["n_removed"]) for r in got} == {(66, 60)}


def test_automaton():
    rng = random.Random(2)
    for _ in range(30):
        ref, text = ([rng.choice("abc") for _ in range(n)] for n in (40, 60))
        lengths, ends = substring_dedup.SuffixAutomaton(ref).statistics(text)
        joined = "".join(ref)
        for i, (n, e) in enumerate(zip(lengths, ends)):
            best = max(k for k in range(i + 2) if "".join(text[i - k + 1:i + 1]) in joined)
            assert n == best and (n == 0 or joined[e - n + 1:e + 1] == "".join(text[i - n + 1:i + 1]))


def test_rules_of_documents(docs, rows, none):
    def plain(t):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        mark = {k + j for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", x):
                dup += x in seen
                seen.add(x)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(mark), len(w) < 50 or 100 * len(mark) > 50 * len(w)
    got = quality_rules.judge_documents(docs)
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(),
         [(d, *plain(t)) for d, t in rows])
    assert all(not (r["kept"] and r["base_failed"]) for r in got.collect())
    kept = quality_rules.keep_passing(docs)
    assert kept.columns == docs.columns
    same(kept.select("doc_id").collect(), [(r["doc_id"],) for r in got.filter("kept").collect()])
    assert quality_rules.judge_documents(none).count() == quality_rules.keep_passing(none).count() == 0


def test_perplexity_bands_reject_noise(spark, sf_dir):
    clean = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    noise = [(-k, " ".join("".join(rng.choices("qzxjkvw0123456789QZ;:_~=+", k=9)) for _ in range(90)), "en") for k in (1, 2)]
    got = quality_rules.judge_documents(clean.unionByName(spark.createDataFrame(noise, clean.schema))).filter("not base_failed")
    assert got.filter("doc_id < 0 and kept").count() == 0
    assert got.filter("doc_id >= 0 and kept").count() >= 0.98 * got.filter("doc_id >= 0").count()


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    grams, counts = np.unique(rng.integers(0, 12, 3000) * 41 ** 2 + rng.integers(0, 12, 3000) * 41 + rng.integers(0, 41, 3000) % 17, return_counts=True)
    model = quality_rules.KneserNey(grams, counts)
    for context in (0, 5 * 41 + 3, 11 * 41 + 11, 40 * 41 + 40):
        assert math.isclose((10 ** model.log_probability(context * 41 + np.arange(41))).sum(), 1, rel_tol=1e-6)


def jaccard_components(rows):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    holders, root = collections.defaultdict(list), {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, ((d, _), s) in enumerate(zip(rows, sets)):
        if d is None:
            continue
        for j, n in collections.Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = find(d), find(rows[j][0])
                root[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(k)
    return [(d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)]


def test_near_duplicates(docs, rows, none):
    want = [(d, n, c, d is None or c == d) for d, n, c in jaccard_components(rows)]
    same(near_dup.link_documents(docs).collect(), want)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    same(kept.select("doc_id").collect(), [(w[0],) for w in want if w[3]])
    assert near_dup.link_documents(none).count() == near_dup.keep_one(none).count() == 0


def test_large_near_group_in_blocks(spark):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(150)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(150)] = f"c{rng.random()}"
        rows.append((k, " ".join(w)))
    got = near_dup.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got.select("doc_id", "n_shingles", "component_id").collect(), jaccard_components(rows))


def test_sketch_fills_and_concentrates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 500):
        s = near_dup.sketch(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        assert not (s == np.uint64(2 ** 64 - 1)).any()
    shared = []
    for _ in range(40):
        x = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
        shared.append((near_dup.sketch(x[:250]) == near_dup.sketch(x[50:])).mean())
    assert abs(np.mean(shared) - 200 / 300) < 0.03


def test_scores(docs, rows, none):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    c = collections.Counter(w for own, h in zip(tokens, held) if not h for w in own)
    total, floor = sum(c.values()), sum(c.values()) + len(c) + 1
    got = lm_scoring.score_documents(docs, RANKS, PATTERN).collect()
    key = [(d, h, len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / floor) for x in w), 5))
           for (d, _), h, w in zip(rows, held, tokens)]
    same([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got], key)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_scoring.score_documents(none, RANKS, PATTERN).count() == 0


def small_model():
    rng = np.random.default_rng(2)
    times = rng.integers(0, 50, 300)
    model = lm_scoring.LanguageModel.fit_counts(times, rng.random(300) < 0.4)
    return model, rng


def test_attention_gradients_and_training():
    model, rng = small_model()
    net = model.attention
    window = rng.integers(0, lm_scoring.INPUTS, (3, lm_scoring.CONTEXT + lm_scoring.SCORED))
    target = rng.integers(-1, len(net.p["c"]), (3, lm_scoring.SCORED))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, _ = net.gradients(window, target)
    for name in net.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-5
        up = net.gradients(window, target)[1]
        net.p[name][at] = keep - 1e-5
        down = net.gradients(window, target)[1]
        net.p[name][at] = keep
        assert math.isclose((up - down) / 2e-5, g[name][at], rel_tol=2e-3, abs_tol=1e-7), name
    ids = np.tile(np.arange(20), 400)
    before = model.log10_texts(ids, np.array([0]))[0]
    model.train(ids, np.array([0]))
    assert model.log10_texts(ids, np.array([0]))[0] > 0.5 * before


def test_windows_score_each_token_once_and_alone():
    model, rng = small_model()
    ids, begin = rng.integers(0, 300, 157), np.array([0, 1, 40, 90])
    _, target, text = model.windows(ids, begin)
    for k, own in enumerate(np.split(ids, begin[1:])):
        assert np.concatenate([t[t >= 0] for t in target[text == k]]).tolist() == own.tolist()
    whole = model.log10_texts(ids, begin)
    alone = [model.log10_texts(own, np.array([0]))[0] for own in np.split(ids, begin[1:])]
    assert np.allclose(whole, alone, rtol=1e-5)
    total = sum(10 ** model.log10_texts(np.array([x]), np.array([0]))[0] for x in range(300))
    assert math.isclose(total, 1, rel_tol=1e-4)


def test_word_subwords_cross_boundaries():
    coder = lm_scoring.Subwords(lm_scoring.load_subwords(RANKS), PATTERN)
    for words in ([b"one", "x\u00a0".encode(), b"two"], ["a".encode(), "ñ".encode(), b"don't", b"12,5%"], []):
        ids, n = coder.of_words(words)
        want = [coder.coder.encode_ordinary(" " + w.decode()) for w in words]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_encoding_round_trip(docs, rows, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in rows:
        ids = coder.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(byte_bpe.encode_documents(docs, RANKS, PATTERN).collect(), want)
    assert byte_bpe.encode_documents(none, RANKS, PATTERN).count() == 0
    codec = byte_bpe.Codec(byte_bpe.build_model(ranks), PATTERN)
    for t in (None, "", "naïve  test\n\n x", edge_texts()[19]):
        assert codec.encode(t) == coder.encode_ordinary(t or "") and codec.decode(codec.encode(t)).decode() == (t or "")


def test_repeated_passages(docs, rows, none):
    texts = [split(t) for _, t in rows]
    long = [m.count(1) for m in repeated_windows(texts, suffix_dedup.LENGTH)]
    short = [m.count(1) for m in repeated_windows(texts, suffix_dedup.KEY)]
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_repeated"]) for r in suffix_dedup.repeated_passages(docs).collect())
    found = {d: n for d, _, n in got}
    for (d, _), n50, n29 in zip(rows, long, short):
        assert found.get(d, 0) >= min(n50, suffix_dedup.KEY) and found.get(d, 0) <= n29 or d in (None, 10_006)
    assert sum(found.get(d, 0) for (d, _) in rows) >= 0.95 * sum(long)
    assert suffix_dedup.repeated_passages(none).count() == 0


def test_packing(docs, rows, none):
    plain = Tokenizer.from_file(JSON)
    want, size = collections.Counter(), 0
    for d, t in rows:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        size += len(ids)
        want[(d, len(ids))] += len(ids)
    pieces = packing.pack_documents(docs, JSON, PATTERN).toPandas()
    got = pieces.groupby(["doc_id", "doc_tokens"], dropna=False).length.sum()
    assert {(None if k[0] != k[0] else int(k[0]), k[1]): v for k, v in got.items()} == dict(want)
    tokens = {d: np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in rows if d is not None}
    for r in pieces[pieces.doc_id.notna()].itertuples():
        assert zlib.crc32(tokens[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    ordered = pieces.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    filled = pieces.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and len(filled) * 2048 <= 1.05 * size + 4096
    assert packing.pack_documents(none, JSON, PATTERN).count() == 0


def test_plan_holds_every_piece():
    rng = random.Random(5)
    for _ in range(5):
        histogram = {rng.randint(1, 64): rng.randint(1, 300) for _ in range(20)}
        plan = packing.plan_patterns(histogram, 64)
        used = collections.Counter()
        for pattern, times in plan:
            assert sum(c * n for c, n in pattern.items()) <= 64
            for c, n in pattern.items():
                used[c] += n * times
        assert used == histogram
        floor = math.ceil(sum(c * n for c, n in histogram.items()) / 64)
        relaxed = sum(t for _, t in packing.column_generation(np.array(sorted(histogram)), np.array([histogram[c] for c in sorted(histogram)], float), 64))
        assert floor <= math.ceil(relaxed + 1e-6) and sum(t for _, t in plan) <= relaxed + 6
    assert packing.price(np.array([3, 5]), np.array([4.0, 7.0]), 11)[0] == 15.0


def test_quality(spark, docs, rows, none, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = spark.createDataFrame([(None, 1, 0), (0, None, 0), (10_006, 1, 0), (10_006, 0, 0)], labels.schema)
    model = quality_classifier.fit_quality(docs, labels.unionByName(odd))
    got = quality_classifier.score_quality(docs, model)
    same(got.select("doc_id", "held_out").collect(), [(d, d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, _ in rows])
    assert got.filter("score between 0 and 1 and predicted = int(score >= 0.5)").count() == len(rows)
    test = got.filter("held_out").join(labels, "doc_id")
    assert test.filter("predicted = quality").count() >= 0.9 * test.count()
    assert quality_classifier.keep_good(docs, model).columns == docs.columns
    assert quality_classifier.keep_good(docs, model).count() == got.filter("predicted = 1").count()
    blank = quality_classifier.fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score_quality(docs, blank).select("score").distinct().collect()} == {0.5}
    assert quality_classifier.score_quality(none, model).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(700, 64))
    near = base[:150] + 0.18 * rng.normal(size=(150, 64))
    crowd = base[200] + 0.15 * rng.normal(size=(400, 64))
    v = np.concatenate([base, near, crowd, np.repeat(base[300:301], 40, 0)])
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(9000, None), (9001, []), (9002, [0.0] * 64), (9003, [math.nan] * 64),
                                                       (9004, [None] + [1.0] * 63), (9005, [1.0, 0.0]), (9006, [2.0, 0.0]), (None, v[0].tolist())]
    got = {r["vec_id"]: r for r in embedding_dedup.link_vectors(
        spark.createDataFrame([(*r, "?", "?") for r in rows], "vec_id long, embedding array<double>, n_links string, unit string")).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    links = (u @ u.T >= 0.95).sum(1) - 1
    found = np.array([got[k]["n_links"] for k in range(len(v))])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum() and links[300] >= 40
    assert len(got) == len(rows) and all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in range(9000, 9005))
    assert got[9005]["n_links"] == got[9006]["n_links"] == 1 and got[9006]["component_id"] == 9005 and not got[9006]["kept"]
    assert got[None]["kept"] and got[None]["n_links"] == 0
    assert embedding_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
