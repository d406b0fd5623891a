"""Fixed forms against plain expressions, and identifiers found by their context."""

import hashlib
import random
import re
import time

from swathframe.llm import private_spans

FORMS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
SCHEMA = "doc_id long, text string, row long, found string, kind int, value string, pattern string, base int, k int, n int"
CLASH = (1, "f", 2, "v", "p", 3, 4, 5)
CARDS = ["4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424", "5105105105105100", "4222222222222220"]


def _plain(text):
    out = []
    for k, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = [int(d) for d in re.sub("[^0-9]", "", m.group())]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            doubled = [2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(doubled) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_forms_equal_plain_expressions():
    rng = random.Random(3)
    parts = ["a", "@", ".", "1", "2", "+", "-", " ", "(", ")", "b.c", "é", "12", "255", "256", "00012", CARDS[0], "+1 555 ", "@x.y",
             "0", "_", "٣", "%", "4111 1111-1111 1111"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert private_spans.fixed_spans(text) == _plain(text), text


def test_long_texts_take_linear_time():
    begun = time.time()
    for text in ("1" * 1_000_000, "a." * 500_000, "a@" * 500_000, "+1" + "(" * 1_000_000, "1.1" * 400_000, "x" * 1_000_000 + "@y"):
        private_spans.instances(text, private_spans.fixed_spans(text))
    assert time.time() - begun < 30


def _planted():
    """Card numbers stand after fixed words; so do numbers whose check digit is wrong, and others stand elsewhere."""
    rng = random.Random(9)
    rows = []
    for k, card in enumerate(CARDS * 2):
        rows.append(f"please charge my card {card} today {k}")
        rows.append(f"{rng.choice(['she', 'he'])} gave card number {card} by mail")
    rows.append("please charge my card 4111111111111112 today 77")  # wrong check digit
    rows.append("he gave card number 4111111111111113 by mail")
    rows += [f"the release version 2.0.{k} of build 41111111111111{k:02d}1 is out" for k in range(20)]  # same shape, other words
    return rows


def test_contexts_reveal_unseen_identifiers(spark):
    texts = _planted()
    docs = spark.createDataFrame([(k, t, *CLASH) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in private_spans.find_private(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        base = _plain(t)
        added = [(2, m.start(), m.end()) for m in re.finditer(r"\b411111111111111[23]\b", t)]
        assert got[k]["spans"] == private_spans.joined(sorted(base + added)), t
        assert got[k]["base_sha256"] == hashlib.sha256(private_spans.joined(base).encode()).hexdigest()
        assert [got[k][f"n_{kind}"] for kind, _ in FORMS] == [sum(s[0] == i for s in base) for i in range(4)]


def test_a_second_round_builds_on_the_first(spark):
    """Codes are known only by words that follow the first round's finds."""
    numbers = [f"40000000{k:07d}" for k in range(24)]
    cards = [n + next(d for d in "0123456789" if any(s[0] == 2 for s in _plain(n + d))) for n in numbers]
    rows = [f"please charge my card {c} today" for c in cards]
    rows += [f"please charge my card 99-88-{k}7 today" for k in range(6)]
    rows += [f"refund for slip 99-88-{k}7 was sent" for k in range(6)] + ["refund for slip QX-5551 was sent"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")

    def found(rounds):
        return {r["doc_id"] for r in private_spans.find_private(docs, rounds=rounds, confidence=0.6).collect() if r["n_added"]}
    assert found(1) == set(range(24, 36))
    assert found(4) == set(range(24, 37))


def test_edges(spark):
    text = "write to a.b@c.de or call +1 (555) 555-0100"
    rows = [(None, text), (1, None), (2, ""), (3, text), (3, text), (4, "x " * 30_000 + CARDS[0])]
    got = sorted((tuple(r) for r in private_spans.find_private(
        spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)).collect()), key=repr)
    want = sorted(((doc, *(sum(s[0] == i for s in _plain(t or "")) for i in range(4)),
                    hashlib.sha256(private_spans.joined(_plain(t or "")).encode()).hexdigest(),
                    private_spans.joined(_plain(t or "")), 0) for doc, t in rows), key=repr)
    assert got == want
    assert private_spans.find_private(spark.createDataFrame([], SCHEMA)).collect() == []
