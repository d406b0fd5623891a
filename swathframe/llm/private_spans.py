"""Personal data: fixed forms, and identifiers found by bootstrapping from the words around them.

Spans of the fixed forms are the seeds.  A token that is one whole seed is a
positive instance of its kind; every other token with a digit or an at sign is
an open instance.  The words around an instance, and one of these words with
the instance's shape, are its patterns.  In each round Spark scores a pattern
by the share of its distinct instances that are known, accepts open instances
whose patterns leave little doubt, and goes on from the larger set.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathframe.llm.common import dealt, slices

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; known instances that a pattern needs; its least confidence; the least score of a new instance.
ROUNDS, SUPPORT, CONFIDENCE, ACCEPT = 4, 3, 0.75, 0.9
#: Characters of an identifier, and of a context word that counts.
LEAST, MOST, WORD = 4, 64, 32

# The forms that the base counts.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGITS, _NO_DIGIT, _SIGNS = re.compile(r"[0-9]"), re.compile(r"[^0-9]"), re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`()[]{}<>.,;:!?*#$%&|=/\\"


# --- fixed forms --------------------------------------------------------------------------------------------------

def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts twice, as its digit sum."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str):
    """Matches as a scan from the left would give them, in time linear in the text: a name ends at an at sign."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of all base spans, by kind and start; ends are exclusive."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m.group()) if m.end() - m.start() <= 37 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# --- instances and patterns ---------------------------------------------------------------------------------------

def shape(token: str) -> str:
    """Digits as 9 and letters as a, repeats with their number."""
    kinds = ["9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in token]
    out, k = [], 0
    while k < len(kinds):
        n = k
        while n < len(kinds) and kinds[n] == kinds[k]:
            n += 1
        out.append(kinds[k] if n - k == 1 else f"{kinds[k]}{n - k}")
        k = n
    return " ".join(out)


def _context(word: str) -> str:
    return _DIGITS.sub("0", word.lower()) if len(word) <= WORD else ""


def instances(text: str, spans) -> list[tuple[int, int, int, str, list[str]]]:
    """(kind's number or -1, start, end, value, patterns) of the identifiers in a text.

    A span is one instance, with its words around it; other tokens of ``LEAST``
    to ``MOST`` characters with a digit or at sign that touch no span are open.
    Patterns are the two words before, the word before with the word after, and
    the word before with the shape; without a word before there is no pattern.
    """
    if not _SIGNS.search(text):
        return []
    taken = sorted((a, b, k) for k, a, b in spans)
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out, s = [], 0
    held = []  # (first token, last token, kind, start, end)
    for t, (a, b) in enumerate(tokens):
        while s < len(taken) and taken[s][1] <= a:
            s += 1
        if s < len(taken) and taken[s][0] < b:
            lo, hi, kind = taken[s]
            if text[a:lo].strip(_EDGE) == "" and lo >= a:
                last = t
                while last + 1 < len(tokens) and tokens[last + 1][0] < hi:
                    last += 1
                if text[hi:tokens[last][1]].strip(_EDGE) == "":
                    held.append((t, last, kind, lo, hi))
            continue
        if b - a <= 2 * MOST and _SIGNS.search(text, a, b):
            word = text[a:b]
            lo = a + len(word) - len(word.lstrip(_EDGE))
            hi = lo + len(word.strip(_EDGE))
            if LEAST <= hi - lo <= MOST:
                held.append((t, t, -1, lo, hi))
    for first, last, kind, lo, hi in held:
        left = [_context(text[slice(*tokens[t])]) if t >= 0 else "" for t in (first - 2, first - 1)]
        right = _context(text[slice(*tokens[last + 1])]) if last + 1 < len(tokens) else ""
        patterns = []
        if left[1]:
            patterns.append(f"s\t{left[1]}\t{shape(text[lo:hi])}")
            if left[0]:
                patterns.append(f"l\t{left[0]}\t{left[1]}")
            if right:
                patterns.append(f"b\t{left[1]}\t{right}")
        out.append((kind, lo, hi, text[lo:hi], patterns))
    return out


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()),
                    ("patterns", pa.list_(pa.string()))])


def read_documents(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, digest, found): fixed spans and instances of every row; texts stay behind."""
    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            ids, base, digest, found = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                spans = fixed_spans(text) if text else []
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                digest.append(hashlib.sha256(joined(spans).encode()).hexdigest())
                found.append([dict(zip(("kind", "start", "end", "value", "patterns"), x))
                              for x in (instances(text, spans) if text else ())])
            n = len(base)
            yield pa.record_batch([pa.array(range(row, row + n), pa.int64()), ids, pa.array(base, pa.list_(_SPAN)),
                                   pa.array(digest), pa.array(found, pa.list_(_FOUND))],
                                  names=["row", "doc_id", "base", "digest", "found"])
            row += n

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "row long, doc_id long, base array<struct<kind int, start long, end long>>, digest string, "
             "found array<struct<kind int, start long, end long, value string, patterns array<string>>>")


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE,
              accept: float = ACCEPT) -> DataFrame:
    """(value, kind) of open instances that the patterns show to be personal data.

    ``found`` has a row (kind, value, patterns) for each instance in the texts,
    kind -1 for open ones.  A pattern's confidence in a kind is known / (all + 1)
    over its distinct instances, each known one by its score; patterns with
    fewer than ``support`` known instances, or below ``confidence``, say
    nothing.  An open instance scores 1 - product(1 - confidence) over distinct patterns
    that speak for one kind and is accepted from ``accept`` on, for its best
    kind (ties: the first of ``KINDS``).  Accepted instances count with their
    score in the next round.  Ends after ``rounds``, or when nothing is new.
    """
    edges = dealt(found.select(F.explode("patterns").alias("pattern"), "value", "kind")
                  .groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    known = dealt(found.filter("kind >= 0").groupBy("value").agg(F.max("kind").alias("k"), F.lit(1.0).alias("score")))
    new = known.limit(0)
    for _ in range(rounds):
        marked = edges.join(known, "value", "left").select("pattern", "k", "score")
        sums = marked.groupBy("pattern").agg(
            F.count("*").alias("n"), *(F.sum(F.when(F.col("k") == i, F.col("score"))).alias(f"p{i}") for i in range(len(KINDS))))
        each = F.array(*(F.struct(F.coalesce(f"p{i}", F.lit(0.0)).alias("sum"), F.lit(i).alias("kind"))
                         for i in range(len(KINDS))))
        sure = (sums.select("pattern", "n", F.explode(each).alias("x")).filter(F.col("x.sum") >= support)
                .select("pattern", F.col("x.kind").alias("k"), (F.col("x.sum") / (F.col("n") + 1)).alias("trust"))
                .filter(F.col("trust") >= confidence))
        doubt = F.sum(F.log1p(-F.col("trust")))
        scored = (edges.filter("kind < 0").join(sure, "pattern").groupBy("value", "k").agg((1 - F.exp(doubt)).alias("score"))
                  .filter(F.col("score") >= accept))
        best = (scored.groupBy("value").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("x"))
                .select("value", (-F.col("x.k")).alias("k"), F.col("x.score").alias("score")))
        fresh = dealt(best.join(known, "value", "left_anti"))
        if fresh.isEmpty():
            break
        new = dealt(new.unionByName(fresh))
        known = dealt(known.unionByName(fresh))
    return new.select("value", F.col("k").cast("int").alias("kind"))


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_private(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE,
                 accept: float = ACCEPT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row for each row of ``docs``.

    The counts and the digest are those of the fixed forms; ``spans`` holds these and the
    added ones.  Null and empty texts have no span; very long ones
    are read in time linear in their length.  Rows without id are read as
    others.  Repeated rows have the same spans each, and their instances count
    once.  Other columns are left out; an empty table gives no rows.  Texts are
    read once; only the small part around identifiers is stored and shuffled.
    """
    read = dealt(read_documents(docs))
    found = read.select("row", F.explode("found").alias("x")).select("row", "x.*")
    new = bootstrap(found.select("kind", "value", "patterns"), rounds, support, confidence, accept)
    added = (found.filter("kind < 0").drop("kind").join(new, "value").groupBy("row")
             .agg(F.collect_set(F.struct("kind", "start", "end")).alias("added")))  # bounded by the row's own text
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))))
    name = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    return (read.drop("found").join(added, "row", "left")
            .select("doc_id", *(_count("base", i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)),
                    F.col("digest").alias("base_sha256"), spans.alias("spans"),
                    F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added")))
