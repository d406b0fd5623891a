"""Packing documents into sequences of fixed length by cutting-stock column generation.

Every document is cut into full sequences and one rest.  The rests' lengths
form a histogram of bounded size.  A linear program chooses how often to use
each pattern (a multiset of length classes that fits one sequence); a knapsack
dynamic program prices new patterns.  Rounded-down patterns and a greedy
remainder give a plan of bounded size, and the ranked documents of each class
take its places.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import re
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swathframe.llm.byte_bpe import byte_characters
from swathframe.llm.common import dealt

#: Characters for which both tokenizer libraries certainly cut alike: printable ASCII, tab, line ends, Latin-1 letters.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
PIECES = ("pid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, local long")
END_ID = 1


# --- plan ---------------------------------------------------------------------------------------------------------

def price(width: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best worth within ``capacity`` and how many of each item give it."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(width, kind="stable")
    sorted_width, sorted_worth = width[order], worth[order]
    upto = np.searchsorted(sorted_width, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w], last[w] = best[w - 1], -2
        if upto[w]:
            got = best[w - sorted_width[:upto[w]]] + sorted_worth[:upto[w]]
            k = int(got.argmax())
            if got[k] > best[w]:
                best[w], last[w] = got[k], k
    count, w = np.zeros(len(width), np.int64), capacity
    while w > 0:
        if last[w] == -2:
            w -= 1
        else:
            count[order[last[w]]] += 1
            w -= sorted_width[last[w]]
    return float(best[capacity]), count


def column_generation(width: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3,
                      rounds: int = 5000) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of the linear relaxation, within ``gap`` of its least number of sequences.

    Revised simplex on the patterns found so far; the best price v bounds the
    optimum from below by (value / v), which ends the search.
    """
    m = len(width)
    columns = np.diag(capacity // width).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ demand
    for _ in range(rounds):
        worth = inverse.sum(axis=0)
        value, column = price(width, worth, capacity)
        if value <= 1 + gap:
            break
        step = inverse @ column
        able = step > 1e-9
        ratio = np.where(able, amount / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        amount[amount < 0] = 0
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out] = column
    return [(columns[:, k].astype(np.int64), float(amount[k])) for k in range(m) if amount[k] > 0]


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns {class: count} and how often each is used; together they hold every piece exactly once."""
    classes = sorted(c for c, n in histogram.items() if n)
    if not classes:
        return []
    width, left = np.array(classes), np.array([histogram[c] for c in classes], np.int64)
    out = []
    for pattern, times in sorted(column_generation(width, left.astype(float), capacity), key=lambda x: -x[1]):
        used = np.flatnonzero(pattern)
        whole = min(int(times + 1e-6), *(int(left[k] // pattern[k]) for k in used))
        if whole > 0:
            left -= whole * pattern
            out.append(({classes[k]: int(pattern[k]) for k in used}, whole))
    while left.any():  # what rounding left: largest first, as often as it fits
        room, own = capacity, {}
        for k in range(len(classes) - 1, -1, -1):
            n = min(int(left[k]), room // classes[k])
            if n:
                own[classes[k]] = n
                room -= n * classes[k]
        times = min(int(left[classes.index(c)]) // n for c, n in own.items())
        for c, n in own.items():
            left[classes.index(c)] -= n * times
        out.append((own, times))
    return out


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple]:
    """For each class, by rank: where a run of ranks begins, pieces per sequence, first sequence id."""
    runs, base, taken = defaultdict(list), 0, defaultdict(int)
    for pattern, times in plan:
        for c, n in pattern.items():
            runs[c].append((taken[c], n, base))
            taken[c] += n * times
        base += times
    return {c: tuple(np.array(x, np.int64) for x in zip(*r)) for c, r in runs.items()}


# --- tokens -------------------------------------------------------------------------------------------------------

class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, without added special tokens.

    Plain Latin text without a special token's string is encoded by tiktoken
    from the same file's vocabulary: the same ids, four times faster.
    """

    def __init__(self, spec: str, pattern: str):
        self.full = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        special = {t["content"] for t in parsed.get("added_tokens", [])}
        back = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(back[c] for c in t): i for t, i in parsed["model"]["vocab"].items() if t not in special}
        self.special = list(special)
        self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")


def cut_pieces(docs: DataFrame, tokenizer_json: str, pattern: str, capacity: int, unit: int) -> DataFrame:
    """One row for each piece: full sequences, then the rest; ``local`` ranks a class within its task."""
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = f.read()

    def run(batches):
        encoder, seen, pid = Encoder(spec, pattern), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encoder.ids(text or ""), np.uint32(END_ID)).astype("<u4")
                data = memoryview(ids.tobytes())
                for start in range(0, len(ids), capacity):
                    n = min(capacity, len(ids) - start)
                    c = -(-n // unit)
                    rows.append((pid, doc, start, n, zlib.crc32(data[4 * start:4 * (start + n)]), len(ids), c, seen[c]))
                    seen[c] += 1
            names = [x.split()[0] for x in PIECES.split(", ")]
            types = [pa.int64()] * 6 + [pa.int32(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 8
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer_json: str, pattern: str, capacity: int = 2048, unit: int = 8) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece.

    A null or empty text is the end id alone.  Repeated rows are packed each
    for itself, null ids too; other columns are left out; an empty table gives
    no pieces.  Lengths are planned in classes of ``unit`` tokens (rounded up),
    so the histogram, the program and the plan have at most capacity/unit
    classes at any size of input.  Ranks within a class are counts per task
    plus an offset per task, so no class meets in one task.
    """
    if capacity % unit:
        raise ValueError("unit must divide capacity")
    pieces = dealt(cut_pieces(docs, tokenizer_json, pattern, capacity, unit))
    per_task = pieces.groupBy("class", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("class", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    where = places(plan_patterns(histogram, capacity // unit))

    def seat(batches):
        for batch in batches:
            classes, rank = batch.column(6).to_numpy(), batch.column(7).to_numpy()
            sequence = np.zeros(len(rank), np.int64)
            for c in np.unique(classes):
                begin, per, base = where[int(c)]
                at = np.flatnonzero(classes == c)
                run = np.searchsorted(begin, rank[at], side="right") - 1
                sequence[at] = base[run] + (rank[at] - begin[run]) // per[run]
            yield pa.record_batch([*batch.columns[1:6], *batch.columns[6:8], pa.array(sequence)],
                                  names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank",
                                         "sequence_id"])

    ranked = pieces.join(offsets, ["class", "pid"]).select(
        "pid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class",
        (F.col("local") + F.col("before")).alias("rank"))
    seated = ranked.mapInArrow(seat, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, "
                                     "rank long, sequence_id long")
    earlier = (Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
               .rowsBetween(Window.unboundedPreceding, -1))  # at most ``capacity`` pieces in a sequence
    return seated.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))
