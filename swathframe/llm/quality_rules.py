"""Quality rules: plain counts, and perplexity under a trigram model of each language.

Spark counts the trigrams of characters over all documents and makes of the
counts a modified Kneser-Ney model, a table of one row for each trigram.  A
document whose perplexity leaves the band of its language is rejected.

Every code point is a character of its own, and a trigram's code is exact.
The most frequent trigrams go to the tasks as sorted hash arrays; the others,
without bound on their number, are joined with the table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from swathframe.llm.common import dealt, slices, words

SYMBOLS = "#*$%&|<>"
#: Bits of a code point in a trigram's code.
BITS = 21
#: Frequent trigrams of all languages that go to every task (8 MB at most); all others are joined.
FREQUENT = 524_288
#: Fixed point of stored logarithms: their sums are whole numbers, equal in any order.
UNIT = 1 << 32
#: Characters whose trigrams wait in a task, and distinct ones that it holds, at most.
_CHUNK = 1 << 20
RULES = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "base_failed boolean")


def trigrams(text: str | None) -> np.ndarray:
    """Code of the trigram that ends at each character; two blanks stand before the text."""
    c = np.frombuffer(("  " + (text or "")).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-2] << 2 * BITS) + (c[1:-1] << BITS) + c[2:]


def language(column: str = "lang") -> Column:
    """Two-letter codes stand for themselves, anything else is one further language; this bounds their number."""
    return F.when(F.col(column).rlike("^[a-z][a-z]\\z"), F.col(column)).otherwise(F.lit("other"))


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of sorted pieces and the sums of their counts."""
    g, n = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], np.add.reduceat(n, first)


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts; each task sums its own part before the shuffle."""
    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def add():
            for lang, own in waiting.items():
                piece = np.unique(np.concatenate(own), return_counts=True)
                held[lang] = _summed(*zip(held[lang], piece)) if lang in held else piece
            waiting.clear()

        def flush():
            for lang, (g, n) in held.items():
                yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)],
                                      names=["lang", "gram", "n"])
            held.clear()

        size = 0
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    waiting.setdefault(lang, []).append(trigrams(text))
                    size += len(text)
                if size > _CHUNK:
                    add()
                    size = 0
                    if sum(len(g) for g, _ in held.values()) > _CHUNK:
                        yield from flush()
        add()
        yield from flush()

    parts = docs.select(language().alias("lang"), "text").mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class HashArrays:
    """Sorted keys and their values; absent keys give the default."""

    keys: np.ndarray
    values: np.ndarray

    def get(self, keys: np.ndarray, default: float = np.nan) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], default)


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2, 3 and more, from the counts of counts."""
    n = [max(int((counts == k).sum()), 1) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
    return np.array(d)


def _interpolate(grams: np.ndarray, counts: np.ndarray, size: int, lower) -> tuple[HashArrays, HashArrays]:
    """Probabilities of the seen grams and the weight that each context leaves to the lower order."""
    context = grams // size
    d = _discounts(counts)[np.minimum(counts, 3)]
    seen, at = np.unique(context, return_inverse=True)
    total, spared = np.bincount(at, counts), np.bincount(at, d)
    left = spared / total
    return HashArrays(grams, (counts - d) / total[at] + left[at] * lower(grams)), HashArrays(seen, left)


class KneserNey:
    """Modified Kneser-Ney trigram model from counted trigrams (sorted codes) in one memory.

    ``log_probabilities`` makes the same of a table; the tests hold it against this.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, size: int = 41):
        self.size = size
        pairs, pair_n = np.unique(grams % size ** 2, return_counts=True)  # how many characters come before each pair
        ones, one_n = np.unique(pairs % size, return_counts=True)
        flat = np.bincount(ones, one_n, size)
        self.one = 0.99 * flat / max(flat.sum(), 1) + 0.01 / size
        self.two, self.two_left = _interpolate(pairs, pair_n, size, lambda g: self.one[g % size])
        self.three, self.three_left = _interpolate(grams, counts, size, lambda g: self._pair(g % size ** 2))

    def _pair(self, pairs: np.ndarray) -> np.ndarray:
        got = self.two.get(pairs)
        miss = np.isnan(got)
        got[miss] = self.two_left.get(pairs[miss] // self.size, 1.0) * self.one[pairs[miss] % self.size]
        return got

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """log10 P(last | first two) for each trigram code."""
        got = self.three.get(grams)
        miss = np.isnan(got)
        got[miss] = self.three_left.get(grams[miss] // self.size, 1.0) * self._pair(grams[miss] % self.size ** 2)
        return np.log10(got)


def _order(counts: DataFrame, bits: int, lower: DataFrame) -> DataFrame:
    """(lang, code, p) of an order from its counts (lang, code, n); ``lower`` is the order below, its codes of ``bits`` bits."""
    def times(k):
        return F.count(F.when(F.col("n") == k, 1))

    n = [F.greatest(times(k), F.lit(1)) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    discounts = counts.groupBy("lang").agg(*(
        F.least(F.greatest(k - (k + 1) * y * n[k] / n[k - 1], F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}") for k in (1, 2, 3)))
    contexts = counts.groupBy("lang", F.shiftright("code", BITS).alias("context")).agg(
        F.sum("n").alias("total"), times(1).alias("c1"), times(2).alias("c2"), F.count(F.when(F.col("n") > 2, 1)).alias("c3"))
    own = counts.select("lang", "code", "n", F.shiftright("code", BITS).alias("context"),
                        F.col("code").bitwiseAND((1 << bits) - 1).alias("suffix"))
    return (own.join(contexts, ["lang", "context"]).join(discounts, "lang")
            .join(lower.select("lang", F.col("code").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
            .select("lang", "code", F.expr("(n - CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"
                                           " + (d1 * c1 + d2 * c2 + d3 * c3) * below) / total").alias("p")))


def log_probabilities(grams: DataFrame) -> DataFrame:
    """(lang, gram, log): log10 P(last | first two) of every counted trigram, in whole ``UNIT``-ths.

    All sums are of whole numbers, so the figures do not depend on their order.
    """
    three = grams.select("lang", F.col("gram").alias("code"), "n")
    two = three.groupBy("lang", F.col("code").bitwiseAND((1 << 2 * BITS) - 1).alias("code")).agg(F.count("*").alias("n"))
    one = two.groupBy("lang", F.col("code").bitwiseAND((1 << BITS) - 1).alias("code")).agg(F.count("*").alias("n"))
    flat = one.join(one.groupBy("lang").agg(F.sum("n").alias("all")), "lang").select(
        "lang", "code", (0.99 * F.col("n") / F.col("all") + 0.01 / (1 << BITS)).alias("p"))
    p = _order(three, 2 * BITS, _order(two, BITS, flat))
    return p.select("lang", F.col("code").alias("gram"), F.round(F.log10("p") * UNIT).cast("long").alias("log"))


@dataclass
class Models:
    """All trigrams with their logarithms, and the frequent ones of each language in sorted arrays."""

    table: DataFrame
    frequent: dict[str, HashArrays]


def fit_models(docs: DataFrame, frequent: int = FREQUENT) -> Models:
    """The models of all languages of ``docs``; at most ``frequent`` trigrams reach the driver."""
    counts = dealt(count_trigrams(docs))
    table = dealt(counts.join(log_probabilities(counts), ["lang", "gram"]))
    # Trigrams by the size of their count: a few hundred rows tell which counts belong to at most ``frequent`` of them.
    size = F.floor(F.log2("n") * 32)
    least, held = float("inf"), 0
    for r in sorted(table.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["size"]):
        held += r["n"]
        if held > frequent:
            break
        least = r["size"]
    rows = table.filter(size >= F.lit(least)).orderBy("lang", "gram").select("lang", "gram", "log").toArrow()
    lang, gram, log = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(), rows.column(2).to_numpy()
    return Models(table, {x: HashArrays(gram[lang == x], log[lang == x]) for x in dict.fromkeys(lang.tolist())})


def text_logs(text: str | None, frequent: HashArrays | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Sum of the logarithms of a text's frequent trigrams, its other trigrams and how often each occurs."""
    g, n = np.unique(trigrams(text), return_counts=True)
    if frequent is None or not len(frequent.keys):
        return 0, g, n
    at = np.minimum(np.searchsorted(frequent.keys, g), len(frequent.keys) - 1)
    known = frequent.keys[at] == g
    return int((frequent.values[at] * n)[known].sum()), g[~known], n[~known]


def text_rules(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a whole text."""
    text = text or ""
    w = words(text)
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    n = len(w)
    repeated = 0
    windows = list(zip(w, w[1:], w[2:]))
    if len(set(windows)) < len(windows):
        first: dict = {}
        mark = bytearray(n)
        for i, x in enumerate(windows):
            j = first.setdefault(x, i)
            if j != i:
                mark[i:i + 3] = mark[j:j + 3] = b"\1\1\1"
        repeated = mark.count(1)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n


def _digest(lang: str, text: str | None) -> str:
    return hashlib.sha256(f"{lang}:{text or ''}".encode("utf-8", "surrogatepass")).hexdigest()


def measure(docs: DataFrame, models: Models) -> DataFrame:
    """Rules and cross entropy of each row, with its language, stored.

    The entropy is -log10 of the probability per character, the logarithm of
    the perplexity; 0 for an empty text.  ``digest`` tells texts with trigrams
    that are not frequent; it is null for all others.
    """
    frequent = models.frequent

    def run(batches):
        pid, row = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rules = [text_rules(t) for t in texts]
            logs = [text_logs(t, frequent.get(x)) for x, t in zip(langs, texts)]
            types = [pa.int64()] * 5 + [pa.bool_()]
            columns = list(zip(*rules)) if rules else [[]] * 6
            yield pa.record_batch([pa.array((pid << 40) + row + np.arange(len(texts))), batch.column(0),
                                   *(pa.array(c, t) for c, t in zip(columns, types)), batch.column(1),
                                   pa.array([len(t or "") for t in texts], pa.int64()), pa.array([x[0] for x in logs], pa.int64()),
                                   pa.array([x[1] for x in logs], pa.list_(pa.int64())),
                                   pa.array([x[2] for x in logs], pa.list_(pa.int64())),
                                   pa.array([_digest(x, t) if len(own[1]) else None for x, t, own in zip(langs, texts, logs)], pa.string())],
                                  names=["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                         "base_failed", "lang", "size", "logs", "rare", "times", "digest"])
            row += len(texts)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language().alias("lang"), "text")
    rows = dealt(own.mapInArrow(run, "row long, " + RULES + ", lang string, size long, logs long, rare array<long>, "
                                     "times array<long>, digest string"))
    rare = (rows.select("row", "lang", F.explode(F.arrays_zip("rare", "times")).alias("x"))
            .select("row", "lang", F.col("x.rare").alias("gram"), "x.times"))
    more = rare.join(models.table, ["lang", "gram"]).groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more"))
    entropy = -(F.col("logs") + F.coalesce("more", F.lit(0))) / UNIT / F.col("size")
    return dealt(rows.drop("rare", "times").join(more, "row", "left")
                 .withColumn("entropy", F.when(F.col("size") > 0, entropy).otherwise(0.0)).drop("row", "size", "logs", "more"))


def bands(measured: DataFrame, outer: float = 0.005, reach: float = 10.0, least: float = 0.005) -> DataFrame:
    """(lang, low, high): outer quantiles of the distinct texts that pass the plain rules.

    Where noise fills a tail, the quartiles widened by ``reach`` quartile
    distances are the limit.  A distance counts as ``least`` at least, and the
    band reaches six times that from the median, so that a large group of near
    copies does not make it too narrow for everything else.
    """
    texts = measured.filter(~F.col("base_failed")).dropDuplicates(["lang", "entropy", "n_words", "word_chars", "n_symbols"])
    q = texts.groupBy("lang").agg(F.percentile_approx("entropy", [outer, 0.25, 0.5, 0.75, 1 - outer], 10_000).alias("q"))
    first, quarter, middle, three, last = (F.col("q")[k] for k in range(5))
    width = reach * F.greatest(three - quarter, F.lit(least))
    return q.select("lang", F.least(F.greatest(first, quarter - width), middle - 6 * least).alias("low"),
                    F.greatest(F.least(last, three + width), middle + 6 * least).alias("high"))


def judge_documents(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, entropy, low, high).

    One row for each row of ``docs``.  Null texts count as empty and fail the
    plain rules; a null language counts as one more language; where no document
    of a language passes the plain rules there is no band and nothing further
    is rejected.  Repeated rows and null ids stay; other columns are left out.
    """
    measured = measure(docs, fit_models(docs, frequent))
    return (measured.join(F.broadcast(bands(measured)), "lang", "left")  # a row for each language: bounded
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & _inside()).alias("kept"), "entropy", "low", "high"))


def _inside() -> Column:
    return F.coalesce(F.col("entropy").between(F.col("low"), F.col("high")), F.lit(True))


def keep_passing(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``judge_documents`` keeps."""
    models = fit_models(docs, frequent)
    measured = measure(docs, models)
    band = dealt(bands(measured))
    limits = {r["lang"]: (r["low"], r["high"]) for r in band.collect()}
    # Rows whose entropy needs the joined trigrams take the verdict of their text.
    asked, given = ("_" * max(map(len, docs.columns)) + x for x in ("asked", "given"))
    verdicts = dealt(measured.filter("digest IS NOT NULL AND NOT base_failed")
                     .join(F.broadcast(band), "lang", "left").filter(_inside())
                     .select(F.col("digest").alias(given)).distinct())
    text, lang, arrays = docs.columns.index("text"), docs.columns.index("lang"), models.frequent
    plain = {a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"}

    def passes(x, t) -> tuple[bool, str | None]:
        x = x if x in plain else "other"
        if text_rules(t)[-1]:
            return False, None
        logs, rare, _ = text_logs(t, arrays.get(x))
        if len(rare):
            return True, _digest(x, t)
        least, most = limits.get(x, (-np.inf, np.inf))
        return least <= -logs / UNIT / len(t) <= most, None

    def run(batches):
        for batch in batches:
            own = list(map(passes, batch.column(lang).to_pylist(), batch.column(text).to_pylist()))
            digests = pa.array([x[1] for x in own], pa.string())
            yield pa.record_batch([*batch.columns, digests], names=[*batch.schema.names, asked]).filter(pa.array([x[0] for x in own], pa.bool_()))

    rows = docs.mapInArrow(run, StructType([*docs.schema, StructField(asked, StringType())]))
    return (rows.join(verdicts, F.col(asked) == F.col(given), "left")
            .filter(F.col(asked).isNull() | F.col(given).isNotNull()).drop(asked, given))
