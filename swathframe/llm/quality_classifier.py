"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trained in numpy from a bounded sample of labelled documents, flattened into
arrays, and applied to every document by vectorised traversal.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.llm.common import fold_of, words

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _SPACE = bytes(range(48, 58)), b" \t\n\r\x0b\x0c"
_SYMBOLS, _MARKS = b"#*$%&|<>", b"!?"
FEATURES = 20


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; shares are 0 for an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    w, size = words(text), len(data)
    n, lines = len(w), data.split(b"\n")

    def share(chars: bytes) -> float:
        return (size - len(data.translate(None, chars))) / max(size, 1)

    counts = Counter(w)
    tops = sorted(counts.values(), reverse=True)[:10]
    pairs = len(set(zip(w, w[1:])))
    same = sum(map(bytes.__eq__, w, w[1:]))
    written = [x for x in lines if x and not x.isspace()]
    lengths = [len(x) for x in written] or [0]
    upper, lower, symbols, marks, digits, space = map(share, (_UPPER, _LOWER, _SYMBOLS, _MARKS, _DIGITS, _SPACE))
    return [np.log1p(size), np.log1p(n), size / (n + 1), len(counts) / (n + 1), tops[0] / (n + 1) if tops else 0.0,
            sum(tops) / (n + 1), pairs / (n + 1), same / (n + 1), upper, lower, symbols, marks, digits, space,
            1 - lower - upper - symbols - marks - digits - space, len(written) / (n + 1),
            1 - len(set(written)) / max(len(written), 1), max(lengths) / (size + 1), float(np.mean(lengths)),
            sum(x.isupper() for x in counts) / (len(counts) + 1)]


@dataclass
class Trees:
    """Complete trees in arrays: node k has children 2k+1 and 2k+2, leaves follow the inner nodes."""

    base: float
    depth: int
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
              least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosted trees on log loss; splits are searched on per-node histograms of gradients over quantile bins.

    Without rows, or with one class only, the model is that constant.
    """
    inner = 2 ** depth - 1
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, depth, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(width) * bins
    total = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-total))
        g, h = q - y, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = 2 ** level - 1, 2 ** level
            key = ((node - first)[:, None] * (width * bins) + flat).ravel()
            gs, hs = (np.bincount(key, np.repeat(v, width), n * width * bins).reshape(n, width, bins) for v in (g, h))
            gl, hl = gs.cumsum(2)[:, :, :-1], hs.cumsum(2)[:, :, :-1]
            gt, ht = gs.sum(2)[:, :1, None], hs.sum(2)[:, :1, None]
            gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = -1
            for j in range(width):
                gain[:, j, len(cuts[j]):] = -1
            best = gain.reshape(n, -1).argmax(1)
            for k in range(n):
                j, b = divmod(int(best[k]), bins - 1)
                if gain[k, j, b] > 1e-9:
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf = -rate * gs / (hs + ridge)
        total = total + leaf[at]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Trees(base, depth, np.array(features), np.array(thresholds), np.array(leaves))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, folds: int = 3, held: int = 1) -> Trees:
    """Model from at most ``sample`` labelled documents outside the held-out fold.

    The sample is the rows with the least hash of their id, so it is the same
    in every run; it is the only bound, and only on training.  Rows of one id
    with equal statistics, as copies have, are one row.  Null ids and labels are left out; contradicting labels of one id count as their mean
    rounded up.  Only the ids of the sample are broadcast.
    """
    chosen = (labels.filter("doc_id is not null and quality is not null").filter(fold_of("doc_id", folds) != held)
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.ceil(F.avg("quality")).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    marks = {r["doc_id"]: r["y"] for r in chosen.collect()}

    def run(batches):
        for batch in batches:
            got = [(d, marks[d], statistics(t)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                   if d in marks]
            yield pa.record_batch([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32()),
                                   pa.array([g[2] for g in got], pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = (docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, y int, x array<double>")
            .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).collect())  # ordered: sums of floats come out alike in every run
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), FEATURES)
    return fit_trees(x, np.array([r["y"] for r in rows], float))


def score_quality(docs: DataFrame, model: Trees, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null texts count as empty; repeated rows stay; other columns are left out.
    A null id is never held out.
    """
    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(2).to_pylist()], float).reshape(-1, FEATURES)
            p = model.probability(x)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model does not reject."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()], float).reshape(-1, FEATURES)
            yield batch.filter(pa.array(model.probability(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
