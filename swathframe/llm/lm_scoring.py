"""Language-model scoring: a causal self-attention model over subword ids, trained in numpy by all tasks.

Words and subwords are counted by Spark over all training documents.  The model
predicts the class of the next subword (classes of equal mass in those counts);
within its class a subword has its counted share.  Texts are scored in
overlapping windows: the first places are context, the others are scored, so
each token is scored once, by masked attention over a whole batch of windows.
Texts are encoded once; training and scoring read the stored ids.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.llm.common import dealt, fold_of, signed, slices, word_hashes, word_places

#: Context tokens and scored tokens of a window; width of the model; classes of the output; rows of the input table.
CONTEXT, SCORED, WIDTH, CLASSES, INPUTS = 16, 24, 16, 64, 4096
#: Frequent words whose counts and subword ids go to every task (some 5 MB at most); all others are joined or encoded there.
FREQUENT = 131_072
#: Rounds of training, each over its own share of all training rows, and sums of weights that reach the driver in a round.
ROUNDS, SUMS = 4, 16
#: Windows of a training step, and those that small inputs are trained on at least, by passing over them again.
STEP, LEAST_WINDOWS = 340, 51_200
#: Windows worked on at a time; what they touch stays in a core's cache.
BLOCK = 68
END_WORD = np.array([0x7E57_0E4D_0F_7E57], np.uint64)  # stands for the end token among word hashes
#: How far back each place of a window lies from each scored place.
BACK = np.arange(CONTEXT, CONTEXT + SCORED)[:, None] - np.arange(CONTEXT + SCORED)[None, :]
_CHUNK = 1 << 21
_COUNTS = "h long, word binary, n long"


class Subwords:
    """Subword ids of words, each as it stands after a space, by a byte-level rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 2  # the last id is the end of a text
        self.width = np.zeros(self.size, np.int64)
        self.width[list(ranks.values())] = [len(t) for t in ranks]
        self.opens = np.zeros(self.size, bool)
        self.opens[list(ranks.values())] = [t[:1] == b" " for t in ranks]

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has.

        The words are encoded as one text; where some token crosses the start
        of a word, word by word.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.array(self.coder.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "surrogatepass")), np.int64)
        ends = np.cumsum(self.width[ids])
        stop = np.cumsum([len(w) + 1 for w in words])
        at = np.searchsorted(ends, stop)
        if (ends[np.minimum(at, len(ends) - 1)] == stop).all():
            return ids, np.diff(np.concatenate([[0], at + 1]))
        own = [self.coder.encode_ordinary(" " + w.decode("utf-8", "surrogatepass")) for w in words]
        return np.array([i for x in own for i in x], np.int64), np.array([len(x) for x in own], np.int64)


def load_subwords(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _chunks(texts: list[str | None]):
    """Consecutive texts of about ``_CHUNK`` bytes, folded, as bytes."""
    own, size = [], 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass").lower()
        own.append(data)
        size += len(data)
        if size > _CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


class Words(Sequence):
    """Words of ``data`` by where they start and end; each is cut out when asked for."""

    def __init__(self, data: bytes, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end = data, start, end

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, k):
        return self.data[self.start[k]:self.end[k]]

    def cut(self, which=slice(None)) -> list[bytes]:
        return [self.data[lo:hi] for lo, hi in zip(self.start[which].tolist(), self.end[which].tolist())]


def _hashed(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as they first occur, their hashes, each word's index among them, and words per text."""
    data = b"\n".join(texts)
    found = pa.array(word_hashes(data)).dictionary_encode()
    h, inverse = found.dictionary.to_numpy(), found.indices.to_numpy().astype(np.int64)
    start, end = word_places(data)
    # A word's index is above all earlier ones where it first occurs.
    first = np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1)) if len(inverse) else np.zeros(0, np.int64)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(start, text_end), prepend=0)
    return Words(data, start[first], end[first]), h, inverse, per_text


def count_words(docs: DataFrame) -> DataFrame:
    """(h, word, n): every distinct folded word of ``docs``; tasks add up before the shuffle."""
    def run(batches):
        held, rows = [], 0

        def merged():
            return (pa.concat_tables(held).group_by(["h", "word"]).aggregate([("n", "sum")])
                    .select(["h", "word", "n_sum"]).rename_columns(["h", "word", "n"]))
        for batch in slices(batches, 2500):
            for texts in _chunks(batch.column(0).to_pylist()):
                words, h, inverse, _ = _hashed(texts)
                held.append(pa.table({"h": pa.array(signed(h)), "word": pa.array(words.cut(), pa.binary()),
                                      "n": pa.array(np.bincount(inverse, minlength=len(words)), pa.int64())}))
                rows += len(words)
                if rows > 600_000:
                    held[:] = [merged()]
                    rows = len(held[0])
                    if rows > 300_000:
                        yield from held.pop().to_batches()
                        rows = 0
        if held:
            yield from merged().to_batches()

    return docs.select("text").mapInArrow(run, _COUNTS).groupBy("h", "word").agg(F.sum("n").alias("n"))


def count_subwords(counts: DataFrame, ranks: dict[bytes, int], pattern: str) -> np.ndarray:
    """Times of each subword in all counted words; as long as the vocabulary."""
    def run(batches):
        coder = Subwords(ranks, pattern)
        total = np.zeros(coder.size, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            for lo in range(0, len(words), 100_000):
                ids, n = coder.of_words(words[lo:lo + 100_000])
                total += np.bincount(ids, np.repeat(batch.column(1).to_numpy()[lo:lo + 100_000], n),
                                     coder.size).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = counts.select("word", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max(ranks.values()) + 2, np.int64)
    out[[r["id"] for r in rows]] = [r["n"] for r in rows]
    return out


# --- model --------------------------------------------------------------------------------------------------------

def _exp_in_place(x: np.ndarray, bound: float) -> None:
    """exp of rows of ``x``, less the row's maximum where ``bound`` on its size leaves room for overflow."""
    if not bound < 60:
        x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[-1], x.dtype)


def _scatter(like: np.ndarray, at: np.ndarray, d: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Sums of the rows of ``d`` by their place in a table like ``like``, added to ``out``; two columns are added as
    one complex number."""
    out = np.zeros_like(like) if out is None else out
    pairs = np.complex64 if like.dtype == np.float32 else np.complex128
    width = like.shape[1] // 2
    np.add.at(out.reshape(-1).view(pairs), _places(len(like), width).take(at, axis=0).ravel(), d.reshape(-1).view(pairs))
    return out


@functools.cache
def _places(rows: int, width: int) -> np.ndarray:
    return np.arange(rows * width).reshape(rows, width)


class Adam:
    """Adam with decays 0.9 and 0.99; ``m`` holds ten times the mean gradient, ``s`` a hundred times the mean square."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.t = p, 0
        p.update({n: x.copy() for n, x in p.items()})
        self.m, self.s = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        """Moves the weights in place; ``g`` is used up."""
        self.t += 1
        root = (1 - 0.99 ** self.t) ** 0.5
        rate *= root / (1 - 0.9 ** self.t)
        for n, x in g.items():
            m, s = self.m[n], self.s[n]
            m *= 0.9
            m += x
            x *= x
            s *= 0.99
            s += x
            np.sqrt(s, out=x)
            x += 1e-6 * root
            np.divide(m, x, out=x)
            x *= rate
            self.p[n] -= x


@dataclass
class Attention:
    """One causal attention layer with learned distances, a path from the last token, and a class output.

    Table ``kv`` holds a token's key and value, ``qr`` its query and its direct
    path, so a window is looked up once for each pair.
    """

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, classes: int, seed: int = 3) -> Attention:
        rng = np.random.default_rng(seed)

        def table(*shape):
            return (rng.normal(size=shape) * 0.1).astype(np.float32)
        return cls({"kv": table(INPUTS, 2 * WIDTH), "qr": table(INPUTS, 2 * WIDTH),
                    "d": table(CONTEXT + SCORED), "u": table(WIDTH, classes), "c": np.zeros(classes, np.float32)})

    def shared(self):
        """What all windows share: the terms of the distances by scored place and place, and bounds on the size of
        attention scores and of class scores with ``c``."""
        p = self.p
        at = np.where(BACK < 0, p["d"].dtype.type(-1e9), p["d"][np.maximum(BACK, 0)])
        longest = [np.einsum("ij,ij->i", x, x).max() for x in (p["qr"][:, :WIDTH], p["kv"][:, :WIDTH])]
        return (at, float((longest[0] * longest[1] / WIDTH) ** 0.5 + np.abs(p["d"]).max()),
                float(np.abs(p["u"]).sum(0).max() + np.abs(p["c"]).max()))

    def logits(self, window: np.ndarray, shared: tuple):
        """Class scores of the tokens that follow the last ``SCORED`` places of each window, one row for each place and
        without the classes' own weights ``c``; what the gradients need follows.

        Place i attends to itself and all before it in the window; later places
        are masked.
        """
        p = self.p
        kv, qr = p["kv"].take(window, axis=0), p["qr"].take(window[:, CONTEXT:], axis=0)
        k, v, r = kv[..., :WIDTH], kv[..., WIDTH:], qr[..., WIDTH:]
        q = qr[..., :WIDTH] * p["kv"].dtype.type(WIDTH ** -0.5)
        a = q @ k.transpose(0, 2, 1)
        a += shared[0]
        _exp_in_place(a, shared[1])
        share = 1 / _row_sums(a)[..., None]  # narrow arrays take the division by the sum
        met = a @ v
        met *= share
        h = met + r
        np.tanh(h, out=h)
        h = h.reshape(-1, WIDTH)
        return h @ p["u"], (q, k, v, a, share, met, h)

    def likelihoods(self, x: np.ndarray, bound: float, row: np.ndarray, at: np.ndarray):
        """Natural logarithms of the probability of class ``at`` in each ``row`` of scores.  ``x`` becomes e, so that
        e * factor / sum are the probabilities of a row; returns the factors of the classes and the sums too.
        """
        c = self.p["c"]
        if bound < 60:
            chosen, factor = x[row, at] + c[at], np.exp(c)
        else:
            x += c
            x -= x.max(axis=-1, keepdims=True)
            chosen, factor = x[row, at], np.ones_like(c)
        np.exp(x, out=x)
        total = x @ factor
        return chosen - np.log(total[row]), factor, total

    def gradients(self, window: np.ndarray, target: np.ndarray) -> tuple[dict, float]:
        """Gradients of the mean negative log likelihood of ``target`` (-1: not counted)."""
        g = {name: np.zeros_like(x) for name, x in self.p.items()}
        n, loss = max(int((target >= 0).sum()), 1), 0.0
        by_place, shared = np.zeros(BACK.size, g["d"].dtype), self.shared()
        for lo in range(0, len(window), BLOCK):
            loss += self._add_gradients(window[lo:lo + BLOCK], target[lo:lo + BLOCK].ravel(), n, shared, g, by_place)
        g["d"] += np.bincount(np.maximum(BACK, 0).ravel(), by_place, CONTEXT + SCORED).astype(by_place.dtype)
        return g, loss / n

    def _add_gradients(self, window: np.ndarray, target: np.ndarray, n: int, shared: tuple, g: dict,
                       by_place: np.ndarray) -> float:
        """Adds the part of some windows to ``g`` and, for distances, to ``by_place``; returns their negative log likelihood."""
        e, (q, k, v, a, share, met, h) = self.logits(window, shared)
        p, row = self.p, np.flatnonzero(target >= 0)
        at = target[row]
        log, factor, total = self.likelihoods(e, shared[2], row, at)
        # The probabilities are e * factor * scale; both go to the narrow side of each product.
        scale = ((target >= 0) / (total * n)).astype(e.dtype)[:, None]
        e[row, at] -= total[row] / factor[at]
        g["u"] += ((h * scale).T @ e) * factor
        g["c"] += (scale[:, 0] @ e) * factor
        dz = ((e @ (p["u"] * factor).T) * ((1 - h * h) * scale)).reshape(q.shape)
        dm = dz * share
        ds = dm @ v.transpose(0, 2, 1)
        ds -= _row_sums(dm * met)[..., None]
        ds *= a  # nothing where masked: there the share is 0
        by_place += np.ones(len(ds), ds.dtype) @ ds.reshape(len(ds), -1)
        kv, qr = np.empty((*window.shape, 2 * WIDTH), ds.dtype), np.empty((*q.shape[:2], 2 * WIDTH), ds.dtype)
        np.matmul(ds.transpose(0, 2, 1), q, out=kv[..., :WIDTH])
        np.matmul(a.transpose(0, 2, 1), dm, out=kv[..., WIDTH:])
        np.multiply(ds @ k, ds.dtype.type(WIDTH ** -0.5), out=qr[..., :WIDTH])
        qr[..., WIDTH:] = dz
        for name, places, d in (("kv", window, kv), ("qr", window[:, CONTEXT:], qr)):
            _scatter(p[name], places.ravel(), d.reshape(-1, 2 * WIDTH), g[name])
        return -float(log.sum())

    def train(self, window: np.ndarray, target: np.ndarray, steps: int = 600, batch: int = 128, rate: float = 0.03,
              seed: int = 5) -> list[float]:
        """Adam; returns the losses."""
        rng, losses, adam = np.random.default_rng(seed), [], Adam(self.p)
        for t in range(1, steps + 1):
            own = rng.integers(0, len(window), batch)
            g, loss = self.gradients(window[own], target[own])
            losses.append(loss)
            adam.step(g, rate * (1 - t / (steps + 1)))
        return losses


@dataclass
class LanguageModel:
    attention: Attention
    input_of: np.ndarray  # subword id -> row of the input tables
    class_of: np.ndarray
    log_share: np.ndarray  # log10 of a subword's share of its class

    @classmethod
    def fit_counts(cls, times: np.ndarray, opens: np.ndarray) -> LanguageModel:
        """Classes of equal mass, apart for subwords that open a word, and input rows; counts are smoothed by one half."""
        by_class = np.lexsort((-times, ~opens))
        mass = times + 0.5
        upto = np.cumsum(mass[by_class])
        group = np.minimum((upto - mass[by_class] / 2) / upto[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        group = np.unique(group + CLASSES * ~opens[by_class], return_inverse=True)[1]
        order = np.argsort(-times, kind="stable")
        class_of = np.empty(len(times), np.int64)
        class_of[by_class] = group
        rank = np.empty(len(times), np.int64)
        rank[order] = np.arange(len(times))
        own = INPUTS - 513
        input_of = np.where(rank < own, rank, own + rank % 512)
        return cls(Attention.fresh(int(group.max()) + 1), input_of, class_of,
                   np.log10(mass / np.bincount(class_of, mass)[class_of]))

    def windows(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows over texts that start at ``begin`` in ``ids``: inputs, wanted ids (-1: none) and each window's text.

        Before each text stand ``CONTEXT + 1`` start marks (the last input row),
        so a text's first token has a full window too.
        """
        size = np.diff(np.append(begin, len(ids)))
        count = -(-size // SCORED)
        text = np.repeat(np.arange(len(begin)), count)
        # Every text with start marks before it and room for its last window after it.
        gap = CONTEXT + 1 + SCORED
        row, want = np.full(len(ids) + gap * len(begin), INPUTS - 1), np.full(len(ids) + gap * len(begin), -1)
        at = np.arange(len(ids)) + np.repeat(gap * np.arange(len(begin)) + CONTEXT + 1, size)
        row[at], want[at] = self.input_of[ids], ids
        start = _inner(count) * SCORED + (begin + gap * np.arange(len(begin)))[text]
        return (sliding_window_view(row, CONTEXT + SCORED)[start] if len(start) else np.zeros((0, CONTEXT + SCORED), np.int64),
                sliding_window_view(want, SCORED)[start + CONTEXT + 1] if len(start) else np.zeros((0, SCORED), np.int64), text)

    def log10_texts(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log10 probability of each text, every token scored in exactly one window."""
        window, target, text = self.windows(ids, begin)
        by_window, shared = np.zeros(len(window)), self.attention.shared()
        for lo in range(0, len(window), BLOCK):
            x = self.attention.logits(window[lo:lo + BLOCK], shared)[0]
            want = target[lo:lo + BLOCK].ravel()
            row = np.flatnonzero(want >= 0)
            own = want[row]
            log = np.zeros(len(want))
            log[row] = self.attention.likelihoods(x, shared[2], row, self.class_of[own])[0] / np.log(10.0) + self.log_share[own]
            by_window[lo:lo + BLOCK] = log.reshape(-1, SCORED).sum(1)
        return np.bincount(text, by_window, len(begin))

    def train(self, ids: np.ndarray, begin: np.ndarray) -> list[float]:
        window, target, _ = self.windows(ids, begin)
        return self.attention.train(window, np.where(target >= 0, self.class_of[np.maximum(target, 0)], -1)) if len(window) else []


def _inner(n: np.ndarray) -> np.ndarray:
    """0, 1, ... below each number of ``n``, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


@dataclass
class Spellings:
    """Subword ids of frequent words by their sorted hashes, so that tasks do not encode these again."""

    h: np.ndarray
    ids: np.ndarray
    n: np.ndarray  # 0: not spelled here

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash in ``h`` and whether it is there; sought in their order, which stays in the cache."""
        order = np.argsort(h)
        at = np.empty(len(h), np.int64)
        at[order] = np.minimum(np.searchsorted(self.h, h[order]), len(self.h) - 1)
        return at, self.h[at] == h

    def of_words(self, words: Words, found: tuple[np.ndarray, np.ndarray], coder: Subwords) -> tuple[np.ndarray, np.ndarray]:
        """As ``coder.of_words``; ``found`` is where the hashes of the words are."""
        at, there = found
        n = np.where(there, self.n[at], 0)
        known = n > 0
        own, n[~known] = coder.of_words(words.cut(~known))
        out, of_known = np.empty(int(n.sum()), np.int64), np.repeat(known, n)
        out[~of_known] = own
        out[of_known] = self.ids[np.repeat((np.cumsum(self.n) - self.n)[at[known]], n[known]) + _inner(n[known])]
        return out, n


def _token_ids(texts: list[bytes], coder: Subwords, hashed=None, spellings: Spellings | None = None,
               found=None) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of several texts, each closed by the end id, and where each text starts."""
    words, h, inverse, per_text = hashed or _hashed(texts)
    flat, n = spellings.of_words(words, found or spellings.find(signed(h)), coder) if spellings else coder.of_words(words.cut())
    first = np.cumsum(n) - n
    size = n[inverse]
    of_text = np.repeat(np.arange(len(texts)), per_text)
    length = np.bincount(of_text, size, len(texts)).astype(np.int64) + 1
    begin = np.cumsum(length) - length
    ids = np.full(int(length.sum()), coder.size - 1, np.int64)
    start = np.cumsum(size) - size + of_text  # one end id for each earlier text
    inner = _inner(size)
    ids[np.repeat(start, size) + inner] = flat[np.repeat(first[inverse], size) + inner]
    return ids, begin


def _id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<i4")


def _packed(ids: np.ndarray, begin: np.ndarray, size: int) -> pa.Array:
    """Each text's ids in one binary value; ``size`` is the length of the vocabulary."""
    data = ids.astype(_id_type(size))
    return pa.array([own.tobytes() for own in np.split(data, begin[1:])], pa.binary())


def _unpacked(batches, size: int):
    """(rows, ids, begin) for some texts at a time; the last column holds their ids."""
    kind = _id_type(size)
    for batch in slices(batches):
        texts, lo, held = batch.column(batch.num_columns - 1).to_pylist(), 0, 0
        for hi, own in enumerate(texts, 1):
            held += len(own)
            if held > _CHUNK or hi == len(texts):
                length = np.array([len(x) // kind.itemsize for x in texts[lo:hi]], np.int64)
                yield (batch.slice(lo, hi - lo), np.frombuffer(b"".join(texts[lo:hi]), kind).astype(np.int64),
                       np.cumsum(length) - length)
                lo, held = hi, 0


def train_rows(training: DataFrame, model: LanguageModel, ranks: dict[bytes, int], pattern: str, tokens: int,
               rate: float = 0.03) -> int:
    """``train_ids`` over the texts of ``training``, encoded and stored; returns the tokens it was trained on."""
    def run(batches):
        coder = Subwords(ranks, pattern)
        for batch in slices(batches, 2500):
            done = 0
            for texts in _chunks(batch.column(1).to_pylist()):
                yield pa.record_batch([batch.column(0).slice(done, len(texts)), _packed(*_token_ids(texts, coder), coder.size)], names=["round", "ids"])
                done += len(texts)

    return train_ids(dealt(training.select(_round(), "text").mapInArrow(run, "round long, ids binary")), model, tokens, rate)


def _round():
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).alias("round")


def train_ids(training: DataFrame, model: LanguageModel, tokens: int, rate: float = 0.03) -> int:
    """Trains the attention of ``model`` on all rows of ``training`` (round, ids); returns the tokens it was trained on.

    Each row belongs to one of ``ROUNDS`` rounds.  A task runs steps over the
    windows of its rows from the weights of the round before and returns
    weights times counts (a row of an input table counts as often as it was
    used), in one vector of fixed size; tasks add these up, and the sums make
    the new weights.  No text leaves its task.
    """
    passes = max(1, -(-LEAST_WINDOWS * SCORED // max(tokens, 1)))
    step = STEP if passes == 1 else STEP // 4
    names = sorted(model.attention.p)
    trained = 0
    for r in range(ROUNDS):
        def run(batches, r=r):
            net, part = Attention(dict(model.attention.p)), TaskContext.get().partitionId()
            adam, rng, used, n = Adam(net.p), np.random.default_rng((r, part)), np.zeros(INPUTS), 0
            for _, ids, begin in _unpacked(batches, len(model.class_of)):
                window, target, _ = model.windows(ids, begin)
                target = np.where(target >= 0, model.class_of[np.maximum(target, 0)], -1)
                used += np.bincount(window.ravel(), minlength=INPUTS)
                n += len(ids)
                for _ in range(passes):
                    order = rng.permutation(len(window))
                    for lo in range(0, len(order), step):
                        own = order[lo:lo + step]
                        adam.step(net.gradients(window[own], target[own])[0], rate * (1 - r / ROUNDS))
            if n:
                out = [net.p[x] * (used[:, None] if len(net.p[x]) == INPUTS else n) for x in names]
                vector = np.concatenate([*(x.ravel() for x in out), used, [n]])
                yield pa.record_batch([pa.array([part]), pa.array([vector.tobytes()], pa.binary())], names=["part", "w"])

        def add(batches):
            part, total = None, 0.0
            for batch in slices(batches, 16):
                for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    part, total = k if part is None else part, total + np.frombuffer(w)
            if part is not None:
                yield pa.record_batch([pa.array([part]), pa.array([total.tobytes()], pa.binary())], names=["part", "w"])

        own = training.filter(F.col("round") == r).select("ids")
        rows = (own.mapInArrow(run, "part long, w binary").repartition(SUMS).sortWithinPartitions("part")
                .mapInArrow(add, "part long, w binary").collect())  # SUMS vectors of fixed size
        if rows:
            total = sum(np.frombuffer(x["w"]) for x in sorted(rows, key=lambda x: x["part"]))
            used, n, at, new = total[-INPUTS - 1:-1], total[-1], 0, {}
            for x in names:
                old = model.attention.p[x]
                sums = total[at:at + old.size].reshape(old.shape)
                at += old.size
                if len(old) == INPUTS:
                    new[x] = np.where(used[:, None] > 0, sums / np.maximum(used, 1)[:, None], old).astype(np.float32)
                else:
                    new[x] = (sums / n).astype(np.float32)
            model.attention.p = new
            trained += int(n)
    return trained


def score_documents(docs: DataFrame, vocabulary: str, pattern: str, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    Null and empty texts are the end token alone.  Rows without id are training
    rows.  Repeated rows are counted and scored each for itself; other columns
    are left out.  Without training rows all counts are 0 and the model stays
    untrained.  The vocabulary file is read by the driver only.
    """
    ranks = load_subwords(vocabulary)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)).alias("held_out"), "text")
    training = own.filter(~F.col("held_out"))
    counts = dealt(count_words(training))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    total, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    # Words by the size of their count: a few hundred rows tell which counts belong to at most FREQUENT words.
    size = F.floor(F.log2("n") * 32)
    by_size = sorted((r["size"], r["words"]) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect())
    least, words = float("inf"), 0
    for s, n in reversed(by_size):
        words += n
        if words > FREQUENT:
            break
        least = s
    top = counts.filter(size >= F.lit(least)).select("h", "n", "word").toArrow()
    top_h = np.concatenate([top.column(0).to_numpy().astype(np.int64), signed(END_WORD)])
    top_n = np.concatenate([top.column(1).to_numpy(), [ends]]).astype(np.int64)
    order = np.argsort(top_h)
    coder = Subwords(ranks, pattern)
    top_words = top.column(2).to_pylist() + [b""]
    flat, sizes = coder.of_words([top_words[k] for k in order if k < len(order) - 1])
    spelled = np.zeros(len(order), np.int64)
    spelled[order < len(order) - 1] = sizes  # the end token is no word
    spellings = Spellings(top_h[order], flat.astype(np.int32), spelled)
    top_n = top_n[order]
    floor = float(np.log10(total + distinct + 1))

    times = count_subwords(counts, ranks, pattern)
    times[-1] += ends
    model = LanguageModel.fit_counts(times, coder.opens)

    def encode(batches):
        coder, pid, row = Subwords(ranks, pattern), TaskContext.get().partitionId(), 0
        for batch in slices(batches, 2500):
            done = 0
            for texts in _chunks(batch.column(3).to_pylist()):
                hashed = _hashed(texts)
                _, h, inverse, per_text = hashed
                found = spellings.find(signed(h))
                n = np.where(found[1], top_n[found[0]], 0)
                of_text = np.repeat(np.arange(len(texts)), per_text)
                logs = np.where(n > 0, np.log10(n + 1), 0.0)[inverse]
                known = np.bincount(of_text, n[inverse] > 0, len(texts)).astype(np.int64) + (ends > 0)
                base = np.bincount(of_text, logs, len(texts)) + np.log10(ends + 1) - floor * (per_text + 1)
                unknown = n[inverse] == 0
                pair, rare_n = np.unique(of_text[unknown] * len(h) + inverse[unknown], return_counts=True)
                bounds = pa.array(np.searchsorted(pair, np.arange(len(texts) + 1) * len(h)), pa.int32())
                rare = signed(h[pair % max(len(h), 1)])
                yield pa.record_batch([
                    pa.array((pid << 40) + row + np.arange(len(texts))), *(batch.column(c).slice(done, len(texts)) for c in (0, 1, 2)),
                    pa.array(per_text + 1), pa.array(known), pa.array(base),
                    *(pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (rare, rare_n)),
                    _packed(*_token_ids(texts, coder, hashed, spellings, found), coder.size)],
                    names=["row", "doc_id", "held_out", "round", "n_tokens", "n_known", "base", "rare", "times", "ids"])
                done += len(texts)
                row += len(texts)

    encoded = dealt(own.select("doc_id", "held_out", _round(), "text").mapInArrow(
        encode, "row long, doc_id long, held_out boolean, round long, n_tokens long, n_known long, base double, "
                "rare array<long>, times array<long>, ids binary"))
    train_ids(encoded.filter(~F.col("held_out")), model, int(times.sum()))

    def score(batches):
        for batch, ids, begin in _unpacked(batches, len(model.class_of)):
            yield pa.record_batch([*batch.columns[:-1], pa.array(model.log10_texts(ids, begin))],
                                  names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids").mapInArrow(
        score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", "x.rare", "x.times")
    more = (rare.join(counts.select(F.col("h").alias("rare"), "n"), "rare").groupBy("row")
            .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("gain")))
    return (scored.join(more, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                    F.lit(total).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), "score"))
