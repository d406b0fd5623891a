"""Byte-level BPE encoding and decoding through a sentencepiece model built from the vocabulary.

The rank file is written as a sentencepiece BPE model: each token is a piece
whose bytes stand as printable characters and whose score is its negative rank,
with identity normalisation.  Merging by highest score is then merging by
lowest rank.  Pre-tokens are encoded one by one; decoding maps each piece's
characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as proto

from swathframe.llm.common import space_chunks

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of a task's cache of encoded words, and the longest word (in characters) that is kept there; only speed depends on them.
CACHE, LONGEST = 128 << 20, 64
#: Bytes of Python objects that an entry takes besides its characters.
_ENTRY = 320


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else the next one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def build_model(ranks: dict[bytes, int]) -> bytes:
    """Serialised sentencepiece model whose piece ids are the ranks (which must be 0, 1, 2, ...)."""
    chars = byte_characters()
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be consecutive from 0")
    model = proto.ModelProto()
    for rank, token in enumerate(order):
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank),
                         type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes with a serialised model; ``pattern`` cuts a text into pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        n = self.pieces.get_piece_size() - 1
        self.token_bytes = [bytes(back[c] for c in self.pieces.id_to_piece(i)) for i in range(n)]
        self.whole = {t: i for i, t in enumerate(self.token_bytes)}
        self.first: dict[str, tuple] = {}
        self.later: dict[str, tuple] = {}
        self.held = 0  # bytes of both caches

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        """A pre-token that is itself a token is that token; others are merged by the model."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        ids = [[self.whole[b]] if b in self.whole else None for b in raw]
        rest = [i for i, x in enumerate(ids) if x is None]
        mapped = [raw[i].decode("latin-1").translate(self.to_chars) for i in rest]
        for i, x in zip(rest, self.pieces.encode(mapped, num_threads=1)):
            ids[i] = x
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.encode_pretokens(self.pattern.findall(text or "")) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def _forms(self, new: list[str], lead: str) -> dict[str, tuple]:
        """Encoded forms (ids as text, count, decoded bytes) of pieces of text."""
        cut = [self.pattern.findall(lead + x) for x in new]
        known = list({p for c in cut for p in c})
        ids = dict(zip(known, self.encode_pretokens(known)))
        out = {}
        for x, c in zip(new, cut):
            own = [i for p in c for i in ids[p]]
            out[x] = (" ".join(map(str, own)), len(own), self.decode(own))
        return out

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(tokens, digest of the ids, digest of the decoded bytes) of each text.

        Words recur, so a text is cut before single spaces, where a pre-token
        always begins, and each distinct piece is encoded once.  Long pieces
        (texts without blanks) are forgotten after this call.
        """
        cut = []
        for t in texts:
            c = space_chunks(t or "")
            cut.append((c[:1], c[1:]) if c is not None else (self.pattern.findall(t), []))
        if self.held > CACHE:
            self.first.clear()
            self.later.clear()
            self.held = 0
        long = []
        for cache, lead, side in ((self.first, "", 0), (self.later, " ", 1)):
            new = list({x for c in cut for x in c[side]} - cache.keys())
            forms = self._forms([x for x in new if len(x) <= LONGEST], lead)
            self.held += sum([_ENTRY + 2 * len(x) + len(f[0]) + len(f[2]) for x, f in forms.items()])
            cache.update(forms)
            long.append(self._forms([x for x in new if len(x) > LONGEST], lead))
        out = []
        for pieces in cut:
            got = [cache[x] if len(x) <= LONGEST else once[x]
                   for own, cache, once in zip(pieces, (self.first, self.later), long) for x in own]
            ids = " ".join([x[0] for x in got if x[1]])
            out.append((sum([x[1] for x in got]), hashlib.sha256(ids.encode()).hexdigest(),
                        hashlib.sha256(b"".join([x[2] for x in got])).hexdigest()))
        return out


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row of ``docs``.

    Null and empty texts have no tokens and the digests of the empty string.
    Other columns of ``docs`` are left out; repeated rows and null ids stay.
    The vocabulary file is read by the driver only.  Tasks hold a batch at a
    time; no shuffle.
    """
    model = build_model(load_ranks(vocabulary))

    def run(batches):
        codec = Codec(model, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 1000):
                got = codec.digests(texts[lo:lo + 1000])
                yield pa.record_batch([ids.slice(lo, 1000), *(pa.array(c, t) for c, t in zip(
                    zip(*got), (pa.int64(), pa.string(), pa.string())))],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
