"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is normalised and marked by the model's own rules and cut before each
word mark; no piece crosses such a cut. The distinct words of a batch are
sorted, which lays them out as the depth-first order of their trie; the forward
scores of a prefix are computed once and reused by every word that shares it.

Forward step. For unigram models a prefix keeps its best score and the length
of its last piece. For BPE models (the public model given is one) scores of
pieces do not add up to the segmentation, merge order does; there a prefix's
only feasible path is kept: the last piece must be what merging yields for
itself, and it must stand next to the piece before it without merging across.
A sequence of pieces is the merged result exactly if all its neighbours are
such pairs, and each prefix has one such path, so the pass is exact. Whether a
pair stands is found by merging the two pieces alone, once per pair.

The work is per row, without a shuffle; a task holds one slice of a batch and a
bounded cache of words. Characters outside the vocabulary become byte pieces.

Defined results: null and empty texts give no ids and decode to ''. Texts of
any length are encoded whole. ``round_trip`` tells whether decoding gives the
text back; it is false for a text holding the mark U+2581 itself, which the
format turns into a space. Repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: words kept in each of two generations of the cache
CACHE_WORDS = 150_000
CACHE_PAIRS = 500_000
#: pieces are looked up by their last characters, shorter ones directly
TAIL = 4
CACHE_WORD_CHARS = 48
SLICE_CHARS = 1_000_000

_MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary:
    """Pieces, scores and byte pieces of a model. ``merges`` is true for BPE."""

    def __init__(self, pieces: list[str], scores: list[float], merges: bool, byte_ids: list[int] | None, unk_id: int,
                 special: Iterable[int] = ()):
        self.pieces, self.scores, self.merges, self.byte_ids, self.unk_id = pieces, scores, merges, byte_ids, unk_id
        hidden = {*special, unk_id, *(byte_ids or ())}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in hidden}
        self.rank = {p: scores[i] for p, i in self.ids.items()}
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            lengths.setdefault(p[-TAIL:], set()).add(len(p))
        #: lengths of the pieces that end in these TAIL characters, longest first
        self.lengths = {tail: tuple(sorted(ls, reverse=True)) for tail, ls in lengths.items() if len(tail) == TAIL}
        self.worst = min(scores) - 10.0
        self._stands: dict[int, bool] = {}         # left id * pieces + right id
        self._solid: dict[int, bool] = {}
        self.raw = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids or ()):
            self.raw[i] = bytes([b])
        for i in special:
            self.raw[i] = b""
        self.raw[unk_id] = " ⁇ ".encode()

    @classmethod
    def of(cls, sp: sentencepiece.SentencePieceProcessor) -> Vocabulary:
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in byte_ids):
            byte_ids = None
        special = [i for i in range(n) if sp.is_control(i)]
        # 1 is the unigram kind in the model format, 2 BPE
        kind = _model_kind(sp.serialized_model_proto())
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces that run across words are not supported")
        return cls(pieces, [sp.get_score(i) for i in range(n)], kind == 2, byte_ids, sp.unk_id(), special)

    # -- BPE --
    def merge(self, text: str, wall: int = 0) -> list[str] | None:
        """Greedy merging: best score first, leftmost among equals. With a
        ``wall``, None as soon as a merge runs across that place."""
        parts, rank, none = list(text), self.rank.get, -math.inf
        scores = [rank(x + y, none) for x, y in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            if wall:
                if at == wall - 1:
                    return None
                wall -= at < wall
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = rank(parts[at] + parts[at + 1], none)
            if at:
                scores[at - 1] = rank(parts[at - 1] + parts[at], none)
        return parts

    def solid(self, k: int) -> bool:
        """Whether merging yields the piece for its own text."""
        out = self._solid.get(k)
        if out is None:
            piece = self.pieces[k]
            out = self._solid[k] = self.merge(piece) == [piece]
        return out

    def stands(self, left: int, right: int) -> bool:
        """Whether merging leaves the two pieces beside each other. A character
        outside the vocabulary (-1) merges with nothing."""
        if left < 0 or right < 0:
            return right < 0 or self.solid(right)
        key = left * len(self.pieces) + right
        out = self._stands.get(key)
        if out is None:
            if len(self._stands) > CACHE_PAIRS:
                self._stands.clear()
            a, b = self.pieces[left], self.pieces[right]
            out = self._stands[key] = self.merge(a + b, len(a)) == [a, b]
        return out

    def candidates(self, word: str, i: int) -> Iterator[int]:
        """Lengths of the pieces that end word[:i], longest first; 1 always."""
        ids = self.ids
        if i >= TAIL:
            for n in self.lengths.get(word[i - TAIL:i], ()):
                if n <= i and word[i - n:i] in ids:
                    yield n
        for n in range(min(TAIL - 1, i), 1, -1):
            if word[i - n:i] in ids:
                yield n
        yield 1

    def extend_merge(self, word: str, back: list[int], last: list[int]) -> None:
        """Append the last piece's length (``back``) and id (``last``) of each
        further prefix of ``word``; index 0 is the empty prefix."""
        ids, lengths, known, pieces = self.ids, self.lengths, self._stands, len(self.pieces)
        for i in range(len(back), len(word) + 1):
            for n in (*lengths.get(word[i - TAIL:i], ()), 3, 2) if i >= TAIL else range(i, 1, -1):
                if n <= i and (k := ids.get(word[i - n:i])) is not None:
                    if n == i:
                        ok = self.solid(k)
                    else:
                        ok = known.get(last[i - n] * pieces + k)
                        if ok is None:
                            ok = self.stands(last[i - n], k)
                    if ok:
                        back.append(n)
                        last.append(k)
                        break
            else:
                back.append(1)
                last.append(ids.get(word[i - 1], -1))

    # -- decoding --
    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _model_kind(proto: bytes) -> int:
    """trainer_spec (field 2) . model_type (field 3) of the serialised model; 1 where absent."""
    def varint(b: bytes, at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (b[at] & 127) << shift
            shift += 7
            at += 1
            if b[at - 1] < 128:
                return out, at

    def fields(b: bytes):
        at = 0
        while at < len(b):
            tag, at = varint(b, at)
            if tag & 7 == 0:
                value, at = varint(b, at)
            elif tag & 7 == 2:
                n, at = varint(b, at)
                value, at = b[at:at + n], at + n
            else:
                n = 8 if tag & 7 == 1 else 4
                value, at = b[at:at + n], at + n
            yield tag >> 3, value

    for number, value in fields(proto):
        if number == 2:
            return next((v for k, v in fields(value) if k == 3), 1)
    return 1


def encode_words(vocab: Vocabulary, words: Iterable[str]) -> dict[str, list[int]]:
    """Ids of each distinct word; sorted words share the forward pass of their prefixes."""
    out: dict[str, list[int]] = {}
    back, last, best, before, merges = [0], [-1], [0.0], "", vocab.merges
    for word in sorted(words):
        shared, top = 0, min(len(before), len(word))
        while shared < top and before[shared] == word[shared]:
            shared += 1
        del back[shared + 1:]
        if merges:
            del last[shared + 1:]
            vocab.extend_merge(word, back, last)
        else:
            del best[shared + 1:]
            extend_best(vocab, word, back, best)
        path, i = [], len(word)
        while i:
            n = back[i]
            k = last[i] if merges else vocab.ids.get(word[i - n:i], -1)
            if k >= 0:
                path.append(k)
            elif vocab.byte_ids:
                path.extend(vocab.byte_ids[b] for b in reversed(word[i - n:i].encode("utf-8", "surrogatepass")))
            else:
                path.append(vocab.unk_id)
            i -= n
        path.reverse()
        out[word] = path
        before = word
    return out


def extend_best(vocab: Vocabulary, word: str, back: list[int], best: list[float]) -> None:
    """Append the last piece's length and the best score of each further prefix."""
    for i in range(len(back), len(word) + 1):
        n, score = 1, best[i - 1] + vocab.rank.get(word[i - 1], vocab.worst)
        for k in vocab.candidates(word, i):
            if k > 1 and best[i - k] + vocab.rank[word[i - k:i]] > score:
                n, score = k, best[i - k] + vocab.rank[word[i - k:i]]
        back.append(n)
        best.append(score)


def marked_words(normal: str) -> list[str]:
    """The normalised text cut before each run of marks."""
    return _MARKED.findall(normal)


class Encoder:
    """A model with its word cache; one per Python worker and model."""

    _made: dict[bytes, Encoder] = {}

    def __init__(self, proto: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.vocab = Vocabulary.of(self.sp)
        self.cache: dict[str, bytes] = {}        # word -> its ids as 32-bit numbers
        self.older: dict[str, bytes] = {}

    @classmethod
    def get(cls, proto: bytes) -> Encoder:
        key = hashlib.sha256(proto).digest()
        if key not in cls._made:
            cls._made[key] = cls(proto)
        return cls._made[key]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the new words of all of them go through one trie."""
        cut = [self.cut(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache      # words in use move on to the new generation
        cache = self.cache
        fresh = set(chain.from_iterable(cut)).difference(cache)
        for word in fresh.intersection(self.older):
            cache[word] = self.older[word]
        fresh.difference_update(self.older)
        for word, ids in encode_words(self.vocab, fresh).items():
            cache[word] = array("i", ids).tobytes()
        out = [np.frombuffer(b"".join(map(cache.__getitem__, words)), dtype=np.int32) for words in cut]
        for word in fresh:
            if len(word) > CACHE_WORD_CHARS:
                del cache[word]
        return out

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        normal = self.sp.normalize(text)
        if normal.startswith(MARK) and not normal.endswith(MARK) and MARK * 2 not in normal:
            # single marks only: cutting at them is all there is to do
            return (MARK + normal[1:].replace(MARK, "\0" + MARK)).split("\0") if "\0" not in normal else marked_words(normal)
        return marked_words(normal)


def _slices(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Rows in slices of bounded text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_CHARS:
            yield start, [t or "" for t in column.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, [t or "" for t in column.slice(start).to_pylist()]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, token_ids, n_tokens, n_chars, decoded_sha256, round_trip per row."""
    with open(model_path, "rb") as f:
        proto = f.read()
    # the model is a file of fixed size (about 0.5 MB), not data
    model = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(model.value)
        decode = encoder.vocab.decode
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                ids = encoder.encode(texts)
                back = [decode(x.tolist()) for x in ids]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(texts)), lists, pa.array(n), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]),
                    pa.array([a == b for a, b in zip(texts, back)])],
                    names=["doc_id", "token_ids", "n_tokens", "n_chars", "decoded_sha256", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(
        run, f"doc_id {kind}, token_ids array<int>, n_tokens long, n_chars long, decoded_sha256 string, round_trip boolean")


def decode_documents(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, text for rows of token ids (null: '')."""
    with open(model_path, "rb") as f:
        proto = f.read()
    model = tokens.sparkSession.sparkContext.broadcast(proto)

    @F.pandas_udf("string")
    def text(ids):
        decode = Encoder.get(model.value).vocab.decode
        return ids.map(lambda x: "" if x is None else decode(np.asarray(x).tolist()), na_action=None)

    return tokens.select(F.col(id_col).alias("doc_id"), text(F.col(ids_col)).alias("text"))
