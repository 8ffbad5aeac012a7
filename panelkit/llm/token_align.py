"""Cross-tokenizer alignment by diagonal run skipping.

A text is encoded by a byte-level BPE (A, over a space and the text) and by a
SentencePiece model (B, which adds the space itself). Both token sequences cover
the same bytes; where tokens of both end at the same offset, a group ends.

Method. The two arrays of token ends are walked together. At the current index
shift the ends are compared over stretches that double while they agree;
the first difference in the failing stretch ends the run, so a one-to-one run of n
tokens costs about log n block comparisons. Where the ends differ, the group is closed locally, moving
whichever side lies behind until both meet, and the shift becomes the new index
difference.

Links. Within a group every A occurrence is linked to every B occurrence. A
pair's count is the number of documents that hold it linked, over the whole
corpus. Documents are handled in bundles of bounded text; a bundle names each of
its pairs once, in the row of the first document that holds it, so only (bundle,
distinct pair) rows are shuffled to be counted and looked up, and the documents of
a bundle meet its figures in one group. No pair table is broadcast, no key collects
more than the bundles it occurs in, and no row holds more than one document.

Defined results: null and empty texts, and texts whose joined token bytes differ
from space + text (a text holding U+2581), have no tokens: zeros and ''. A text
is encoded whole, however long; its task holds it and its token arrays. Groups
of very many tokens are linked by distinct ids with multiplicities. Rows repeat
as given and each counts as a document; null ids are kept; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelkit.llm.common import written

A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: characters of text in one bundle (a longer text is a bundle of its own)
BUNDLE_CHARS = 1_000_000
#: rows hold the links of whole documents: a writer holds, and a reader takes, about this much at a time
ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "10"}
#: tokens of the first stretch compared along a diagonal
FIRST_STRETCH = 8
#: groups with more links than this are linked by distinct ids
WIDE_GROUP = 4096

#: fixed value: the public word pattern of byte-level BPE
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level BPE: printable Latin-1 stands for itself,
    the other bytes are numbered from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(shifted)}}


class ByteLevel:
    """Encoder of a byte-level BPE file. Where ids follow merge order and words
    are cut by the public pattern, tiktoken runs the same vocabulary (several
    times faster); otherwise the file's own library does."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        byte_of, vocab = byte_level_alphabet(), spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.raw = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.raw[k] = token.encode() if token in special else bytes(map(byte_of.__getitem__, token))
        self.fast = None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        cut = spec.get("pre_tokenizer") or {}
        if (made == sorted(made) and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
                and not cut.get("add_prefix_space") and not spec.get("normalizer")):
            ranks = {self.raw[k]: k for t, k in vocab.items() if t not in special}
            self.fast = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
        else:
            self.slow = Tokenizer.from_str(blob.decode())
            self.slow.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is not None:
            return [self.fast.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.slow.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """Encoder of a SentencePiece file."""

    def __init__(self, blob: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.raw = []
        for k in range(self.sp.get_piece_size()):
            piece = self.sp.id_to_piece(k)
            self.raw.append(bytes([int(piece[3:5], 16)]) if self.sp.is_byte(k) else piece.replace(MARK, " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)


def irregular_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first A, next A, first B, next B) of every group that is not one token
    to one token. Both arrays ascend and close with the same value."""
    out: list[tuple[int, int, int, int]] = []
    n, m = len(ends_a), len(ends_b)
    block_a, block_b = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    a, b = ends_a.tolist(), ends_b.tolist()
    number = int.from_bytes
    i = j = 0
    while i < n and j < m:
        if a[i] == b[j]:
            # along the diagonal: double the stretch while it agrees; where it does
            # not, the lowest differing bit tells how far it still did
            step = FIRST_STRETCH
            while True:
                x, y = block_a[8 * i:8 * (i + step)], block_b[8 * j:8 * (j + step)]
                if x != y:
                    break
                k = len(x) >> 3
                i, j = i + k, j + k
                if k < step:
                    break
                step <<= 1
            if x != y:
                size = min(len(x), len(y))
                differ = number(x[:size], "little") ^ number(y[:size], "little")
                k = (differ & -differ).bit_length() - 1 >> 6 if differ else size >> 3
                i, j = i + k, j + k
            continue
        i0, j0 = i, j
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        out.append((i0, i, j0, j))
    return out


def _flat(coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each text has."""
    n = np.array(list(map(len, coded)), dtype=np.int64)
    return np.fromiter(chain.from_iterable(coded), dtype=np.int64, count=int(n.sum())), n


class TokenBytes:
    """The bytes of every token, end to end."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(r) for r in raw], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def come_back(self, coded: list[list[int]], raw: list[bytes]) -> np.ndarray:
        """Per text: whether its tokens' joined bytes are ``raw``."""
        ids, n = _flat(coded)
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        made = np.diff(ends[np.concatenate([[0], np.cumsum(n)])])
        joined = self.table[np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])]
        want = np.array([len(r) for r in raw], dtype=np.int64)
        same = made == want
        if same.all():
            differ = joined != np.frombuffer(b"".join(raw), dtype=np.uint8)
            if differ.any():
                same[np.searchsorted(np.cumsum(want), np.flatnonzero(differ), side="right")] = False
            return same
        stops = np.cumsum(made)
        for d in np.flatnonzero(same):
            same[d] = joined[stops[d] - made[d]:stops[d]].tobytes() == raw[d]
        return same


class Aligner:
    """Both encoders and the tables by token id; one per Python worker and pair of files."""

    _made: dict[bytes, Aligner] = {}

    def __init__(self, blob_a: bytes, blob_b: bytes):
        self.a, self.b = ByteLevel(blob_a), Pieces(blob_b)
        self.bytes_a, self.bytes_b = TokenBytes(self.a.raw), TokenBytes(self.b.raw)
        self.size_a, self.size_b = self.bytes_a.size, self.bytes_b.size
        self.base = len(self.b.raw)
        self.texts = [s for k in range(len(self.a.raw)) for s in (b"%d," % k, b"%d|" % k)]
        self.texts += [s for k in range(self.base) for s in (b"%d," % k, b"%d;" % k)]

    @classmethod
    def get(cls, blob_a: bytes, blob_b: bytes) -> Aligner:
        key = hashlib.sha256(blob_a).digest() + hashlib.sha256(blob_b).digest()
        if key not in cls._made:
            cls._made[key] = cls(blob_a, blob_b)
        return cls._made[key]

    def bundle(self, texts: list[str | None]) -> Bundle:
        given = [t or "" for t in texts]
        spaced = [" " + t for t in given]
        raw = [s.encode() for s in spaced]
        coded_a, coded_b = self.a.encode(spaced), self.b.encode(given)
        same = np.array([bool(t) for t in given], dtype=bool)
        same &= self.bytes_a.come_back(coded_a, raw) & self.bytes_b.come_back(coded_b, raw)
        for d in np.flatnonzero(~same):
            coded_a[d], coded_b[d] = [], []
        (ids_a, n_a), (ids_b, n_b) = _flat(coded_a), _flat(coded_b)
        last_a, last_b = np.ones(len(ids_a), dtype=bool), np.ones(len(ids_b), dtype=bool)
        at_a, at_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        for d in range(len(texts)):
            if not n_a[d]:
                continue
            sa, sb = int(at_a[d]), int(at_b[d])
            ends_a, ends_b = np.cumsum(self.size_a[ids_a[sa:at_a[d + 1]]]), np.cumsum(self.size_b[ids_b[sb:at_b[d + 1]]])
            found = np.array(irregular_groups(ends_a, ends_b), dtype=np.int64).reshape(-1, 4)
            _inside(last_a[sa:], found[:, 0], found[:, 1])
            _inside(last_b[sb:], found[:, 2], found[:, 3])
        return Bundle(self, ids_a, ids_b, last_a, last_b, at_a, at_b)


def _inside(last: np.ndarray, first: np.ndarray, stop: np.ndarray) -> None:
    """Clear the flags of all tokens but the last of each group."""
    inner = stop - first - 1
    if inner.sum():
        last[np.repeat(first - np.cumsum(inner) + inner, inner) + np.arange(inner.sum())] = False


class Bundle:
    """Aligned texts: ids of both sides and, per token, whether it closes its group."""

    def __init__(self, made: Aligner, ids_a, ids_b, last_a, last_b, at_a, at_b):
        self.made, self.ids_a, self.ids_b, self.last_a, self.last_b, self.at_a, self.at_b = made, ids_a, ids_b, last_a, last_b, at_a, at_b
        self.group_a, self.group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        stops_a, stops_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        self.len_a, self.len_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
        self.start_a, self.start_b = stops_a - self.len_a, stops_b - self.len_b

    def n_groups(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.last_a)])[self.at_a])

    def group_texts(self) -> list[str]:
        """`a1,a2|b1;a3|b2` per text, '' without tokens."""
        codes = np.empty(len(self.ids_a) + len(self.ids_b), dtype=np.int64)
        codes[np.arange(len(self.ids_a)) + self.start_b[self.group_a]] = 2 * self.ids_a + self.last_a
        codes[np.arange(len(self.ids_b)) + (self.start_a + self.len_a)[self.group_b]] = 2 * (self.ids_b + len(self.made.a.raw)) + self.last_b
        pieces, at = self.made.texts, self.at_a + self.at_b
        return [b"".join(map(pieces.__getitem__, codes[s:e].tolist()))[:-1].decode() for s, e in zip(at[:-1], at[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of the distinct linked id pairs of each text; pair = A id * |B| + B id."""
        doc_of = np.repeat(np.arange(len(self.at_a) - 1), np.diff(self.at_a))
        wide = self.len_a * self.len_b > WIDE_GROUP
        token = np.flatnonzero(~wide[self.group_a])
        times = self.len_b[self.group_a[token]]
        first = np.repeat(self.start_b[self.group_a[token]], times)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        span = len(self.made.a.raw) * self.made.base
        keys = np.repeat(doc_of[token] * span + self.ids_a[token] * self.made.base, times) + self.ids_b[first + step]
        keys, n = np.unique(keys, return_counts=True)
        if wide.any():
            more, weight = [keys], [n]
            for g in np.flatnonzero(wide):
                a, na = np.unique(self.ids_a[self.start_a[g]:self.start_a[g] + self.len_a[g]], return_counts=True)
                b, nb = np.unique(self.ids_b[self.start_b[g]:self.start_b[g] + self.len_b[g]], return_counts=True)
                more.append((doc_of[self.start_a[g]] * span + np.add.outer(a * self.made.base, b)).ravel())
                weight.append(np.multiply.outer(na, nb).ravel())
            keys, at = np.unique(np.concatenate(more), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(weight)).astype(np.int64)
        return keys // span, keys % span, n


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for batch in batches:
        ids, texts, start, held = batch.column(0), batch.column(1), 0, 0
        for k, size in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
            if k > start and held + size > BUNDLE_CHARS:
                yield ids.slice(start, k - start), texts.slice(start, k - start).to_pylist()
                start, held = k, 0
            held += size
        if start < len(texts):
            yield ids.slice(start), texts.slice(start).to_pylist()


def _models(docs: DataFrame, a_path: str, b_path: str):
    """Both files, of fixed size, to every worker."""
    blobs = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            blobs.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(tuple(blobs))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """doc_id, a_ids, b_ids and per token whether it closes its group (a_last, b_last)."""
    files = _models(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Aligner.get(*files.value)
        for ids, texts in _bundles(batches):
            x = made.bundle(texts)
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values)) for at, values in (
                (x.at_a, x.ids_a.astype(np.int32)), (x.at_b, x.ids_b.astype(np.int32)), (x.at_a, x.last_a), (x.at_b, x.last_b))]
            yield pa.RecordBatch.from_arrays([ids, *lists], names=["doc_id", "a_ids", "b_ids", "a_last", "b_last"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(
        run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_last array<boolean>, b_last array<boolean>")


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """``values`` cut into one list per text."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def linked_documents(docs: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """One row per document: its bundle, its figures, and its links as places among the pairs
    of the bundle. ``pairs`` are those that no earlier document of the bundle holds, from place
    ``first_place`` on, ``pair_docs`` the documents of the bundle that hold them."""
    files = _models(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Aligner.get(*files.value)
        bundle = TaskContext.get().partitionId() << 33
        for ids, texts in _bundles(batches):
            x, n = made.bundle(texts), len(texts)
            doc, pair, times = x.links()
            pairs, first, at, held = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(first)                                  # links ascend by document
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            new = np.bincount(doc[first], minlength=n)
            linked = np.bincount(doc, minlength=n)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.group_texts()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, bundle)), ids, *map(pa.array, (
                    np.diff(x.at_a), np.diff(x.at_b), x.n_groups(), np.bincount(doc, weights=times, minlength=n).astype(np.int64))),
                 pa.array(digests, pa.string()), _lists(place[at], linked), _lists(times.astype(np.int64), linked),
                 pa.array(np.cumsum(new) - new), _lists(pairs[order], new), _lists(held[order], new)], names=names)
            bundle += 1

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["bundle", "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "link_at", "link_times", "first_place", "pairs", "pair_docs"]
    kinds = ["long", kind, "long", "long", "long", "long", "string", "array<int>", "array<long>", "long", "array<long>", "array<long>"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(
        run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return written(rows, "links", **ROW_GROUPS)


def pair_counts(linked: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best) over the corpus: documents holding the pair linked, and
    whether no other pair of the same A id is held by more."""
    each = linked.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p")).select("p.pairs", "p.pair_docs")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("pair_docs").alias("n"))
    counts = written(counts, "pair_counts")
    first = F.floor(F.col("pair") / F.lit(n_b)).alias("a")
    top = counts.groupBy(first).agg(F.max("n").alias("top"))
    return counts.select("pair", "n", first).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row."""
    linked = linked_documents(docs, id_col, text_col, a_path, b_path)
    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    asked = linked.select("bundle", "first_place", F.posexplode("pairs").alias("k", "pair"))
    asked = asked.select("bundle", (F.col("first_place") + F.col("k")).alias("place"), "pair")
    found = asked.join(pair_counts(linked, n_b), "pair").select(F.col("bundle").alias("of"), "place", "n", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def figures(texts: pa.Table, found: pa.Table) -> pa.Table:
        # each place of the bundle is found once
        where = found["place"].to_numpy()
        n, best = np.zeros(len(where), dtype=np.int64), np.zeros(len(where), dtype=np.int64)
        n[where], best[where] = found["n"].to_numpy(), found["best"].to_numpy()
        links = texts["link_at"].combine_chunks()
        place, times = links.flatten().to_numpy(), texts["link_times"].combine_chunks().flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy())])
        sums = [np.diff(np.concatenate([[0], np.cumsum(times * v[place])])[at]) for v in (best, n)]
        return pa.table([*(texts[c] for c in names[:5]), *map(pa.array, sums), texts["digest"]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    kept = linked.drop("first_place", "pairs", "pair_docs")
    return kept.groupBy("bundle").cogroup(found.groupBy("of")).applyInArrow(
        figures, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
