"""Byte-level BPE encoding by speculation and verification, and decoding.

Texts are cut into chunks at white space, and each chunk is encoded once per
worker and remembered in a bounded cache. For the pieces of new chunks, greedy
longest match proposes tokens; all adjacent pairs of the proposals are tested in
one vectorised pass; only pieces with an incompatible pair are merged exactly.

A proposal is right if every token stands for itself and no merge ever crosses a
boundary. Tokens on either side of a boundary are only seen by it through the
right edge of the left token's merge tree and the left edge of the right one's, so
the test walks both edges back in time, latest merge first, and looks for a merge
that would have come before the two tokens were absorbed by their parents.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.llm import vectext as V
from factflow.llm.shared import small_batches

CACHE, LONG_PIECE = 400_000, 128
_SPACE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, then 256 and on."""
    own = [b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file with its merge trees as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_characters()
        raw = {tid: bytes(of[c] for c in token) for token, tid in spec["model"]["vocab"].items()}
        self.ids = {b: tid for tid, b in raw.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = raw | {tid: s.encode() for s, tid in self.special.items()}
        size = max(self.bytes) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        vocab = spec["model"]["vocab"]
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.merges:
                self.merges[x, y] = rank, z
                if self.rank[z] < 0:
                    self.rank[z], self.left[z], self.right[z] = rank, x, y
        pairs = np.array([x * size + y for x, y in self.merges], np.int64)
        order = np.argsort(pairs)
        self.size, self._pairs, self._ranks = size, pairs[order], np.array([r for r, _ in self.merges.values()])[order]
        self.longest = ahocorasick.Automaton()
        for b, tid in self.ids.items():
            self.longest.add_word(b.decode("latin-1"), tid)
        self.longest.make_automaton()
        self._whole = np.full(size, -1, np.int8)
        lengths = np.array([len(self.bytes.get(t, b"")) for t in range(size)])
        self.blob = np.frombuffer(b"".join(self.bytes.get(t, b"") for t in range(size)), np.uint8)
        self.at, self.length = np.cumsum(lengths) - lengths, lengths
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, piece: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals."""
        if len(piece) > LONG_PIECE:
            return self._merged_by_heap(piece)
        ids, get, none = [self.ids[piece[k : k + 1]] for k in range(len(piece))], self.merges.get, (1 << 60, -1)
        near = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while near and (best := min(near)) is not none:
            k = near.index(best)
            ids[k : k + 2] = [best[1]]
            del near[k]
            if k < len(near):
                near[k] = get((ids[k], ids[k + 1]), none)
            if k:
                near[k - 1] = get((ids[k - 1], ids[k]), none)
        return ids

    def _merged_by_heap(self, piece: bytes) -> list[int]:
        """The same in O(n log n): a heap of (rank, place) and links to the neighbours; entries that have gone stale are skipped."""
        ids, get, n = [self.ids[piece[k : k + 1]] for k in range(len(piece))], self.merges.get, len(piece)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [m[0] << 32 | k for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, k = divmod(heapq.heappop(heap), 1 << 32)
            if ids[k] < 0 or (j := after[k]) >= n or not (m := get((ids[k], ids[j]))) or m[0] != rank:
                continue
            ids[k], ids[j] = m[1], -1
            behind = after[k] = after[j]
            if behind < n:
                before[behind] = k
                if m := get((ids[k], ids[behind])):
                    heapq.heappush(heap, m[0] << 32 | k)
            if (b := before[k]) >= 0 and (m := get((ids[b], ids[k]))):
                heapq.heappush(heap, m[0] << 32 | b)
        return [x for x in ids if x >= 0]

    def proposed(self, piece: bytes) -> list[int]:
        """Greedy longest match; every byte is a token, so matches leave no gap."""
        return [t for _, t in self.longest.iter_long(piece.decode("latin-1"))]

    def whole(self, tokens: np.ndarray) -> np.ndarray:
        """The tokens whose own bytes encode to them alone."""
        for t in np.unique(tokens[self._whole[tokens] < 0]).tolist():
            self._whole[t] = self.merged(self.bytes[t]) == [t]
        return self._whole[tokens] > 0

    def _rank_of(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        key = u * self.size + v
        k = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[k] == key, self._ranks[k], 1 << 60)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens: no merge crosses the boundary between them."""
        ok = np.ones(len(a), bool)
        live, u, v = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        taken_u = np.full(len(a), 1 << 59)
        taken_v = taken_u.copy()
        while len(live):
            crossing = self._rank_of(u, v)
            bad = (crossing < taken_u) & (crossing <= taken_v)
            ok[live[bad]] = False
            ru, rv = self.rank[u], self.rank[v]
            go = ~bad & ((ru >= 0) | (rv >= 0))
            live, u, v, taken_u, taken_v, ru, rv = (x[go] for x in (live, u, v, taken_u, taken_v, ru, rv))
            from_u = ru > rv
            taken_u, taken_v = np.where(from_u, ru, taken_u), np.where(from_u, taken_v, rv)
            u, v = np.where(from_u, self.right[u], u), np.where(from_u, v, self.left[v])
        return ok

    def encoded(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: proposals where every token and pair fits, exact merging elsewhere."""
        tried = [self.proposed(p) for p in pieces]
        if not pieces:
            return tried
        n = np.array([len(t) for t in tried])
        flat = np.array([t for ids in tried for t in ids], np.int64)
        last = np.zeros(len(flat), bool)
        last[np.cumsum(n) - 1] = True
        good = self.whole(flat)
        pair, place = np.unique(flat[:-1][~last[:-1]] * self.size + flat[1:][~last[:-1]], return_inverse=True)
        good[:-1][~last[:-1]] &= self.compatible(pair // self.size, pair % self.size)[place]
        good = np.logical_and.reduceat(good, np.cumsum(n) - n).tolist()
        return [ids if ok else self.merged(piece) for piece, ids, ok in zip(pieces, tried, good, strict=True)]

    def text(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        n = self.length[ids]
        return self.blob[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Cache:
    """Values of keys, each made once by fill(new keys) and kept while among the last ``CACHE`` to ``2 * CACHE`` keys met."""

    def __init__(self, fill: Callable[[list], Iterable]) -> None:
        self.fill, self.now, self.old = fill, {}, {}

    def values(self, keys: Iterable) -> Callable:
        """A getter that knows ``keys``."""
        lacking = (keys := keys if isinstance(keys, set) else set(keys)) - self.now.keys()
        if len(self.now) + len(lacking) > CACHE:
            self.now, self.old = {}, self.now
            lacking = keys
        new = [k for k in lacking if k not in self.old]
        self.now.update((k, self.old[k]) for k in lacking if k in self.old)
        self.now.update(zip(new, self.fill(new), strict=True))
        return self.now.__getitem__


def packed(texts: list[list[str]], cache: Cache) -> list[np.ndarray]:
    """The ids of each text, given as its chunks; the cache has each chunk's ids as uint32 bytes."""
    get = cache.values(set().union(*texts))
    return [np.frombuffer(b"".join(map(get, t)), np.uint32) for t in texts]


def chunk_cache(vocab: Vocabulary) -> Cache:
    pieces = Cache(lambda new: vocab.encoded([p.encode() for p in new]))

    def fill(chunks: list[str]) -> list[bytes]:
        split = [None if c in vocab.special else _PIECE.findall(c) for c in chunks]
        get = pieces.values(p for s in split for p in s or ())
        return [np.array([vocab.special[c]] if s is None else list(chain.from_iterable(map(get, s))), np.uint32).tobytes() for c, s in zip(chunks, split, strict=True)]

    return Cache(fill)


def _chunks(vocab: Vocabulary, text: str) -> list[str]:
    if not any(s in text for s in vocab.special):
        return _CHUNK.findall(text)
    return [c for part in vocab.special_split.split(text) for c in ([part] if part in vocab.special else _CHUNK.findall(part))]


def ids_batch(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))


def encode(docs: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array<int>); a null text has none.

    Equals the reference encoding of the vocabulary file without added special tokens
    at the ends; special strings inside a text are their ids. Repeated rows are encoded
    each. Nothing is shuffled, and an empty table stays empty. A column of ``docs`` that is
    already named ``ids_col`` is replaced; pass another name to keep it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        cache = chunk_cache(vocab)
        for whole in batches:
            for b in V.slices(whole, text_col):
                texts = [_chunks(vocab, t) if t else [] for t in b.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, ids_batch(packed(texts, cache))], names=[*b.schema.names, ids_col])

    small_batches(docs.sparkSession)
    docs = docs.drop(ids_col)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, vocab_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids. Null ids give an empty text, unknown ids nothing, broken UTF-8 U+FFFD.

    A column of ``rows`` that is already named ``text_col`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for b in batches:
            lists = b.column(ids_col)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))))
            texts = [vocab.text(values[lo:hi].astype(np.int64)).decode("utf-8", "replace") for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    small_batches(rows.sparkSession)
    rows = rows.drop(text_col)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def digests(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """id, n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    return rows.select(
        F.col(id_col),
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(text_col).cast("binary"), 256).alias("decoded_sha256"),
    )
