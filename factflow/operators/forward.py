"""Many phrases found in one pass over texts, and many searches answered part by part.

Both run on Arrow batches inside tasks. A part is some pages of a few
million tokens: one row names its pages, and a row for each phrase found there says on which of
them, by their number in the part, and how often.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.operators.search import B, K1

SPOTS = 24  # the filter of phrases has 2 ** SPOTS bits, 2 MB, however many phrases there are
PAIRS = 1 << 21  # candidates of searches that are held at once
STEP = 1 << 14
BETWEEN = "|"  # between the phrases of a search; no token holds it

_TURN, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hashed(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _joined(hashes: Sequence[np.ndarray]) -> np.ndarray:
    """The place in the filter of token sequences, from the hashes of their first, second, ... tokens."""
    met = hashes[0]
    for h in hashes[1:]:
        met = met * _TURN + h
    return (met * _SPREAD) >> np.uint64(64 - SPOTS)


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where phrases stand in the filter."""
    for b in batches:
        split = pc.split_pattern(b.column("phrase"), " ")
        n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        start, hashes = np.cumsum(n) - n, _hashed(split.flatten())
        for m in np.unique(n):
            spot = _joined([hashes[start[n == m] + j] for j in range(m)])
            yield pa.RecordBatch.from_arrays([pa.array((spot >> np.uint64(6)).astype(np.int32)), pa.array((spot & np.uint64(63)).astype(np.int32))], names=["word", "bit"])


def filter_of(phrases: DataFrame) -> tuple[bytes, list[int]]:
    """A filter of stated size that lets all ``phrases`` (phrase) through and few others, and how many tokens they have."""
    words = phrases.mapInArrow(_spots, "word int, bit int").groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    bits = np.zeros(1 << (SPOTS - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    lengths = phrases.select(F.size(F.split("phrase", " ")).alias("m")).distinct().collect()  # a few numbers
    return bits.tobytes(), sorted(r.m for r in lengths)


def _weight(tf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), values.slice(ends[0], ends[-1] - ends[0]))


def finder(filtered: bytes, lengths: Sequence[int], mean: float, k: int, schema: pa.Schema, most: int):
    """The parts, of about ``most`` tokens, of pages (url_id, scope, size, texts): their pages, and the pages of each phrase that the filter lets through.

    ``least`` of a phrase has, for each scope with ``k`` pages or more in the part, the
    k-th largest weight.
    """

    def has(spot: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(filtered, np.uint64)
        return (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1

    def blocks(name: str, phrase: pa.Array, ends: np.ndarray, page: np.ndarray, tf: np.ndarray, size: np.ndarray, scopes: pa.Array, scope: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = np.diff(ends)
        some = np.flatnonzero(np.repeat(n >= k, n))
        gram, own = np.repeat(np.arange(len(n)), n)[some], scope[page[some]]
        weight = _weight(tf[some], size[page[some]], mean)
        by = np.lexsort((-weight, own, gram))
        key = (gram * len(scopes) + own)[by]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        first = first[np.diff(np.append(first, len(key))) >= k]
        least = pa.StructArray.from_arrays([scopes.take(pa.array(key[first] % len(scopes))), pa.array(weight[by][first + k - 1])], names=["scope", "weight"])
        least_ends = np.searchsorted(key[first] // len(scopes), np.arange(len(n) + 1))
        for lo in range(0, len(n), STEP):
            hi = min(lo + STEP, len(n))
            cut = ends[lo : hi + 1]
            made = {"part": pa.array([name] * (hi - lo)), "phrase": phrase[lo:hi], "page": _lists(cut, pa.array(page.astype(np.int32))), "tf": _lists(cut, pa.array(tf.astype(np.int32))), "least": _lists(least_ends[lo : hi + 1], least)}
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(hi - lo, f.type) for f in schema], schema=schema)

    def part(name: str, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        ids, scope, size = (table.column(c).combine_chunks() for c in ("url_id", "scope", "size"))
        made = {"part": pa.array([name]), "url_id": _lists(np.array([0, len(ids)]), ids), "scope": _lists(np.array([0, len(ids)]), scope), "size": _lists(np.array([0, len(ids)]), size)}
        yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(1, f.type) for f in schema], schema=schema)
        coded = scope.dictionary_encode()
        scopes, scope, size = coded.dictionary, coded.indices.to_numpy().astype(np.int64), size.to_numpy().astype(np.int64)
        said = table.column("texts").combine_chunks().flatten()
        width, words, own = len(said) // len(size), [], []
        for f in range(width):
            text = said.take(pa.array(np.arange(len(size)) * width + f))
            split = pc.split_pattern(pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text), " ")
            n = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words.append(split.flatten())
            own.append(np.repeat(np.arange(len(size), dtype=np.int32) + np.int32(f * len(size)), n))  # each token's page and field
        coded, own = pa.concat_arrays(words).dictionary_encode(), np.concatenate(own)
        names, code = coded.dictionary, coded.indices.to_numpy()
        hashes = _hashed(names)
        for m in lengths:
            n = len(code) - m + 1
            if n <= 0:
                continue
            if m == 1:
                at = np.flatnonzero(has(_joined([hashes]))[code])
            else:
                at = np.flatnonzero(has(_joined([hashes[code[j : n + j]] for j in range(m)])) & (own[:n] == own[m - 1 :]))
            if not len(at):
                continue
            gram = code[at].astype(np.int64)
            for j in range(1, m):
                gram = np.unique(gram * len(names) + code[at + j], return_inverse=True)[1]
            key, first, tf = np.unique(gram * len(size) + own[at] % len(size), return_index=True, return_counts=True)
            start = np.flatnonzero(np.concatenate(([True], key[1:] // len(size) != key[:-1] // len(size))))
            phrase = pc.binary_join_element_wise(*[names.take(pa.array(code[at[first[start]] + j])) for j in range(m)], " ")
            yield from blocks(name, phrase, np.append(start, len(key)), key % len(size), tf, size, scopes, scope)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            ends, at = np.concatenate(([0], np.cumsum(b.column("size").to_numpy().astype(np.int64)))), 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + most - n, "right")) - 1)
                held.append(b.slice(at, to - at))
                n, at = n + ends[to] - ends[at], to
                if n >= most or at < b.num_rows:
                    yield from part(f"{task}/{no}", held)
                    no, held, n = no + 1, [], 0
        if held:
            yield from part(f"{task}/{no}", held)

    return run


def _rounded(score: np.ndarray) -> np.ndarray:
    """Millionths, halves up as of the written number; looked at closely only where a half may be meant."""
    up = score * 1e6 + 0.5
    near = np.abs(up - np.rint(up)) < 1e-4
    out = np.floor(up).astype(np.int64)
    if near.any():
        values, back = np.unique(score[near], return_inverse=True)
        out[near] = np.array([int(Decimal(repr(float(v))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP)) for v in values])[back]
    return out


class _Part:
    """The pages and phrases of a part, and the best pages there for searches."""

    def __init__(self, pages: pa.RecordBatch, blocks: list[pa.RecordBatch], mean: float, k: int) -> None:
        self.k = k
        self.ids, scope, size = (pages.column(c).flatten() for c in ("url_id", "scope", "size"))
        coded = scope.dictionary_encode()
        self.scopes, self.scope, self.by_id = coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.empty(len(scope), np.int64)
        self.by_id[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(scope))
        table = pa.Table.from_batches(blocks)
        self.phrases, page = table.column("phrase").combine_chunks(), table.column("page").combine_chunks()
        self.n = pc.list_value_length(page).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start, self.page = np.cumsum(self.n) - self.n, page.flatten().to_numpy().astype(np.int64)
        self.key = np.repeat(np.arange(len(self.n)), self.n) * len(scope) + self.page
        self.weight = _weight(table.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64), size.to_numpy()[self.page], mean)

    def best(self, asked: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        split = pc.split_pattern(asked.column("phrase"), BETWEEN)
        n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        start, ask = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        code = pc.fill_null(pc.index_in(split.flatten(), value_set=self.phrases), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        idf, skip = asked.column("idf").flatten().to_numpy(), asked.column("skip").to_numpy()
        low = np.full((len(n), len(self.scopes)), -1.0)
        lows = asked.column("lows")
        of = np.repeat(np.arange(len(n)), pc.fill_null(pc.list_value_length(lows), 0).to_numpy(zero_copy_only=False))
        where = pc.fill_null(pc.index_in(lows.flatten().field("scope"), value_set=self.scopes), -1).to_numpy(zero_copy_only=False)
        low[of[where >= 0], where[where >= 0]] = lows.flatten().field("low").to_numpy(zero_copy_only=False)[where >= 0]
        code_at, idf_at = np.full((len(n), n.max()), -1), np.zeros((len(n), n.max()))
        code_at[ask, np.arange(len(ask)) - start[ask]], idf_at[ask, np.arange(len(ask)) - start[ask]] = code, idf
        lazy = np.where(skip >= 0, code[start + np.maximum(skip, 0)], -1)
        own = np.flatnonzero((code >= 0) & (code != lazy[ask]))
        total = np.zeros(len(n), np.int64)
        np.add.at(total, ask[own], self.n[code[own]])
        turn = (np.cumsum(total) - total) // PAIRS  # some searches at once
        most = idf_at.sum(axis=1) * (K1 + 1)
        for t in np.unique(turn[ask[own]]):
            some = own[turn[ask[own]] == t]
            count = self.n[code[some]]
            term = np.repeat(some, count)
            hit = np.arange(len(term)) - np.repeat(np.cumsum(count) - count, count) + self.start[code[term]]
            reach = most[ask[term]] - idf[term] * (K1 + 1 - self.weight[hit])
            open_ = reach >= low[ask[term], self.scope[self.page[hit]]] - 1e-5
            pair = np.unique(ask[term[open_]] * len(self.scope) + self.page[hit[open_]])
            a, page = pair // len(self.scope), pair % len(self.scope)
            score = np.zeros(len(a))
            for j in range(code_at.shape[1]):
                wanted = code_at[a, j] * len(self.scope) + page
                at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
                score += np.where((code_at[a, j] >= 0) & (self.key[at] == wanted), idf_at[a, j] * self.weight[at], 0.0)
            kept = np.flatnonzero(score >= low[a, self.scope[page]] - 2e-6)
            a, page, score = a[kept], page[kept], score[kept]
            by = np.lexsort((self.by_id[page], -_rounded(score), self.scope[page], a))
            group = (a * len(self.scopes) + self.scope[page])[by]
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            by = by[place < self.k]
            made = [asked.column("phrase").take(pa.array(a[by])), self.scopes.take(pa.array(self.scope[page[by]])), self.ids.take(pa.array(page[by])), pa.array(score[by])]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, schema, strict=True)], schema=schema)


def scorer(mean: float, k: int, schema: pa.Schema):
    """The ``k`` best pages of each part and scope for every search that comes to it, with their scores.

    Rows are sorted by part and kind: the pages (0), the phrases (1), the searches (2).
    Searches go through a part a batch at a time. Their candidates are the pages of all
    their phrases but the one at ``skip``; a page below its scope's bound in ``lows`` is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = pages = part = None
        blocks: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            parts, kinds = b.column("part"), b.column("kind")
            changed = pc.or_(pc.not_equal(parts[1:], parts[:-1]), pc.not_equal(kinds[1:], kinds[:-1])).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(changed) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                piece, kind = b.slice(lo, hi - lo), kinds[lo].as_py()
                if parts[lo].as_py() != name:
                    name, pages, part, blocks = parts[lo].as_py(), None, None, []
                if kind == 0:
                    pages = piece
                elif kind == 1:
                    blocks.append(piece)
                else:
                    part = part or _Part(pages, blocks, mean, k)
                    blocks = []
                    yield from part.best(piece, schema)

    return run
