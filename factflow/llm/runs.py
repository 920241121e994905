"""Periodic runs of words, from an enhanced suffix array and the branching-tandem test.

A run is a stretch of words with smallest period q, at least ``TIMES`` periods and
``LEAST`` words long, that no neighbouring word extends. Texts never share a run, so every
batch of texts is resolved where it lies, without a shuffle:

1. A word that occurs fewer than ``TIMES`` times in its stretch of text can lie in no run;
   such words part the text into shorter stretches, until nothing changes.
2. The suffix array of what is left is sorted by prefix doubling, its LCP values found by
   comparing hashes of doubled lengths, and each LCP interval is known by the previous
   and the next smaller LCP value; no tree is built.
3. In each LCP interval of depth d, every suffix i of all children but the largest looks up
   ``ISA[i + d]`` and ``ISA[i - d]``. A rank inside the interval but outside the child is a
   square of period d whose next word breaks the period.
4. Squares are rotated to the left as far as the period holds, which gives the run that
   ends where they end. Of squares with one run the smallest period counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factflow.llm import vectext as V
from factflow.llm.shared import renamed

LEAST, TIMES = 6, 4
EXPAND = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _stretches(h: np.ndarray, bounds: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of words, number of their stretch) after words that can lie in no run are gone."""
    at = np.arange(len(h))
    part = np.searchsorted(bounds, at, "right") - 1
    while len(at):
        with np.errstate(over="ignore"):
            key = V.mix(h[at] + V.mix(part.astype(np.uint64) + np.uint64(1)))
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        often = n[inverse] >= times
        kept, own = at[often], part[often]
        head = np.ones(len(kept), bool)
        head[1:] = (np.diff(kept) != 1) | (np.diff(own) != 0)
        number = np.cumsum(head) - 1
        long = np.bincount(number, minlength=1)[number] >= least
        if long.all() and len(kept) == len(at):
            return at, number
        at, part = kept[long], number[long]
    return at, part


def _symbols(h: np.ndarray, at: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All stretches in a row, an end mark of its own behind each; and the place of each symbol, -1 for the marks."""
    _, rank = np.unique(h[at], return_inverse=True)
    _, part = np.unique(part, return_inverse=True)
    marks = int(part[-1]) + 1
    spot = np.arange(len(at)) + part
    symbols = np.empty(len(at) + marks, np.int64)
    where = np.full(len(symbols), -1)
    ends = np.searchsorted(part, np.arange(marks), "right") + np.arange(marks)
    symbols[ends], symbols[spot], where[spot] = np.arange(marks), rank + marks, at
    return symbols, where


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling over the groups that are not sorted yet. The last symbol must be the only one of its kind."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    width, open_ = 1, np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(open_):
        s = order[open_]
        first, second = rank[s], rank[np.minimum(s + width, n - 1)]
        s = s[np.lexsort((second, first))]
        first, second = rank[s], rank[np.minimum(s + width, n - 1)]
        order[open_] = s
        head = np.ones(len(s), bool)
        head[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[s] = open_[np.flatnonzero(head)[np.cumsum(head) - 1]]
        open_ = open_[~(head & np.append(head[1:], True))]
        width *= 2
    return order


class _Hashed:
    """Hashes of all runs of symbols, to compare long stretches at once."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        up, self.down = V._power_tables(n + 1)
        with np.errstate(over="ignore"):
            self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(V.mix(symbols.astype(np.uint64)) * up[:n])))
        self.n = n

    def equal(self, a: np.ndarray, b: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Whether the ``width`` symbols from ``a`` and from ``b`` on are the same."""
        with np.errstate(over="ignore"):
            return (self.total[a + width] - self.total[a]) * self.down[a] == (self.total[b + width] - self.total[b]) * self.down[b]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` and ``b`` on are the same."""
        out = np.zeros(len(a), np.int64)
        for k in range(self.n.bit_length(), -1, -1):
            inside = np.flatnonzero(np.maximum(a, b) + out + (1 << k) <= self.n)
            same = self.equal(a[inside] + out[inside], b[inside] + out[inside], 1 << k)
            out[inside[same]] += 1 << k
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` and ``b`` are the same."""
        out = np.zeros(len(a), np.int64)
        for k in range(self.n.bit_length(), -1, -1):
            inside = np.flatnonzero(np.minimum(a, b) - out >= 1 << k)
            same = self.equal(a[inside] - out[inside] - (1 << k), b[inside] - out[inside] - (1 << k), 1 << k)
            out[inside[same]] += 1 << k
        return out


def previous_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value, -1 where there is none.

    Minima of blocks of doubled size are climbed until one to the left is smaller, and
    walked down again: twice the memory of ``v``, whatever the values.
    """
    most = np.iinfo(v.dtype).max
    levels = [v]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append(np.minimum(x[0::2], np.append(x[1::2], np.full(len(x) & 1, most, v.dtype))))
    node, level = np.full(len(v), -1), np.full(len(v), -1)
    todo = np.arange(len(v))
    for t, x in enumerate(levels):
        pos = todo >> t
        hit = (pos & 1).astype(bool)
        hit[hit] = x[pos[hit] - 1] < v[todo[hit]]
        node[todo[hit]], level[todo[hit]] = pos[hit] - 1, t
        todo = todo[~hit]
    for t in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(level >= t)
        right = node[down] * 2 + 1
        inside = right < len(levels[t - 1])
        inside[inside] = levels[t - 1][right[inside]] < v[down[inside]]
        node[down] = right - ~inside
    return node


def _squares(symbols: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray, _Hashed]:
    """(start, period) of squares whose next symbol breaks the period and that ``times`` periods before it keep; and the hashes."""
    n = len(symbols)
    order = suffix_order(symbols)
    isa = np.empty(n, np.int64)
    isa[order] = np.arange(n)
    hashed = _Hashed(symbols)
    lcp = np.concatenate(([-1], hashed.ahead(order[:-1], order[1:]), [-1]))
    low, high = previous_smaller(lcp), n - previous_smaller(lcp[::-1])[::-1]

    # Intervals are known by (low, high); what lies in them are single suffixes and smaller intervals.
    inner = np.flatnonzero(lcp >= 1)
    _, first = np.unique(low[inner] * (n + 1) + high[inner], return_index=True)
    inner = inner[first]
    a = np.concatenate((np.arange(n), low[inner]))
    b = np.concatenate((np.arange(n), high[inner] - 1))
    up = np.where(lcp[a] >= lcp[b + 1], a, b + 1)  # a border of the parent
    ok = (lcp[up] >= 1) & (lcp[up] * times <= n)
    a, b, up = a[ok], b[ok], up[ok]
    parent, size = low[up] * (n + 1) + high[up], b - a + 1
    order_of = np.lexsort((size, parent))
    largest = np.append(parent[order_of][1:] != parent[order_of][:-1], [True] * bool(len(parent)))
    small = np.sort(order_of[~largest])
    a, b, up, size = a[small], b[small], up[small], size[small]

    starts, periods = [], []
    cuts = np.searchsorted(np.cumsum(size), np.arange(EXPAND, int(size.sum()) + EXPAND, EXPAND), "right")
    for lo, hi in zip(np.append(0, cuts[:-1]), np.append(cuts[:-1], len(size)), strict=True):
        s = size[lo:hi]
        child = np.repeat(np.arange(lo, hi), s)
        i = order[a[child] + np.arange(len(child)) - np.repeat(np.cumsum(s) - s, s)]
        d = lcp[up[child]]
        for other, start in ((i + d, i), (i - d, i - d)):
            inside = (other >= 0) & (other < n)
            r = isa[np.where(inside, other, 0)]
            inside &= (r >= low[up[child]]) & (r < high[up[child]]) & ((r < a[child]) | (r > b[child]))
            inside &= start >= (times - 2) * d
            x, p = start[inside], d[inside]
            far = hashed.equal(x - (times - 2) * p, x - (times - 3) * p, (times - 2) * p) if times > 2 else np.ones(len(x), bool)
            starts.append(x[far])
            periods.append(p[far])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(periods or none), hashed


def runs_of(h: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, period) of all runs of the texts ``bounds``, by place; equal hashes are equal words. ``times`` is 2 or more."""
    none = np.zeros(0, np.int64)
    at, part = _stretches(h, bounds, least, times)
    if not len(at):
        return none, none, none
    symbols, where = _symbols(h, at, part)
    start, period, hashed = _squares(symbols, times)
    end = start + 2 * period
    start = start - hashed.behind(start, start + period)
    ok = end - start >= np.maximum(least, times * period)
    start, end, period = start[ok], end[ok], period[ok]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, end, period = start[new], end[new], period[new]
    first = where[start]
    by = np.lexsort((period, first))
    return first[by], (first + end - start)[by], period[by]


def _found(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in V.slices(whole, "text"):
                raw, offsets = V.buffer_of(batch.column("text"))
                start, end, text, h = V.words_of(raw, offsets)
                bounds = V.runs(batch.num_rows, text)
                a, b, period = runs_of(h, bounds, least, times)
                cover = np.zeros(len(h) + 1, np.int64)
                np.add.at(cover, a + period, 1)
                np.add.at(cover, b, -1)
                gone = np.cumsum(cover[:-1]) > 0
                data, own = raw.tobytes(), np.searchsorted(bounds, a, "right") - 1
                some = np.zeros(batch.num_rows, bool)
                some[own] = True
                left = []
                for k in range(batch.num_rows):
                    if not some[k]:
                        left.append(b" ".join(data[offsets[k] : offsets[k + 1]].split()))
                        continue
                    kept = bounds[k] + np.flatnonzero(~gone[bounds[k] : bounds[k + 1]])
                    left.append(b" ".join([data[x:y] for x, y in zip(start[kept].tolist(), end[kept].tolist(), strict=True)]))
                fields = [pa.array(a - bounds[own]), pa.array(b - a), pa.array(period)]
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(bounds)), found, pa.array(left, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return run


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """id, n_words, runs (array of start, length, period by start and period), collapsed: one row per input row.

    ``collapsed`` has the words joined by one space, each run cut down to its first period.
    Words stand between bytes 9-13 and 32. A null or empty text has no words and no runs;
    ids may be null or repeat, as rows are looked at one by one; an empty table gives an
    empty one. Other columns are ignored, whatever their names. Texts are handled whole:
    memory is about 200 bytes for each word of the longest text that may lie in a run.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return renamed(docs, id=id_col, text=text_col).mapInArrow(_found(least, times), f"id {kind}, n_words long, runs array<{RUN}>, collapsed string").withColumnRenamed("id", id_col)


def longest(runs: Column) -> Column:
    """Of an array of runs the one with most periods, compared exactly; of equals the first by start and period; null if there is none."""

    def order(x: Column, y: Column) -> Column:
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(left != right, F.when(left > right, -1).otherwise(1)).when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))

    return F.get(F.array_sort(runs, order), F.lit(0))


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The number of runs, the one with most periods, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    every = F.array_join(F.transform("runs", line), "")
    top = rows.withColumn("_top", F.when(F.size("runs") > 0, longest(F.col("runs"))))
    milli = F.expr("1000 * _top.length div _top.period")
    return top.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "_top.start", "_top.length", "_top.period", milli.alias("exponent_milli"),
        F.sha2(every.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def with_planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which every tenth document, by a checksum of its id, repeats its words from some place on.

    Of such a text with n words, the word i >= a is word a + (i - a) % p of the original.
    A row without an id or without words stays as it is.
    """
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), "[ \t\n\x0b\f\r]+")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("_h"), F.when((h % 10 == 0) & (F.btrim("text", F.lit(" \t\n\x0b\f\r")) != ""), words).alias("_w"))
    n, g = F.size("_w"), F.expr("_h div 10")
    placed = chosen.withColumn("_a", (g % n).cast("int"))
    placed = placed.withColumn("_p", F.expr("cast(1 + (size(_w) - _a) div (3 + (_h div 10) % 8) as int)"))
    block = F.expr("slice(_w, _a + 1, _p)")
    again = F.flatten(F.array_repeat(block, F.expr("cast(ceil((size(_w) - _a) / _p) as int)")))
    text = F.array_join(F.slice(F.concat(F.expr("slice(_w, 1, _a)"), again), F.lit(1), n), " ")
    return placed.select("doc_id", F.when(F.col("_w").isNotNull(), text).otherwise(F.col("text")).alias("text"))
