"""Substring dedup by relative Lempel-Ziv parsing over words.

Stretches of text that share an anchor (see ``repeats``) meet in one group. Every stretch
is a reference block, indexed by the hash of each ``WINDOW``-word seed in it. A stretch is
factored greedily from left to right: at a place whose seed stands in another block the
factor runs on for as long as both go on alike; a place without one is a literal. A factor
holds at least ``WINDOW`` words, so it is a duplicate span. Windows that straddle its end
may still match a third block, so parsing goes on at the first of them, not behind the
factor: every window lies inside a factor or is looked up itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.llm import repeats as R
from factflow.llm import vectext as V

WINDOW, CORE, HOT = 35, 6, 50_000
SCHEME = R.Scheme(R.word_units, WINDOW, CORE)


def partners(seeds: np.ndarray, core: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For each seed, another place with the same seed in its group; its own if its text has copies; else -1."""
    order = np.lexsort((seeds, core))
    s, c = seeds[order], core[order]
    same = (s[1:] == s[:-1]) & (c[1:] == c[:-1])
    out = np.where(copies > 1, np.arange(len(seeds)), -1)
    out[order[:-1][same]] = order[1:][same]
    first = same & ~np.concatenate(([False], same[:-1]))[: len(same)]
    out[order[1:][same]] = order[:-1][same]
    out[order[:-1][first]] = order[1:][first]
    return out


def parsed(seeds: list[int], other: list[int], stop: list[int], lo: int) -> list[tuple[int, int]]:
    """Factors of the seeds [lo, stop[lo]) as runs of seed places [first, end)."""
    out, x, hi = [], lo, stop[lo]
    while x < hi:
        ref = other[x]
        if ref < 0:
            x += 1
            continue
        y, r, r_end = x + 1, ref + 1, stop[ref]
        if ref == x:
            while y < hi and other[y] == y:
                y += 1
        else:
            while y < hi and r < r_end and seeds[y] == seeds[r]:
                y += 1
                r += 1
        out.append((x, y))
        x = y
    return out


def repeated_windows(g: R.Groups, scheme: R.Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, end) of the spans, relative to the anchor, of all windows that occur more than once."""
    units, bounds, _, _ = scheme.units(g.raw, g.offsets)
    n = g.before - g.least + 1
    row = np.repeat(np.arange(len(n)), n)
    base = np.cumsum(n) - n
    inside = np.arange(len(row)) - base[row]
    seeds = R.hashed_runs(units, scheme.window)[bounds[row] + inside]
    other = partners(seeds, g.core[row], g.copies[row])
    has = np.flatnonzero(np.add.reduceat((other >= 0).astype(np.int64), base)) if len(base) else np.zeros(0, np.int64)
    s, o, stop = seeds.tolist(), other.tolist(), (base + n)[row].tolist()
    spans = [(k, x - int(base[k]), y - int(base[k])) for k in has.tolist() for x, y in parsed(s, o, stop, int(base[k]))]
    k, x, y = np.array(spans, np.int64).reshape(-1, 3).T
    return k, x - g.before[k], y - 1 + scheme.window - g.before[k]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in V.slices(whole, "text", R.PIECE):
            raw, offsets = V.buffer_of(b.column("text"))
            _, bounds, start, end = R.word_units(raw, offsets)
            gone = R.removal_mask(b.column("spans"), bounds, WINDOW)
            total = np.concatenate(([0], np.cumsum(gone)))
            data, kept = raw.tobytes(), []
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                stay = np.flatnonzero(~gone[x:y]) + x
                kept.append(b" ".join([data[p:q] for p, q in zip(start[stay].tolist(), end[stay].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(bounds)), pa.array(np.diff(total[bounds])), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, n_words, n_removed, kept (the remaining words joined by one space), one row per input row.

    A word goes if a ``WINDOW``-word sequence that covers it starts anywhere else too, in
    the same text or another; sequences are judged on the input and never cross texts. All
    places lose it, the first one too. Null texts have no words; ids may be null or repeat;
    equal rows each lose the same words. Other columns are ignored, an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = R.covered(docs, SCHEME, repeated_windows, id_col, text_col, hot)
    return out.mapInArrow(_cut, f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return rows.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
