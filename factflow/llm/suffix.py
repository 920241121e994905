"""Suffix-array dedup of byte passages, with a linear grouping construction.

Passages of ``WINDOW`` bytes that occur at two places are found group by group (see
``repeats``). The stretches to the right of a group's anchors are cut into blocks of
``BLOCK`` bytes, the blocks ranked in byte order, and the suffix array of all stretches of
a chunk built over the ranks:

* Phase 1 keeps suffixes grouped by their Lyndon prefix. Groups are processed in
  descending order. Each suffix of the group finds its previous smaller suffix by pointer
  jumping; the suffixes found are split off to the end of their own groups, those that were
  found more often further up, for their prefixes grow by that many copies.
* Phase 2 walks the result once: the suffix before each one, and from there along the
  previous-smaller pointers, takes the next free place of its group. No names are renewed
  and nothing recurses.

The bytes to the left of the anchors, read backwards, stand in the same array. With the byte
LCPs of neighbours, the stretches that agree for at least ``window - e`` bytes to the right
are intervals of the array, and so are those that agree for ``e`` bytes to the left; what
lies in both the same right and the same left interval holds equal windows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.llm import repeats as R
from factflow.llm import vectext as V

# 51 words of four letters with a space between them have 254 bytes.
WINDOW, PASSAGE, CORE, BLOCK, HOT = 400, 254, 64, 32, 20_000
SCHEME = R.Scheme(R.byte_units, WINDOW, CORE)
CELLS, STEP = 1 << 18, 1 << 10


def _ints(values: np.ndarray) -> array:
    """Four bytes a number, where a list takes about forty."""
    return array("i", values.astype(np.int32).tobytes())


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Start places of all suffixes in order; ``symbols`` are non-negative ints.

    An end mark below all symbols is understood, so a suffix stands before those it begins.
    """
    n = len(symbols)
    order = _ints(np.argsort(np.array(symbols, np.int64), kind="stable"))
    group, end, spot = _ints(np.zeros(n)), _ints(np.zeros(n + 1)), _ints(np.zeros(n))
    start, last = 0, None
    for k, s in enumerate(order):
        if symbols[s] != last:
            start, last = k, symbols[s]
        group[s], spot[s] = start, k
        end[start] = k + 1
    before, jump = _ints(np.full(n, -1)), _ints(np.full(n, -1))
    stop = n
    while stop:
        start = group[order[stop - 1]]
        found: dict[int, int] = {}
        for s in sorted(order[start:stop]):
            p, seen = s - 1, []
            while p >= 0 and group[p] >= start:
                seen.append(p)
                p = jump[p]
            for q in seen:
                jump[q] = p
            before[s] = jump[s] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, times in found.items():
            by_times.setdefault(times, []).append(p)
        for times in sorted(by_times, reverse=True):
            of_group: dict[int, list[int]] = {}
            for p in by_times[times]:
                of_group.setdefault(group[p], []).append(p)
            for g, members in of_group.items():
                top = end[g]
                new = top - len(members)
                if new == g:
                    continue
                k = top
                for p in members:  # each changes places with what stands at the end
                    k -= 1
                    q, at = order[k], spot[p]
                    order[at], order[k] = q, p
                    spot[q], spot[p] = at, k
                for p in members:
                    group[p] = new
                end[g], end[new] = new, top
        stop = start

    out, free, placed = _ints(np.full(n, -1)), _ints(np.arange(n)), bytearray(n)
    last = n - 1
    for k in range(-1, n):
        s = last if k < 0 else out[k] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
    return out.tolist()


def _sides(g: R.Groups, scheme: R.Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes from each anchor on, and those before it in reverse, one row a stretch; and how many there are."""
    size, before = np.diff(g.offsets), g.before
    right = size - before
    wide = max(scheme.windows) + (-(max(scheme.windows) - scheme.core) % BLOCK)
    deep = scheme.spread - 1 + (-(scheme.spread - 1) % BLOCK)
    ahead, behind = np.zeros((len(size), wide), np.uint8), np.zeros((len(size), deep), np.uint8)
    for lo in range(0, len(size), STEP):
        row = lo + np.repeat(np.arange(len(size[lo : lo + STEP])), size[lo : lo + STEP])
        raw = g.raw[g.offsets[lo] : g.offsets[lo] + len(row)]
        place = np.arange(len(row)) + (g.offsets[lo] - g.offsets[row] - before[row])
        after = place >= 0
        ahead[row[after], place[after]] = raw[after]
        behind[row[~after], -1 - place[~after]] = raw[~after]
    return ahead, right, behind, before


def _blocks(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows cut into blocks, each with the number of bytes in use behind it: a text stands before those it begins."""
    n, wide = text.shape
    out = np.zeros((n, wide // BLOCK, BLOCK + 1), np.uint8)
    out[:, :, :BLOCK] = text.reshape(n, -1, BLOCK)
    out[:, :, BLOCK] = np.clip(size[:, None] - BLOCK * np.arange(wide // BLOCK)[None], 0, BLOCK)
    return out


def _common(text: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For rows in order, how many bytes each has in common with the one before it; 0 for the first."""
    lcp = np.zeros(len(rows), np.int64)
    for lo in range(1, len(rows), STEP):
        a, b = rows[lo - 1 : lo + STEP - 1], rows[lo : lo + STEP]
        a = a[: len(b)]
        differ = text[a] != text[b]
        lcp[lo : lo + STEP] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1]), np.minimum(size[a], size[b]))
    return lcp


def repeated_windows(g: R.Groups, scheme: R.Scheme) -> tuple[np.ndarray, ...]:
    """(stretch, start, end[, window]) of the spans, relative to the anchor, that the windows found more than once cover.

    All windows of one length of a stretch hold its anchor, so what they cover is one span.
    The fourth column is there if the scheme has two windows. Memory is a few hundred bytes
    a stretch beside the texts.
    """
    n, core = len(g.core), scheme.core
    ahead, right, behind, before = _sides(g, scheme)
    blocks = [_blocks(ahead[:, core:], right - core), _blocks(behind, before)]
    shape = [b.shape[:2] for b in blocks]
    used = [b[:, :, BLOCK] > 0 for b in blocks]
    _, rank = np.unique(np.concatenate([b.reshape(-1, BLOCK + 1) for b in blocks]).view(f"S{BLOCK + 1}"), return_inverse=True)
    del blocks
    rank = rank.reshape(-1) + 2
    top = int(rank.max(initial=1)) + 2
    _, name = np.unique(g.core, return_inverse=True)
    lines, cut = [], shape[0][0] * shape[0][1]
    # A line is its head, its blocks and an end mark; heads of right sides are the groups, those of left sides stand above.
    for part, (rows, width), use, head in ((rank[:cut], shape[0], used[0], top + name), (rank[cut:], shape[1], used[1], np.full(n, top + n))):
        line = np.concatenate((head[:, None], np.where(use, part.reshape(rows, width), -1), np.ones((rows, 1), np.int64)), axis=1)
        lines.append((line.reshape(-1), line.shape[1]))
    symbols = np.concatenate([x for x, _ in lines])
    keep = symbols >= 0
    at = np.cumsum(keep) - 1
    heads = np.concatenate((at[: len(lines[0][0]) : lines[0][1]], at[len(lines[0][0]) :: lines[1][1]]))
    found = np.array(suffix_array(_ints(np.append(symbols[keep], 0))), np.int32)
    owner = np.full(len(found), -1)
    owner[heads] = np.arange(2 * n)
    rows = owner[found]
    del symbols, keep, at, heads, found, owner
    rows = rows[rows >= 0]
    by_right, by_left = rows[rows < n], rows[rows >= n] - n

    lcp = _common(ahead, right, by_right)
    lcp[1:] *= g.core[by_right[1:]] == g.core[by_right[:-1]]
    lcs = _common(behind, before, by_left)
    del ahead, behind
    spot = np.empty(n, np.int64)
    spot[by_left] = np.arange(n)
    spot = spot[by_right]
    least, most, copies, reach = g.least[by_right], before[by_right], g.copies[by_right], right[by_right]
    ends = [(window, np.full(n, window), np.full(n, -1)) for window in scheme.windows]
    step = max(1, CELLS // max(1, n))
    for lo in range(int(least.min(initial=scheme.window)), int(most.max(initial=-1)) + 1, step):
        e = np.arange(lo, min(lo + step, int(most.max()) + 1))
        same_left = np.cumsum(lcs[:, None] < e[None], axis=0)[spot]
        own = (least[:, None] <= e[None]) & (e[None] <= most[:, None])
        for window, low, high in ends:
            k, c = np.nonzero(own & (window - e[None] <= reach[:, None]))  # a longer window may not fit into the text
            same_right = np.cumsum(lcp[:, None] < (window - e)[None], axis=0)
            key = (c * (n + 1) + same_right[k, c]) * (n + 1) + same_left[k, c]
            _, which = np.unique(key, return_inverse=True)
            many = np.bincount(which, copies[k])[which] > 1
            np.minimum.at(low, k[many], e[c[many]])
            np.maximum.at(high, k[many], e[c[many]])
    found = []
    for window, low, high in ends:
        hit = np.flatnonzero(high >= 0)
        found.append((by_right[hit], -high[hit], window - low[hit], np.full(len(hit), window)))
    return tuple(map(np.concatenate, zip(*found, strict=True)))[: 4 if scheme.longer else 3]


def _cut(batches: Iterator[pa.RecordBatch], window: int, passage: int | None = None) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in V.slices(whole, "text", R.PIECE):
            raw, offsets = V.buffer_of(b.column("text"))
            gone = R.removal_mask(b.column("spans"), offsets, window)
            total = np.concatenate(([0], np.cumsum(gone)))
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            inner = offsets[1:-1][offsets[1:-1] < len(raw)]
            starts[inner] = gone[inner]
            runs = np.concatenate(([0], np.cumsum(starts)))
            kept = [raw[x:y][~gone[x:y]].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = {"id": b.column("id"), "n_bytes": np.diff(offsets), "n_removed": np.diff(total[offsets]), "n_spans": np.diff(runs[offsets]), "kept": pa.array(kept, pa.binary())}
            if passage:
                within = np.concatenate(([0], np.cumsum(R.removal_mask(b.column("spans"), offsets, passage))))
                columns["n_in_passages"] = np.diff(within[offsets])
            yield pa.RecordBatch.from_pydict(columns)


def scheme_of(window: int) -> R.Scheme:
    """Windows of ``window`` bytes, ``2 * CORE`` at least, with anchors of ``CORE``."""
    return R.Scheme(R.byte_units, window, CORE)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, window: int = WINDOW, passage: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the remaining bytes)[, n_in_passages], one row per input row.

    A byte goes if a ``window``-byte string that covers it starts anywhere else too, in
    the same text or another; strings are judged on the input and never cross texts. All
    places lose it, the first one too. Null texts are empty; ids may be null or repeat.
    Equal rows each lose the same bytes. Other columns are ignored, whatever their names.
    An empty table gives no rows.

    With ``passage``, a number of bytes below ``window``, ``n_in_passages`` counts in the same
    pass the bytes that repeated strings of that length cover; they are only removed where a
    ``window`` covers them too.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if passage and not 2 * CORE <= passage < window:
        raise ValueError(f"a passage has {2 * CORE} to {window - 1} bytes")
    scheme = R.Scheme(R.byte_units, passage, CORE, window) if passage else scheme_of(window)
    out = R.covered(docs, scheme, repeated_windows, id_col, text_col, hot)
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary" + (", n_in_passages long" if passage else "")
    return out.mapInArrow(lambda batches: _cut(batches, window, passage), schema).withColumnRenamed("id", id_col)


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    more = [c for c in ("n_in_passages",) if c in rows.columns and c != id_col]
    return rows.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *more)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, window: int = WINDOW) -> DataFrame:
    """``docs`` with all columns and repeated passages gone from the text; a character that lost a byte goes whole.

    Rows stay, also those whose text is null (it becomes empty) or repeated from end to end.
    An empty table stays empty.
    """
    whole = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]))
    out = R.covered(whole, scheme_of(window), repeated_windows, id_col, text_col, hot, carry="_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, b in zip(_cut(iter([batch]), window), V.slices(batch, "text", R.PIECE), strict=True):
                text = pa.array([x.decode("utf-8", "ignore") for x in cut.column("kept").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("carried"), text], names=["carried", "text"])

    done = out.mapInArrow(run, T.StructType([T.StructField("carried", out.schema["carried"].dataType), T.StructField("text", T.StringType())]))
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"carried.`{c}`").alias(c) for c in docs.columns])
