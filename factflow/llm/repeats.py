"""Repeated passages over a whole corpus: the part that substring operators share.

A text is a sequence of units (bytes or words). Two equal windows of ``window`` units
select the same place inside them: the smallest, and of equals the last, hash among
their runs of ``core`` units. So equal windows only ever meet in the group of one
anchor hash, at one offset from the anchor, and each window belongs to one anchor.

1. Every text gives its anchors, each with the interval of windows it stands for.
   Exact copies of a text are one row with a count, combined before the shuffle.
2. Anchors that occur once are dropped: their windows are unique.
3. The others take the surrounding stretch of their text along and meet by hash. Groups
   of up to ``hot`` rows are resolved in memory, a bounded chunk of groups at a time, by
   the operator's own method. Larger groups are cut at finer anchors and their pieces
   counted in Spark, which spreads one group over all tasks.
4. Spans go back to their texts. Copies of a whole text (equal SHA-256) are covered from
   end to end.

Keys that many rows share (a window, a text) are counted first, with partial sums before
the shuffle, and written; the join back then has two plain shuffles as its sides, so
adaptive execution can split the rows of one key over many tasks.

The shuffle of the texts by id is planned twice and, being equal, done once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.llm import vectext as V
from factflow.llm.shared import renamed, written

_PLACE = np.uint64((1 << 21) - 1)
_BYTES = V.mix(V._CODES[False])
PIECE, SPAN = 1 << 19, 1 << 17
CHUNK_ROWS = 2048
HOT_CORES = 1 << 20


def byte_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mixed hash, text bounds, first byte, end byte) of every byte as a unit."""
    at = np.arange(len(raw))
    return _BYTES[raw], offsets, at, at + 1


def word_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for words between white space."""
    start, end, text, h = V.words_of(raw, offsets)
    return V.mix(h), V.runs(len(offsets) - 1, text), start, end


@dataclass(frozen=True)
class Scheme:
    """What the units are, how many make a window, and how many an anchor's core.

    A second, longer window may be looked for in the same pass. It belongs to the anchor of
    the ``window`` units it begins with, so equal ones meet there too, at one offset.
    """

    units: Callable
    window: int
    core: int
    longer: int | None = None

    @property
    def spread(self) -> int:
        return self.window - self.core + 1

    @property
    def windows(self) -> list[int]:
        return [self.window, *([self.longer] if self.longer else [])]


def hashed_runs(u: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` units."""
    up, down = V._power_tables(len(u) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(u * up[: len(u)])))
        return V.mix((total[width:] - total[: max(0, len(u) + 1 - width)]) * down[: max(0, len(u) - width + 1)])


def _runs(u: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run [start, end) of units."""
    up, down = V._power_tables(len(u) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(u * up[: len(u)])))
        return V.mix((total[end] - total[start]) * down[start])


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    n, size = len(v) - width + 1, 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:n], v[width - size : width - size + n])


def anchors(u: np.ndarray, bounds: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, ...]:
    """(text, anchor place, first and last window start, core hash) of all texts' windows; places count from their text's start."""
    text, place, first, last, core = [], [], [], [], []
    for lo, hi, t in _pieces(bounds, scheme.window):
        if hi - lo < scheme.window:
            continue
        part = u[lo:hi]
        g = hashed_runs(part, scheme.core)
        least = _sliding_least((g & ~_PLACE) | (_PLACE - np.arange(len(g), dtype=np.uint64)), scheme.spread)
        # A run of windows begins where the anchor changes or a text begins, and ends with the last window that its text holds.
        head = np.concatenate(([True], least[1:] != least[:-1]))
        if t is None:
            ends = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi, "right")] - lo
            ends = np.concatenate((ends, ends - scheme.window + 1))
            head[ends[(ends >= 0) & (ends < len(head))]] = True
        start = np.flatnonzero(head)
        stop = np.concatenate((start[1:], [len(head)])) - 1
        own = np.searchsorted(bounds, lo + start, "right") - 1 if t is None else np.full(len(start), t)
        ok = lo + start + scheme.window <= bounds[own + 1]
        start, stop, own = start[ok], stop[ok], own[ok]
        if not len(start):
            continue
        at = (_PLACE - (least[start] & _PLACE)).astype(np.int64)
        base = lo - bounds[own]
        text.append(own)
        place.append(at + base)
        first.append(start + base)
        last.append(stop + base)
        core.append(g[at])
    if not text:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, (text, place, first, last, core)))


def _pieces(bounds: np.ndarray, window: int) -> Iterator[tuple[int, int, int | None]]:
    """Runs of whole texts of at most ``SPAN`` units, which a processor's cache holds; a longer text comes in pieces that share window - 1 units."""
    k, n, most = 0, len(bounds) - 1, min(PIECE, max(SPAN, 8 * window))
    while k < n:
        stop = max(k + 1, int(np.searchsorted(bounds, bounds[k] + most, "right")) - 1)
        if bounds[stop] - bounds[k] <= most:
            yield int(bounds[k]), int(bounds[stop]), None
        else:
            for lo in range(int(bounds[k]), int(bounds[stop]), most - window + 1):
                yield lo, min(lo + most, int(bounds[stop])), k
        k = stop


def _anchored(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, "text", PIECE):
                u, bounds, _, _ = scheme.units(*V.buffer_of(b.column("text")))
                text, place, first, last, core = anchors(u, bounds, scheme)
                spot = place << 20 | (place - first) << 10 | (place - last)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(text)), b.column("fp").take(pa.array(text)), pa.array(core.view(np.int64)), pa.array(spot)], names=["id", "fp", "core", "spot"])

    return run


def _stretched(scheme: Scheme):
    """Each wanted anchor with the text around it: from its first window's start to the end of its last, longest window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, "text", PIECE):
                raw, offsets = V.buffer_of(b.column("text"))
                _, bounds, start, end = scheme.units(raw, offsets)
                lists = b.column("wanted")
                rows = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                core, spot, copies = (flat.field(k).to_numpy() for k in range(3))
                place, before, least = spot >> 20, (spot >> 10) & 1023, spot & 1023
                lo = start[bounds[rows] + place - before]
                hi = end[np.minimum(bounds[rows] + place - least + max(scheme.windows), bounds[rows + 1]) - 1]
                whole_text = raw.tobytes()
                around = pa.array([whole_text[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("fp").take(at), pa.array(core), pa.array(spot), pa.array(copies), around], names=["id", "fp", "core", "spot", "copies", "around"])

    return run


@dataclass
class Groups:
    """Different stretches of whole anchor groups; ``copies`` counts the texts and places that a stretch stands for."""

    core: np.ndarray
    before: np.ndarray  # units before the anchor, the largest offset of a window's start
    least: np.ndarray  # the smallest such offset
    copies: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray


def _gathered(t: pa.Table) -> tuple[Groups, np.ndarray, np.ndarray]:
    """Groups of a table's rows, and for each row its stretch and its anchor's place."""
    core, spot, copies = (t.column(c).to_numpy() for c in ("core", "spot", "copies"))
    coded = t.column("around").combine_chunks().dictionary_encode()
    number, before, least = coded.indices.to_numpy(), (spot >> 10) & 1023, spot & 1023
    _, first, of = np.unique(number.astype(np.int64) << 20 | before << 10 | least, return_index=True, return_inverse=True)
    raw, offsets = V.buffer_of(coded.dictionary.take(pa.array(number[first])))
    return Groups(core[first], before[first], least[first], np.bincount(of, copies).astype(np.int64), raw, offsets), of, spot >> 20


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups, about ``CHUNK_ROWS`` rows at a time, from batches sorted by core."""
    held: list[pa.RecordBatch] = []
    count = 0
    for whole in batches:
        for lo in range(0, whole.num_rows, CHUNK_ROWS):
            b = whole.slice(lo, CHUNK_ROWS)
            core = b.column("core").to_numpy()
            if held and count >= CHUNK_ROWS:
                last = held[-1].column("core")[-1].as_py()
                cut = int(np.argmax(core != last)) if (core != last).any() else len(core)
                held.append(b.slice(0, cut))
                count += cut
                if cut == len(core):
                    continue
                yield pa.Table.from_batches(held)
                held, count, b = [], 0, b.slice(cut)
            held.append(b)
            count += b.num_rows
    if count:
        yield pa.Table.from_batches(held)


def _resolved(scheme: Scheme, method: Callable[[Groups, Scheme], tuple[np.ndarray, ...]]):
    """Spans of repeated windows; the method gives them by stretch and relative to the anchor, each row takes them over.

    With two windows it says fourth which of them a span is for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            g, of, place = _gathered(t)
            stretch, lo, hi, *width = method(g, scheme)
            width = width[0] if width else np.full(len(stretch), scheme.window)
            rows, n = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(g.core))
            start, times = np.cumsum(n) - n, n[stretch]
            row = rows[np.repeat(start[stretch] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks().take(at), t.column("fp").combine_chunks().take(at), pa.array(place[row] + np.repeat(lo, times)), pa.array(place[row] + np.repeat(hi, times)), pa.array(np.repeat(width, times).astype(np.int32))], names=["id", "fp", "a", "b", "width"])
            del t, g
            pa.default_memory_pool().release_unused()

    return run


def _hot_stretches(scheme: Scheme, cores: np.ndarray):
    """What ``_stretched`` gives, for the anchors of some cores in texts that were not asked for anything yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, "text", PIECE):
                raw, offsets = V.buffer_of(b.column("text"))
                u, bounds, start, end = scheme.units(raw, offsets)
                text, place, first, last, core = anchors(u, bounds, scheme)
                hot = cores[np.minimum(np.searchsorted(cores, core), len(cores) - 1)] == core
                text, place, first, last, core = (x[hot] for x in (text, place, first, last, core))
                lo = start[bounds[text] + first]
                hi = end[np.minimum(bounds[text] + last + max(scheme.windows), bounds[text + 1]) - 1]
                data = raw.tobytes() if len(text) else b""
                for k in range(0, len(text), CHUNK_ROWS):
                    part = slice(k, k + CHUNK_ROWS)
                    at = pa.array(text[part])
                    around = pa.array([data[x:y] for x, y in zip(lo[part].tolist(), hi[part].tolist(), strict=True)], pa.binary())
                    spot = (place << 20 | (place - first) << 10 | (place - last))[part]
                    ones = pa.array(np.ones(len(spot), np.int64))
                    yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("fp").take(at), pa.array(core[part].view(np.int64)), pa.array(spot), ones, around], names=["id", "fp", "core", "spot", "copies", "around"])

    return run


def _finer(scheme: Scheme):
    """Stretches (for ``scheme.window`` alone) of hot groups cut at finer anchors, whose core is nearly a window long.

    Each piece stands for the few windows that select its anchor: ``a`` is the start of the
    first, ``ws`` their hashes, ``piece`` a hash of all their text, ``shape`` where the
    anchor lies in it. Like the first anchors, the finer ones depend on windows alone.
    """
    fine = Scheme(scheme.units, scheme.window, scheme.window - max(1, scheme.spread // 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK_ROWS // 4):
                t = whole.slice(lo, CHUNK_ROWS // 4)
                spot = t.column("spot").to_numpy()
                u, bounds, _, _ = scheme.units(*V.buffer_of(t.column("around")))
                before = (spot >> 10) & 1023
                row, place, first, last, core = anchors(u, bounds, fine)
                last = np.minimum(last, (before - (spot & 1023))[row])  # windows behind it belong to the next stretch
                own = first <= last
                row, place, first, last, core = (x[own] for x in (row, place, first, last, core))
                n = last - first + 1
                w = hashed_runs(u, scheme.window)
                at = np.repeat(bounds[row] + first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                piece = V.mix(_runs(u, bounds[row] + first, bounds[row] + last + scheme.window) + n.astype(np.uint64))
                shape = (place - first) << 10 | n
                take = pa.array(row)
                columns = [t.column("id").take(take), t.column("fp").take(take), pa.array(core.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(shape), t.column("copies").take(take)]
                columns += [pa.array((spot >> 20)[row] - before[row] + first), pa.ListArray.from_arrays(pa.array(ends), pa.array(w[at].view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "core", "piece", "shape", "copies", "a", "ws"])

    return run


def _hot_spans(near: DataFrame, scheme: Scheme, key: str) -> DataFrame:
    """(id, fp, a, b, width) of hot groups: pieces are counted, and only windows of pieces that occur once are looked at one by one.

    What thousands of texts share is the same piece in all of them and counts as one row
    from the first aggregate on; most of what surrounds it has a core of its own and is
    dropped. No group is held in one place.
    """
    fine = near.mapInArrow(_finer(scheme), f"{key}, core long, piece long, shape long, copies long, a long, ws array<long>")
    one = [F.min(F.struct("id"))["id"].alias("id"), F.sum("copies").alias("copies"), F.first("core").alias("core"), F.first("ws").alias("ws")]
    fine = written(fine.groupBy("fp", "a", "piece", "shape").agg(*one))  # copies of a whole text are one
    often = written(fine.groupBy("core").agg(F.sum("copies").alias("times")).where("times > 1").select("core"))
    met = fine.join(often.hint("merge"), "core", "left_semi")
    same = ["piece", "shape"]  # they hold the core; without it the join before may be split
    pieces = written(met.groupBy(*same).agg(F.sum("copies").alias("n"), F.min(F.struct("id", "fp", "a")).alias("who"), F.first("ws").alias("ws")))
    twice = written(pieces.select(F.explode("ws").alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").select("w"))
    several = written(pieces.where("n > 1").select(*same))
    end, width = F.col("a") + F.col("shape").bitwiseAND(1023) - 1 + scheme.window, F.lit(scheme.window).alias("width")
    out = fine.join(several.hint("merge"), same, "left_semi").select("id", "fp", "a", end.alias("b"), width)
    single = pieces.where("n = 1").select("who.*", F.posexplode("ws").alias("k", "w")).join(twice.hint("merge"), "w", "left_semi")
    return out.unionByName(single.select("id", "fp", (F.col("a") + F.col("k")).alias("a"), (F.col("a") + F.col("k") + scheme.window).alias("b"), width))


def covered(docs: DataFrame, scheme: Scheme, method: Callable, id_col: str, text_col: str, hot: int, carry: str | None = None) -> DataFrame:
    """(id, text, spans[, carried]): every input row with the sorted spans (a, b, width) of units that a repeated window covers.

    ``width`` is the window's. Spans may overlap; the last one of a text with copies reaches past its end. Rows are
    told apart by id and text, so ids may be null or repeat; a null text has no units.
    """
    own = renamed(docs, id=id_col, text=text_col, **({"carried": carry} if carry else {}))
    own = own.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("fp", F.xxhash64("text"))
    kind = own.schema["id"].dataType.simpleString()
    key = f"id {kind}, fp long"
    rows = own.select("id", "text", "fp").mapInArrow(_anchored(scheme), f"{key}, core long, spot long")
    rows = rows.groupBy("core", "spot", "fp").agg(F.min(F.struct("id")).alias("who"), F.count("*").alias("copies"))
    rows = written(rows.sortWithinPartitions("fp", "spot"))  # ids and hashes of a text stand together and take less disk
    often = written(rows.groupBy("core").agg(F.sum("copies").alias("times"), F.count("*").alias("rows")).where("times > 1"))
    hot_cores = often.where(F.col("rows") > hot).select("core")
    n_hot = hot_cores.count()
    found = rows.join(often.hint("merge"), "core").select(F.col("who.id").alias("id"), "fp", F.struct("core", "spot", "copies", "rows").alias("w"))
    wanted = found.groupBy("id", "fp").agg(F.collect_list("w").alias("wanted"))

    same = own["id"].eqNullSafe(wanted["id"]) & (own["fp"] == wanted["fp"])
    # What is carried is not pruned here, or the two shuffles of the texts would differ.
    near = own.join(wanted.hint("merge"), same).select(own["id"], own["fp"], "text", "wanted", *(["carried"] if carry else []))
    schema = f"{key}, core long, spot long, copies long, around binary"

    def around(rule) -> DataFrame:
        part = near.withColumn("wanted", F.filter("wanted", rule)).where("size(wanted) > 0")
        part = part.withColumn("wanted", F.transform("wanted", lambda w: F.struct(w["core"], w["spot"], w["copies"])))
        return part.mapInArrow(_stretched(scheme), schema)

    small = around(lambda w: w["rows"] <= hot).repartition("core").sortWithinPartitions("core")
    spans = small.mapInArrow(_resolved(scheme, method), f"{key}, a long, b long, width int")
    if n_hot:
        # Their texts need no shuffle of their own: the few hot cores are looked for in the texts where they are.
        large = around(lambda w: w["rows"] > hot)
        if n_hot <= HOT_CORES:
            cores = np.array([r.core for r in hot_cores.collect()], np.int64).view(np.uint64)
            large = own.select("id", "text", "fp").mapInArrow(_hot_stretches(scheme, np.sort(cores)), schema)
        if scheme.longer:
            large = written(large)
        for window in scheme.windows:
            spans = spans.unionByName(_hot_spans(large, Scheme(scheme.units, window, scheme.core), key))
    copied = own.where(F.octet_length("text") >= scheme.window).select("id", "fp", F.unhex(F.sha2("text", 256)).alias("digest"))
    again = written(copied.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    spans = spans.unionByName(copied.join(again.hint("merge"), "digest", "left_semi").select("id", "fp", F.lit(0).cast("long").alias("a"), F.lit(1 << 60).alias("b"), F.explode(F.lit(scheme.windows).cast("array<int>")).alias("width")))
    listed = spans.groupBy("id", "fp").agg(F.sort_array(F.collect_set(F.struct("a", "b", "width"))).alias("spans"))
    same = own["id"].eqNullSafe(listed["id"]) & (own["fp"] == listed["fp"])
    return own.join(listed.hint("merge"), same, "left").select(own["id"], "text", *(["carried"] if carry else []), F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint,width:int>>")).alias("spans"))


def removal_mask(spans: pa.ListArray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Which units of all texts the spans of a window cover; texts shorter than it have none."""
    flat = spans.flatten()
    row = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy(zero_copy_only=False))
    size = np.diff(bounds)[row]
    a, b = flat.field(0).to_numpy(), np.minimum(flat.field(1).to_numpy(), size)
    ok = (size >= window) & (flat.field(2).to_numpy() == window)
    change = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(change, bounds[row][ok] + a[ok], 1)
    np.add.at(change, bounds[row][ok] + b[ok], -1)
    return np.cumsum(change[:-1]) > 0
