"""Benchmark decontamination by template canonicalisation.

Texts are cut into tokens. Numbers, names (capitalised inside a sentence) and units become
typed placeholders, everything else is lower-cased; punctuation and spacing do not count.
Windows of ``WIDTH`` tokens of the benchmark are hash-joined with those of the documents
under two keys: the lower-cased words themselves, so that a verbatim copy is found whatever
its case, its place in a sentence and its number of slots, and the template, for windows
with slots and at least one word. Matches of one document, one item and one shift form an
instance. An instance is consistent if equal slot values of the item stand for equal values
in the document, so a question asked with other numbers or names is found, and a chance
mixture is not; of an inconsistent one only the verbatim windows count. A document is
contaminated by an item if its instances cover at least ``COVER`` of the item's tokens.

Items of 2 to ``SHORTEST`` - 1 tokens, and items of nothing but slots, say too little for
that. They are found where they stand word for word from end to end, and marked as short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factflow.llm import vectext as V
from factflow.llm.shared import renamed, written

WIDTH, SHORTEST, COVER, BROADCAST_ROWS = 8, 5, 0.6, 500_000
# Unit words.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l litre litres liter liters "
    "second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees celsius fahrenheit "
    "watt watts volt volts amp amps joule joules newton newtons mph kmh"
).split()
_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = False
_BETWEEN[128:] = False
_DIGIT, _UPPER, _LOWER, _STOP = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = True
_LOWER[128:] = True
_STOP[list(b".!?\n:;\"|")] = True
NUMBER, NAME, UNIT, VERBATIM = np.uint64(101), np.uint64(102), np.uint64(103), np.uint64(104)
_UNIT_HASHES = np.sort(V.words_of(*V.buffer_of(pa.array(UNITS)), space=_BETWEEN, fold=True)[3])


def _lower_tables() -> dict[int, np.ndarray]:
    """Of all characters of 2 and of 3 bytes the lower-case one of the same length, else the character itself."""
    out = {}
    for size, stop in ((2, 0x800), (3, 0x10000)):
        table = np.arange(stop, dtype=np.int64)
        for c in range(0x80 if size == 2 else 0x800, stop):
            low = chr(c).lower()
            if len(low) == 1 and low != chr(c) and len(low.encode()) == size:
                table[c] = ord(low)
        out[size] = table
    return out


_LOWERS = _lower_tables()


def _lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with letters beyond ASCII lower-cased where that keeps their length; A-Z are folded by the hash."""
    out = raw
    for size, lead in ((2, (raw >= 0xC2) & (raw <= 0xDF)), (3, (raw >= 0xE0) & (raw <= 0xEF))):
        at = np.flatnonzero(lead[: max(0, len(raw) - size + 1)])
        parts = [raw[at + k].astype(np.int64) for k in range(size)]
        code = parts[0] & (0x1F if size == 2 else 0x0F)
        for part in parts[1:]:
            code = code << 6 | part & 0x3F
        low = _LOWERS[size][code]
        change = low != code
        for part in parts[1:]:
            change &= part >> 6 == 2
        if change.any():
            out = raw.copy() if out is raw else out
            at, low = at[change], low[change]
            for k in range(size - 1, 0, -1):
                out[at + k] = 0x80 | low & 0x3F
                low = low >> 6
            out[at] = (0xC0 if size == 2 else 0xE0) | low
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of each text's tokens, template hash, plain hash, is a slot)."""
    raw, offsets = V.buffer_of(texts)
    start, end, text, plain = V.words_of(_joined_numbers(_lowered(raw), offsets), offsets, space=_BETWEEN, fold=True)
    template = plain.copy()
    if len(start):
        head = raw[start]
        number = _DIGIT[head]
        stops = np.concatenate(([0], np.cumsum(_STOP[raw])))
        opens = np.ones(len(start), bool)
        opens[1:] = (text[1:] != text[:-1]) | (stops[start[1:]] > stops[end[:-1]])
        after = raw[np.minimum(start + 1, len(raw) - 1)]
        name = ~opens & (((end - start > 1) & _UPPER[head] & _LOWER[after]) | ((head == 0xC3) & (after >= 0x80) & (after <= 0x9E)))
        unit = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, plain), len(_UNIT_HASHES) - 1)] == plain
        for mask, kind in ((name, NAME), (unit, UNIT), (number, NUMBER)):
            template[mask] = kind
        slot = number | name | unit
    else:
        slot = np.zeros(0, bool)
    return V.runs(len(offsets) - 1, text), template, plain, slot


def _joined_numbers(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes with a point or comma between two digits made a digit, so that 3.50 is one token."""
    if len(raw) < 3:
        return raw
    inner = np.flatnonzero(((raw[1:-1] == 46) | (raw[1:-1] == 44)) & _DIGIT[raw[:-2]] & _DIGIT[raw[2:]]) + 1
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    inner = inner[~np.isin(inner, edges) & ~np.isin(inner + 1, edges)]
    if not len(inner):
        return raw
    out = raw.copy()
    out[inner] = np.where(raw[inner] == 46, 0xF8, 0xF9)  # bytes no UTF-8 text has
    return out


def _windows(width: int, keys: np.ndarray, text: np.ndarray, verbatim: bool) -> tuple[np.ndarray, np.ndarray]:
    first, w = V.windows(keys, text, width)
    return first, V.mix(w ^ VERBATIM) if verbatim else w


def _rows(ids: pa.Array, of: np.ndarray, at: np.ndarray, w: np.ndarray, first: np.ndarray, width: int, plain: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    cells = first[:, None] + np.arange(width)[None]
    slots = slot[cells].reshape(-1) if len(first) else np.zeros(0, bool)
    counts = slots.reshape(-1, width).sum(axis=1) if len(first) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    values = plain[cells].reshape(-1)[slots].view(np.int64) if len(first) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(w.view(np.int64)), pa.array(at), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["id", "w", "at", "slots"])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items: of ``WIDTH`` tokens, or the whole of a shorter item; by template only with slots and words, and only of items that are not short."""
    for b in batches:
        bounds, template, plain, slot = tokens(b.column("text"))
        size = np.diff(bounds)
        text = np.repeat(np.arange(len(size)), size)
        many = np.concatenate(([0], np.cumsum(slot)))
        short = (size < SHORTEST) | (many[bounds[1:]] - many[bounds[:-1]] == size)
        for width in range(2, WIDTH + 1):
            for verbatim in (True, False):
                first, w = _windows(width, plain if verbatim else template, text, verbatim)
                of = text[first]
                ok = (size[of] >= WIDTH) if width == WIDTH else (size[of] == width)
                if not verbatim:
                    held = many[first + width] - many[first]
                    ok &= (held > 0) & (held < width) & ~short[of]
                of, first, w = of[ok], first[ok], w[ok]
                rows = _rows(b.column("id"), of, first - bounds[of], w, first, width, plain, slot)
                more = [pa.array(np.full(len(of), width)), pa.array(size[of]), pa.array(np.full(len(of), verbatim)), pa.array(short[of])]
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*rows.schema.names, "width", "size", "verbatim", "short"])


def _document_windows(widths: list[int], known: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, "text"):
                bounds, template, plain, slot = tokens(b.column("text"))
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for width in widths:
                    for verbatim in (True, False):
                        first, w = _windows(width, plain if verbatim else template, text, verbatim)
                        if known is not None:
                            hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, w), len(known) - 1)] == w)
                            first, w = first[hit], w[hit]
                        of = text[first]
                        yield _rows(b.column("id"), of, first - bounds[of], w, first, width, plain, slot)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cover: float = COVER, broadcast_rows: int = BROADCAST_ROWS, short_items: bool = False) -> DataFrame:
    """One row per contaminated pair: id, item_id, n_tokens (of the item), n_covered, changed (slot values differ somewhere), short.

    Short items (fewer than ``SHORTEST`` tokens, or nothing but slots, such as a row of
    numbers) count only as whole verbatim copies, and are reported with ``short_items`` alone. An item of one token is not looked for:
    that would be a search for a word. Null texts hold nothing, an empty table gives no
    rows, other columns are ignored, equal items of two ids give a pair each; rows that repeat a document id are one document, and rows without an id give pairs without
    one. Item windows are counted first: up to ``broadcast_rows`` they travel to the tasks
    and documents send only windows that hit; beyond it all windows meet in a shuffle.
    """
    items = renamed(benchmark, id=item_col, text=item_text_col).where("text IS NOT NULL")
    kind = items.schema["id"].dataType.simpleString()
    indexed = written(items.mapInArrow(_item_windows, f"id {kind}, w long, at long, slots array<long>, width long, size long, verbatim boolean, short boolean").distinct())
    widths = sorted(r.width for r in indexed.select("width").distinct().collect())
    few = indexed.count() <= broadcast_rows
    known = np.unique(np.array([r.w for r in indexed.select("w").distinct().collect()], np.int64).view(np.uint64)) if few and widths else None

    own = renamed(docs, id=id_col, text=text_col).where("text IS NOT NULL")
    dkind = own.schema["id"].dataType.simpleString()
    hits = own.mapInArrow(_document_windows(widths, known), f"id {dkind}, w long, at long, slots array<long>")
    wanted = indexed.select(F.col("id").alias("item"), "w", F.col("at").alias("place"), F.col("slots").alias("asked"), "width", "size", "verbatim", "short")
    met = hits.join(F.broadcast(wanted) if few else wanted, "w")

    # The words of a verbatim match are equal, also where the document's case makes other slots of them.
    pairs = F.zip_with("asked", F.when(F.col("verbatim"), F.col("asked")).otherwise(F.col("slots")), lambda a, s: F.struct(a.alias("a"), s.alias("s")))
    places = F.sequence(F.col("place"), F.col("place") + F.col("width") - 1)

    def united(column: Column) -> Column:
        return F.array_distinct(F.flatten(F.collect_set(column)))

    shifted = met.groupBy("id", "item", "size", "short", (F.col("at") - F.col("place")).alias("shift")).agg(
        united(pairs).alias("pairs"), united(places).alias("every"), united(F.when(F.col("verbatim"), places)).alias("equal")
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"])))
    changed = consistent & F.exists("pairs", lambda p: p["a"] != p["s"])
    whole = F.size("equal") == F.col("size")
    shifted = shifted.select("id", "item", "size", "short", whole.alias("whole"), F.when(consistent, F.col("every")).otherwise(F.col("equal")).alias("places"), changed.alias("changed"))
    found = shifted.where("size(places) > 0").groupBy("id", "item", "size", "short").agg(F.size(united(F.col("places"))).cast("long").alias("n_covered"), F.min("changed").alias("changed"), F.max("whole").alias("whole"))
    enough = F.when(F.col("short"), F.col("whole")).otherwise(F.col("n_covered") >= cover * F.col("size"))
    found = found.where(enough) if short_items else found.where(enough & ~F.col("short"))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("size").alias("n_tokens"), "n_covered", "changed", "short")
