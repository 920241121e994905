"""Vectorised text primitives over Arrow string batches.

Everything works on the UTF-8 bytes of a whole batch at once with numpy: word
bounds, one 64-bit hash per word, hashes of word windows. Texts are whole, never
prefixes; a null text counts as empty. The per-byte arrays are built in segments
of at most ``SEGMENT`` bytes, cut at white space, so a very long text needs no
more memory per byte than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _byte_codes(fold: bool) -> np.ndarray:
    codes = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {False: _byte_codes(False), True: _byte_codes(True)}
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _PRIME))))
            _powers["down"] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, inverse))))
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets; nulls become empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``most`` bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        pa.default_memory_pool().release_unused()
        start = stop


def _segment_ends(raw: np.ndarray, space: np.ndarray) -> list[int]:
    cuts, at = [], 0
    while len(raw) - at > 2 * SEGMENT:
        window = space[raw[at + SEGMENT : at + 2 * SEGMENT]]
        k = int(np.argmax(window))
        cuts.append(at := at + SEGMENT + (k if window[k] else SEGMENT))
    return [*cuts, len(raw)]


def words_of(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number, hash) of every maximal run of non-``space`` bytes.

    ``fold`` lower-cases A-Z inside the hash. Equal words have equal hashes;
    different words share one with probability of about 2**-64.
    """
    starts, ends, hashes, at, n = [], [], [], 0, len(raw)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    for stop in _segment_ends(raw, space):
        part = raw[at:stop]
        if not len(part):
            continue
        word = ~space[part]
        head = word.copy()
        head[1:] &= ~word[:-1] | first[at + 1 : stop]
        tail = word.copy()
        tail[:-1] &= ~word[1:] | first[at + 1 : stop]
        s, e = np.flatnonzero(head), np.flatnonzero(tail) + 1
        up, down = _power_tables(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[fold][part] * up[: len(part)])))
            h = (total[e] - total[s]) * down[s]
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix(h))
        at = stop
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    s, e, h = map(np.concatenate, (starts, ends, hashes))
    return s, e, np.searchsorted(offsets, s, "right") - 1, h


def windows(h: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every window of ``width`` words inside one text."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _power_tables(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(width)) * up[: len(h)])))
        w = (total[width:] - total[:-width]) * down[:n]
    inside = text[:n] == text[width - 1 :]
    return np.flatnonzero(inside), mix(w[inside])


def runs(n_texts: int, text: np.ndarray) -> np.ndarray:
    """n_texts + 1 bounds of each text's words."""
    return np.searchsorted(text, np.arange(n_texts + 1))


def spread(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask over n places: covered by [start, start + width) of any start."""
    if not len(starts):
        return np.zeros(n, bool)
    change = np.bincount(starts, minlength=n + width + 1)[: n + width + 1].astype(np.int32)
    change[width:] -= np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int32)
    return np.cumsum(change[:n]) > 0
