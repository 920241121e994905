"""Token ids in seekable zstandard files.

A shard holds the documents of one range of ids in ascending order. Each document is
one independent zstandard frame of its ids as little-endian uint32. A skippable frame
with the document ids (int64) follows, and then the seek table of the public
zstandard seekable format: for each frame the compressed size, the size and the low
half of the XXH64 of its content, then the number of frames, a descriptor and a magic
number. A reader fetches the tail, then only the frames it wants, and checks each.

Shards are written under a name of the attempt and moved into place, so repeated and
lost attempts leave nothing behind that is read.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factflow.llm import vectext as V
from factflow.llm.shared import renamed, shared_folder, written

SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
NO_ID = -(1 << 63)
CACHE = 600_000
_MARKS = b".,;:!?#$%&*"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = _MARK[list(_MARKS)] = True


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _library(vocab_path: str) -> tuple[Callable, Callable]:
    """Encoders of plain segments, many as one text, and of any other chunk on its own.

    A plain segment is one piece for the library, so segments with a space between them
    are told apart by the library's piece numbers.
    """
    t = _tokenizer(vocab_path)

    def together(text: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
        e = t.encode(text.decode(), add_special_tokens=False)
        n = np.bincount(np.array(e.word_ids, np.int64), minlength=count)
        if len(n) != count or not n.all():
            raise ValueError("pieces differ from words")
        return np.array(e.ids, np.uint32), n

    def alone(chunks: list[bytes]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]

    return together, alone


@dataclass
class Segments:
    """Places of segments in ``low``: runs of letters, of marks behind them, and whole chunks that hold anything else."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    plain: np.ndarray
    text: np.ndarray


def segments(raw: np.ndarray, offsets: np.ndarray) -> Segments:
    """Chunks between white space, cut where the library cuts them whatever their letters are.

    Letters are those of ASCII and Latin-1, lower-cased here as the library does; marks are
    ``_MARKS``. A chunk that is not letters and then marks stays whole, as it is written.
    """
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    low, space = _LOWER[raw], V.SPACE[raw]
    trail = np.zeros(n, bool)
    trail[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    low[trail & (raw <= 0x9E)] += 0x20
    letter = _LETTER[low] | trail
    letter[:-1] |= trail[1:]
    mark = _MARK[low]
    odd = ~(letter | mark | space)
    odd[1:] |= letter[1:] & mark[:-1] & ~first[1:n]
    head, tail = ~space, ~space
    head[1:] &= space[:-1] | first[1:n]
    tail[:-1] &= space[1:] | first[1:n]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    odds, letters = (np.concatenate(([0], np.cumsum(x, dtype=np.int32))) for x in (odd, letter))
    plain = odds[end] == odds[start]
    middle = np.where(plain, start + letters[end] - letters[start], end)
    if not plain.all():
        whole = np.zeros(n + 1, np.int32)
        whole[start[~plain]] += 1
        np.subtract.at(whole, end[~plain], 1)
        low = np.where(np.cumsum(whole[:n]) > 0, raw, low)
    lo, hi = np.stack((start, middle), axis=1).reshape(-1), np.stack((middle, end), axis=1).reshape(-1)
    some = lo < hi
    lo, hi = lo[some], hi[some]
    return Segments(low, lo, hi, np.repeat(plain, 2)[some], np.searchsorted(offsets, lo, "right") - 1)


def _taken(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``values`` of all runs [start, start + n), one after the other."""
    return values[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class TokenTable:
    """Ids of all segments met, found by hash and then compared byte by byte; begun anew beyond ``CACHE`` segments."""

    def __init__(self, vocab_path: str) -> None:
        self.together, self.alone = _library(vocab_path)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.ids_at, self.n_ids = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _added(self, g: Segments, which: np.ndarray) -> np.ndarray:
        """Encode the segments; returns their new rows."""
        start, size = g.start[which], (g.end - g.start)[which]
        ids, n = [self.ids], np.zeros(len(which), np.int64)
        order = np.concatenate((np.flatnonzero(g.plain[which]), np.flatnonzero(~g.plain[which])))
        start, size, n_plain = start[order], size[order], int(g.plain[which].sum())
        for lo in range(0, n_plain, 4096):
            part = size[lo : min(lo + 4096, n_plain)]
            text = np.full(int(part.sum()) + len(part) - 1, 32, np.uint8)
            at = np.cumsum(part + 1) - part - 1
            text[np.repeat(at - (np.cumsum(part) - part), part) + np.arange(int(part.sum()))] = _taken(g.low, start[lo : lo + len(part)], part)
            got, n[lo : lo + len(part)] = self.together(text.tobytes(), len(part))
            ids.append(got)
        others = self.alone([g.low[x : x + k].tobytes() for x, k in zip(start[n_plain:].tolist(), size[n_plain:].tolist(), strict=True)])
        n[n_plain:] = [len(x) for x in others]
        ids.append(np.array([t for x in others for t in x], np.uint32))
        rows = np.empty(len(which), np.int64)
        rows[order] = len(self.size) + np.arange(len(which))
        self.at = np.concatenate((self.at, len(self.bytes) + np.cumsum(size) - size))
        self.ids_at = np.concatenate((self.ids_at, len(self.ids) + np.cumsum(n) - n))
        self.bytes, self.size = np.concatenate((self.bytes, _taken(g.low, start, size))), np.concatenate((self.size, size))
        self.ids, self.n_ids = np.concatenate(ids), np.concatenate((self.n_ids, n))
        return rows

    def _rows(self, g: Segments) -> np.ndarray:
        up, down = V._power_tables(len(g.low) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(V._CODES[False][g.low] * up[: len(g.low)])))
            h, one, of = np.unique((total[g.end] - total[g.start]) * down[g.start], return_index=True, return_inverse=True)
        if len(self.size) + len(h) > CACHE:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        known = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        row = np.empty(len(h), np.int64)
        row[known] = self.rows[at[known]]
        if not known.all():
            row[~known] = self._added(g, one[~known])
            keys = np.concatenate((self.keys, h[~known]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], np.concatenate((self.rows, row[~known]))[order]
        row, size = row[of], g.end - g.start
        same = self.size[row] == size
        here, there = _taken(g.low, g.start[same], size[same]), _taken(self.bytes, self.at[row[same]], size[same])
        if not np.array_equal(here, there):
            begin = np.cumsum(size[same]) - size[same]
            same[np.flatnonzero(same)[np.add.reduceat(here != there, begin) > 0]] = False
        if not same.all():  # another segment has this hash
            row[~same] = self._added(g, np.flatnonzero(~same))
        return row

    def encoded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of ids of each text, all their ids); a text longer than two ``SEGMENT`` gives several, each with all texts counted."""
        raw, offsets = V.buffer_of(texts)
        for lo, hi in _parts(raw):
            bounds = np.clip(offsets - lo, 0, hi - lo)
            g = segments(raw[lo:hi], bounds)
            row = self._rows(g)
            n = self.n_ids[row]
            yield np.bincount(g.text, n, len(texts)).astype(np.int64), _taken(self.ids, self.ids_at[row], n)


def _parts(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``SEGMENT`` bytes, cut at white space only."""
    lo = 0
    while len(raw) - lo > 2 * V.SEGMENT:
        hi = lo + V.SEGMENT
        while hi < len(raw) and not V.SPACE[raw[hi]]:
            ahead = V.SPACE[raw[hi : hi + V.SEGMENT]]
            hi += int(np.argmax(ahead)) if ahead.any() else len(ahead)
        yield lo, hi
        lo = hi
    yield lo, len(raw)


class ShardWriter:
    """Frames go to the file as they come; ids, sizes and checksums are kept for its end."""

    def __init__(self, out, level: int = 1) -> None:
        self.out, self.press = out, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.ids, self.table, self.tokens = array("q"), array("I"), 0

    def add(self, doc_id: int, tokens: bytes) -> None:
        frame = self.press.compress(tokens)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.table.extend((len(frame), len(tokens), xxhash.xxh64_intdigest(tokens) & 0xFFFFFFFF))
        self.tokens += len(tokens) // 4

    def close(self) -> None:
        names = struct.pack("<II", SKIPPABLE_IDS, 8 * len(self.ids)) + np.array(self.ids, "<i8").tobytes()
        self.table.extend((len(names), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        body = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table) // 3, CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(names + struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body)


def shard_bytes(ids: list[int], tokens: list[bytes], level: int = 1) -> bytes:
    """A whole shard file."""
    writer = ShardWriter(out := io.BytesIO(), level)
    for i, t in zip(ids, tokens, strict=True):
        writer.add(i, t)
    writer.close()
    return out.getvalue()


class Shard:
    """A shard's tail, and its documents on demand."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        count, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or descriptor != CHECKSUMS:
            raise ValueError("not a seekable shard")
        rows = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.at = np.cumsum(rows[:, 0]) - rows[:, 0]
        self.packed, self.size, self.sums = rows[:-1].T
        self.ids = np.frombuffer(self._at(int(self.at[-1]) + 8, int(rows[-1, 0]) - 8), np.int64)

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def tokens(self, k: int) -> bytes:
        """The k-th document's ids as bytes, checked."""
        if not self.size[k]:
            return b""
        out = zstandard.ZstdDecompressor().decompress(self._at(int(self.at[k]), int(self.packed[k])), max_output_size=int(self.size[k]))
        if xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"checksum of frame {k} differs")
        return out


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def write(docs: DataFrame, folder: str, vocab_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write shards; returns (shard, path, docs, tokens), one row a shard.

    A null text holds the end id alone, rows without an id come first, rows that repeat
    an id are all kept, in the order of a hash of their texts. Empty tables make no shard;
    other columns are ignored. Frames are written as they are made, so a task holds one
    slice of texts and its shard's table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end, writer = TokenTable(vocab_path), np.uint32(end_id).tobytes(), None
        fs, root = _open(folder)
        path = f"{TaskContext.get().partitionId():08d}.zst"
        own = f"{root}/_{uuid.uuid4().hex}"
        for whole in batches:
            for b in V.slices(whole, "text"):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    writer = ShardWriter(fs.open_output_stream(own))
                parts = [(np.concatenate(([0], np.cumsum(n))), ids) for n, ids in table.encoded(b.column("text"))]
                for k, i in enumerate(b.column("id").to_pylist()):
                    writer.add(NO_ID if i is None else i, b"".join([ids[at[k] : at[k + 1]].tobytes() for at, ids in parts]) + end)
        if writer is not None:
            writer.close()
            writer.out.close()
            fs.move(own, f"{root}/{path}")
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [f"{folder}/{path}"], "docs": [len(writer.ids)], "tokens": [writer.tokens]})

    own = renamed(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    # The hash deals rows that share an id, or have none, over several shards too.
    dealt = own.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").drop("h")
    return written(dealt.mapInArrow(run, "shard long, path string, docs long, tokens long"))


def read(shards: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Documents of shards as (doc_id, start, tokens): ids of all documents before it, its own as little-endian uint32.

    ``wanted`` ids alone are decompressed if given. Every start comes from the seek tables.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path in zip(b.column("shard").to_pylist(), b.column("path").to_pylist(), strict=True):
                fs, at = _open(path)
                with fs.open_input_file(at) as f:
                    yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "total": [int(Shard(f).size.sum()) // 4]})

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, at = _open(path)
                with fs.open_input_file(at) as f:
                    s = Shard(f)
                    start = base + (np.cumsum(s.size) - s.size) // 4
                    chosen = np.arange(len(s.ids)) if wanted is None else np.flatnonzero(np.isin(s.ids, wanted))
                    for part in np.array_split(chosen, max(1, int(s.size[chosen].sum()) >> 22)):
                        ids = pa.array(s.ids[part], mask=s.ids[part] == NO_ID)
                        yield pa.RecordBatch.from_arrays([ids, pa.array(start[part]), pa.array([s.tokens(k) for k in part], pa.binary())], names=["doc_id", "start", "tokens"])

    n = shards.count()
    one_each = shards.select("shard", "path").repartition(max(1, n), "shard")
    totals = one_each.mapInArrow(sizes, "shard long, path string, total long")
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = totals.select("shard", "path", before.alias("base")).repartition(max(1, n), "shard")
    return based.select("path", "base").mapInArrow(documents, "doc_id long, start long, tokens binary")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token_files/{uuid.uuid4().hex}"


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the packed ids."""
    return rows.select("doc_id", "start", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32"))
