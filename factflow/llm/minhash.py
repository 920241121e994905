"""Near-duplicate documents: b-bit MinHash signatures in a multi-index Hamming join.

A document is the set of its distinct five-word shingles (A-Z lower-cased). Its
signature has ``CHUNKS * WIDTH`` minima of 16 bits each. The distance of two
signatures is the number of places that differ. The places are split into
``CHUNKS`` chunks; of two signatures at distance at most ``2 * CHUNKS - 1`` some
chunk differs in at most one place (pigeonhole), so each chunk is indexed once for
every place left out: ``CHUNKS * WIDTH`` keys, and every pair up to that distance
meets in one. Pairs that meet are compared on a longer 8-bit signature and their
sizes, and links are confirmed on the full sets. A pair at similarity 0.80 fails to
meet with a probability below 3e-5, one at 0.85 below 1e-6.

Equal sets are one class from the start. Inside a key, rows are first linked to
their neighbour in signature order and to a first row; a key's rows may lie in many
tasks for that. Only rows that are then still in different components are compared
with each other. In keys of up to ``BLOCK`` rows that is done pair by pair, each pair at
the first key it shares; what is linked there counts as one component at once, so no
group gives more links than rows. Larger keys are cut by their rows' rarest shingles: of
two sets of similarity t, each holds a shingle of the other among its
``n - ceil(t * n) + 1`` rarest, so rows meet again only under such a shingle. Rows that
share a common part alone, however large it is, never meet there. Rows that do meet are
compared in blocks by how they differ from what most rows of the block have, and what is
linked counts as one component at once: links leave a block, not pairs that may be links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factflow.llm import vectext as V
from factflow.llm.components import components
from factflow.llm.shared import renamed, written

SHINGLE, CHUNKS, WIDTH, LONG, BLOCK = 5, 8, 5, 128, 1024
BLOCK_SHINGLES = 1 << 22
KEYED = CHUNKS * WIDTH
_RNG = np.random.default_rng(7)
_TURN = _RNG.integers(1, 1 << 63, LONG, dtype=np.uint64) | np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, LONG, dtype=np.uint64)
_WEIGHT = _RNG.integers(1, 1 << 63, (CHUNKS, WIDTH), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of 1 to width - 1 words has one."""
    raw, offsets = V.buffer_of(texts)
    _, _, text, h = V.words_of(raw, offsets, fold=True)
    first, w = V.windows(h, text, width)
    n = len(offsets) - 1
    words, cut = V.runs(n, text), V.runs(n, text[first])
    out = []
    for k in range(n):
        if cut[k + 1] > cut[k]:
            s = np.sort(w[cut[k] : cut[k + 1]])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif words[k + 1] > words[k]:
            few = h[words[k] : words[k + 1]]
            with np.errstate(over="ignore"):
                out.append(V.mix(np.array([np.sum(V.mix(few + np.arange(1, len(few) + 1, dtype=np.uint64)))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in V.slices(whole, "text"):
            sets = shingle_sets(b.column("text"))
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            minima = np.zeros((len(n), LONG), np.uint64)
            if len(some):
                every = np.concatenate([sets[k] for k in some])
                at = np.concatenate(([0], np.cumsum(n[some])[:-1]))
                with np.errstate(over="ignore"):
                    f1[some] = np.add.reduceat(V.mix(every + np.uint64(11)), at)
                    f2[some] = np.add.reduceat(V.mix(every + np.uint64(13)), at)
                    for j in range(LONG):
                        minima[some, j] = np.minimum.reduceat((every ^ _FLIP[j]) * _TURN[j], at)
            minima = V.mix(minima)
            keys = _keys((minima[:, :KEYED] & np.uint64(0xFFFF)).reshape(len(n), CHUNKS, WIDTH))
            sig = np.ascontiguousarray((minima >> np.uint64(48)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * KEYED + 1, KEYED, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64))),
                    pa.array([sig[k].tobytes() for k in range(len(n))], pa.binary()),
                ],
                names=["id", "n", "f1", "f2", "keys", "sig"],
            )


def _keys(places: np.ndarray) -> np.ndarray:
    """One key for each chunk and each place left out of it."""
    with np.errstate(over="ignore"):
        part = V.mix((places + np.uint64(1)) * _WEIGHT)
        whole = part.sum(axis=2, keepdims=True, dtype=np.uint64)
        left_out = np.arange(KEYED, dtype=np.uint64).reshape(CHUNKS, WIDTH)
        return V.mix(whole - part + (left_out + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys, from batches sorted by key, many groups at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in key:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= held[-1].column(k)[-1].as_py() != v[0]
        last = np.flatnonzero(change)
        if len(last):
            cut = int(last[-1])
            if held or cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(sig) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(-1, LONG)


def _far(percent: int) -> int:
    """Differing places of the long signature beyond which a pair at the threshold practically never falls."""
    p = 1 - percent / 100
    return int(LONG * p + 5 * (LONG * p * (1 - p)) ** 0.5) + 1


def _near(n1, n2, s1, s2, percent: int) -> np.ndarray:
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    return (100 * small >= percent * large) & ((s1 != s2).sum(axis=1) <= _far(percent))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _chained(percent: int):
    """Each row against the row before it in its key and against the first row of its key in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = head = None
        for b in batches:
            if not b.num_rows:
                continue
            key, i, n, c = (b.column(x).to_numpy(zero_copy_only=False) for x in ("key", "id", "n", "root"))
            s = _matrix(b.column("sig"))
            if before is not None:
                key, i, n, c, s = (np.concatenate(both) for both in zip(before, (key, i, n, c, s), strict=True))
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
            hi, hn, hc, hs = i[first], n[first], c[first], s[first]
            if head is not None and key[0] == head[0]:
                same = first == 0
                hi, hn, hc, hs = np.where(same, head[1], hi), np.where(same, head[2], hn), np.where(same, head[3], hc), np.where(same[:, None], head[4], hs)
            k = np.flatnonzero(~fresh)
            for oi, on, oc, os_ in ((i[k - 1], n[k - 1], c[k - 1], s[k - 1]), (hi[k], hn[k], hc[k], hs[k])):
                ok = (oc != c[k]) & _near(on, n[k], os_, s[k], percent)
                yield _pairs(oi[ok], i[k][ok])
            before = key[-1:], i[-1:], n[-1:], c[-1:], s[-1:]
            head = key[-1], hi[-1], hn[-1], hc[-1], hs[-1]

    return run


def _headed(percent: int):
    """Each row against the first row of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, n, c, hi, hn, hc = (b.column(x).to_numpy() for x in ("id", "n", "root", "hi", "hn", "hc"))
                ok = (hc != c) & _near(hn, n, _matrix(b.column("hs")), _matrix(b.column("sig")), percent)
                yield _pairs(hi[ok], i[ok])

    return run


def _neighbours(met: DataFrame, percent: int) -> DataFrame:
    """Near pairs of rows (key, rows, id, n, root, sig) next to each other in signature order, or with a first row.

    Rows are dealt by ranges of key and signature, so a key's rows may lie in many tasks;
    in keys beyond ``BLOCK`` each is also compared with the first row of all.
    """
    dealt = met.repartitionByRange("key", "sig", "id").sortWithinPartitions("key", "sig", "id")
    large = met.where(F.col("rows") > BLOCK)
    heads = large.groupBy("key").agg(F.min(F.struct("sig", "id", "n", "root")).alias("h"))
    headed = large.join(heads.select("key", *[F.col(f"h.{x}").alias(y) for x, y in (("id", "hi"), ("n", "hn"), ("root", "hc"), ("sig", "hs"))]), "key")
    pairs = dealt.mapInArrow(_chained(percent), "a long, b long").unionByName(headed.mapInArrow(_headed(percent), "a long, b long"))
    return pairs.where("a <> b").distinct()


def _crossed(percent: int):
    """Links between rows in different components, each pair tried at the first key it shares.

    Near pairs are confirmed on their full sets at once, and rows linked here count as one
    component from then on, so a group gives fewer links than it has rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key"]):
            key, no, i, n = (t.column(k).to_numpy() for k in ("key", "no", "id", "n"))
            c, s = t.column("root").to_numpy().copy(), _matrix(t.column("sig"))
            places = t.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, KEYED)
            values, at = t.column("s").combine_chunks().flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(n)))
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            a, b = [], []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                for k in range(lo, hi):
                    j = np.arange(k + 1, hi)
                    j = j[c[j] != c[k]]
                    j = j[_near(n[j], n[k], s[j], s[k][None], percent)] if len(j) else j
                    j = j[(places[j] == places[k]).argmax(axis=1) == no[k]] if len(j) else j
                    if not len(j):
                        continue
                    own, theirs = values[at[k] : at[k + 1]], np.concatenate([values[at[m] : at[m + 1]] for m in j])
                    met = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                    both = np.add.reduceat(met.astype(np.int64), np.cumsum(n[j]) - n[j])
                    for m in j[100 * both >= percent * (n[k] + n[j] - both)].tolist():
                        if c[m] != c[k]:
                            a.append(i[k])
                            b.append(i[m])
                            c[lo:hi][c[lo:hi] == c[m]] = c[k]
            yield _pairs(np.array(a, np.int64), np.array(b, np.int64))

    return run


def _linked(values: np.ndarray, n: np.ndarray, c: np.ndarray, maybe: Callable[[int], np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links between rows of one group (their sets one after another in ``values``); ``c``, their components, becomes what they are then.

    Rows are held as their differences from the shingles that most rows of the group have.
    Two rows differ by ``d1 + d2 - 2 * shared`` shingles, d being the sizes of these
    differences, so no two whole sets are compared. Where d1 + d2 is little enough the rows
    are linked whatever they share; the row closest to the middle has links to all of those.
    """
    m, row = len(n), np.repeat(np.arange(len(n)), n)
    _, code, df = np.unique(values, return_inverse=True, return_counts=True)
    most = np.flatnonzero(2 * df > m)
    place = np.full(len(df), -1)
    place[most] = np.arange(len(most))
    lacks, usual = np.ones((m, len(most)), bool), place[code] >= 0
    lacks[row[usual], place[code[usual]]] = False
    gone, which = np.nonzero(lacks)
    row, code = np.concatenate((row[~usual], gone)), np.concatenate((code[~usual], most[which]))
    d = np.bincount(row, minlength=m)
    rest = (100 + percent) * d - (100 - percent) * n
    h = int(rest.argmin())
    for j in np.flatnonzero((rest + rest[h] <= 0) & (c != c[h])).tolist():
        if c[j] != c[h]:
            yield h, j
            c[c == c[j]] = c[h]

    by = np.lexsort((row, code))
    starts = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(df)))))
    having, by_row = row[by], code[np.lexsort((code, row))]
    ends = np.concatenate(([0], np.cumsum(d)))
    for k in range(m):
        j = maybe(k)
        j = j[c[j] != c[k]]
        if not len(j):
            continue
        lo, size = starts[by_row[ends[k] : ends[k + 1]]], np.diff(starts)[by_row[ends[k] : ends[k + 1]]]
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        shared = np.bincount(having[at], minlength=m)[j]
        for o in j[(100 + percent) * (d[k] + d[j] - 2 * shared) <= (100 - percent) * (n[k] + n[j])].tolist():
            if c[o] != c[k]:
                yield k, o
                c[c == c[o]] = c[k]


def _apart(percent: int):
    """Links between rows in different components, of groups dealt in pairs of blocks, confirmed on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key", "x", "y"]):
            key, x, y, block, i, n, c = (t.column(k).to_numpy() for k in ("key", "x", "y", "block", "id", "n", "root"))
            s, values, at = _matrix(t.column("sig")), t.column("s").combine_chunks().flatten().to_numpy(), np.concatenate(([0], np.cumsum(n)))
            end = np.flatnonzero(np.concatenate(((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True]))) + 1
            for lo, hi in zip(np.concatenate(([0], end[:-1])), end, strict=True):
                gn, gc, gs, gb, both = n[lo:hi], c[lo:hi].copy(), s[lo:hi], block[lo:hi], x[lo] != y[lo]

                def maybe(k: int, gn=gn, gc=gc, gs=gs, gb=gb, both=both) -> np.ndarray:
                    j = np.arange(k + 1, len(gn))
                    j = j[(gc[j] != gc[k]) & ((gb[j] != gb[k]) | ~both)]
                    return j[_near(gn[j], gn[k], gs[j], gs[k][None], percent)] if len(j) else j

                links = np.array(list(_linked(values[at[lo] : at[hi]], gn, gc, maybe, percent)), np.int64).reshape(-1, 2) + lo
                yield _pairs(i[links[:, 0]], i[links[:, 1]])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in V.slices(whole, "text"):
            sets = shingle_sets(b.column("text"))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["id", "s"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("s", "sb"))
    return right.join(sets.withColumnRenamed("id", "a"), "a").where(100 * both >= percent * (F.size("s") + F.size("sb") - both)).select("a", "b")


def _rarest(hot: DataFrame, percent: int) -> DataFrame:
    """(key, id): shared shingles among the rarest of each row of ``hot`` (id, n, s).

    Sets of similarity ``percent`` or more share at least ``ceil(percent * n / 100)`` of
    either's n shingles, hence one of the ``n - ceil(...) + 1`` that come first in any order
    that holds for all rows; here the rarest come first.
    """
    shingles = hot.select("id", "n", F.xxhash64("s").alias("own"), F.explode("s").alias("key"))  # a repeated id has several sets
    counts = written(shingles.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    nth = F.row_number().over(Window.partitionBy("id", "own").orderBy(F.coalesce("df", F.lit(1)), "key"))
    first = shingles.join(counts, "key", "left").withColumn("nth", nth).where(F.expr(f"nth <= n - ({percent} * n + 99) DIV 100 + 1"))
    return written(first.where("df IS NOT NULL").select("key", "id").distinct())


def _open(keyed: DataFrame, roots: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (key, rows, id, n, root, sig) of the keys whose rows are in different components."""
    placed = keyed.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = placed.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key", "rows")
    return written(placed.join(several, "key").join(rows, "id").select("key", "rows", "id", "n", "root", "sig"))


def _stars(roots: DataFrame) -> DataFrame:
    """What is known of components as links of each row to its root: far fewer steps follow than from the links found."""
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _in_large_keys(hot: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the rows of ``hot`` (id, n, sig, s) that ``roots`` holds apart, over their rarest shingles."""
    rare, rows = _rarest(hot, percent), hot.select("id", "n", "sig").distinct()
    more = written(_confirmed(_neighbours(_open(rare, roots, rows), percent), sets, percent))
    left = _open(rare, components(_stars(roots).unionByName(more)), rows)
    wide = left.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("wide"))
    left = left.join(wide, "key").withColumn("block", F.pmod(F.xxhash64("id"), "wide").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    left = left.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "n", "root", "sig")
    left = left.join(hot.select("id", "n", "sig", "s").distinct(), ["id", "n", "sig"])
    found = left.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_apart(percent), "a long, b long")
    return more.unionByName(written(found.where("a <> b").distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links), kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B|. A null or blank text has
    no shingles and no link. Rows that repeat an id are one document and thus linked. Rows
    without an id are linked with nothing: component_id is null and they are kept.
    An empty table gives an empty result; other columns are ignored.
    """
    own = renamed(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    sig = written(own.mapInArrow(_signatures, "id long, n long, f1 long, f2 long, keys array<long>, sig binary"))
    usable = sig.where("n > 0 AND id IS NOT NULL")
    classes = written(usable.groupBy("f1", "f2").agg(F.min("id").alias("c"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig")))

    keyed = classes.select(F.col("c").alias("id"), F.posexplode("keys").alias("no", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    rows = classes.select(F.col("c").alias("id"), "n", "sig", "keys")
    met = keyed.join(shared, "key").select("key", "no", "rows", "id")
    met = written(met.join(rows.drop("keys"), "id"))

    chained = _neighbours(met.withColumn("root", F.col("id")), percent)
    seen = met.select("id").distinct()
    needed = own.join(seen.hint("merge"), "id", "left_semi").where("text IS NOT NULL")
    sets = written(needed.mapInArrow(_sets, "id long, s array<long>").where("size(s) > 0"))
    links = written(_confirmed(chained, sets, percent))

    roots = components(links)
    placed = met.select("key", "no", "rows", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key")
    left = placed.join(open_keys, "key")
    small = left.where(F.col("rows") <= BLOCK).join(rows, "id").join(sets, "id").where("size(s) = n")
    crossed = small.select("key", "no", "id", "n", "root", "sig", "keys", "s").repartition("key").sortWithinPartitions("key").mapInArrow(_crossed(percent), "a long, b long").distinct()
    found = _stars(roots).unionByName(crossed)
    hot = written(left.where(F.col("rows") > BLOCK).select("id").distinct().join(rows.drop("keys"), "id").join(sets, "id").where("size(s) = n"))
    if not hot.isEmpty():
        found = found.unionByName(_in_large_keys(hot, roots, sets, percent))
    roots = components(found)

    by_class = classes.select("f1", "f2", "c").join(roots.withColumnRenamed("node", "c"), "c", "left").select("f1", "f2", F.coalesce("root", "c").alias("root"))
    out = sig.join(by_class, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
