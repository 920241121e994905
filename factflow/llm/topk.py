"""Exact top-k by inner product, from an impact-ordered index read score at a time.

Vectors are dealt to shards by a hash of their id. The index of a shard has a posting
segment for every dimension and quantised impact: the members whose component has it, with
the exact components. A query meets each shard once:

1. Segments are taken in descending order of the most they can add to or take from a
   score, a share of all postings at a time, into one running score a member.
2. What a member has not met yet is bounded twice: by the lengths of the parts of query and
   member that are still open (Cauchy-Schwarz), and by the impact of the next segment times
   the dimensions it has not met. The members with the largest running scores are scored
   exactly; the k-th best of them is a score that the result reaches at least.
3. Reading stops only when no more than a few members can still reach that score by their
   bound. These, and no others, are scored exactly.

Shards give their k best each, the k best of those are the result. Queries meet shards in
blocks of stated size, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factflow.llm.shared import renamed, written

SHARD, BLOCK = 8192, 1024
STEP, SHARES, FEW = 16, 8, 32
MEMBERS = -1


def _quantised(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vector")
            flat = lists.flatten()
            x = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))
            row = np.repeat(np.arange(b.num_rows), np.nan_to_num(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64))
            bad = np.zeros(b.num_rows, bool)
            bad[row[~np.isfinite(x) | flat.is_null().to_numpy(zero_copy_only=False)]] = True
            bad |= lists.is_null().to_numpy(zero_copy_only=False) | b.column("id").is_null().to_numpy(zero_copy_only=False)
            keep = ~bad[row]
            n = np.bincount(row[keep], minlength=b.num_rows)[~bad]
            vectors = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(x[keep].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(~bad)), vectors], names=["id", "vector"])

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, vector of long): each component x becomes floor(scale * x). Rows without an id, without a vector, or with a null or non-finite component are left out."""
    kind = vectors.schema[id_col].dataType.simpleString()
    return renamed(vectors, id=id_col, vector=vector_col).mapInArrow(_quantised(scale), f"id {kind}, vector array<bigint>")


def _indexed(key: tuple, table: pa.Table) -> pa.Table:
    """The posting segments of one shard, and a row ``MEMBERS`` with the ids they number."""
    table = table.sort_by("id")
    ids, lists = table.column("id").combine_chunks(), table.column("vector").combine_chunks()
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    value = lists.flatten().to_numpy(zero_copy_only=False)
    member = np.repeat(np.arange(len(ids)), n)
    dim = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
    impact = value // STEP
    by = np.lexsort((member, impact, dim))
    dim, impact, member, value = dim[by], impact[by], member[by], value[by]
    head = np.ones(len(dim), bool)
    head[1:] = (np.diff(dim) != 0) | (np.diff(impact) != 0)
    start = np.flatnonzero(head)
    ends = np.concatenate((start, [len(dim)])) if len(dim) else np.zeros(1, np.int64)
    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate((ends, ends[-1:])).astype(np.int32)), pa.array(x)) for x in (member.astype(np.int32), value)]
    members = pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(len(start) + 1), [len(ids)])).astype(np.int32)), ids)
    columns = [np.full(len(start) + 1, key[0].as_py()), np.append(dim[start], MEMBERS), np.append(impact[start], 0)]
    return pa.Table.from_arrays([*[pa.array(c.astype(np.int64)) for c in columns], *lists, members], names=["shard", "dim", "impact", "members", "components", "ids"])


def build_index(vectors: DataFrame, shards: int) -> DataFrame:
    """(shard, dim, impact, members, components, ids): the posting segments of ``vectors`` (id, vector).

    Of rows that share an id the one with the smallest vector is in the index. A shard is
    built in one task; hashed ids make shards about equally large.
    """
    one = vectors.groupBy("id").agg(F.min("vector").alias("vector"))
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"shard bigint, dim bigint, impact bigint, members array<int>, components array<bigint>, ids array<{kind}>"
    return one.withColumn("shard", _shard(F.col("id"), shards)).groupBy("shard").applyInArrow(_indexed, schema)


def _shard(x: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(shards))


class Shard:
    """One shard's segments, laid out for reading by impact."""

    def __init__(self, table: pa.Table) -> None:
        dims = table.column("dim").to_numpy()
        at = int(np.flatnonzero(dims == MEMBERS)[0])
        self.ids = table.column("ids")[at].values.to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(dims != MEMBERS)
        part = table.take(pa.array(rows))
        self.dim = dims[rows]
        size = part.column("members").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.start, self.size = np.cumsum(size) - size, size
        self.member = part.column("members").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.value = part.column("components").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.least = np.minimum.reduceat(self.value, self.start) if len(size) else size
        self.most = np.maximum.reduceat(self.value, self.start) if len(size) else size
        self.wide = int(self.dim.max(initial=-1)) + 1
        self.exact = np.zeros((len(self.ids), self.wide), np.int64)
        self.exact[self.member, np.repeat(self.dim, size)] = self.value
        squares = self.value.astype(np.float64) ** 2
        self.length = np.bincount(self.member, squares, len(self.ids))
        self.dims = np.bincount(self.member, minlength=len(self.ids))

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best members for a query, itself left out; and how many postings were read."""
        q = np.zeros(self.wide, np.int64)
        q[: len(query)] = query[: self.wide]
        others = np.flatnonzero(self.ids != own)
        if not len(others):
            return self.ids[:0], np.zeros(0, np.int64), 0
        weight = q[self.dim].astype(np.float64)
        impact = np.maximum(np.abs(weight * self.least), np.abs(weight * self.most))
        order = np.argsort(-impact, kind="stable")
        order = order[weight[order] != 0]
        taken = np.cumsum(self.size[order])
        total = int(taken[-1]) if len(taken) else 0
        n = len(self.ids)
        score, met, met_q, met_v = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        length = float((q.astype(np.float64) ** 2).sum())
        slack = 1 + 1e-9 * np.sqrt(length * self.length)
        lo = read = 0
        for share in range(1, SHARES + 1):
            hi = int(np.searchsorted(taken, total * share // SHARES, "left")) + 1 if total else 0
            part = order[lo : min(hi, len(order))]
            lo = max(lo, min(hi, len(order)))
            count = self.size[part]
            at = np.repeat(self.start[part] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            who, v, w = self.member[at], self.value[at].astype(np.float64), np.repeat(weight[part], count)
            read += len(at)
            score += np.bincount(who, v * w, n)
            met += np.bincount(who, minlength=n)
            met_q += np.bincount(who, w * w, n)
            met_v += np.bincount(who, v * v, n)
            lasting = float(impact[order[lo]]) if lo < len(order) else 0.0
            open_ = np.sqrt(np.maximum(length - met_q, 0) * np.maximum(self.length - met_v, 0))
            bound = score + np.minimum(open_, np.maximum(self.dims - met, 0) * lasting) + slack
            top = others if len(others) <= FEW else others[np.argpartition(-score[others], FEW - 1)[:FEW]]
            reached = np.sort(self.exact[top] @ q)[-k] if len(top) >= k else -np.inf
            possible = others[bound[others] >= reached]
            if len(possible) <= FEW * 4 or lo >= len(order):
                break
        exact = self.exact[possible] @ q
        first = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible[first]], exact[first], read


def _searched(k: int):
    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if index.num_rows and queries.num_rows:
            shard = Shard(index)
            for own, vector in zip(queries.column("id").to_pylist(), queries.column("vector"), strict=True):
                ids, scores, _ = shard.best(own, vector.values.to_numpy(zero_copy_only=False), k)
                out.append((np.full(len(ids), own), ids, scores))
        columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 3)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query (id, vector) with what the index holds, ties by smaller id.

    A vector shorter than a query counts as filled up with zeros. A member with the
    query's own id is no result. Fewer members than k give fewer rows.
    """
    kind = queries.schema["id"].dataType.simpleString()
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = index.withColumn("block", block)
    one = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    right = one.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_searched(k), f"query_id {kind}, vec_id {kind}, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``search`` of all rows against the rows for which ``is_query``, a condition on ``id``, holds.

    Scores are longs; their magnitude must stay below 2**63. Null ids, null vectors and
    vectors with null or non-finite components take no part; an empty table gives no rows.
    Rows with one id count as one, with the smallest vector. Other columns are ignored.
    Memory of a task is bounded by ``shard`` members and ``block`` queries.
    """
    rows = written(quantised(vectors, id_col, vector_col))
    n, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // block))
    return search(written(build_index(rows, shards)), rows.where(is_query), shards, blocks, k)
