"""The n best rows of each group, by bounded partial results before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HELD = 1 << 16
MOST = 1 << 20


def _cut(table: pa.Table, keys: Sequence[str], order: Sequence[tuple[str, bool]], n: int) -> pa.Table:
    """The n first rows of each group of a bounded table."""
    table = table.take(pc.sort_indices(table, sort_keys=[*[(k, "ascending") for k in keys], *[(c, "ascending" if up else "descending") for c, up in order]]))
    new = None
    for k in keys:
        column = table.column(k).combine_chunks()
        same = pc.fill_null(pc.equal(column[1:], column[:-1]), False) if len(column) > 1 else pa.array([], pa.bool_())
        both_null = pc.and_(column[1:].is_null(), column[:-1].is_null()) if len(column) > 1 else same
        same = pc.or_(same, both_null)
        new = pc.invert(same) if new is None else pc.or_(new, pc.invert(same))
    import numpy as np

    head = np.concatenate(([True], new.to_numpy(zero_copy_only=False))) if table.num_rows else np.zeros(0, bool)
    at = np.arange(table.num_rows)
    place = at - np.maximum.accumulate(np.where(head, at, 0)) if table.num_rows else at
    return table.filter(pa.array(place < n))


def _partial(keys: Sequence[str], order: Sequence[tuple[str, bool]], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = limit = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows < max(HELD, limit):
                continue
            kept = _cut(pa.concat_tables(held), keys, order, n)
            held, rows, limit = [kept], kept.num_rows, 2 * kept.num_rows
            if rows > MOST:  # too many groups for one task's memory: what it has goes on, it is a partial result anyway
                yield from kept.to_batches()
                held, rows, limit = [], 0, 0
        if rows:
            yield from _cut(pa.concat_tables(held), keys, order, n).to_batches()

    return run


def best_of(rows: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group by (column, ascending) pairs, with their place from 1 in ``rank`` if named.

    Each task keeps the best rows of the groups it has met so far, cut whenever they have
    doubled, so no more than that is shuffled and no full sort of all rows is made; at
    most about ``MOST`` rows are held. Nulls in keys are a group of their own.
    """
    few = rows.mapInArrow(_partial(keys, order, n), rows.schema)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order]))
    name = rank or "_rank"
    out = few.withColumn(name, place).where(F.col(name) <= n)
    return out if rank else out.drop(name)
