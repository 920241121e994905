"""Deletion along declared foreign keys, and the proof that nothing is left over."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """Rows of ``child`` belong to the row of ``parent`` that ``column`` names and go with it; a null belongs to none."""

    child: str
    column: str
    parent: str
    parent_column: str


#: What belongs to what in a fact-checking site: a project, its products and pages, and all that hangs on them.
KEYS = (
    Key("products", "source_id", "sources", "source_id"), Key("urls", "source_id", "sources", "source_id"), Key("rules", "product_id", "products", "product_id"),
    Key("matches", "url_id", "urls", "url_id"), Key("matches", "rule_id", "rules", "rule_id"), Key("faqs", "url_id", "urls", "url_id"), Key("crawls", "url_id", "urls", "url_id"),
    *(Key(t, "source_id", "sources", "source_id") for t in ("issues", "external", "snippets", "external_pages", "profiles", "queries", "jobs", "schedules")),
)


def parents_first(keys: Sequence[Key]) -> list[str]:
    """All tables of the keys, each behind its parents; keys that lead in a circle are an error."""
    waiting = {t: {k.parent for k in keys if k.child == t and k.parent != t} for k in keys for t in (k.child, k.parent)}
    out: list[str] = []
    while waiting:
        free = sorted(t for t, ps in waiting.items() if not ps & waiting.keys())
        if not free:
            raise ValueError(f"keys lead in a circle: {sorted(waiting)}")
        out += free
        for t in free:
            del waiting[t]
    return out


def _named(parents: DataFrame, key: Key) -> DataFrame:
    return parents.select(F.col(key.parent_column).alias(key.column)).where(F.col(key.column).isNotNull()).distinct()


def delete(tables: Mapping[str, DataFrame], root: str, where: Column, keys: Sequence[Key] = KEYS) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(what stays, what goes) of each table when the rows of ``root`` go for which ``where`` holds.

    Parents come first, each key is one anti-join and one semi-join, and a row that hangs
    on two deleted parents goes once. Tables that hang on nothing deleted stay as they are.
    """
    hit = F.coalesce(where, F.lit(False))
    left, gone = {root: tables[root].where(~hit)}, {root: tables[root].where(hit)}
    for table in parents_first(keys):
        if table == root or table not in tables:
            continue
        rest, parts = tables[table], []
        for k in keys:
            if k.child == table and k.parent in gone:
                ids = _named(gone[k.parent], k)
                parts.append(rest.join(ids, k.column, "left_semi"))
                rest = rest.join(ids, k.column, "left_anti")
        left[table] = rest
        if parts:
            gone[table] = parts[0]
            for p in parts[1:]:
                gone[table] = gone[table].unionByName(p)
    return left, gone


def counts(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(part, n): how many rows each has."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def orphans(tables: Mapping[str, DataFrame], keys: Sequence[Key] = KEYS) -> DataFrame:
    """(part, n) of every key: rows whose parent is named but is not there."""
    return counts({f"{k.child}.{k.column}": tables[k.child].where(F.col(k.column).isNotNull()).join(_named(tables[k.parent], k), k.column, "left_anti") for k in keys if k.child in tables and k.parent in tables})
