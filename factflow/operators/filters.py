"""The filter model: groups of conditions compiled to one column, which Catalyst pushes down.

A model is ``{"groups": [{"mode": "all" | "any" | "none", "field": name, "values": [...]}]}``.
Inside a group, all joins with AND, any with OR, none negates the OR. Groups fold from the
left: a group joins with OR if its own mode is any, else with AND. Unknown fields and empty
groups are skipped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from factflow.functions.text import staged
from factflow.sources.folders import checkpointed

#: field -> (column, kind) of findings, of external findings and of pages to crawl.
FINDINGS = {
    "category": ("category", "enum"), "severity": ("severity", "enum"), "status": ("status", "enum"), "locale": ("locale", "enum"), "section": ("section", "enum"),
    "url": ("url", "contains"), "not_url": ("url", "not_contains"), "evidence": ("evidence", "contains"), "product": ("product_name", "enum"),
    "detected_at": ("detected_at", "date"), "last_checked": ("last_checked_at", "date"),
}
EXTERNAL = {
    "severity": ("severity", "enum"), "status": ("status", "enum"), "verdict": ("verdict", "enum"), "domain": ("domain", "contains"), "not_domain": ("domain", "not_contains"),
    "url": ("external_url", "contains"), "snippet": ("snippet", "contains"),
}
CRAWL = {
    "locale": ("locale", "enum"), "section": ("section", "enum"), "content_type": ("content_type", "enum"), "url": ("url", "contains"), "not_url": ("url", "not_contains"),
    "changed": ("", "changed"), "lastmod": ("lastmod", "date"),
}


def condition(kind: str, column: str, value: str) -> Column | None:
    c = F.col(column) if column else None
    if kind == "enum":
        return c == value
    if kind == "contains":
        return c.ilike(f"%{value}%")
    if kind == "not_contains":
        return ~c.ilike(f"%{value}%")
    if kind == "changed":
        stale = F.col("last_crawled").isNull() | (F.col("lastmod").isNotNull() & (F.col("lastmod") > F.col("last_crawled")))
        return stale if value == "yes" else ~stale
    if kind == "date":
        lo, _, hi = value.partition("|")
        parts = [*([c >= lo] if lo else []), *([c <= hi + "T23:59:59"] if hi else [])]
        return reduce(lambda a, b: a & b, parts) if parts else None
    raise ValueError(kind)


def compile_model(model: Mapping[str, Any], fields: Mapping[str, tuple[str, str]]) -> Column:
    """The model as one boolean column; true if nothing is asked."""
    whole = None
    for group in model.get("groups", ()):
        if group.get("field") not in fields:
            continue
        column, kind = fields[group["field"]]
        parts = [p for v in group.get("values", ()) if (p := condition(kind, column, str(v))) is not None]
        if not parts:
            continue
        mode = group.get("mode", "any")
        one = reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), parts)
        one = ~one if mode == "none" else one
        whole = one if whole is None else (whole | one if mode == "any" else whole & one)
    return F.lit(True) if whole is None else whole


def in_locales(locales: Sequence[str] | None, column: str = "locale") -> Column:
    """The locale is listed, ``(root)`` standing for none; everything if nothing is listed."""
    if not locales:
        return F.lit(True)
    named = [x for x in locales if x != "(root)"]
    hit = F.col(column).isin(named) if named else F.lit(False)
    return F.coalesce(hit, F.lit(False)) | (F.col(column).isNull() if "(root)" in locales else F.lit(False))


def resolve_locales(mode: str, detected: Sequence[str], preset: Sequence[str], custom: Sequence[str] = ()) -> list[str] | None:
    """None for all; the detected part of the preset and the root; or a custom list, where an empty one means all."""
    if mode == "all":
        return None
    if mode == "english":
        return [*[x for x in preset if x in set(detected)], "(root)"]
    return list(custom) or None


def preset_locales(mode: str, preset: Sequence[str], custom: Sequence[str] = ()) -> list[str] | None:
    """As ``resolve_locales`` without asking the pages: a preset locale that no page has selects nothing anyway."""
    return resolve_locales(mode, preset, preset, custom)


MOST_FILTERS = 10_000


def saved_models(filters: DataFrame) -> list[tuple[int, Mapping[str, Any]]]:
    """(filter_id, model) of saved filters (filter_id, model as JSON); one whose model is no JSON object selects nothing and is left out.

    Saved filters are configuration and go to the driver, ``MOST_FILTERS`` at most.
    """
    rows = filters.select("filter_id", "model").limit(MOST_FILTERS + 1).collect()
    if len(rows) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} saved filters")
    out = []
    for r in sorted(rows):
        try:
            model = json.loads(r.model or "{}")
        except ValueError:
            continue
        if isinstance(model, dict):
            out.append((r.filter_id, model))
    return out


def with_saved_filters(rows: DataFrame, filters: DataFrame, fields: Mapping[str, tuple[str, str]], out: str = "filter_ids") -> DataFrame:
    """``rows`` with the ids of all saved filters that select them, in one scan.

    Conditions that filters share are looked at once a row; each filter then only combines
    their truth values, as ``compile_model`` does.
    """
    atoms: dict[tuple[str, str], int] = {}
    conditions: list[Column] = []

    def place(field: str, value: str) -> int | None:
        if (field, value) not in atoms:
            column, kind = fields[field]
            c = condition(kind, column, value)
            if c is None:
                return None
            atoms[field, value] = len(conditions)
            conditions.append(c)
        return atoms[field, value]

    chosen = []
    for filter_id, model in saved_models(filters):
        whole = None
        for group in model.get("groups", ()):
            places = [k for v in group.get("values", ()) if group.get("field") in fields and (k := place(group["field"], str(v))) is not None]
            if not places:
                continue
            mode = group.get("mode", "any")
            one = reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), [F.get("_atoms", F.lit(k)) for k in places])
            one = ~one if mode == "none" else one
            whole = one if whole is None else (whole | one if mode == "any" else whole & one)
        chosen.append(F.lit(filter_id) if whole is None else F.when(whole, F.lit(filter_id)))
    kind = filters.schema["filter_id"].dataType
    rows = staged(rows, _atoms=F.array(*conditions).cast("array<boolean>"))
    return rows.withColumn(out, F.array_compact(F.array(*chosen)).cast(ArrayType(kind)) if chosen else F.array().cast(ArrayType(kind))).drop("_atoms")


PARSED = "model string, groups array<struct<mode:string,atoms:array<struct<column:string,kind:string,value:string>>>>"


def _groups_of(fields: Mapping[str, tuple[str, str]]):
    """Batches of models as their groups of (column, kind, value); unknown fields and empty conditions are skipped, what is no JSON object goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["model"]:
                try:
                    model = json.loads(text or "{}")
                except ValueError:
                    continue
                if not isinstance(model, dict):
                    continue
                groups = []
                for group in model.get("groups", ()):
                    column, kind = fields.get(group.get("field"), (None, None))
                    values = [str(v) for v in group.get("values", ()) if kind] if kind != "date" else [v for v in map(str, group.get("values", ())) if v.replace("|", "", 1)]
                    if values:
                        groups.append({"mode": group.get("mode", "any"), "atoms": [{"column": column, "kind": kind, "value": v} for v in values]})
                rows.append((text, groups))
            yield pd.DataFrame(rows, columns=["model", "groups"])

    return run


def _holds(kind: str, column: str, value: Column) -> Column:
    """``condition`` with a value that is a column."""
    c = F.col(column) if column else None
    if kind in ("contains", "not_contains"):
        like = F.ilike(c, F.concat(F.lit("%"), value, F.lit("%")))
        return like if kind == "contains" else ~like
    if kind == "changed":
        stale = condition("changed", "", "yes")
        return F.when(value == "yes", stale).otherwise(~stale)
    if kind == "date":
        lo, hi = F.substring_index(value, "|", 1), F.when(F.contains(value, F.lit("|")), F.substr(value, F.instr(value, "|") + 1)).otherwise("")
        return ((lo == "") | (c >= lo)) & ((hi == "") | (c <= F.concat(hi, F.lit("T23:59:59"))))
    return c == value


def saved_filter_counts(rows: DataFrame, filters: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(filter_id, n) of every saved filter, zeros included, from one scan of ``rows``.

    Filters are rows here, however many: equal models count once, and so does a condition
    that several of them share. Rows on which all conditions come out alike are one with a
    count; each of those meets each different model, and only the counts go on.
    """
    text = F.coalesce("model", F.lit(""))
    parsed = checkpointed(filters.select(text.alias("model")).distinct().mapInPandas(_groups_of(fields), PARSED))
    listed = parsed.select("model", F.posexplode("groups").alias("no", "g")).select("model", "no", "g.mode", F.explode("g.atoms").alias("atom"))
    every = checkpointed(listed.agg(F.sort_array(F.collect_set("atom")).alias("every")))  # the different conditions, one row
    used = sorted(tuple(r) for r in listed.select("atom.kind", "atom.column").distinct().collect())  # as many as there are fields

    def truth(a: Column) -> Column:
        out = F.lit(None).cast("boolean")
        for kind, column in used:
            out = F.when((a["kind"] == kind) & (a["column"] == column), _holds(kind, column, a["value"])).otherwise(out)
        return out

    alike = rows.join(F.broadcast(every)).select(F.transform("every", truth).alias("truth")).groupBy("truth").agg(F.count("*").alias("n"))
    placed = listed.join(every.select(F.posexplode("every").alias("place", "atom")), "atom")
    folded = placed.groupBy("model", "no", "mode").agg(F.collect_list("place").alias("places"))
    folded = folded.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("no", "mode", "places"))).alias("gs"))
    models = parsed.select("model").join(folded, "model", "left")

    def one(g: Column) -> Column:
        at = lambda p: F.get("truth", p)
        return F.when(g["mode"] == "all", F.forall(g["places"], at)).when(g["mode"] == "none", ~F.exists(g["places"], at)).otherwise(F.exists(g["places"], at))

    def fold(acc: Column, g: Column) -> Column:
        v = F.when(~acc["on"], one(g)).when(g["mode"] == "any", acc["v"] | one(g)).otherwise(acc["v"] & one(g))
        return F.struct(F.lit(True).alias("on"), v.alias("v"))

    whole = F.aggregate("gs", F.struct(F.lit(False).alias("on"), F.lit(None).cast("boolean").alias("v")), fold)["v"]
    hits = alike.crossJoin(models).where(F.col("gs").isNull() | whole).groupBy("model").agg(F.sum("n").alias("n"))
    return filters.select("filter_id", text.alias("model")).join(hits, "model", "left").select("filter_id", F.coalesce("n", F.lit(0)).alias("n"))
