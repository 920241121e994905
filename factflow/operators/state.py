"""Keyed tables rewritten per run: merges, reconciliation, duplicate collapse and actions.

Plain Parquet has no in-place update, so each operator takes the old version and the
change and returns the new version; the caller writes it to a new path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factflow.functions.text import fact_rule_of
from factflow.operators.snapshots import latest

FINDING_KEY = ("url_id", "category", "title", "related_url_id")
KEPT_STATUSES = ("ignored", "false_positive")


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], rule: Mapping[str, Column] | None = None, new_first: Sequence[str] = ()) -> DataFrame:
    """Full outer merge. ``rule`` gives a column from ``o`` and ``n`` (the old and new row, null if there is none);
    columns in ``new_first`` take the new row's value where it is not null; others keep the old row's while there is one."""
    o = old.select(*keys, F.struct(*[c for c in old.columns]).alias("o"))
    n = new.select(*keys, F.struct(*[c for c in new.columns]).alias("n"))
    both = o.join(n, list(keys), "full_outer")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif rule and c in rule:
            out.append(rule[c].alias(c))
        elif c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c in new_first:
            out.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            out.append(F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return both.select(*out)


def merge_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """A run's findings into the table: one row a key, the run's last write counting.

    A status that a person set stays, and so does that of a soft-deleted finding whose
    evidence is the same; the deletion itself is lifted only if the evidence differs.
    """
    last = latest(new, FINDING_KEY, ["write_seq"]).drop("write_seq")
    o, n = F.col("o"), F.col("n")
    same = F.col("o.evidence") == F.col("n.evidence")
    deleted = F.col("o.deleted_at").isNotNull()
    keep = o.isNotNull() & (n.isNull() | F.col("o.status").isin(*KEPT_STATUSES) | (deleted & F.coalesce(same, F.lit(False))))
    status = F.when(keep, F.col("o.status")).otherwise(F.col("n.status"))
    lifted = F.when(n.isNotNull() & F.coalesce(~same, F.lit(False)), F.lit(None)).otherwise(F.col("o.deleted_at"))
    fresh = {c: F.when(n.isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in ("severity", "detail", "evidence", "expected", "matched_value", "last_checked_at", "detected_at", "detection_method", "product_id") if c in old.columns and c in last.columns}
    return merge(old, last, FINDING_KEY, {"status": status, "deleted_at": lifted, **fresh})


def merge_verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Verdicts by rule and page; where a run wrote one, it counts as a whole. ``new`` has one row a key."""
    return merge(old, new, ("rule_id", "url_id"), _taken([c for c in old.columns if c not in ("rule_id", "url_id")]))


def reconcile(findings: DataFrame, run_start: str, categories: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """Open findings that detectors which ran did not write again become fixed."""
    gone = (F.col("status") == "open") & F.col("category").isin(*categories) & F.col("detection_method").isin(*methods) & (F.col("detected_at") < run_start)
    return findings.withColumn("status", F.when(gone, "fixed").otherwise(F.col("status")))


def collapse_duplicates(findings: DataFrame) -> DataFrame:
    """True duplicates (source, page, category, rule, evidence) become their earliest row: open if any is, else unclear if any is."""
    key = ["source_id", "url_id", "category", fact_rule_of(F.col("title")), F.coalesce("evidence", F.lit(""))]
    live = findings.where("deleted_at IS NULL")
    group = Window.partitionBy(*key)
    first = F.row_number().over(group.orderBy("detected_at", "issue_id"))
    some = {s: F.max(F.when(F.col("status") == s, 1).otherwise(0)).over(group) == 1 for s in ("open", "unclear")}
    status = F.when(some["open"], "open").when(some["unclear"], "unclear").otherwise(F.col("status"))
    checked = F.max("last_checked_at").over(group)
    kept = live.select("*", first.alias("_k"), status.alias("_s"), checked.alias("_c")).where("_k = 1")
    kept = kept.withColumn("status", F.col("_s")).withColumn("last_checked_at", F.col("_c")).select(findings.columns)
    return kept.unionByName(findings.where("deleted_at IS NOT NULL"))


def apply_actions(rows: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """Columns of ``actions`` replace those of the row with their key where they are not null; unknown keys do nothing."""
    named = [c for c in actions.columns if c != key]
    renamed = actions.select(key, *[F.col(c).alias(f"_{c}") for c in named])
    return rows.join(renamed, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in named else F.col(c) for c in rows.columns])


def replace_for(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` are replaced by ``new``."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def recheck(findings: DataFrame, bodies: DataFrame, core: Column) -> DataFrame:
    """Open if the evidence still stands on the newest page, fixed if not, unverifiable without a readable page."""
    b = bodies.select("url_id", F.lower("body_text").alias("_b"))
    found = F.contains(F.col("_b"), F.lower(core)) & (core != "")
    checked = F.when(F.col("_b").isNull(), "unverifiable").when(found, "open").otherwise("fixed")
    return findings.join(b, "url_id", "left").withColumn("recheck", checked).drop("_b")


def edit(rows: DataFrame, edits: DataFrame, key: str, kept: Sequence[str]) -> DataFrame:
    """``apply_actions`` for edits by hand: edited rows are marked, and the first edit keeps the old ``kept`` columns as JSON."""
    before = F.when(F.col("_edit"), F.coalesce("original_snapshot", F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}))).otherwise(F.col("original_snapshot"))
    marked = rows.join(edits.select(key, F.lit(True).alias("_edit")), key, "left").withColumn("_edit", F.coalesce("_edit", F.lit(False)))
    marked = marked.withColumns({"original_snapshot": before, "edited": F.col("_edit") | F.coalesce("edited", F.lit(False))}).drop("_edit")
    return apply_actions(marked, edits, key)


def start_runs(runs: DataFrame | None, started: DataFrame) -> DataFrame:
    """Adds runs (run_id, source_id, kind, started_at) that have not ended."""
    new = started.withColumn("finished_at", F.lit(None).cast("string"))
    return new if runs is None else runs.unionByName(new)


def finish_runs(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """Sets finished_at of runs (run_id, finished_at); a run that was told to have ended before keeps the new time."""
    return apply_actions(runs, ended, "run_id")


def last_runs(runs: DataFrame) -> DataFrame:
    """(source_id, last_run_at): the last start of each source, whether it ended or not."""
    return runs.groupBy("source_id").agg(F.max("started_at").alias("last_run_at"))


def _taken(columns: Sequence[str]) -> dict[str, Column]:
    """Merge rules: the new row's value where there is a new row, null or not."""
    return {c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in columns}


def save_filters(filters: DataFrame, new: DataFrame) -> DataFrame:
    """Saved filters (filter_id, source_id, context, name, model, ...) by source, context and name: a known one takes the new model and keeps the rest."""
    return merge(filters, new, ("source_id", "context", "name"), _taken(["model"]))


#: What saving a rule or importing a file changes of a rule that is there; it stays enabled or not, and keeps its window.
SAVED = ("rule_type", "category", "correct_value", "search_terms", "stale_patterns", "allowed_patterns", "required_context", "severity", "product_id")
IMPORTED = ("correct_value", "stale_patterns")


def save_rules(rules: DataFrame, new: DataFrame, columns: Sequence[str] = SAVED) -> DataFrame:
    """Rules by slug: known ones take ``columns`` of the new row, new ones are added as they are."""
    return merge(rules, new, ("slug",), _taken([c for c in columns if c in rules.columns and c in new.columns]))


def toggle(rules: DataFrame, slugs: DataFrame) -> DataFrame:
    """Rules named by ``slugs`` (slug) are switched from enabled to not, or back; named twice counts once."""
    named = slugs.select("slug").distinct().withColumn("_named", F.lit(1))
    switched = F.when(F.col("_named") == 1, 1 - F.col("enabled")).otherwise(F.col("enabled"))
    return rules.join(named, "slug", "left").withColumn("enabled", switched).select(rules.columns)


def approve(pages: DataFrame, source_id: int, ids: DataFrame | None = None) -> DataFrame:
    """Pages of a source become ok: those of ``ids`` (page_id), or without it all its candidates."""
    own = F.col("source_id") == source_id
    if ids is None:
        return pages.withColumn("fetch_status", F.when(own & (F.col("fetch_status") == "candidate"), "ok").otherwise(F.col("fetch_status")))
    named = ids.select("page_id").distinct().withColumn("_named", F.lit(1))
    return pages.join(named, "page_id", "left").withColumn("fetch_status", F.when(own & (F.col("_named") == 1), "ok").otherwise(F.col("fetch_status"))).select(pages.columns)
