"""State tables, page groups, sources, extraction, sinks and the stream."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.functions import text as X
from factflow.functions import urls as U
from factflow.operators import detect as K
from factflow.operators import graph as N
from factflow.operators import pages as B
from factflow.operators import snapshots as S
from factflow.operators import state as M
from factflow.operators.stored import Stored
from factflow.plans import detection as T
from factflow.plans.detection import _FOUND, _SCAN, claim_inventory, claims_found, stale_rules
from factflow.plans.registry import ORACLES, Tables, o, query
from factflow.plans.scalars import _MARKED, evidence_sql
from factflow.plans.tables import _JOINED, _LATEST, _VALUES, findings, findings_by_url, recovered
from factflow.sources import landed as A
from factflow.sources.folders import checkpointed, scratch
from factflow.streaming import site as Y
from factflow.streaming import sync as P

_RG, _CT = o("registry"), o("catalog")
_I, _U, _M, _R, _P, _C, _X, _J, _F = (o(n) for n in ("issues", "urls", "matches", "rules", "products", "crawls", "external", "jobs", "faqs"))

# M: state
_NEW = f"(SELECT url_id, category, title, related_url_id, 'high' AS severity, CASE WHEN issue_id % 4 = 0 THEN 'other words' ELSE evidence END AS evidence, 'open' AS status, issue_id AS write_seq FROM {_I} WHERE issue_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY url_id, category, title, related_url_id ORDER BY issue_id DESC) = 1)"
_OLD = f"(SELECT * FROM {_I} QUALIFY row_number() OVER (PARTITION BY url_id, category, title, related_url_id ORDER BY issue_id DESC) = 1)"


def _old_findings(t: Tables) -> DataFrame:
    return S.latest(t.fx("issues"), M.FINDING_KEY, ["issue_id"])


@query("merge_findings", f"""SELECT url_id, category, title, related_url_id, coalesce(n.severity, o.severity) AS severity, CASE WHEN n.url_id IS NULL THEN o.evidence ELSE n.evidence END AS evidence,
CASE WHEN n.url_id IS NULL OR o.status IN ('ignored', 'false_positive') OR (o.deleted_at IS NOT NULL AND coalesce(o.evidence = n.evidence, false)) THEN o.status ELSE n.status END AS status,
CASE WHEN coalesce(o.evidence <> n.evidence, false) THEN NULL ELSE o.deleted_at END AS deleted_at FROM {_OLD} o LEFT JOIN {_NEW} n USING (url_id, category, title, related_url_id)""")
def merge_findings(t: Tables) -> DataFrame:
    new = t.fx("issues").where("issue_id % 3 = 0").withColumns({"severity": F.lit("high"), "status": F.lit("open"), "evidence": F.when(F.col("issue_id") % 4 == 0, "other words").otherwise(F.col("evidence")), "write_seq": F.col("issue_id")})
    return M.merge_findings(_old_findings(t), new).select("url_id", "category", "title", "related_url_id", "severity", "evidence", "status", "deleted_at")


def _stored(t: Tables, old: DataFrame, new: DataFrame, keys: Sequence[str], how) -> DataFrame:
    """A merge into a table that is kept in buckets: version 0 is the table as it was, version 1 what comes of it."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in old.schema)
    table = Stored(scratch(t.spark, "stored"), schema, keys, 8)
    table.write(table.placed(old), 0)
    return table.change(t.spark, 0, new, how)


def _run_findings(t: Tables) -> DataFrame:
    return t.fx("issues").where("issue_id % 3 = 0").withColumns({"severity": F.lit("high"), "status": F.lit("open"), "evidence": F.when(F.col("issue_id") % 4 == 0, "other words").otherwise(F.col("evidence")), "write_seq": F.col("issue_id")})


@query("merge_findings_stored", ORACLES["merge_findings"])
def merge_findings_stored(t: Tables) -> DataFrame:
    return _stored(t, _old_findings(t), _run_findings(t), M.FINDING_KEY, M.merge_findings).select("url_id", "category", "title", "related_url_id", "severity", "evidence", "status", "deleted_at")


@query("merge_matches_stored", ORACLES["merge_matches"])
def merge_matches_stored(t: Tables) -> DataFrame:
    new = K.stale_scan(t.fx("claims"), stale_rules(t)).select("rule_id", "url_id", "verdict")
    return _stored(t, t.fx("matches").select("rule_id", "url_id", "verdict"), new, ["rule_id", "url_id"], M.merge_verdicts)


@query("clear_matches", f"SELECT rule_id, url_id FROM {_M} WHERE url_id NOT IN (SELECT url_id FROM {_U} WHERE source_id = 1)")
def clear_matches(t: Tables) -> DataFrame:
    return t.fx("matches").join(t.fx("urls").where("source_id = 1").select("url_id"), "url_id", "left_anti").select("rule_id", "url_id")


@query("reconcile_fixed", f"SELECT issue_id, CASE WHEN status = 'open' AND category IN ('faq', 'positioning', 'free_claim') AND detection_method IN ('regex', 'inventory') AND detected_at < '2024-06-01' THEN 'fixed' ELSE status END AS status FROM {_I}")
def reconcile_fixed(t: Tables) -> DataFrame:
    return M.reconcile(t.fx("issues"), "2024-06-01", ["faq", "positioning", "free_claim"], ["regex", "inventory"]).select("issue_id", "status")


_RULE_OF = "CASE WHEN starts_with(title, 'llm:') OR starts_with(title, 'lang_ctx:') OR starts_with(title, 'reg_ctx:') THEN array_to_string(string_split(title, ':')[1:2], ':') ELSE string_split(title, ':')[1] END"


@query("dedup_findings", f"""SELECT arg_min(issue_id, detected_at || lpad(CAST(issue_id AS VARCHAR), 12, '0')) AS issue_id, CASE WHEN bool_or(status = 'open') THEN 'open' WHEN bool_or(status = 'unclear') THEN 'unclear' ELSE arg_min(status, detected_at || lpad(CAST(issue_id AS VARCHAR), 12, '0')) END AS status, max(last_checked_at) AS last_checked_at
FROM {_I} WHERE deleted_at IS NULL GROUP BY source_id, url_id, category, {_RULE_OF}, coalesce(evidence, '') UNION ALL SELECT issue_id, status, last_checked_at FROM {_I} WHERE deleted_at IS NOT NULL""")
def dedup_findings(t: Tables) -> DataFrame:
    return M.collapse_duplicates(t.fx("issues")).select("issue_id", "status", "last_checked_at")


_DIGITS = "regexp_replace({0}, '\\p{{Nd}}', 'n', 'g')"
_EVID = f"(SELECT issue_id, {_DIGITS.format('evidence')} AS stored, trim({_DIGITS.format('evidence')}) AS b, {_DIGITS.format('mv')} AS mv FROM (SELECT i.issue_id, i.evidence, coalesce(i.matched_value, m.v) AS mv FROM {_I} i LEFT JOIN {_VALUES} m ON m.url_id = i.url_id AND m.e = coalesce(i.evidence, '')) x0 WHERE evidence <> '')"
_EVENDS = f"(SELECT *, length(b) AS n, list_transform(range(1, len(q)), lambda k: CAST(length(array_to_string(q[1:k], '')) AS INT)) AS ends, CASE WHEN coalesce(mv, '') <> '' AND contains(b, mv) THEN instr(b, mv) - 1 ELSE length(b) // 2 END AS at_, CASE WHEN coalesce(mv, '') <> '' AND contains(b, mv) THEN length(mv) ELSE 1 END AS w FROM (SELECT *, string_split({_MARKED}, '\x01') AS q FROM {_EVID} x1) x2)"


@query("backfill_evidence", f"SELECT issue_id, CASE WHEN cut <> '' THEN cut ELSE stored END AS evidence, cut <> '' AND cut <> stored AS trimmed FROM (SELECT issue_id, stored, CASE WHEN n <= 300 AND len(ends) <= 1 THEN b ELSE evidence END AS cut FROM ({evidence_sql(_EVENDS, 'issue_id, stored, n, ends, b')}) x3)")
def backfill_evidence(t: Tables) -> DataFrame:
    """Stored evidence cut to its sentence, the matched value recovered first; ``trimmed`` marks what changed."""
    own = recovered(t).where("evidence <> ''").select("issue_id", *[F.regexp_replace(c, r"\p{Nd}", "n").alias(c) for c in ("evidence", "matched_value")])
    cut = X.with_trimmed_evidence(own, "evidence", F.col("matched_value"), "cut")
    changed = (F.col("cut") != "") & (F.col("cut") != F.col("evidence"))
    return cut.select("issue_id", F.when(changed, F.col("cut")).otherwise(F.col("evidence")).alias("evidence"), changed.alias("trimmed"))


@query("merge_urls", f"SELECT url_id, CASE WHEN url_id % 2 = 0 THEN first_seen ELSE '2024-12-01' END AS first_seen, CASE WHEN url_id % 3 = 0 THEN '2024-11-11' WHEN url_id % 2 = 0 THEN lastmod END AS lastmod FROM {_U} WHERE url_id % 2 = 0 OR url_id % 3 = 0")
def merge_urls(t: Tables) -> DataFrame:
    u = t.fx("urls")
    new = u.where("url_id % 3 = 0").select("url_id", F.lit("2024-12-01").alias("first_seen"), F.lit("2024-11-11").alias("lastmod"))
    return M.merge(u.where("url_id % 2 = 0").select("url_id", "first_seen", "lastmod"), new, ["url_id"], new_first=["lastmod"])


@query("merge_urls_stored", ORACLES["merge_urls"])
def merge_urls_stored(t: Tables) -> DataFrame:
    u = t.fx("urls")
    new = u.where("url_id % 3 = 0").select("url_id", F.lit("2024-12-01").alias("first_seen"), F.lit("2024-11-11").alias("lastmod"))
    return _stored(t, u.where("url_id % 2 = 0").select("url_id", "first_seen", "lastmod"), new, ["url_id"], lambda a, b: M.merge(a, b, ["url_id"], new_first=["lastmod"]))


@query("rules_import_merge", f"SELECT slug, severity, coalesce(correct_value, '-') AS correct_value FROM (SELECT slug, CASE WHEN rule_id % 2 = 0 THEN 'low' ELSE severity END AS severity, CASE WHEN rule_id % 2 = 0 THEN 'imported' ELSE correct_value END AS correct_value FROM {_RG} UNION ALL SELECT 'brand_new', 'low', 'imported')")
def rules_import_merge(t: Tables) -> DataFrame:
    r = t.fx("registry").select("slug", "severity", "correct_value")
    new = t.fx("registry").where("rule_id % 2 = 0").select("slug").unionByName(t.spark.createDataFrame([("brand_new",)], "slug string")).select("slug", F.lit("low").alias("severity"), F.lit("imported").alias("correct_value"))
    return M.merge(r, new, ["slug"], new_first=["severity", "correct_value"]).select("slug", "severity", F.coalesce("correct_value", F.lit("-")).alias("correct_value"))


_QUERIES = f"(SELECT title AS query_text, min(issue_id) AS query_id, 'value ' || min(issue_id) AS correct_value, count(*) AS runs FROM {_I} WHERE issue_id % 3 <> 0 GROUP BY title)"
_RERUN = f"(SELECT title AS query_text, max(issue_id) AS query_id, CASE WHEN max(issue_id) % 2 = 0 THEN 'new ' || max(issue_id) END AS correct_value, count(*) AS runs FROM {_I} WHERE issue_id % 3 = 0 GROUP BY title)"


@query("merge_queries", f"SELECT query_text, coalesce(o.query_id, n.query_id) AS query_id, coalesce(n.correct_value, o.correct_value) AS correct_value, coalesce(o.runs, 0) + coalesce(n.runs, 0) AS runs FROM {_QUERIES} o FULL JOIN {_RERUN} n USING (query_text)")
def merge_queries(t: Tables) -> DataFrame:
    """Saved queries by their text: the first id stays, a new value counts where there is one, runs add up."""
    own = t.fx("issues").select(F.col("title").alias("query_text"), "issue_id")
    old = own.where("issue_id % 3 <> 0").groupBy("query_text").agg(F.min("issue_id").alias("query_id"), F.concat(F.lit("value "), F.min("issue_id")).alias("correct_value"), F.count("*").alias("runs"))
    last = F.max("issue_id")
    new = own.where("issue_id % 3 = 0").groupBy("query_text").agg(last.alias("query_id"), F.when(last % 2 == 0, F.concat(F.lit("new "), last)).alias("correct_value"), F.count("*").alias("runs"))
    runs = F.coalesce("o.runs", F.lit(0)) + F.coalesce("n.runs", F.lit(0))
    return M.merge(old, new, ["query_text"], {"runs": runs}, new_first=["correct_value"])


@query("merge_features", f"SELECT name, arg_max(status, k) AS status, arg_max(aliases, k) AS aliases, min(product_id) AS feature_id FROM (SELECT name, product_id, 'available' AS status, aliases, product_id AS k FROM {_CT} WHERE product_id % 3 <> 0 UNION ALL SELECT name, product_id, 'planned', 'x,' || aliases, 1000000000 + product_id FROM {_CT} WHERE product_id % 3 = 0) GROUP BY name")
def merge_features(t: Tables) -> DataFrame:
    """Feature entries by name: the last of a file's rows wins, an entry that is there keeps its id."""
    rows = t.fx("catalog").select("name", "product_id", "aliases")
    old = S.latest(rows.where("product_id % 3 <> 0"), ["name"], ["product_id"]).select("name", F.lit("available").alias("status"), "aliases")
    new = S.latest(rows.where("product_id % 3 = 0"), ["name"], ["product_id"]).select("name", F.lit("planned").alias("status"), F.concat(F.lit("x,"), "aliases").alias("aliases"))
    merged = M.merge(old, new, ["name"], new_first=["status", "aliases"])
    return merged.join(rows.groupBy("name").agg(F.min("product_id").alias("feature_id")), "name")


_SFK = "source_id, context, name"


@query("merge_filters", f"""WITH o AS (SELECT * FROM {o('saved_filters')} WHERE filter_id % 30 <> 0 QUALIFY row_number() OVER (PARTITION BY {_SFK} ORDER BY filter_id) = 1), n AS (SELECT * FROM {o('saved_filters')} WHERE filter_id % 30 = 0 QUALIFY row_number() OVER (PARTITION BY {_SFK} ORDER BY filter_id DESC) = 1)
SELECT {_SFK}, coalesce(o.filter_id, n.filter_id) AS filter_id, CASE WHEN n.filter_id IS NULL THEN o.model ELSE n.model END AS model FROM o FULL JOIN n USING ({_SFK})""")
def merge_filters(t: Tables) -> DataFrame:
    """Saved filters by source, context and name: a known one takes the model it is saved with again."""
    rows, key = t.fx("saved_filters").select("filter_id", "source_id", "context", "name", "model"), ["source_id", "context", "name"]
    new = S.latest(rows.where("filter_id % 30 = 0"), key, ["filter_id"])
    old = rows.where("filter_id % 30 <> 0").groupBy(*key).agg(F.min(F.struct("filter_id", "model")).alias("f")).select("f.filter_id", *key, "f.model")
    return M.save_filters(old, new).select(*key, "filter_id", "model")


@query("save_rules", f"SELECT slug, CASE WHEN rule_id % 2 = 0 THEN 'low' ELSE severity END AS severity, coalesce(CASE WHEN rule_id % 2 = 0 THEN NULLIF('saved', CASE WHEN rule_id % 4 = 0 THEN 'saved' END) ELSE correct_value END, '-') AS correct_value, CASE WHEN rule_id % 2 = 0 THEN '[\"new\"]' ELSE stale_patterns END AS stale_patterns, enabled FROM {_RG}")
def save_rules(t: Tables) -> DataFrame:
    """Rules that are saved again by hand take the new values, also empty ones; whether they are enabled stays."""
    r = t.fx("registry").select("slug", "severity", "correct_value", "stale_patterns", "enabled", "rule_id")
    new = r.where("rule_id % 2 = 0").select("slug", F.lit("low").alias("severity"), F.when(F.col("rule_id") % 4 != 0, "saved").alias("correct_value"), F.lit('["new"]').alias("stale_patterns"), F.lit(1).alias("enabled"))
    return M.save_rules(r.drop("rule_id"), new).selectExpr("slug", "severity", "coalesce(correct_value, '-') AS correct_value", "stale_patterns", "enabled")


@query("import_rules", f"SELECT slug, severity, coalesce(CASE WHEN rule_id % 2 = 0 THEN 'imported' ELSE correct_value END, '-') AS correct_value, CASE WHEN rule_id % 2 = 0 THEN '[\"new\"]' ELSE stale_patterns END AS stale_patterns, enabled FROM {_RG} UNION ALL SELECT 'brand_new', 'low', 'imported', '[\"new\"]', 1")
def import_rules(t: Tables) -> DataFrame:
    """Rules of an imported file change two columns of known rules, and are added where they are new."""
    r = t.fx("registry").select("slug", "severity", "correct_value", "stale_patterns", "enabled")
    named = t.fx("registry").where("rule_id % 2 = 0").select("slug").unionByName(t.spark.createDataFrame([("brand_new",)], "slug string"))
    new = named.select("slug", F.lit("low").alias("severity"), F.lit("imported").alias("correct_value"), F.lit('["new"]').alias("stale_patterns"), F.lit(1).alias("enabled"))
    return M.save_rules(r, new, M.IMPORTED).selectExpr("slug", "severity", "coalesce(correct_value, '-') AS correct_value", "stale_patterns", "enabled")


@query("toggle_rules", f"SELECT slug, CASE WHEN rule_id % 3 = 1 THEN 1 - enabled ELSE enabled END AS enabled FROM {_RG}")
def toggle_rules(t: Tables) -> DataFrame:
    return M.toggle(t.fx("registry"), t.fx("registry").where("rule_id % 3 = 1")).select("slug", "enabled")


_CAND = o("candidates")


@query("approve_pages", f"SELECT page_id, CASE WHEN source_id = 2 AND fetch_status = 'candidate' OR source_id = 1 AND page_id % 6 = 0 THEN 'ok' ELSE fetch_status END AS fetch_status FROM {_CAND}")
def approve_pages(t: Tables) -> DataFrame:
    """All candidates of one source, and named pages of another; pages of a third that are named too stay as they are."""
    named = t.fx("candidates").where("page_id % 6 IN (0, 5)").select("page_id")
    return M.approve(M.approve(t.fx("candidates"), 2), 1, named).select("page_id", "fetch_status")


@query("replace_faqs", f"SELECT faq_id, answer FROM {_F} WHERE url_id % 4 <> 0 UNION ALL SELECT faq_id, 'fresh' FROM {_F} WHERE url_id % 4 = 0 AND faq_id % 2 = 0 UNION ALL SELECT faq_id, answer FROM {_F} f WHERE url_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM {_F} g WHERE g.url_id = f.url_id AND g.faq_id % 2 = 0)")
def replace_faqs(t: Tables) -> DataFrame:
    f = t.fx("faqs").select("faq_id", "url_id", "answer")
    return M.replace_for(f, f.where("url_id % 4 = 0 AND faq_id % 2 = 0").withColumn("answer", F.lit("fresh")), "url_id").select("faq_id", "answer")


_RECHECK = f"(SELECT issue_id, CASE WHEN b IS NULL THEN 'unverifiable' WHEN core <> '' AND contains(lower(b), lower(core)) THEN 'open' ELSE 'fixed' END AS recheck FROM (SELECT issue_id, url_id, left(trim(coalesce(evidence, '')), 80) AS core FROM {_I}) i LEFT JOIN (SELECT url_id, body_text AS b FROM {_LATEST} WHERE coalesce(body_text, '') <> '') l USING (url_id))"


def _rechecked(t: Tables) -> DataFrame:
    return M.recheck(t.fx("issues"), S.readable(t.fx("crawls")), X.evidence_core(F.col("evidence"))).select("issue_id", "recheck")


@query("recheck_findings", f"SELECT issue_id, recheck FROM {_RECHECK}")
def recheck_findings(t: Tables) -> DataFrame:
    return _rechecked(t)


@query("recheck_tally", f"SELECT recheck, count(*) AS n FROM {_RECHECK} GROUP BY recheck")
def recheck_tally(t: Tables) -> DataFrame:
    return _rechecked(t).groupBy("recheck").agg(F.count("*").alias("n"))


@query("false_positive_learn", f"SELECT slug, list_sort(list_distinct(list(phrase))) AS learned FROM (SELECT {_RULE_OF} AS slug, left(trim(evidence), 80) AS phrase FROM {_I} WHERE status = 'false_positive' AND evidence IS NOT NULL) JOIN (SELECT DISTINCT slug FROM {_R}) r USING (slug) GROUP BY slug".replace("list_sort(list_distinct(list(phrase)))", "array_to_string(list_sort(list_distinct(list(phrase))), '|')"))
def false_positive_learn(t: Tables) -> DataFrame:
    marked = X.staged(t.fx("issues").where("status = 'false_positive' AND evidence IS NOT NULL"), _title=F.col("title"), _core=X.evidence_core(F.col("evidence")))
    learned = marked.groupBy(X.fact_rule_of(F.col("_title")).alias("slug")).agg(F.collect_set("_core").alias("p"))
    rules = t.fx("rules").select("slug", F.array().cast("array<string>").alias("allowed"))
    return rules.join(learned, "slug").select("slug", F.array_join(F.array_sort(F.array_union("allowed", "p")), "|").alias("learned"))


@query("edit_findings", f"SELECT issue_id, CASE WHEN issue_id % 5 = 0 THEN 'edited' ELSE note END AS note, CASE WHEN issue_id % 10 = 0 THEN 'low' ELSE severity END AS severity, CASE WHEN issue_id % 15 = 0 THEN 'faq' ELSE category END AS category, issue_id % 5 = 0 AS edited, CASE WHEN issue_id % 20 = 0 THEN '{{}}' WHEN issue_id % 5 = 0 THEN CAST(json_object('severity', severity, 'category', category, 'expected', expected) AS VARCHAR) END AS original_snapshot FROM {_I}")
def edit_findings(t: Tables) -> DataFrame:
    k = F.col("issue_id")
    i = t.fx("issues").withColumns({"edited": F.lit(False), "original_snapshot": F.when(k % 20 == 0, "{}")})
    edits = i.where(k % 5 == 0).select("issue_id", F.lit("edited").alias("note"), F.when(k % 10 == 0, "low").alias("severity"), F.when(k % 15 == 0, "faq").alias("category"))
    return M.edit(i, edits, "issue_id", ("severity", "category", "expected")).select("issue_id", "note", "severity", "category", "edited", "original_snapshot")


@query("apply_actions", f"SELECT issue_id, CASE issue_id % 7 WHEN 0 THEN 'ignored' WHEN 1 THEN 'fixed' ELSE status END AS status, CASE WHEN issue_id % 7 = 2 THEN '2024-12-24' ELSE deleted_at END AS deleted_at FROM {_I}")
def apply_actions(t: Tables) -> DataFrame:
    k = F.col("issue_id") % 7
    actions = t.fx("issues").where(k <= 2).select("issue_id", F.when(k == 0, "ignored").when(k == 1, "fixed").alias("status"), F.when(k == 2, "2024-12-24").alias("deleted_at"))
    return M.apply_actions(t.fx("issues"), actions, "issue_id").select("issue_id", "status", "deleted_at")


@query("merge_external_pages", "SELECT source_id, url FROM (SELECT page_id % 3 AS source_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages) GROUP BY ALL")
def merge_external_pages(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", (F.col("page_id") % 3).alias("source_id"), F.regexp_replace("url", "[?#].*$", "").alias("url"))
    old, new = rows.where("page_id % 2 = 0").select("source_id", "url").distinct(), rows.select("source_id", "url").distinct()
    return old.unionByName(new.join(old, ["source_id", "url"], "left_anti"))


@query("merge_cache", f"SELECT content_hash, max(crawl_id) AS crawl_id FROM {_C} WHERE content_hash IS NOT NULL GROUP BY 1")
def merge_cache(t: Tables) -> DataFrame:
    return S.latest(t.fx("crawls").where("content_hash IS NOT NULL").select("content_hash", "crawl_id"), ["content_hash"], ["crawl_id"])


@query("link_query_findings", f"SELECT issue_id, CASE WHEN title LIKE 'fact:%' THEN 7 END AS query_id, group_id FROM {_I} LEFT JOIN (SELECT url_id, group_id FROM {_U}) u USING (url_id)")
def link_query_findings(t: Tables) -> DataFrame:
    return t.fx("issues").join(t.fx("urls").select("url_id", "group_id"), "url_id", "left").select("issue_id", F.when(F.col("title").startswith("fact:"), 7).alias("query_id"), "group_id")


@query("run_log", f"SELECT job_id AS run_id, source_id, job_type AS kind, started_at, CASE WHEN status = 'done' THEN finished_at END AS finished_at, max(started_at) OVER (PARTITION BY source_id) AS last_run_at FROM {_J}")
def run_log(t: Tables) -> DataFrame:
    """Runs as they start, then as they end; the source takes over the time of its last start."""
    j = t.fx("jobs")
    begun = M.start_runs(None, j.select(F.col("job_id").alias("run_id"), "source_id", F.col("job_type").alias("kind"), "started_at"))
    ended = M.finish_runs(begun, j.where("status = 'done'").select(F.col("job_id").alias("run_id"), "finished_at"))
    return ended.join(M.last_runs(ended), "source_id").select("run_id", "source_id", "kind", "started_at", "finished_at", "last_run_at")


# A: sources
_XMLP = "(SELECT page_id, regexp_replace(url, '[?#].*$', '') AS loc, CASE WHEN page_id % 3 = 0 THEN NULL ELSE '2024-01-0' || (1 + page_id % 9) END AS lastmod, page_id // 10 AS doc FROM pages)"
_ALT = f"(SELECT p.page_id, p.doc, p.loc, q.loc AS alt FROM {_XMLP} p JOIN {_XMLP} q ON q.page_id = p.page_id + 1 AND q.page_id // 4 = p.page_id // 4 UNION ALL SELECT page_id, doc, loc, loc || '/alt' FROM {_XMLP} WHERE page_id % 5 = 0)"


def _sitemaps(t: Tables) -> DataFrame:
    """Sitemaps of ten pages each; alternates are the next page of four and, for a fifth of the pages, one more."""
    own = t.pages.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("loc"))
    own = own.join(own.select((F.col("page_id") - 1).alias("page_id"), F.col("loc").alias("next")), "page_id", "left")
    lastmod = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("<lastmod> 2024-01-0"), (1 + F.col("page_id") % 9).cast("string"), F.lit(" </lastmod>")))
    link = lambda c: F.concat(F.lit('<xhtml:link rel="Alternate" hreflang="fr" href="'), c, F.lit('"/>'))
    alt = F.concat(F.when(F.col("page_id") % 5 == 0, link(F.concat("loc", F.lit("/alt")))).otherwise(""), F.when((F.col("page_id") % 4 != 3) & F.col("next").isNotNull(), link(F.col("next"))).otherwise(""))
    entry = F.concat(F.lit("<url><loc> "), "loc", F.lit(" </loc>"), lastmod, alt, F.lit("</url>"))
    docs = own.groupBy(F.expr("page_id div 10").alias("doc")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("b"))
    return docs.select("doc", F.concat(F.lit("<urlset>"), "b", F.lit("<url><lastmod>x</lastmod></url></urlset>")).alias("xml"))


_ENTRIES = f"SELECT x.doc, x.loc, lastmod, coalesce(string_agg(alt, '|' ORDER BY alt <> x.loc || '/alt'), '') AS alternate FROM {_XMLP} x LEFT JOIN {_ALT} a USING (page_id) GROUP BY x.page_id, x.doc, x.loc, lastmod"


@query("sitemap_entries", _ENTRIES)
def sitemap_entries(t: Tables) -> DataFrame:
    return A.sitemap_texts(_sitemaps(t)).select("doc", "loc", "lastmod", F.array_join("alternates", "|").alias("alternate"))


@query("sitemap_gzip", _ENTRIES)
def sitemap_gzip(t: Tables) -> DataFrame:
    """Sitemaps as they are fetched: bytes, every other one packed."""
    fetched = A.packed(_sitemaps(t), "xml", F.col("doc") % 2 == 0)
    return A.sitemap_texts(A.unpacked(fetched, "xml")).select("doc", "loc", "lastmod", F.array_join("alternates", "|").alias("alternate"))


@query("sitemap_url_union", f"SELECT loc AS url FROM {_XMLP} UNION SELECT alt FROM {_ALT}")
def sitemap_url_union(t: Tables) -> DataFrame:
    e = A.sitemap_texts(_sitemaps(t))
    return e.select(F.col("loc").alias("url")).unionByName(e.select(F.explode("alternates").alias("url"))).distinct()


_CLOSURE = f"e(x, y) AS (SELECT loc, alt FROM {_ALT} UNION SELECT alt, loc FROM {_ALT}), r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b), g AS (SELECT a AS node, dense_rank() OVER (ORDER BY least(a, m)) AS k FROM (SELECT a, min(b) AS m FROM r GROUP BY a))"


@query("hreflang_groups", f"WITH RECURSIVE {_CLOSURE} SELECT node, k AS \"group\" FROM g")
def hreflang_groups(t: Tables) -> DataFrame:
    return N.groups(A.alternate_pairs(A.sitemap_texts(_sitemaps(t))))


_DOM = "regexp_extract({0}, '://[^/?#:]*?([^./?#:]+[.][^./?#:]+)(?:[:/?#]|$)', 1)"


@query("ingest_stats", f"WITH RECURSIVE {_CLOSURE}, u AS (SELECT loc AS url FROM {_XMLP} UNION SELECT alt FROM {_ALT}) SELECT (SELECT count(*) FROM u) AS total, (SELECT count(*) FROM u WHERE {_DOM.format('url')} = 'example.com') AS on_domain, (SELECT count(*) FROM {_ALT} WHERE {_DOM.format('alt')} <> 'example.com') AS external, (SELECT coalesce(max(k), 0) FROM g) AS groups")
def ingest_stats(t: Tables) -> DataFrame:
    return A.ingest_stats(A.sitemap_texts(_sitemaps(t)), "example.com")


# Links that stand in the pages, all to paths of their own host, and links from page to page laid between them.
_EXCLUDED = ["example.org"]
_OWN = "(SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || regexp_replace(h, '#.*$', '') AS link, url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"(/[^/\"][^\"]*)\"', 1)) AS h FROM pages))"
_OUT = f"(SELECT p.page_id AS src, q.page_id AS dst, regexp_replace(q.url, '#.*$', '') AS node FROM pages p JOIN pages q ON q.page_id IN (2 * p.page_id + 1, 3 * p.page_id + 1) WHERE p.page_id % 7 <> 5 AND {_DOM.format('p.url')} = {_DOM.format('q.url')} UNION ALL SELECT page_id, NULL, link FROM {_OWN})"


def _linked(t: Tables) -> DataFrame:
    """Pages whose text links to others, so that a crawl can go on from each."""
    p = t.pages.select("page_id", "url")
    to = p.where("page_id % 7 <> 5").select("page_id", F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 3 + 1)).alias("dst"))
    anchor = to.join(p.select(F.col("page_id").alias("dst"), F.col("url").alias("target")), "dst").select("page_id", F.concat(F.lit('<a href="'), "target", F.lit('">x</a>')).alias("a"))
    more = anchor.groupBy("page_id").agg(F.array_join(F.collect_list("a"), " ").alias("more"))  # two a page
    return t.pages.select("page_id", "url", "html").join(more, "page_id", "left").select("page_id", "url", F.concat("html", F.coalesce("more", F.lit(""))).alias("html"))


@query("link_bfs", f"WITH RECURSIVE r(id, node, depth) AS (SELECT page_id, regexp_replace(url, '#.*$', ''), 0 FROM pages WHERE page_id IN (SELECT min(page_id) FROM pages GROUP BY {_DOM.format('url')}) UNION SELECT l.dst, l.node, r.depth + 1 FROM r JOIN {_OUT} l ON l.src = r.id) SELECT node, min(depth) AS depth FROM r GROUP BY node ORDER BY depth, node LIMIT 500")
def link_bfs(t: Tables) -> DataFrame:
    """A crawl of every site, from its first page."""
    pages = _linked(t)
    own = F.regexp_replace("url", "#.*$", "")
    links = checkpointed(B.links(pages).select(own.alias("src"), F.col("link").alias("dst")))  # pages are parsed once, not at each depth
    first = t.pages.groupBy(U.registrable_domain(U.host(F.col("url"))).alias("site")).agg(F.min_by(own, "page_id").alias("node"))
    return N.discover(links, first.select("node"), 500)


_KIDS = "(SELECT p.page_id AS src, q.page_id AS dst FROM pages p JOIN pages q ON q.page_id IN (2 * p.page_id + 1, 3 * p.page_id + 1) WHERE p.page_id % 7 <> 5)"


def _indexes(t: Tables) -> DataFrame:
    """A sitemap for every page: an index of others, or, without any, one that lists its page."""
    p = t.pages.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("loc"))
    to = p.where("page_id % 7 <> 5").select("page_id", F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 3 + 1)).alias("dst")).join(p.select(F.col("page_id").alias("dst")), "dst", "left_semi")
    child = F.concat(F.lit("<sitemap><loc> sm"), "dst", F.lit(" </loc></sitemap>"))
    index = to.groupBy("page_id").agg(F.array_join(F.collect_list(child), "").alias("kids"))
    xml = F.when(F.col("kids").isNotNull(), F.concat(F.lit("<sitemapindex>"), "kids", F.lit("</sitemapindex>"))).otherwise(F.concat(F.lit("<urlset><url><loc>"), "loc", F.lit("</loc></url></urlset>")))
    return p.join(index, "page_id", "left").select(F.concat(F.lit("sm"), "page_id").alias("sitemap"), xml.alias("xml"))


@query("sitemap_index_expand", f"WITH RECURSIVE r(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT l.dst FROM r JOIN {_KIDS} l ON l.src = r.node) SELECT 'sm' || node AS sitemap, regexp_replace(url, '[?#].*$', '') AS loc FROM r JOIN pages ON page_id = node WHERE node NOT IN (SELECT src FROM {_KIDS})")
def sitemap_index_expand(t: Tables) -> DataFrame:
    docs = _indexes(t)
    return A.expanded(docs, docs.where("sitemap = 'sm0'")).select("sitemap", "loc")


@query("url_list_scan", "SELECT CASE page_id % 4 WHEN 0 THEN upper(left(url, 4)) || substr(url, 5) ELSE url END AS url FROM pages WHERE page_id % 4 <> 3")
def url_list_scan(t: Tables) -> DataFrame:
    """A list of lines; every fourth one is a comment."""
    k = F.col("page_id")
    line = F.when(k % 4 == 0, F.concat(F.lit("  "), F.upper(F.left("url", F.lit(4))), F.expr("substring(url, 5)"), F.lit("  "))).when(k % 4 == 3, F.concat(F.lit("# "), "url")).otherwise(F.col("url"))
    return A.url_list(t.pages.select(line.alias("value")))


@query("url_list_csv", "SELECT CASE page_id % 5 WHEN 1 THEN url || ',x' WHEN 2 THEN url || '\"q\"' ELSE url END AS url FROM pages WHERE page_id % 5 <> 4")
def url_list_csv(t: Tables) -> DataFrame:
    """The first cells of comma-separated lines, some quoted, with commas and doubled quotes inside."""
    k, q = F.col("page_id") % 5, F.lit('"')
    line = (
        F.when(k == 0, F.concat(q, F.lit(" "), "url", q, F.lit(',"other, cell"')))
        .when(k == 1, F.concat(q, "url", F.lit(',x",1,2')))
        .when(k == 2, F.concat(q, "url", F.lit('""q"""')))
        .when(k == 3, F.concat("url", F.lit(",,")))
        .otherwise(F.concat(F.lit("name,"), "url"))
    )
    return A.url_list(t.pages.select(line.alias("value")), csv=True)


@query("robots_sitemaps", "SELECT page_id, url || '.xml' AS sitemap FROM pages WHERE page_id % 2 = 0")
def robots_sitemaps(t: Tables) -> DataFrame:
    text = F.concat(F.lit("User-agent: *\n"), F.when(F.col("page_id") % 2 == 0, "SiteMap:  ").otherwise("# sitemap: "), "url", F.lit(".xml\nDisallow: /"))
    return A.robots_sitemaps(t.pages.select("page_id", text.alias("txt")), "txt")


_LOADED = f"SELECT slug, rule_type, coalesce(context_window, 120) AS context_window, coalesce(severity, 'medium') AS severity, CASE WHEN rule_type = 'inventory' THEN correct_value END AS canonical_value, p.name AS product_name FROM {_RG} r LEFT JOIN {_CT} p USING (product_id) WHERE enabled = 1"
_COLS = ["slug", "rule_type", "context_window", "severity", "canonical_value", "product_name"]


@query("rules_load", _LOADED)
def rules_load(t: Tables) -> DataFrame:
    return A.load_rules(t.fx("registry"), t.fx("catalog")).select(_COLS)


@query("rules_for_product", _LOADED + " AND (r.product_id IS NULL OR r.product_id = 1)")
def rules_for_product(t: Tables) -> DataFrame:
    return A.load_rules(t.fx("registry"), t.fx("catalog"), product_id=1).select(_COLS)


@query("registry_export", f"SELECT rule_id, slug, rule_type, category, correct_value, product_id, enabled, array_to_string(CAST(coalesce(try_cast(stale_patterns AS JSON), '[]') AS VARCHAR[]), '|') AS stale, array_to_string(CAST(coalesce(try_cast(allowed_patterns AS JSON), '[]') AS VARCHAR[]), '|') AS allowed FROM {_RG}")
def registry_export(t: Tables) -> DataFrame:
    """The whole registry, rules out of use too, as JSON lines with real lists, and read back."""
    rules = A.load_rules(t.fx("registry"), t.fx("catalog"), enabled_only=False).drop("product_name", "canonical_value")
    back = _round_trip(rules, "json")
    return back.select("rule_id", "slug", "rule_type", "category", "correct_value", "product_id", "enabled", F.array_join("stale_patterns", "|").alias("stale"), F.array_join("allowed_patterns", "|").alias("allowed"))


@query("features_load", f"SELECT name, len(list_filter(string_split(aliases, ','), lambda x: x <> ''))::INT AS n FROM {_CT}")
def features_load(t: Tables) -> DataFrame:
    stored = t.fx("catalog").select("name", F.to_json(F.filter(F.split("aliases", ","), lambda x: x != "")).alias("j"))
    return stored.select("name", F.size(X.json_strings(F.col("j"))).alias("n"))


# B: extraction
_UNESC = "replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_ONE = _UNESC.format("trim(regexp_replace(regexp_extract(html, '(?is)<{0}[^>]*>(.*?)</{0}>', 1), '\\s+', ' ', 'g'))")


def _headed(t: Tables) -> DataFrame:
    """The given pages with the head elements that they lack."""
    k = F.col("page_id").cast("string")
    head = F.concat(F.lit('<head><meta name="Description" content="  About\n'), k, F.lit('  "><META property="og:x" content="no"><link rel="stylesheet" href="s"><link rel="Canonical" href="https://c/'), k, F.lit('">'))
    head = F.concat(head, F.when(F.col("page_id") % 3 == 0, '<meta name="robots" content="noindex"><meta name="robots" content="index">').otherwise(""))
    body = F.replace("html", F.lit("</article>"), F.concat(F.lit("<h2>Part <b>"), k, F.lit("</b></h2><h2> </h2><h1>More</h1></article>")))
    return t.pages.select("page_id", F.replace(body, F.lit("<head>"), head).alias("html"))


@query("page_fields", f"SELECT page_id, {_ONE.format('title')} AS title, {_ONE.format('h1')} || CASE WHEN contains(html, '</article>') THEN '|More' ELSE '' END AS h1, CASE WHEN contains(html, '</article>') THEN 'Part ' || page_id ELSE '' END AS h2, 'About ' || page_id AS meta_description, 'https://c/' || page_id AS canonical, CASE WHEN page_id % 3 = 0 THEN 'noindex' END AS meta_robots FROM pages")
def page_fields(t: Tables) -> DataFrame:
    found = B.extract(_headed(t))
    return found.select("page_id", "title", F.array_join("h1s", "|").alias("h1"), F.array_join("h2s", "|").alias("h2"), "meta_description", "canonical", "meta_robots")


@query("page_body")
def page_body(t: Tables) -> DataFrame:
    return B.extract(t.pages).select("page_id", "title", "body", "author", "canonical", "meta_robots", "meta_description")


@query("page_main_text", "SELECT doc_id AS page_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) AS body FROM documents")
def page_main_text(t: Tables) -> DataFrame:
    """Each document as the main text of a page, in one of the five places where it is looked for, between parts that are none."""
    k = F.col("doc_id") % 5
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cut = F.floor(F.char_length(text) / 2).cast("int")
    inner = F.when(k == 0, text).otherwise(F.concat(text, F.lit("<script>no()</script><nav>no</nav><svg><text>no</text></svg>")))
    junk = F.lit("<nav><ul><li>no</li></ul></nav><header>no</header><style>no</style><form><input value='no'>no</form>")
    place = (
        F.when(k == 0, F.concat(F.lit("<article>other</article><main>"), inner, F.lit("</main><main>second</main>")))
        .when(k == 1, F.concat(F.lit("<div>other</div><article>"), inner, F.lit("</article>")))
        .when(k == 2, F.concat(F.lit("<div></div><section>"), inner, F.lit("</section>")))
        .when(k == 3, F.concat(F.lit("<div><aside>no</aside><div>"), inner, F.lit("</div></div>")))
        .otherwise(F.concat(F.lit("<p>"), inner, F.lit("</p>")))
    )
    page = F.concat(F.lit("<html><head><title>t</title></head><body>"), junk, place, F.lit("<footer>no</footer><iframe>no</iframe><noscript>no</noscript></body></html>"))
    return B.extract(t.documents.select(F.col("doc_id").alias("page_id"), page.alias("html"))).select("page_id", "body")


@query("body_hash_wordcount", "SELECT doc_id, sha256(b) AS content_hash, CASE WHEN b = '' THEN 0 ELSE len(string_split(b, ' ')) END::INT AS word_count FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) AS b FROM documents)")
def body_hash_wordcount(t: Tables) -> DataFrame:
    b = X.normalize(F.col("text"))
    return t.documents.select("doc_id", F.sha2(b.cast("binary"), 256).alias("content_hash"), F.when(b == "", 0).otherwise(F.size(F.split(b, " "))).alias("word_count"))


def _faq_pages(t: Tables, kind: str) -> DataFrame:
    """Questions and answers in pages: as data with answers of every form, or as visible lists; each twice, so that repeats are met."""
    f = t.fx("faqs").withColumn("question", X.normalize(F.col("question"))).withColumn("answer", X.normalize(F.col("answer")))
    if kind == "jsonld":
        text = lambda c: F.to_json(F.struct(F.col(c).alias("x")))
        value = lambda c: F.regexp_extract(text(c), r'(?s)^\{"x":(.*)\}$', 1)
        thing = F.concat(F.lit('{"@type":"Answer","text":'), value("answer"), F.lit("}"))
        k = F.col("faq_id") % 3
        answer = F.when(k == 0, F.concat(F.lit('"acceptedAnswer":'), thing)).when(k == 1, F.concat(F.lit('"acceptedAnswer":'), value("answer"))).otherwise(F.concat(F.lit('"suggestedAnswer":['), thing, F.lit(',{"text":"second"}]')))
        name = F.concat(F.when(k == 2, '"question":').otherwise('"name":'), value("question"))
        one = F.concat(F.when(k == 1, '{"@type":["Thing","Question"],').otherwise('{"@type":"Question",'), name, F.lit(","), answer, F.lit("}"))
        rows = f.groupBy("url_id").agg(F.sort_array(F.collect_list(F.struct("faq_id", one.alias("h")))).alias("qs"))
        listed = F.array_join(F.transform("qs", lambda x: x["h"]), ",")
        html = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"hasPart":{"mainEntity":['), F.replace(listed, F.lit("</"), F.lit("<\\/")), F.lit("]}}]}</script>"))
    else:
        esc = {c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")) for c in ("question", "answer")}
        one = F.when(F.col("faq_id") % 4 == 0, F.concat(F.lit("<dl><dt>"), esc["question"], F.lit("</dt><dd>"), esc["answer"], F.lit("</dd></dl>"))).otherwise(F.concat(F.lit("<details><summary>"), esc["question"], F.lit("</summary><p>"), esc["answer"], F.lit("</p></details>")))
        rows = f.groupBy("url_id").agg(F.sort_array(F.collect_list(F.struct("faq_id", one.alias("h")))).alias("qs"))
        html = F.array_join(F.transform("qs", lambda x: x["h"]), "")
    return rows.select(F.col("url_id").alias("page_id"), F.concat(F.lit("<html><body><script type='application/ld+json'>{broken</script>"), html, html, F.lit("</body></html>")).alias("html"))


_NQ = "trim(regexp_replace({0}, '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
_FAQ = f"SELECT url_id AS page_id, arg_min(q, %s) AS question, arg_min(a, %s) AS answer FROM (SELECT url_id, faq_id, {_NQ.format('question')} AS q, {_NQ.format('answer')} AS a FROM {_F}) WHERE q <> '' AND a <> '' GROUP BY url_id, lower(q)"


def _read_faqs(t: Tables, kind: str) -> DataFrame:
    got = B.extract(_faq_pages(t, kind)).select("page_id", F.explode("faqs").alias("f")).where(F.col("f.source") == kind)
    return got.select("page_id", "f.question", "f.answer")


@query("faq_jsonld", _FAQ.replace("%s", "faq_id"))
def faq_jsonld(t: Tables) -> DataFrame:
    return _read_faqs(t, "jsonld")


# All details come before all lists.
@query("faq_visible", _FAQ.replace("%s", "(faq_id % 4 = 0, faq_id)"))
def faq_visible(t: Tables) -> DataFrame:
    return _read_faqs(t, "visible")


@query("faq_dedupe", f"SELECT url_id, min(faq_id) AS faq_id FROM {_F} WHERE question <> '' AND answer <> '' GROUP BY url_id, lower(question), source")
def faq_dedupe(t: Tables) -> DataFrame:
    f = t.fx("faqs").where("question <> '' AND answer <> ''")
    return f.groupBy("url_id", F.lower("question").alias("q"), "source").agg(F.min("faq_id").alias("faq_id")).select("url_id", "faq_id")


@query("author_extract", """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'Ada ' || page_id || '; Bob' WHEN 1 THEN 'Eve ' || page_id WHEN 2 THEN 'Max ' || page_id WHEN 3 THEN 'Jane Doe'
WHEN 4 THEN 'Lin ' || page_id WHEN 5 THEN 'Zoe' WHEN 6 THEN 'Kim' END AS author FROM pages WHERE page_id % 9 <> 8""")
def author_extract(t: Tables) -> DataFrame:
    """Authors of blog and news pages, named in every way that is read; a way whose name is no name falls through to the next."""
    n = F.col("page_id").cast("string")
    ld = lambda *x: F.concat(F.lit('<script type="application/ld+json">'), *[F.lit(y) if isinstance(y, str) else y for y in x], F.lit("</script>"))
    k = F.col("page_id") % 8
    head = (
        F.when(k == 0, F.concat(ld('{"@type":"Person","author":"Nobody"}'), ld('{"@graph":[{"@type":["X","NewsArticle"],"author":[{"name":"By Ada ', n, ', Editor"},"Bob",{"name":"ADA ', n, '"}]}]}'), F.lit('<meta name="author" content="Other">')))
        .when(k == 1, F.concat(ld('{"@type":"Report","author":{"name":" "}}'), F.lit('<meta name="author" content="Late"><meta property="article:author" content="https://x/y"><meta property="og:article:author" content="Written by: Eve '), n, F.lit(' | Staff">')))
        .when(k == 2, F.concat(F.lit('<meta property="article:author" content="/team/max"><meta name="author" content="Max '), n, F.lit(' on May 5">')))
        .otherwise("")
    )
    long = F.lit("x" * 81)
    body = (
        F.when(k == 3, F.concat(F.lit('<p class="meta-byline">'), long, F.lit("</p><span rel='author'>By Jane Doe – Editor</span><p class='author'>Second</p>")))
        .when(k == 4, F.concat(F.lit("<b itemprop='author'> posted by Lin "), n, F.lit("</b>")))
        .when(k == 5, "<p class='lead writer'>Zoe</p>")
        .when(k == 6, "<article><h1>x</h1> <p>Written by: Kim, today</p></article>")
        .otherwise("<p>By the way</p>")
    )
    html = F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), body, F.lit("</body></html>"))
    url = F.concat(F.lit("https://a.example.com/"), F.when(F.col("page_id") % 9 == 8, "about").when(F.col("page_id") % 2 == 0, "blog").otherwise("news"), F.lit("/p"), n)
    dated = t.pages.select("page_id", html.alias("html"), U.content_type(F.split(url, "/"), "blog", "news").alias("kind")).where("kind IN ('blog', 'news')")
    return B.extract(dated).select("page_id", "author")


@query("page_links", f"SELECT page_id, link FROM {_OWN} WHERE NOT regexp_matches(link, '://([^/?#]*[.])?example[.]org([:/?#]|$)')")
def page_links(t: Tables) -> DataFrame:
    return B.links(t.pages, _EXCLUDED).select("page_id", "link")


# O: sinks, each written and read again
def _round_trip(df: DataFrame, kind: str, **options) -> DataFrame:
    path = scratch(df.sparkSession, kind)
    df.write.options(**options).format(kind).save(path)
    return df.sparkSession.read.options(**options).schema(df.schema).format(kind).load(path)


_CSV = {"header": "true", "escape": '"', "nullValue": "", "emptyValue": "", "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


_COLUMNS = ["url", "locale", "content_type", "author", "product", "category", "severity", "status", "fact_rule", "evidence", "matched_value", "expected", "detection_method", "detected_at"]
_EXT = ["domain", "external_url", "finding_type", "severity", "status", "evidence", "expected", "reason", "found_at"]
_EXPORT = f"SELECT url, locale, content_type, author, product_name AS product, category, severity, status, title AS fact_rule, evidence, matched_value, expected, detection_method, detected_at FROM {_JOINED} WHERE deleted_at IS NULL"


def _filled(sql: str, columns: list[str]) -> str:
    return "SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in columns) + f" FROM ({sql})"


def _empty_for_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def _exported(t: Tables) -> DataFrame:
    """Findings that are not deleted, with the columns of every findings file."""
    return findings(t).where("deleted_at IS NULL").withColumnsRenamed({"product_name": "product", "title": "fact_rule"}).select(_COLUMNS)


@query("export_findings", _filled(_EXPORT + " AND status = 'open'", _COLUMNS))
def export_findings(t: Tables) -> DataFrame:
    """Open findings as CSV, one folder a category, empty categories having none."""
    rows = _exported(t).where("status = 'open'")
    path = scratch(t.spark, "findings_csv")
    rows.write.partitionBy("category").options(**_CSV).csv(path)
    return _empty_for_null(t.spark.read.options(**_CSV).schema(rows.schema).csv(path).select(_COLUMNS))


@query("export_findings_all", _filled(_EXPORT, _COLUMNS))
def export_findings_all(t: Tables) -> DataFrame:
    return _empty_for_null(_round_trip(_exported(t), "csv", **_CSV))


_EXTERNAL = f"SELECT domain, external_url, finding_type, severity, status, snippet AS evidence, expected, reason, created_at AS found_at FROM {_X} WHERE kind = 'factcheck' AND deleted_at IS NULL AND status = 'open'"


@query("export_external", _filled(_EXTERNAL, _EXT))
def export_external(t: Tables) -> DataFrame:
    rows = t.fx("external").where("kind = 'factcheck' AND deleted_at IS NULL AND status = 'open'").withColumnsRenamed({"snippet": "evidence", "created_at": "found_at"}).select(_EXT)
    return _empty_for_null(_round_trip(rows, "csv", **_CSV))


@query("export_by_url", f"SELECT * FROM ({ORACLES['findings_by_url']})")
def export_by_url(t: Tables) -> DataFrame:
    rows = _round_trip(findings_by_url(t), "csv", **_CSV)
    texts = [c for c in rows.columns if c not in ("issue_count", "locale", "author")]
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


_SCOPED = ["scope", *_COLUMNS]


@query("export_filtered", _filled(f"SELECT 'internal' AS scope, url, locale, content_type, author, product_name AS product, category, severity, status, title AS fact_rule, evidence, matched_value, expected, detection_method, last_checked_at AS detected_at FROM {_JOINED} WHERE status = 'open' AND deleted_at IS NULL UNION ALL SELECT 'external', external_url, NULL, NULL, NULL, NULL, finding_type, severity, status, NULL, snippet, NULL, expected, NULL, NULL FROM {_X} WHERE status = 'open' AND deleted_at IS NULL", _SCOPED))
def export_filtered(t: Tables) -> DataFrame:
    """Findings of both kinds in one file; the date column of this file is that of the last check."""
    a = findings(t).where("status = 'open' AND deleted_at IS NULL").drop("detected_at").withColumnsRenamed({"product_name": "product", "title": "fact_rule", "last_checked_at": "detected_at"})
    b = t.fx("external").where("status = 'open' AND deleted_at IS NULL").select(F.lit("external").alias("scope"), F.col("external_url").alias("url"), F.col("finding_type").alias("category"), "severity", "status", F.col("snippet").alias("evidence"), "expected")
    rows = a.select(F.lit("internal").alias("scope"), *_COLUMNS).unionByName(b, allowMissingColumns=True)
    return _empty_for_null(_round_trip(rows, "csv", **_CSV))


@query("export_claims", ORACLES["claim_inventory"])
def export_claims(t: Tables) -> DataFrame:
    return _round_trip(claim_inventory(t), "csv", **_CSV)


_JSON = "CAST(to_json(x) AS VARCHAR)"


@query("report_payload", f"""SELECT 'summary' AS section, source_id, {_JSON} AS payload FROM (SELECT source_id, {{{{'category': category, 'n': count(*), 'open': count(*) FILTER (WHERE status = 'open')}}}} AS x FROM {_I} GROUP BY source_id, category)
UNION ALL SELECT 'issues', source_id, {_JSON} FROM (SELECT source_id, {{{{'url': url, 'category': category, 'severity': severity, 'status': status, 'title': title, 'evidence': evidence}}}} AS x FROM {_JOINED} WHERE deleted_at IS NULL)
UNION ALL SELECT 'inventory', source_id, {_JSON} FROM (SELECT source_id, {{{{'kind': kind, 'value': value, 'frequency': count(*)}}}} AS x FROM ({_FOUND}) GROUP BY source_id, kind, value)
UNION ALL SELECT 'external', source_id, {_JSON} FROM (SELECT source_id, {{{{'kind': kind, 'external_url': external_url, 'domain': domain, 'snippet': snippet, 'verdict': verdict, 'reason': reason, 'expected': expected}}}} AS x FROM {_X})""".replace("{{", "{").replace("}}", "}"))
def report_payload(t: Tables) -> DataFrame:
    """What a report shows, as JSON rows of four sections for each source, written and read again."""
    i, claims = t.fx("issues"), claims_found(t).join(t.fx("claims").select("url_id", "source_id"), "url_id")
    parts = {
        "summary": i.groupBy("source_id", "category").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("open")),
        "issues": findings(t).where("deleted_at IS NULL").select("source_id", "url", "category", "severity", "status", "title", "evidence"),
        "inventory": claims.groupBy("source_id", "kind", "value").agg(F.count("*").alias("frequency")),
        "external": t.fx("external").select("source_id", "kind", "external_url", "domain", "snippet", "verdict", "reason", "expected"),
    }
    out = None
    for name, rows in parts.items():
        payload = F.to_json(F.struct(*[c for c in rows.columns if c != "source_id"]), {"ignoreNullFields": "false"})
        one = rows.select(F.lit(name).alias("section"), "source_id", payload.alias("payload"))
        out = one if out is None else out.unionByName(one)
    return _round_trip(out, "json")


# P: the stream
ROWS_A_FILE = 10_000


def landing_files(rows: int) -> int:
    """How many files a landing of that many rows has, an even number; half of them are a batch."""
    return max(4, 2 * math.ceil(rows / (2 * ROWS_A_FILE)))


def _files(t: Tables) -> int:
    return landing_files(2 * t.documents.count())


def _landed(t: Tables) -> str:
    path = scratch(t.spark, "landing")
    pages = t.fx("claims").select("url_id", "locale", "body_text", F.lit(1).cast("long").alias("version"))
    old = pages.withColumn("body_text", F.when(F.col("url_id") % 6 != 0, "old text of the page")).withColumn("version", F.lit(0).cast("long"))
    old.unionByName(pages).repartition(_files(t)).write.parquet(path)
    return path


@query("sync_stream", f"SELECT rule_id, slug, url_id, verdict FROM ({_SCAN})")
def sync_stream(t: Tables) -> DataFrame:
    return P.sync(t.spark, _landed(t), scratch(t.spark, "sync"), stale_rules(t), _files(t) // 2).select("rule_id", "slug", "url_id", "verdict")


@query("sync_findings", f"SELECT url_id, slug || ':stale' AS title, category, severity, lower(matched) AS matched_value, 'open' AS status FROM ({_SCAN}) h WHERE verdict = 'issue'")
def sync_findings(t: Tables) -> DataFrame:
    """The findings table after a sync into an empty one: those of the newest version of each page."""
    state = scratch(t.spark, "sync")
    P.sync(t.spark, _landed(t), state, stale_rules(t), _files(t) // 2)
    return P.findings(t.spark, state).select("url_id", "title", "category", "severity", F.lower("matched_value").alias("matched_value"), "status")


@query("sync_metrics", f"SELECT (SELECT CAST(2 * count(*) AS BIGINT) FROM documents) AS pages, (SELECT count(*) FROM documents WHERE doc_id % 6 = 0) AS errors, count(*) FILTER (WHERE verdict = 'issue') AS issue, count(*) FILTER (WHERE verdict = 'positive') AS positive FROM ({_SCAN})")
def sync_metrics(t: Tables) -> DataFrame:
    """Pages and errors of all batches, and the verdicts that stand after the last."""
    state = scratch(t.spark, "sync")
    P.sync(t.spark, _landed(t), state, stale_rules(t), _files(t) // 2)
    return P.metrics(t.spark, state)


# The whole sync: raw pages in two versions, all detectors, findings of an earlier run.
def _raw(t: Tables) -> str:
    path = scratch(t.spark, "landing")
    shown = F.replace(F.replace("body_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    own = t.fx("claims").select("url_id", "locale", F.concat(F.lit("<title>t</title><nav>of the license</nav><main><p>"), shown, F.lit("<script>of the</script></main>")).alias("html"), F.lit(1).cast("long").alias("version"))
    old = own.withColumn("html", F.when(F.col("url_id") % 6 != 0, "<p>a list of the 30 languages and of the 95 regulations")).withColumn("version", F.lit(0).cast("long"))
    old.unionByName(own).repartition(_files(t)).write.parquet(path)
    return path


def _detectors(t: Tables) -> Y.Detectors:
    rules = A.load_rules(t.fx("rules"), t.fx("products")).where("canonical_value IS NOT NULL")
    canonical = rules.select(F.col("slug").alias("kind"), "rule_id", F.col("canonical_value").alias("canonical"), "category")
    counts = (Y.Counts(4, "lang", "language_count", T._LANG, 1, T.LANGUAGE_CONTEXTS), Y.Counts(102, "reg", "regulation_count", T._REG, 1, T.REGULATION_CONTEXTS))
    return Y.Detectors(stale_rules(t), T.CLAIMED, canonical, counts, [("closed:regulations", "feature_claim", "(?i)atlas")])


def _earlier(t: Tables) -> DataFrame:
    """Findings of an earlier run, some of which a person ignored."""
    k = F.col("doc_id")
    null = lambda kind="string": F.lit(None).cast(kind)
    return t.documents.where("doc_id % 10 IN (3, 4)").select(k.alias("url_id"), F.lit("other_mismatch").alias("category"), F.lit("of_the:stale").alias("title"), F.lit(0).cast("long").alias("related_url_id"), F.lit("low").alias("severity"), null().alias("detail"), F.lit("old").alias("evidence"), null().alias("expected"), F.lit("old").alias("matched_value"), F.lit("regex").alias("detection_method"), F.lit("2024-01-01").alias("detected_at"), F.when(k % 4 == 0, "ignored").otherwise("open").alias("status"), null().alias("last_checked_at"), null().alias("deleted_at"))


def _synced(t: Tables) -> tuple[DataFrame, DataFrame]:
    state, detectors = scratch(t.spark, "site"), _detectors(t)
    Y.ingest(t.spark, _raw(t), state, detectors, files=_files(t) // 2)
    return Y.finish(t.spark, state, detectors, "2024-06-01", _earlier(t))


_KIND_RULES = "(VALUES ('languages', 4, 'language_count'), ('countries', 5, 'other_mismatch')) kr(kind, rule_id, category)"


@query("site_verdicts", f"""SELECT rule_id, url_id, verdict, matched_value FROM (
SELECT rule_id, url_id, verdict, lower(matched) AS matched_value, 0 AS rank, 0 AS seq FROM ({_SCAN}) UNION ALL SELECT rule_id, url_id, verdict, value, 1, 0 FROM ({T._CONSISTENT}) JOIN {_KIND_RULES} USING (kind)
UNION ALL SELECT 4, url_id, verdict, number, 2, start FROM ({T._LSQL}) UNION ALL SELECT 102, url_id, verdict, number, 2, start FROM ({T._RSQL})) QUALIFY row_number() OVER (PARTITION BY rule_id, url_id ORDER BY rank DESC, seq DESC) = 1""")
def site_verdicts(t: Tables) -> DataFrame:
    """Verdicts of all detectors after a sync of raw pages, the last write of each rule and page."""
    return _synced(t)[0].select("rule_id", "url_id", "verdict", F.lower("matched_value").alias("matched_value"))


_WRITTEN = f"""(SELECT url_id, slug || ':stale' AS title, category, severity, 'open' AS status, lower(matched) AS matched_value FROM ({_SCAN}) WHERE verdict = 'issue'
UNION ALL SELECT url_id, kind || ':inconsistent', category, 'high', 'open', value FROM ({T._CONSISTENT}) JOIN {_KIND_RULES} USING (kind) WHERE verdict = 'issue'
UNION ALL SELECT url_id, title, 'language_count', severity, status, matched_value FROM ({T._count_findings(T._LSQL, 'lang')}) UNION ALL SELECT url_id, title, 'regulation_count', severity, status, matched_value FROM ({T._count_findings(T._RSQL, 'reg')})
UNION ALL SELECT url_id, 'closed:regulations', 'feature_claim', 'high', 'open', lower(arg_max(matched_value, start)) FROM ({ORACLES['forbidden_claims']}) GROUP BY url_id)"""


@query("site_findings", f"""SELECT url_id, title, category, coalesce(n.severity, o.severity) AS severity, CASE WHEN o.status = 'ignored' THEN 'ignored' WHEN n.url_id IS NULL THEN 'fixed' ELSE n.status END AS status, coalesce(n.matched_value, o.matched_value) AS matched_value
FROM {_WRITTEN} n FULL JOIN (SELECT doc_id AS url_id, 'other_mismatch' AS category, 'of_the:stale' AS title, 'low' AS severity, CASE WHEN doc_id % 4 = 0 THEN 'ignored' ELSE 'open' END AS status, 'old' AS matched_value FROM documents WHERE doc_id % 10 IN (3, 4)) o USING (url_id, title, category)""")
def site_findings(t: Tables) -> DataFrame:
    """The findings table after the sync: written again, new, fixed, or left as a person decided."""
    return _synced(t)[1].select("url_id", "title", "category", "severity", "status", F.lower("matched_value").alias("matched_value"))
