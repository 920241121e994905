"""Filters, joins, aggregates, order and set operations over findings, pages and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.functions.categories import INTERNAL, severity_rank
from factflow.operators import cascade as D
from factflow.operators import detect as K
from factflow.operators import filters as E
from factflow.operators import snapshots as S
from factflow.operators.detect import first_of
from factflow.plans.registry import Tables, o, query
from factflow.sources import landed as A

_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
_IN = ", ".join(f"'{c}'" for c in INTERNAL)
_CT = o("catalog")
_I, _U, _P, _C, _M, _R, _X, _J = (o(n) for n in ("issues", "urls", "products", "crawls", "matches", "rules", "external", "jobs"))
_JOINED = f"(SELECT i.*, u.url, u.locale, u.section, u.content_type, u.author, r.url AS related_url, p.name AS product_name FROM {_I} i JOIN {_U} u USING (url_id) LEFT JOIN {_U} r ON r.url_id = i.related_url_id AND i.related_url_id <> 0 LEFT JOIN {_P} p ON p.product_id = i.product_id)"
_LATEST = f"(SELECT * FROM {_C} QUALIFY row_number() OVER (PARTITION BY url_id ORDER BY crawl_id DESC) = 1)"


def findings(t: Tables) -> DataFrame:
    """Findings with their page, the related page and the product; the product dimension is small and checked by size."""
    u = t.fx("urls")
    related = u.select(F.col("url_id").alias("related_url_id"), F.col("url").alias("related_url"))
    own = t.fx("issues").join(u.select("url_id", "url", "locale", "section", "content_type", "author"), "url_id").join(related, "related_url_id", "left")
    return own.join(t.fx("products").select("product_id", F.col("name").alias("product_name")), "product_id", "left").withColumn("related_url", F.when(F.col("related_url_id") != 0, F.col("related_url")))


# E: filters
def _model(name: str, groups: list[dict], sql: str) -> None:
    @query(name, f"SELECT issue_id FROM {_JOINED} WHERE {sql}")
    def run(t: Tables) -> DataFrame:
        return findings(t).where(E.compile_model({"groups": groups}, E.FINDINGS)).select("issue_id")


_model("filter_model_fold", [{"mode": "all", "field": "url", "values": ["site1", "blog"]}, {"mode": "any", "field": "severity", "values": ["critical", "low"]}, {"mode": "none", "field": "status", "values": ["open"]}, {"field": "nope", "values": ["x"]}, {"field": "url", "values": []}], "((url ILIKE '%site1%' AND url ILIKE '%blog%') OR (severity = 'critical' OR severity = 'low')) AND NOT (status = 'open')")
_model("filter_enum_none", [{"mode": "none", "field": "locale", "values": ["en", "fr"]}], "NOT (locale = 'en' OR locale = 'fr')")
_model("filter_product", [{"mode": "any", "field": "product", "values": ["Atlas", "Echo"]}], "product_id IN (SELECT product_id FROM " + _P + " WHERE name IN ('Atlas', 'Echo'))")
_model("filter_contains", [{"mode": "any", "field": "evidence", "values": ["THE_", "license"]}], "evidence ILIKE '%THE_%' OR evidence ILIKE '%license%'")
_model("filter_not_contains", [{"mode": "any", "field": "not_url", "values": ["SITE2"]}], "url NOT ILIKE '%SITE2%'")
_model("filter_date_range", [{"mode": "any", "field": "detected_at", "values": ["2024-03-01|2024-05-12", "|"]}, {"mode": "all", "field": "last_checked", "values": ["2024-02-01|"]}], "detected_at >= '2024-03-01' AND detected_at <= '2024-05-12T23:59:59' AND last_checked_at >= '2024-02-01'")


@query("filter_changed", f"SELECT url_id FROM {_U} WHERE last_crawled IS NULL OR (lastmod IS NOT NULL AND lastmod > last_crawled)")
def filter_changed(t: Tables) -> DataFrame:
    return t.fx("urls").where(E.compile_model({"groups": [{"field": "changed", "values": ["yes"]}]}, E.CRAWL)).select("url_id")


@query("crawl_scope", f"SELECT url_id FROM {_U} WHERE in_source = 1 AND content_type = 'blog' AND (locale IN ('en', 'de') OR locale IS NULL) AND NOT url LIKE '%site3%' AND NOT (lastmod IS NOT NULL AND last_crawled IS NOT NULL AND lastmod <= last_crawled) ORDER BY url_id LIMIT 40")
def crawl_scope(t: Tables) -> DataFrame:
    model = {"groups": [{"mode": "any", "field": "content_type", "values": ["blog"]}, {"mode": "all", "field": "not_url", "values": ["site3"]}]}
    fresh = F.col("lastmod").isNotNull() & F.col("last_crawled").isNotNull() & (F.col("lastmod") <= F.col("last_crawled"))
    return t.fx("urls").where((F.col("in_source") == 1) & E.compile_model(model, E.CRAWL) & E.in_locales(["en", "de", "(root)"])).where(~fresh).select("url_id").orderBy("url_id").limit(40)


@query("only_changed", f"SELECT url_id FROM {_U} WHERE lastmod IS NULL OR last_crawled IS NULL OR lastmod > last_crawled")
def only_changed(t: Tables) -> DataFrame:
    return t.fx("urls").where("lastmod IS NULL OR last_crawled IS NULL OR lastmod > last_crawled").select("url_id")


@query("locale_scope", f"SELECT url_id, locale FROM {_U} WHERE locale = 'en' OR locale IS NULL")
def locale_scope(t: Tables) -> DataFrame:
    return t.fx("urls").where(E.in_locales(E.preset_locales("english", ["en", "gb", "us"]))).select("url_id", "locale")


@query("english_pages", f"SELECT url_id FROM {o('claims')} WHERE locale IS NULL OR locale IN ('en')")
def english_pages(t: Tables) -> DataFrame:
    return t.fx("claims").where(F.col("locale").isNull() | F.col("locale").isin("en")).select("url_id")


@query("findings_flat", f"SELECT issue_id FROM {_JOINED} WHERE status = 'open' AND deleted_at IS NULL AND category IN ({_IN}) AND severity = 'high' AND locale = 'en'")
def findings_flat(t: Tables) -> DataFrame:
    return findings(t).where((F.col("status") == "open") & F.col("deleted_at").isNull() & F.col("category").isin(*INTERNAL) & (F.col("severity") == "high") & (F.col("locale") == "en")).select("issue_id")


def ranked(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(severity_rank(F.col("severity")), "url", "issue_id").limit(n)


@query("findings_model", f"SELECT issue_id, url, severity FROM {_JOINED} WHERE deleted_at IS NULL AND status = 'open' AND (category = 'free_claim' OR category = 'database_size') ORDER BY {_RANK}, url, issue_id LIMIT 50")
def findings_model(t: Tables) -> DataFrame:
    model = {"groups": [{"mode": "any", "field": "category", "values": ["free_claim", "database_size"]}]}
    return ranked(findings(t).where(F.col("deleted_at").isNull() & (F.col("status") == "open") & E.compile_model(model, E.FINDINGS)), 50).select("issue_id", "url", "severity")


_SF = o("saved_filters")


@query("saved_filter_counts", f"SELECT filter_id, count(i.issue_id) AS n FROM {_SF} f LEFT JOIN {_JOINED} i ON (((i.category = f.cat OR i.category = 'free_claim') AND NOT (i.severity = f.sev)) OR i.url ILIKE '%p' || f.frag || '%') AND i.detected_at >= '2024-02' AND i.detected_at <= '2024-08T23:59:59' GROUP BY filter_id")
def saved_filter_counts(t: Tables) -> DataFrame:
    """How many findings each saved filter selects, all of them in one scan."""
    return E.saved_filter_counts(findings(t), t.fx("saved_filters"), E.FINDINGS)


@query("findings_external", f"SELECT finding_id, domain FROM {_X} WHERE kind = 'factcheck' AND status = 'open' AND deleted_at IS NULL AND snippet ILIKE '%snippet%'")
def findings_external(t: Tables) -> DataFrame:
    model = {"groups": [{"mode": "any", "field": "snippet", "values": ["snippet"]}]}
    return t.fx("external").where((F.col("kind") == "factcheck") & (F.col("status") == "open") & F.col("deleted_at").isNull() & E.compile_model(model, E.EXTERNAL)).orderBy("domain", "finding_id").select("finding_id", "domain")


@query("filter_counts", f"SELECT a AS internal, b AS external, a + b AS total FROM (SELECT (SELECT count(*) FROM {_I} WHERE deleted_at IS NULL AND status = 'open' AND severity = 'high') AS a, (SELECT count(*) FROM {_X} WHERE kind = 'factcheck' AND deleted_at IS NULL AND status = 'open' AND severity = 'high') AS b)")
def filter_counts(t: Tables) -> DataFrame:
    ok = F.col("deleted_at").isNull() & (F.col("status") == "open") & (F.col("severity") == "high")
    both = t.fx("issues").where(ok).select(F.lit(1).alias("i"), F.lit(0).alias("x")).unionByName(t.fx("external").where(ok & (F.col("kind") == "factcheck")).select(F.lit(0).alias("i"), F.lit(1).alias("x")))
    return both.agg(F.coalesce(F.sum("i"), F.lit(0)).alias("internal"), F.coalesce(F.sum("x"), F.lit(0)).alias("external"), F.count("*").alias("total"))


@query("scope_counts", f"SELECT source_id, count(*) FILTER (WHERE in_source = 1 AND locale = 'en') AS selected, count(*) AS total FROM {_U} GROUP BY source_id")
def scope_counts(t: Tables) -> DataFrame:
    return t.fx("urls").groupBy("source_id").agg(F.count_if((F.col("in_source") == 1) & (F.col("locale") == "en")).alias("selected"), F.count("*").alias("total"))


@query("report_text_filter", f"SELECT issue_id FROM {_JOINED} WHERE contains(lower(concat_ws(' ', url, title, evidence, detail)), 'fact:3') AND status <> 'fixed'")
def report_text_filter(t: Tables) -> DataFrame:
    return findings(t).where(F.lower(F.concat_ws(" ", "url", "title", "evidence", "detail")).contains("fact:3") & (F.col("status") != "fixed")).select("issue_id")


@query("findings_list", f"SELECT issue_id, severity, url FROM {_JOINED} WHERE category = 'free_claim' AND status = 'open' ORDER BY {_RANK}, url, issue_id LIMIT 20")
def findings_list(t: Tables) -> DataFrame:
    return ranked(findings(t).where("category = 'free_claim' AND status = 'open'"), 20).select("issue_id", "severity", "url")


# F: joins
@query("latest_crawl", f"SELECT url_id, crawl_id, status_code, content_hash FROM {_LATEST}")
def latest_crawl(t: Tables) -> DataFrame:
    return S.latest(t.fx("crawls"), ["url_id"], ["crawl_id"]).select("url_id", "crawl_id", "status_code", "content_hash")


@query("latest_bodies", f"SELECT url_id, crawl_id, md5(body_text) AS h FROM {_LATEST} WHERE coalesce(body_text, '') <> ''")
def latest_bodies(t: Tables) -> DataFrame:
    return S.readable(t.fx("crawls")).select("url_id", "crawl_id", F.md5("body_text").alias("h"))


@query("findings_join", f"SELECT issue_id, url, related_url, product_name FROM {_JOINED}")
def findings_join(t: Tables) -> DataFrame:
    return findings(t).select("issue_id", "url", "related_url", "product_name")


@query("matches_in_source", f"SELECT rule_id, url_id, verdict FROM {_M} WHERE url_id IN (SELECT url_id FROM {_U} WHERE source_id = 2)")
def matches_in_source(t: Tables) -> DataFrame:
    return t.fx("matches").join(t.fx("urls").where("source_id = 2").select("url_id"), "url_id", "left_semi").select("rule_id", "url_id", "verdict")


_CACHE = f"(SELECT DISTINCT content_hash, 'screen' AS task, 'm1' AS model FROM {_C} WHERE content_hash IS NOT NULL AND url_id % 2 = 0)"


def _cached(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.fx("crawls").where("content_hash IS NOT NULL")
    done = c.where("url_id % 2 = 0").select("content_hash", F.lit("screen").alias("task"), F.lit("m1").alias("model")).distinct()
    asked = S.latest(c, ["url_id"], ["crawl_id"]).select("url_id", "content_hash", F.lit("screen").alias("task"), F.lit("m1").alias("model"))
    return asked, done


_ASKED = f"(SELECT url_id, content_hash FROM {_C} WHERE content_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url_id ORDER BY crawl_id DESC) = 1)"


@query("cache_hits", f"SELECT url_id, content_hash FROM {_ASKED} WHERE content_hash IN (SELECT content_hash FROM {_CACHE})")
def cache_hits(t: Tables) -> DataFrame:
    asked, done = _cached(t)
    return asked.join(done, ["content_hash", "task", "model"], "left_semi").select("url_id", "content_hash")


@query("cache_misses", f"SELECT url_id, content_hash FROM {_ASKED} WHERE content_hash NOT IN (SELECT content_hash FROM {_CACHE})")
def cache_misses(t: Tables) -> DataFrame:
    asked, done = _cached(t)
    return asked.join(done, ["content_hash", "task", "model"], "left_anti").select("url_id", "content_hash")


@query("match_matrix", f"""SELECT slug, count(*) FILTER (WHERE verdict = 'positive') AS positive, count(*) FILTER (WHERE verdict = 'issue') AS issue, count(*) FILTER (WHERE verdict = 'unclear') AS unclear, count(url_id) AS total
FROM {_R} r LEFT JOIN (SELECT m.* FROM {_M} m JOIN {_U} u USING (url_id) WHERE u.source_id IN (1, 2)) x USING (rule_id) WHERE enabled = 1 GROUP BY slug""")
def match_matrix(t: Tables) -> DataFrame:
    own = t.fx("matches").join(t.fx("urls").where("source_id IN (1, 2)").select("url_id"), "url_id", "left_semi")
    counts = own.groupBy("rule_id").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("positive", "issue", "unclear")], F.count("*").alias("total"))
    cols = [F.coalesce(c, F.lit(0)).alias(c) for c in ("positive", "issue", "unclear", "total")]
    return t.fx("rules").where("enabled = 1").join(counts, "rule_id", "left").select("slug", *cols).orderBy(F.desc("total"), "slug")


@query("match_drilldown", f"SELECT url, matched_value, evidence FROM {_M} m JOIN {_U} u USING (url_id) WHERE rule_id = 3 AND verdict = 'positive' ORDER BY url LIMIT 300")
def match_drilldown(t: Tables) -> DataFrame:
    return t.fx("matches").where("rule_id = 3 AND verdict = 'positive'").join(t.fx("urls"), "url_id").orderBy("url").limit(300).select("url", "matched_value", "evidence")


@query("match_stats", f"SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'positive') AS positive, count(*) FILTER (WHERE verdict = 'issue') AS issue, count(*) FILTER (WHERE verdict = 'unclear') AS unclear, count(DISTINCT rule_id) AS rules, (SELECT count(*) FROM {_R} WHERE enabled = 1) AS enabled_rules FROM {_M} JOIN {_U} u USING (url_id) WHERE u.source_id = 1")
def match_stats(t: Tables) -> DataFrame:
    own = t.fx("matches").join(t.fx("urls").where("source_id = 1").select("url_id"), "url_id", "left_semi")
    n = own.agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("positive", "issue", "unclear")], F.count_distinct("rule_id").alias("rules"))
    return n.join(t.fx("rules").where("enabled = 1").agg(F.count("*").alias("enabled_rules")))


@query("read_stats", f"""SELECT source_id, count(*) FILTER (WHERE NOT bad) AS readable, count(*) FILTER (WHERE bad) AS unreadable, coalesce(any_value(q.faqs), 0) AS faqs
FROM (SELECT u.source_id, coalesce(body_text, '') = '' OR error IS NOT NULL OR status_code >= 400 AS bad FROM {_LATEST} l JOIN {_U} u USING (url_id)) LEFT JOIN (SELECT source_id, count(*) AS faqs FROM {o('faqs')} f JOIN {_U} v USING (url_id) GROUP BY 1) q USING (source_id) GROUP BY source_id""")
def read_stats(t: Tables) -> DataFrame:
    bad = (F.coalesce("body_text", F.lit("")) == "") | F.col("error").isNotNull() | (F.col("status_code") >= 400)
    pages = t.fx("urls").select("url_id", "source_id")
    faqs = t.fx("faqs").select("url_id").join(pages, "url_id").groupBy("source_id").agg(F.count("*").alias("faqs"))
    own = S.latest(t.fx("crawls"), ["url_id"], ["crawl_id"]).join(pages, "url_id").groupBy("source_id").agg(F.count_if(~bad).alias("readable"), F.count_if(bad).alias("unreadable"))
    return own.join(faqs, "source_id", "left").select("source_id", "readable", "unreadable", F.coalesce("faqs", F.lit(0)).alias("faqs"))


@query("faq_groups", f"SELECT url_id, count(*) AS n, md5(string_agg(question || '=' || answer, '|' ORDER BY faq_id)) AS h FROM {o('faqs')} f JOIN {_U} u USING (url_id) WHERE u.locale IS NULL OR u.locale = 'en' GROUP BY url_id")
def faq_groups(t: Tables) -> DataFrame:
    own = t.fx("faqs").join(t.fx("urls").where("locale IS NULL OR locale = 'en'").select("url_id"), "url_id")
    g = own.groupBy("url_id").agg(F.sort_array(F.collect_list(F.struct("faq_id", "question", "answer"))).alias("q"))
    return g.select("url_id", F.size("q").cast("long").alias("n"), F.md5(F.array_join(F.transform("q", lambda x: F.concat(x["question"], F.lit("="), x["answer"])), "|").cast("binary")).alias("h"))


# The text around a finding: its value, or how its evidence begins, on the page's newest text.
_FOUND_AT = f"""(SELECT *, CASE WHEN m > 0 THEN m - 1 ELSE e - 1 END AS at_, CASE WHEN m > 0 THEN length(needle) ELSE length(probe) END AS w, length(b) AS n FROM (
SELECT *, CASE WHEN needle = '' THEN 0 ELSE instr(b, needle) END AS m, CASE WHEN probe = '' THEN 0 ELSE instr(b, probe) END AS e FROM (
SELECT issue_id, evidence, b, coalesce(trim(matched_value), '') AS needle, left(trim(trim(coalesce(evidence, ''), '…')), 60) AS probe FROM {_I} i LEFT JOIN (SELECT url_id, body_text AS b FROM {_LATEST} WHERE coalesce(body_text, '') <> '') l USING (url_id) WHERE deleted_at IS NULL) f0) f1)"""
_AROUND_400 = f"(SELECT *, substr(b, lo + 1, hi - lo) AS s FROM (SELECT *, greatest(at_ - 400, 0) AS lo, least(at_ + w + 400, n) AS hi FROM {_FOUND_AT}) f2)"


@query("finding_context", f"""SELECT issue_id, CASE WHEN b IS NULL THEN NULL WHEN m = 0 AND e = 0 THEN evidence ELSE trim((CASE WHEN lo > 0 THEN '…' ELSE '' END)
|| regexp_replace(CASE WHEN lo > 0 THEN regexp_replace(s, '^[^ ]* ', '') ELSE s END, CASE WHEN hi < n THEN ' [^ ]*$' ELSE '$' END, '') || (CASE WHEN hi < n THEN '…' ELSE '' END)) END AS context,
CASE WHEN m > 0 THEN needle WHEN e > 0 THEN probe END AS matched FROM {_AROUND_400}""")
def finding_context(t: Tables) -> DataFrame:
    own = t.fx("issues").where("deleted_at IS NULL").select("issue_id", "url_id", "matched_value", "evidence")
    return K.finding_context(own, S.readable(t.fx("crawls")).select("url_id", "body_text")).select("issue_id", "context", "matched")


_VALUES = f"(SELECT url_id, coalesce(evidence, '') AS e, min(matched_value) AS v FROM {_M} WHERE matched_value <> '' GROUP BY 1, 2)"


def recovered(t: Tables) -> DataFrame:
    """Findings whose missing matched value is taken from the verdict with the same page and evidence, the smallest of several."""
    m = t.fx("matches").where("matched_value <> ''").groupBy("url_id", F.coalesce("evidence", F.lit("")).alias("e")).agg(F.min("matched_value").alias("v"))
    return t.fx("issues").withColumn("e", F.coalesce("evidence", F.lit(""))).join(m, ["url_id", "e"], "left").withColumn("matched_value", F.coalesce("matched_value", "v"))


@query("matched_value_recover", f"SELECT i.issue_id, coalesce(i.matched_value, m.v) AS matched_value FROM {_I} i LEFT JOIN {_VALUES} m ON m.url_id = i.url_id AND m.e = coalesce(i.evidence, '')")
def matched_value_recover(t: Tables) -> DataFrame:
    return recovered(t).select("issue_id", "matched_value")


@query("hits_with_group", f"SELECT m.url_id, u.group_id FROM {_M} m LEFT JOIN {_U} u USING (url_id) WHERE m.verdict = 'issue'")
def hits_with_group(t: Tables) -> DataFrame:
    return t.fx("matches").where("verdict = 'issue'").join(t.fx("urls").select("url_id", "group_id"), "url_id", "left").select("url_id", "group_id")


_SRC = "(VALUES (1, 'https://one.example.com/sitemap.xml', 'One', NULL), (2, 'https://two.example.com', NULL, 'two.org'), (3, 'upload.csv', 'Three', NULL)) s(source_id, location, brand, domain)"


def sources(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, "https://one.example.com/sitemap.xml", "One", None), (2, "https://two.example.com", None, "two.org"), (3, "upload.csv", "Three", None)], "source_id int, location string, brand string, domain string")


@query("job_history", f"SELECT job_id, location, status FROM {_J} j LEFT JOIN {_SRC} USING (source_id) ORDER BY started_at DESC, job_id DESC LIMIT 20")
def job_history(t: Tables) -> DataFrame:
    return t.fx("jobs").join(sources(t), "source_id", "left").orderBy(F.desc("started_at"), F.desc("job_id")).limit(20).select("job_id", "location", "status")


@query("latest_job", f"SELECT source_id, job_type, job_id FROM {_J} QUALIFY row_number() OVER (PARTITION BY source_id, job_type ORDER BY started_at DESC, job_id DESC) = 1")
def latest_job(t: Tables) -> DataFrame:
    return S.latest(t.fx("jobs"), ["source_id", "job_type"], ["started_at", "job_id"]).select("source_id", "job_type", "job_id")


@query("source_defaults", f"SELECT u.source_id, coalesce(brand, 'the brand') AS brand, coalesce(domain, nullif(regexp_extract(location, '://([^/]+)', 1), '')) AS domain, count(*) AS urls FROM {_U} u LEFT JOIN {_SRC} USING (source_id) GROUP BY ALL")
def source_defaults(t: Tables) -> DataFrame:
    own = t.fx("urls").groupBy("source_id").agg(F.count("*").alias("urls")).join(sources(t), "source_id", "left")
    return own.select("source_id", F.coalesce("brand", F.lit("the brand")).alias("brand"), F.coalesce("domain", F.nullif(F.regexp_extract("location", "://([^/]+)", 1), F.lit(""))).alias("domain"), "urls")


@query("match_product", f"""SELECT doc_id, product_id FROM (SELECT doc_id, p.product_id, row_number() OVER (PARTITION BY doc_id ORDER BY is_default, name) AS k FROM (SELECT doc_id, CAST(doc_id % 3 + 1 AS INT) AS source_id, lower(text) AS b FROM documents) d
JOIN (SELECT *, list_filter(string_split(lower(name || ',' || aliases), ','), lambda x: x <> '') AS al FROM {_P}) p ON p.source_id = d.source_id AND (is_default = 1 OR list_sum(list_transform(al, lambda x: CAST(contains(b, x) AS INT))) > 0)) WHERE k = 1""")
def match_product(t: Tables) -> DataFrame:
    p = t.fx("products").withColumn("al", F.filter(F.split(F.lower(F.concat_ws(",", "name", "aliases")), ","), lambda x: x != ""))
    per = p.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("is_default", "name", "product_id", "al"))).alias("ps"))
    d = t.documents.select("doc_id", (F.col("doc_id") % 3 + 1).cast("int").alias("source_id"), F.lower("text").alias("b")).join(per, "source_id")
    hit = F.filter("ps", lambda x: (x["is_default"] == 1) | F.exists(x["al"], lambda a: F.contains(F.col("b"), a)))
    return d.select("doc_id", F.try_element_at(hit, F.lit(1))["product_id"].alias("product_id")).where("product_id IS NOT NULL")


# G: aggregates
@query("pipeline_state", f"""SELECT u.source_id, count(DISTINCT u.url_id) AS total, count(DISTINCT CASE WHEN l.body_text IS NOT NULL THEN u.url_id END) AS read, count(DISTINCT CASE WHEN l.error IS NOT NULL THEN u.url_id END) AS errors,
any_value(j.stage) AS stage FROM {_U} u LEFT JOIN {_LATEST} l USING (url_id) LEFT JOIN (SELECT source_id, CASE status WHEN 'running' THEN 'active' WHEN 'done' THEN 'done' ELSE 'failed' END AS stage FROM {_J} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, job_id DESC) = 1) j ON j.source_id = u.source_id GROUP BY u.source_id""")
def pipeline_state(t: Tables) -> DataFrame:
    own = t.fx("urls").join(S.latest(t.fx("crawls"), ["url_id"], ["crawl_id"]).select("url_id", "body_text", "error"), "url_id", "left")
    n = own.groupBy("source_id").agg(F.count("*").alias("total"), F.count("body_text").alias("read"), F.count("error").alias("errors"))
    stage = F.when(F.col("status") == "running", "active").when(F.col("status") == "done", "done").otherwise("failed")
    return n.join(S.latest(t.fx("jobs"), ["source_id"], ["started_at", "job_id"]).select("source_id", stage.alias("stage")), "source_id", "left")


@query("site_cards", f"SELECT u.source_id, count(*) AS urls, count(u.last_crawled) AS crawled, count(l.error) AS errors, any_value(x.n) AS external FROM {_U} u LEFT JOIN {_LATEST} l USING (url_id) LEFT JOIN (SELECT source_id, count(*) AS n FROM {_X} GROUP BY 1) x ON x.source_id = u.source_id GROUP BY u.source_id")
def site_cards(t: Tables) -> DataFrame:
    own = t.fx("urls").join(S.latest(t.fx("crawls"), ["url_id"], ["crawl_id"]).select("url_id", "error"), "url_id", "left")
    n = own.groupBy("source_id").agg(F.count("*").alias("urls"), F.count("last_crawled").alias("crawled"), F.count("error").alias("errors"))
    return n.join(t.fx("external").groupBy("source_id").agg(F.count("*").alias("external")), "source_id", "left")


@query("new_findings_by_category", f"SELECT category, count(*) AS n FROM {_I} WHERE status = 'open' AND detected_at >= '2024-05-01' GROUP BY category")
def new_findings_by_category(t: Tables) -> DataFrame:
    return t.fx("issues").where("status = 'open' AND detected_at >= '2024-05-01'").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


@query("rules_with_counts", f"SELECT slug, (SELECT count(*) FROM {_M} m WHERE m.rule_id = r.rule_id AND verdict = 'positive') AS positive, (SELECT count(*) FROM {_M} m WHERE m.rule_id = r.rule_id AND verdict = 'issue') AS issue, (SELECT count(*) FROM {_M} m WHERE m.rule_id = r.rule_id AND verdict = 'unclear') AS unclear FROM {_R} r")
def rules_with_counts(t: Tables) -> DataFrame:
    n = t.fx("matches").groupBy("rule_id").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("positive", "issue", "unclear")])
    return t.fx("rules").join(n, "rule_id", "left").select("slug", *[F.coalesce(v, F.lit(0)).alias(v) for v in ("positive", "issue", "unclear")])


@query("category_counts", f"SELECT category, count(*) FILTER (WHERE status = 'open') AS open, count(*) AS total FROM {_I} WHERE deleted_at IS NULL GROUP BY category")
def category_counts(t: Tables) -> DataFrame:
    return t.fx("issues").where("deleted_at IS NULL").groupBy("category").agg(F.count_if(F.col("status") == "open").alias("open"), F.count("*").alias("total"))


@query("severity_counts", f"SELECT s AS severity, count(issue_id) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) v(s) LEFT JOIN (SELECT * FROM {_I} WHERE status = 'open' AND deleted_at IS NULL) i ON i.severity = s GROUP BY s")
def severity_counts(t: Tables) -> DataFrame:
    levels = t.spark.createDataFrame([(s,) for s in ("critical", "high", "medium", "low")], "severity string")
    n = t.fx("issues").where("status = 'open' AND deleted_at IS NULL").groupBy("severity").agg(F.count("*").alias("n"))
    return levels.join(n, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


@query("report_summary", f"SELECT category, severity, status, count(*) AS n FROM {_I} GROUP BY ALL")
def report_summary(t: Tables) -> DataFrame:
    return t.fx("issues").groupBy("category", "severity", "status").agg(F.count("*").alias("n"))


@query("locale_counts", f"SELECT source_id, coalesce(locale, '(root)') AS locale, count(*) AS n FROM {_U} GROUP BY ALL")
def locale_counts(t: Tables) -> DataFrame:
    return t.fx("urls").groupBy("source_id", F.coalesce("locale", F.lit("(root)")).alias("locale")).agg(F.count("*").alias("n")).orderBy(F.col("locale") == "(root)", F.desc("n"))


@query("section_counts", f"SELECT section, count(*) AS n FROM {_U} WHERE section IS NOT NULL GROUP BY section ORDER BY n DESC, section LIMIT 40")
def section_counts(t: Tables) -> DataFrame:
    return t.fx("urls").where("section IS NOT NULL").groupBy("section").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section").limit(40)


@query("findings_by_url", f"""SELECT url, any_value(locale) AS locale, any_value(content_type) AS content_type, any_value(author) AS author, coalesce(list(product_name ORDER BY {_RANK}, issue_id)[1], '') AS product, count(*) AS issue_count, string_agg(DISTINCT category, '; ' ORDER BY category) AS categories,
CASE min({_RANK}) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE CASE WHEN bool_or(severity = 'low') THEN 'low' ELSE '' END END AS severities,
array_to_string(list_transform(list_filter(list(evidence ORDER BY {_RANK}, issue_id), lambda e: coalesce(e, '') <> '')[1:10], lambda e: left(e, 120)), ' | ') AS evidences FROM {_JOINED} WHERE status = 'open' AND deleted_at IS NULL GROUP BY url""")
def findings_by_url(t: Tables) -> DataFrame:
    """One row a page: counts over all its findings, the product of the first and the first ten evidences; never more than ten in a list."""
    rows = findings(t).where("status = 'open' AND deleted_at IS NULL").withColumn("r", severity_rank(F.col("severity")))
    top = F.min(F.when(F.col("severity").isin("critical", "high", "medium", "low"), F.col("r"))).alias("top")
    n = rows.groupBy("url").agg(F.first("locale").alias("locale"), F.first("content_type").alias("content_type"), F.first("author").alias("author"), F.min_by("product_name", F.struct("r", "issue_id")).alias("product"), F.count("*").alias("issue_count"), F.sort_array(F.collect_set("category")).alias("c"), top)
    shown = first_of(rows.where("evidence <> ''"), ["url"], [F.col("r"), F.col("issue_id")], 10)
    shown = shown.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("r", "issue_id", F.left("evidence", F.lit(120)).alias("e")))).alias("rows"))
    named = F.when(F.col("top") == 0, "critical").when(F.col("top") == 1, "high").when(F.col("top") == 2, "medium").when(F.col("top") == 3, "low").otherwise("")
    out = n.join(shown, "url", "left").select("url", "locale", "content_type", "author", F.coalesce("product", F.lit("")).alias("product"), "issue_count", F.array_join("c", "; ").alias("categories"), named.alias("severities"), F.coalesce(F.array_join(F.transform("rows", lambda x: x["e"]), " | "), F.lit("")).alias("evidences"))
    return out.orderBy(F.desc("issue_count"), "url")


@query("content_type_counts", f"SELECT content_type, count(*) AS n, count(author) AS found, count(*) FILTER (WHERE content_type <> 'other' AND author IS NULL) AS not_found FROM {_U} GROUP BY content_type")
def content_type_counts(t: Tables) -> DataFrame:
    return t.fx("urls").groupBy("content_type").agg(F.count("*").alias("n"), F.count("author").alias("found"), F.count_if((F.col("content_type") != "other") & F.col("author").isNull()).alias("not_found"))


@query("author_status", f"SELECT url_id, CASE WHEN content_type = 'other' THEN 'not_applicable' WHEN author IS NULL THEN 'not_found' ELSE 'found' END AS author_status FROM {_U}")
def author_status(t: Tables) -> DataFrame:
    return t.fx("urls").select("url_id", F.when(F.col("content_type") == "other", "not_applicable").when(F.col("author").isNull(), "not_found").otherwise("found").alias("author_status"))


@query("author_backfill_stats", f"SELECT content_type, count(author) AS found, count(*) - count(author) AS not_found FROM {_U} WHERE content_type IN ('blog', 'news') GROUP BY 1")
def author_backfill_stats(t: Tables) -> DataFrame:
    return t.fx("urls").where("content_type IN ('blog', 'news')").groupBy("content_type").agg(F.count("author").alias("found"), F.count_if(F.col("author").isNull()).alias("not_found"))


@query("verdict_counts", f"SELECT coalesce(verdict, 'unclear') AS verdict, count(*) AS n FROM {_X} GROUP BY 1")
def verdict_counts(t: Tables) -> DataFrame:
    return t.fx("external").groupBy(F.coalesce("verdict", F.lit("unclear")).alias("verdict")).agg(F.count("*").alias("n"))


# A project and all that hangs on it.
PROJECT_ROWS = {"sources": "source_id", "products": "product_id", "urls": "url_id", "rules": "rule_id", "matches": "write_seq", "faqs": "faq_id", "crawls": "crawl_id", "issues": "issue_id", "external": "finding_id", "snippets": "snippet_id", "external_pages": "page_id", "profiles": "profile_id", "queries": "query_id", "jobs": "job_id", "schedules": "schedule_id"}


def project_tables(t: Tables) -> dict[str, DataFrame]:
    return {"sources": sources(t), **{n: t.fx(n) for n in PROJECT_ROWS if n != "sources"}}


def project_sql(gone: int) -> tuple[dict[str, str], dict[str, str]]:
    """(what stays, what goes) of each table, in the checking SQL's own way."""
    of = {n: o(n) for n in PROJECT_ROWS if n != "sources"} | {"sources": f"(SELECT * FROM {_SRC})"}
    hit = {n: f"source_id = {gone}" for n in PROJECT_ROWS}
    hit["rules"] = f"product_id IN (SELECT product_id FROM {of['products']} WHERE source_id = {gone})"
    pages = f"url_id IN (SELECT url_id FROM {of['urls']} WHERE source_id = {gone})"
    hit |= {"faqs": pages, "crawls": pages, "matches": f"({pages} OR rule_id IN (SELECT rule_id FROM {of['rules']} WHERE {hit['rules']}))"}
    return ({n: f"(SELECT * FROM {of[n]} WHERE NOT coalesce({hit[n]}, false))" for n in PROJECT_ROWS}, {n: f"(SELECT * FROM {of[n]} WHERE {hit[n]})" for n in PROJECT_ROWS})


_, _GONE = project_sql(1)
_KEPT, _ = project_sql(2)


@query("delete_summary", f"""SELECT (SELECT brand FROM {_SRC} WHERE source_id = 1) AS name, (SELECT count(*) FROM {_GONE['urls']}) AS pages, (SELECT count(*) FROM {_M} JOIN {_U} u USING (url_id) WHERE u.source_id = 1) AS matches,
(SELECT count(*) FROM {_GONE['issues']}) + (SELECT count(*) FROM {_GONE['external']}) AS findings, (SELECT count(*) FROM {_GONE['rules']}) AS rules, (SELECT count(*) FROM {_GONE['external_pages']}) AS external, (SELECT count(*) FROM {_GONE['jobs']}) AS jobs, (SELECT count(*) FROM {_GONE['schedules']}) AS schedules""")
def delete_summary(t: Tables) -> DataFrame:
    """What the deletion of a project would take, as it is shown before: verdicts count by page alone."""
    _, gone = D.delete(project_tables(t), "sources", F.col("source_id") == 1)
    paged = t.fx("matches").join(gone["urls"].select("url_id"), "url_id", "left_semi")
    n = D.counts({"pages": gone["urls"], "matches": paged, "issues": gone["issues"], "found": gone["external"], "rules": gone["rules"], "external": gone["external_pages"], "jobs": gone["jobs"], "schedules": gone["schedules"]})
    part = lambda p: F.max(F.when(F.col("part") == p, F.col("n")))
    row = n.agg(*[part(p).alias(p) for p in ("pages", "matches")], (part("issues") + part("found")).alias("findings"), *[part(p).alias(p) for p in ("rules", "external", "jobs", "schedules")])
    return sources(t).where("source_id = 1").select(F.coalesce("brand", "location").alias("name")).join(row)  # two single rows


@query("delete_project", " UNION ALL ".join(f"SELECT '{n}' AS part, CAST({k} AS BIGINT) AS id FROM {_KEPT[n]}" for n, k in PROJECT_ROWS.items()))
def delete_project(t: Tables) -> DataFrame:
    """The rows of every table that stay when a project goes."""
    left, _ = D.delete(project_tables(t), "sources", F.col("source_id") == 2)
    out = None
    for n, k in PROJECT_ROWS.items():
        one = left[n].select(F.lit(n).alias("part"), F.col(k).cast("long").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


@query("sources_list", f"SELECT source_id, location, (SELECT count(*) FROM {_U} u WHERE u.source_id = s.source_id) AS urls FROM {_SRC}")
def sources_list(t: Tables) -> DataFrame:
    return sources(t).join(t.fx("urls").groupBy("source_id").agg(F.count("*").alias("urls")), "source_id", "left").select("source_id", "location", F.coalesce("urls", F.lit(0)).alias("urls"))


@query("external_by_domain", f"SELECT coalesce(domain, '?') AS domain, count(*) AS n FROM {_X} WHERE status = 'open' AND deleted_at IS NULL GROUP BY 1")
def external_by_domain(t: Tables) -> DataFrame:
    return t.fx("external").where("status = 'open' AND deleted_at IS NULL").groupBy(F.coalesce("domain", F.lit("?")).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain")


@query("orphan_check", " UNION ALL ".join(f"SELECT '{k.child}.{k.column}' AS part, count(*) AS n FROM {_KEPT[k.child]} WHERE {k.column} IS NOT NULL AND {k.column} NOT IN (SELECT {k.parent_column} FROM {_KEPT[k.parent]})" for k in D.KEYS))
def orphan_check(t: Tables) -> DataFrame:
    """After a project went: rows of every key that name a parent that is not there. Some of these tables name sources that never were."""
    left, _ = D.delete(project_tables(t), "sources", F.col("source_id") == 2)
    return D.orphans(left)


@query("usage_cost", "SELECT model, count(*) AS calls, sum(n_chars) AS tokens, round(sum(n_chars * price), 6) AS spend FROM (SELECT n_chars, CASE doc_id % 2 WHEN 0 THEN 'fast' ELSE 'deep' END AS model FROM documents) d JOIN (VALUES ('fast', CAST(0.000001 AS DOUBLE)), ('deep', CAST(0.00001 AS DOUBLE))) p(model, price) USING (model) GROUP BY model")
def usage_cost(t: Tables) -> DataFrame:
    prices = t.spark.createDataFrame([("fast", 0.000001), ("deep", 0.00001)], "model string, price double")
    log = t.documents.select("n_chars", F.when(F.col("doc_id") % 2 == 0, "fast").otherwise("deep").alias("model"))
    return log.join(prices, "model").groupBy("model").agg(F.count("*").alias("calls"), F.sum("n_chars").alias("tokens"), F.round(F.sum(F.col("n_chars") * F.col("price")), 6).alias("spend"))


_RG = o("registry")


@query("rules_context", f"""SELECT product, count(*) AS rules, string_agg(line, chr(10) ORDER BY rule_id) AS context FROM (SELECT rule_id, coalesce(p.name, 'any product') AS product,
'- [' || slug || ' / ' || coalesce(category, '') || ' / product: ' || coalesce(p.name, 'any product') || ']. Correct value: ' || coalesce(correct_value, 'TBD') || '.' || CASE WHEN len(al) > 0 THEN ' ALLOWED (not an issue): ' || array_to_string(al[1:4], '; ') || '.' ELSE '' END AS line
FROM (SELECT *, CAST(coalesce(try_cast(allowed_patterns AS JSON), '[]') AS VARCHAR[]) AS al FROM {_RG} WHERE enabled = 1) r LEFT JOIN {_CT} p USING (product_id)) GROUP BY product""")
def rules_context(t: Tables) -> DataFrame:
    """Rules as lines of text with at most four of their allowed patterns, per product, in rule order."""
    return A.rules_context(A.load_rules(t.fx("registry"), t.fx("catalog")))


@query("features_context", f"SELECT s.source_id, coalesce(string_agg('- [f' || product_id || '] ' || name || ' — status=' || CASE product_id % 3 WHEN 0 THEN 'planned' ELSE 'available' END || '. ' || CASE WHEN product_id % 4 = 1 THEN '' ELSE 'About ' || name END || CASE product_id % 5 WHEN 0 THEN ' NOTE: note ' || product_id ELSE '' END, chr(10) ORDER BY product_id), '(none)') AS context FROM (SELECT DISTINCT source_id FROM {_J}) s LEFT JOIN {_CT} c USING (source_id) GROUP BY s.source_id")
def features_context(t: Tables) -> DataFrame:
    k = F.col("product_id")
    features = t.fx("catalog").select("source_id", k.alias("feature_id"), F.concat(F.lit("f"), k).alias("slug"), "name", F.when(k % 3 == 0, "planned").otherwise("available").alias("status"), F.when(k % 4 != 1, F.concat(F.lit("About "), "name")).alias("description"), F.when(k % 5 == 0, F.concat(F.lit("note "), k)).alias("notes"))
    return A.features_context(features, t.fx("jobs").select("source_id").distinct())


# H, I: windows, order
@query("match_last_write", f"SELECT rule_id, k, url_id, verdict FROM (SELECT *, url_id % 50 AS k FROM {_M}) QUALIFY row_number() OVER (PARTITION BY rule_id, k ORDER BY write_seq DESC) = 1")
def match_last_write(t: Tables) -> DataFrame:
    return S.latest(t.fx("matches").withColumn("k", F.col("url_id") % 50), ["rule_id", "k"], ["write_seq"]).select("rule_id", "k", "url_id", "verdict")


@query("verdict_batches", f"SELECT rule_id, batch, count(*) AS n, min(url_id) AS first_url_id FROM (SELECT rule_id, url_id, (row_number() OVER (PARTITION BY rule_id ORDER BY url_id) - 1) // 10 AS batch FROM {_M}) GROUP BY ALL")
def verdict_batches(t: Tables) -> DataFrame:
    return S.batches(t.fx("matches"), "rule_id", "url_id", 10).groupBy("rule_id", "batch").agg(F.count("*").alias("n"), F.min("url_id").alias("first_url_id"))


@query("content_changes", f"SELECT url_id, v FROM (SELECT url_id, v, crawl_id, content_hash, lag(content_hash) OVER (PARTITION BY url_id ORDER BY crawl_id) AS p FROM {_C}) WHERE p IS NOT NULL AND content_hash IS NOT NULL AND content_hash <> p")
def content_changes(t: Tables) -> DataFrame:
    return S.with_previous_hash(t.fx("crawls")).where("previous_hash IS NOT NULL AND content_hash <> previous_hash").select("url_id", "v")


@query("findings_ranked", f"SELECT issue_id, severity, url FROM {_JOINED} WHERE deleted_at IS NULL ORDER BY {_RANK}, url, issue_id LIMIT 500")
def findings_ranked(t: Tables) -> DataFrame:
    return ranked(findings(t).where("deleted_at IS NULL"), 500).select("issue_id", "severity", "url")


@query("error_pages", f"SELECT url_id, status_code, error FROM {_LATEST} WHERE error IS NOT NULL OR status_code >= 400 ORDER BY url_id LIMIT 200")
def error_pages(t: Tables) -> DataFrame:
    return S.latest(t.fx("crawls"), ["url_id"], ["crawl_id"]).where("error IS NOT NULL OR status_code >= 400").orderBy("url_id").limit(200).select("url_id", "status_code", "error")


# J: sets
@query("url_set_diff", f"SELECT url_id, 'new' AS change FROM {_U} WHERE url_id % 7 <> 0 AND url_id % 5 = 0 UNION ALL SELECT url_id, 'removed' FROM {_U} WHERE url_id % 7 = 0 AND url_id % 5 <> 0")
def url_set_diff(t: Tables) -> DataFrame:
    return S.set_diff(t.fx("urls").where("url_id % 5 <> 0"), t.fx("urls").where("url_id % 7 <> 0"), "url_id")


@query("findings_union", f"SELECT 'internal' AS scope, issue_id AS id, url, category, severity FROM {_JOINED} WHERE status = 'open' AND deleted_at IS NULL UNION ALL SELECT 'external', finding_id, external_url, NULL, severity FROM {_X} WHERE status = 'open' AND deleted_at IS NULL")
def findings_union(t: Tables) -> DataFrame:
    a = findings(t).where("status = 'open' AND deleted_at IS NULL").select(F.lit("internal").alias("scope"), F.col("issue_id").alias("id"), "url", "category", "severity")
    b = t.fx("external").where("status = 'open' AND deleted_at IS NULL").select(F.lit("external").alias("scope"), F.col("finding_id").alias("id"), F.col("external_url").alias("url"), "severity")
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_locales", f"SELECT DISTINCT locale FROM {_U} WHERE locale IS NOT NULL")
def distinct_locales(t: Tables) -> DataFrame:
    return t.fx("urls").where("locale IS NOT NULL").select("locale").distinct()


@query("locale_intersect", f"SELECT DISTINCT locale FROM {_U} WHERE locale IN ('en', 'fr', 'xx')")
def locale_intersect(t: Tables) -> DataFrame:
    return t.fx("urls").select("locale").intersect(t.spark.createDataFrame([("en",), ("fr",), ("xx",)], "locale string"))


@query("brand_aliases", f"SELECT source_id, arg_min(a, k) AS alias, min(k) // 1000000 AS product_id, min(k) % 1000000 AS place FROM (SELECT source_id, a, product_id * 1000000 + row_number() OVER (PARTITION BY product_id ORDER BY pos) AS k FROM (SELECT source_id, CAST(product_id AS BIGINT) AS product_id, unnest(x) AS a, generate_subscripts(x, 1) AS pos FROM (SELECT *, string_split(name || ',' || aliases, ',') AS x FROM {_CT})) WHERE a <> '') GROUP BY source_id, lower(a)")
def brand_aliases(t: Tables) -> DataFrame:
    """Names and aliases of a source without repeats in any case, as they are written first, by product and place."""
    names = t.fx("catalog").select("source_id", F.col("product_id").cast("long").alias("product_id"), F.posexplode(F.filter(F.split(F.concat_ws(",", "name", "aliases"), ","), lambda x: x != "")).alias("pos", "a"))
    first = names.groupBy("source_id", F.lower("a").alias("low")).agg(F.min(F.struct("product_id", (F.col("pos") + 1).cast("long").alias("place"), "a")).alias("f"))
    return first.select("source_id", F.col("f.a").alias("alias"), "f.product_id", "f.place")


@query("needs_sync", f"SELECT source_id, total, crawled, updated, CASE WHEN crawled = 0 THEN 'Never synced' WHEN total > crawled THEN (total - crawled) || ' never synced' WHEN updated > 0 THEN updated || ' updated' ELSE 'up to date' END AS message FROM (SELECT source_id, count(*) AS total, count(last_crawled) AS crawled, count(*) FILTER (WHERE lastmod > last_crawled) AS updated FROM {_U} GROUP BY 1)")
def needs_sync(t: Tables) -> DataFrame:
    return S.sync_message(t.fx("urls"))


_LAST = f"(SELECT source_id, max_by(started_at, (started_at, job_id)) AS since FROM {_J} WHERE status = 'done' AND started_at IS NOT NULL GROUP BY source_id)"


@query("what_changed", f"""WITH last AS {_LAST}, lags AS (SELECT url_id, crawled_at, content_hash, lag(content_hash) OVER (PARTITION BY url_id ORDER BY crawl_id) AS p FROM {_C})
SELECT l.source_id, (SELECT count(*) FROM {_U} u WHERE u.source_id = l.source_id AND in_source = 1 AND first_seen >= since) AS new_urls,
(SELECT count(*) FROM lags JOIN {_U} u USING (url_id) WHERE u.source_id = l.source_id AND p IS NOT NULL AND content_hash <> p) AS changed,
(SELECT count(*) FROM {_U} u WHERE u.source_id = l.source_id AND in_source = 0) AS removed,
(SELECT count(*) FROM {_I} i WHERE i.source_id = l.source_id AND status = 'open' AND detected_at >= since) AS new_findings,
(SELECT count(*) FROM {_I} i WHERE i.source_id = l.source_id AND status = 'fixed' AND last_checked_at >= since) AS fixed FROM last l""")
def what_changed(t: Tables) -> DataFrame:
    """Per source with a finished run: pages new since its last one, changed and removed, findings new and fixed since."""
    last = t.fx("jobs").where("status = 'done' AND started_at IS NOT NULL").groupBy("source_id").agg(F.max("started_at").alias("since"))
    u, i = t.fx("urls"), t.fx("issues").join(last, "source_id")
    pages = u.join(last, "source_id").groupBy("source_id").agg(F.count_if((F.col("in_source") == 1) & (F.col("first_seen") >= F.col("since"))).alias("new_urls"), F.count_if(F.col("in_source") == 0).alias("removed"))
    changed = content_changes(t).join(u.select("url_id", "source_id"), "url_id").groupBy("source_id").agg(F.count("*").alias("changed"))
    found = i.groupBy("source_id").agg(F.count_if((F.col("status") == "open") & (F.col("detected_at") >= F.col("since"))).alias("new_findings"), F.count_if((F.col("status") == "fixed") & (F.col("last_checked_at") >= F.col("since"))).alias("fixed"))
    out = last.join(pages, "source_id", "left").join(changed, "source_id", "left").join(found, "source_id", "left")
    return out.select("source_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("new_urls", "changed", "removed", "new_findings", "fixed")])
