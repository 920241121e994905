"""Checks of the URL and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.functions import categories as C
from factflow.functions import text as X
from factflow.functions import urls as U
from factflow.plans.registry import Tables, o, query

# C: URLs
_SEGS = "list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"
_HOST = "nullif(regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www[.]', ''), '')"
_PAGES = f"(SELECT page_id, url, {_SEGS} AS s, {_HOST} AS h FROM pages)"


@query("url_locale_section", f"SELECT page_id, CASE WHEN regexp_full_match(s[1], '[a-z][a-z]') THEN s[1] END AS locale, CASE WHEN regexp_full_match(s[1], '[a-z][a-z]') THEN s[2] ELSE s[1] END AS section FROM {_PAGES}")
def url_locale_section(t: Tables) -> DataFrame:
    s = U.path_segments(F.col("url"))
    return t.pages.select("page_id", U.locale(s).alias("locale"), U.section(s).alias("section"))


@query("url_content_type", f"SELECT page_id, CASE WHEN list_contains(s, 'fr') THEN 'blog' WHEN list_contains(s, 'de') THEN 'news' ELSE 'other' END AS content_type FROM {_PAGES}")
def url_content_type(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.content_type(U.path_segments(F.col("url")), "fr", "de").alias("content_type"))


@query("url_host", f"SELECT page_id, h AS host FROM {_PAGES}")
def url_host(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.host(F.col("url")).alias("host"))


@query("url_domain", f"SELECT page_id, regexp_extract(h, '([^.]*[.])?[^.]*$') AS domain FROM {_PAGES}")
def url_domain(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.registrable_domain(U.host(F.col("url"))).alias("domain"))


@query("url_host_excluded", f"SELECT page_id, coalesce(h = 'example.org' OR ends_with(h, '.example.org') OR h = 'example.com', false) AS excluded FROM (SELECT page_id, h FROM {_PAGES}) WHERE true")
def url_host_excluded(t: Tables) -> DataFrame:
    name = U.host(F.col("url"))
    return t.pages.select("page_id", (U.host_excluded(name, [".Example.ORG", " "]) | (name == "example.com")).alias("excluded"))


@query("crawl_domain_gate", f"SELECT page_id, ends_with(h, 'ample.net') AS on_domain, h = 'ample.net' OR ends_with(h, '.ample.net') AS on_domain_strict FROM {_PAGES} WHERE ends_with(h, 'ample.net')")
def crawl_domain_gate(t: Tables) -> DataFrame:
    name = U.host(F.col("url"))
    return t.pages.where(U.on_domain(name, "ample.net")).select("page_id", F.lit(True).alias("on_domain"), U.on_domain(name, "ample.net", strict=True).alias("on_domain_strict"))


@query("slugify", "SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '_', 'g'), '_'), 48), ''), 'rule') AS slug FROM documents")
def slugify(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", U.slug(F.col("text")).alias("slug"))


# D: text
_SP = "[\\s\\x0B\\x1c-\\x1f\\x{85}\\p{Z}]"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SP}+', ' ', 'g'))"


@query("text_normalize", f"SELECT doc_id, {_norm('text')} AS body FROM documents")
def text_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize(F.col("text")).alias("body"))


@query(
    "regex_matches_offsets",
    """SELECT doc_id, m AS value, CAST(length(list_aggregate(p[1:k], 'string_agg', '')) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda z: length(z))), 0) AS INT) AS start
FROM (SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS k, ms, p FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+tion') AS ms, regexp_split_to_array(text, '[A-Za-z]+tion') AS p FROM documents))""",
)
def regex_matches_offsets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(X.regex_matches(F.col("text"), "[A-Za-z]+tion")).alias("m")).select("doc_id", "m.value", "m.start")


@query("context_window", "SELECT doc_id, substr(text, greatest(instr(text, ' the ') - 81, 0) + 1, instr(text, ' the ') + 84 - greatest(instr(text, ' the ') - 81, 0)) AS seg FROM documents WHERE contains(text, ' the ')")
def context_window(t: Tables) -> DataFrame:
    at = F.instr("text", " the ") - 1
    return t.documents.where(F.col("text").contains(" the ")).select("doc_id", X.context_window(F.col("text"), at, at + 5, 80).alias("seg"))


_AROUND = f"""(SELECT doc_id, lo, hi, n, text, substr(text, lo + 1, hi - lo) AS s FROM (SELECT *, greatest(at_ - 150, 0) AS lo, least(at_ + 155, n) AS hi FROM
(SELECT doc_id, text, instr(text, ' the ') - 1 AS at_, length(text) AS n FROM (SELECT doc_id, {_norm('text')} AS text FROM documents) d0 WHERE contains(text, ' the ')) d1) d2)"""


@query("context_snippet", f"""SELECT doc_id, trim((CASE WHEN lo > 0 THEN '…' ELSE '' END) || regexp_replace(CASE WHEN lo > 0 THEN regexp_replace(s, '^[^ ]* ', '') ELSE s END, CASE WHEN hi < n THEN ' [^ ]*$' ELSE '$' END, '') || (CASE WHEN hi < n THEN '…' ELSE '' END)) AS snippet FROM {_AROUND}""")
def context_snippet(t: Tables) -> DataFrame:
    body = t.documents.select("doc_id", X.normalize(F.col("text")).alias("b")).where(F.col("b").contains(" the "))
    at = F.instr("b", " the ") - 1
    return body.select("doc_id", X.context_snippet(F.col("b"), at, at + 5, 150).alias("snippet"))


# Sentence ends by another road: a mark behind every ender, then cut at the marks.
_MARKED = "regexp_replace(regexp_replace(b, '([.!?…]+)( |$)', '\\1\x01\\2', 'g'), '([。！？।]+)', '\\1\x01', 'g')"
_BODY = f"(SELECT doc_id, regexp_replace({_norm('text')}, '\\p{{Nd}}', 'n', 'g') || CASE WHEN doc_id % 4 = 0 THEN ' Short. Fine。ok' ELSE '' END AS b FROM documents)"
_ENDS = f"(SELECT doc_id, b, length(b) AS n, list_transform(range(1, len(q)), lambda k: CAST(length(array_to_string(q[1:k], '')) AS INT)) AS ends FROM (SELECT doc_id, b, string_split({_MARKED}, '\x01') AS q FROM {_BODY}) z)"


def _bodies(t: Tables) -> DataFrame:
    tail = F.when(F.col("doc_id") % 4 == 0, " Short. Fine。ok").otherwise("")
    return t.documents.select("doc_id", F.concat(F.regexp_replace(X.normalize(F.col("text")), r"\p{Nd}", "n"), tail).alias("b"))


@query("sentence_boundaries", f"SELECT doc_id, CAST(len(ends) AS INT) AS n_ends, array_to_string(ends, ',') AS ends FROM {_ENDS}")
def sentence_boundaries(t: Tables) -> DataFrame:
    found = _bodies(t).select("doc_id", X.sentence_ends(F.col("b")).alias("e"))
    return found.select("doc_id", F.size("e").alias("n_ends"), F.array_join(F.col("e").cast("array<string>"), ",").alias("ends"))


def evidence_sql(source: str, keep: str) -> str:
    """Evidence of the match [at, at + w) of ``b`` with sentence ends ``ends``."""
    return f"""SELECT {keep}, CASE WHEN n = 0 THEN '' WHEN lost OR length(best) > 300 THEN trim((CASE WHEN wl > 0 THEN '…' ELSE '' END)
  || regexp_replace(CASE WHEN wl > 0 THEN regexp_replace(ws, '^[^ ]* ', '') ELSE ws END, CASE WHEN wh < n THEN ' [^ ]*$' ELSE '$' END, '') || (CASE WHEN wh < n THEN '…' ELSE '' END))
  ELSE best END AS evidence FROM (
SELECT *, NOT contains(sent, m) AS lost, CASE WHEN length(sent) < 40 AND hi < n AND length(wide) <= 300 THEN wide ELSE sent END AS best, substr(b, wl + 1, wh - wl) AS ws FROM (
SELECT *, trim(substr(b, lo + 1, hi - lo)) AS sent, trim(substr(b, lo + 1, coalesce(list_min(list_filter(ends, lambda x: x > hi)), n) - lo)) AS wide, substr(b, at_ + 1, w) AS m,
  greatest(at_ - 120, 0) AS wl, least(at_ + w + 120, n) AS wh FROM (
SELECT *, coalesce(list_max(list_filter(ends, lambda x: x <= at_)), 0) AS lo, coalesce(list_min(list_filter(ends, lambda x: x >= at_ + w)), n) AS hi FROM {source}) e1) e2) e3"""


_AT = f"(SELECT *, instr(b, 'the') - 1 AS at_, 3 AS w FROM {_ENDS} WHERE contains(b, 'the'))"


@query("sentence_evidence", evidence_sql(_AT, "doc_id"))
def sentence_evidence(t: Tables) -> DataFrame:
    at = F.instr("b", "the") - 1
    return X.with_evidence(_bodies(t).where(F.col("b").contains("the")), "b", at, at + 3).select("doc_id", "evidence")


_TRIM_AT = f"(SELECT *, CASE WHEN doc_id % 2 = 0 AND contains(b, 'the') THEN instr(b, 'the') - 1 ELSE n // 2 END AS at_, CASE WHEN doc_id % 2 = 0 AND contains(b, 'the') THEN 3 ELSE 1 END AS w FROM {_ENDS})"


@query("evidence_trim", f"SELECT doc_id, CASE WHEN n <= 300 AND len(ends) <= 1 THEN b ELSE evidence END AS trimmed FROM ({evidence_sql(_TRIM_AT, 'doc_id, n, ends, b')})")
def evidence_trim(t: Tables) -> DataFrame:
    stored = _bodies(t).select("doc_id", F.concat(F.lit("…"), F.col("b"), F.lit(" …")).alias("s"))
    return X.with_trimmed_evidence(stored, "s", F.when(F.col("doc_id") % 2 == 0, "the")).select("doc_id", "trimmed")


@query("evidence_core", f"SELECT doc_id, left(trim({_norm('text')}), 80) AS core FROM documents")
def evidence_core(t: Tables) -> DataFrame:
    stored = F.concat(F.lit("… <mark>"), F.left("text", F.lit(3)), F.lit("</mark>"), F.substring("text", 4, 100000000), F.lit(" …"))
    return t.documents.select("doc_id", X.evidence_core(stored).alias("core"))


_TERMS = ["rights reserved", "license", "of the"]
_FIRST = "(SELECT *, list_min(list_filter([{p: instr(lower(b), 'rights reserved'), k: 0, w: 15}, {p: instr(lower(b), 'license'), k: 1, w: 7}, {p: instr(lower(b), 'of the'), k: 2, w: 6}], lambda z: z.p > 0)) AS f FROM " + _ENDS + ")"
_TERM_EV = evidence_sql(f"(SELECT *, f.p - 1 AS at_, f.w AS w FROM {_FIRST} WHERE f IS NOT NULL)", "doc_id, w, ['rights reserved', 'license', 'of the'][f.k + 1] AS term")


@query("search_term_context", f"SELECT doc_id, CASE WHEN p > 0 THEN left(evidence, p - 1) || '<mark>' || substr(evidence, p, w) || '</mark>' || substr(evidence, p + w) ELSE evidence END AS snippet FROM (SELECT *, instr(lower(evidence), term) AS p FROM ({_TERM_EV}))")
def search_term_context(t: Tables) -> DataFrame:
    return X.with_term_context(_bodies(t), "b", _TERMS).select("doc_id", "snippet").where("snippet IS NOT NULL")


@query("fact_rule_of", f"SELECT issue_id, CASE WHEN starts_with(title, 'llm:') OR starts_with(title, 'lang_ctx:') OR starts_with(title, 'reg_ctx:') THEN array_to_string(string_split(title, ':')[1:2], ':') ELSE string_split(title, ':')[1] END AS fact_rule FROM {o('issues')}")
def fact_rule_of(t: Tables) -> DataFrame:
    return t.fx("issues").select("issue_id", X.fact_rule_of(F.col("title")).alias("fact_rule"))


@query("search_term_clean", "SELECT doc_id, trim(regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}_\\s+.,%$-]', ' ', 'g')) AS term FROM documents")
def search_term_clean(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_term(F.col("text")).alias("term"))


@query("term_list_split", "SELECT doc_id, array_to_string(list_filter(list_transform(CASE WHEN contains(t, chr(10)) THEN string_split(t, chr(10)) ELSE string_split(t, ',') END, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), '|') AS terms FROM (SELECT doc_id, text AS t FROM documents)")
def term_list_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.split_terms(F.col("text")), "|").alias("terms"))


@query("first_number", "SELECT doc_id, regexp_extract(text, '[0-9]{1,3}') AS number FROM documents")
def first_number(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.first_number(F.col("text")).alias("number"))


@query("run_duration", f"SELECT job_id, CAST(epoch(CAST(finished_at AS TIMESTAMPTZ)) - epoch(CAST(started_at AS TIMESTAMPTZ)) AS BIGINT) AS seconds FROM {o('jobs')}")
def run_duration(t: Tables) -> DataFrame:
    return t.fx("jobs").select("job_id", (F.unix_timestamp(F.to_timestamp("finished_at")) - F.unix_timestamp(F.to_timestamp("started_at"))).alias("seconds"))


@query("json_array_safe", f"SELECT rule_id, CAST(coalesce(len(TRY_CAST(CASE WHEN json_valid(current_patterns) THEN current_patterns END AS VARCHAR[])), 0) AS INT) AS n, coalesce(array_to_string(TRY_CAST(CASE WHEN json_valid(current_patterns) THEN json(current_patterns) END AS VARCHAR[]), '|'), '') AS patterns FROM {o('registry')}")
def json_array_safe(t: Tables) -> DataFrame:
    a = X.json_strings(F.col("current_patterns"))
    return t.fx("registry").select("rule_id", F.size(a).alias("n"), F.array_join(a, "|").alias("patterns"))


@query("severity_floor", f"SELECT issue_id, CASE WHEN severity IN ('critical', 'high') THEN severity ELSE 'medium' END AS floored, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM {o('issues')}")
def severity_floor(t: Tables) -> DataFrame:
    return t.fx("issues").select("issue_id", C.at_least_medium(F.col("severity")).alias("floored"), C.severity_rank(F.col("severity")).alias("rank"))


@query("error_class", "SELECT event_id, CASE event_type || '' WHEN 'click' THEN 'timeout' WHEN 'view' THEN 'ssl' WHEN 'purchase' THEN 'dns' WHEN 'signup' THEN 'connection' ELSE 'network: OddError' END AS class FROM events")
def error_class(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "click", "ReadTimeout").when(kind == "signup", "ConnectError").otherwise("OddError")
    message = F.when(kind == "view", "bad Certificate").when(kind == "purchase", "Name or service not known").otherwise("broken")
    return t.events.select("event_id", X.error_class(name, message).alias("class"))


@query("author_clean", "SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE 'Ada Byron ' || doc_id END AS author FROM documents")
def author_clean(t: Tables) -> DataFrame:
    k, name = F.col("doc_id") % 6, F.concat(F.lit("Ada  Byron "), F.col("doc_id"))
    line = (
        F.when(k == 0, F.concat(F.lit("By "), name)).when(k == 1, F.concat(F.lit("Written by: "), name, F.lit(" | 19 Mar"))).when(k == 2, F.concat(name, F.lit(" on March 2024")))
        .when(k == 3, F.concat(F.lit("  Author "), name, F.lit(", Editor"))).when(k == 4, F.concat(name, F.lit(" — Staff"))).otherwise(F.repeat(F.lit("x"), 90))
    )
    return t.documents.select("doc_id", X.clean_author(line).alias("author"))
