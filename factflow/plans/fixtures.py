"""Derived tables of the checks: site snapshots, findings and verdicts made from the given tables.

Each function takes a dialect and returns a query. Both sides of a check read the same
derived rows; only the operators under test differ.
"""

from __future__ import annotations

from factflow.functions.categories import CATEGORIES

_PICK = "CASE {k} " + " ".join(f"WHEN {n} THEN '{c}'" for n, c in enumerate(CATEGORIES)) + " END"


def urls(d) -> str:
    return f"""
SELECT *, 'https://www.site' || source_id || '.example.com/' || coalesce(locale || '/', '') || coalesce(section || '/', '') || 'p' || url_id AS url,
  CASE section WHEN 'blog' THEN 'blog' WHEN 'news' THEN 'news' ELSE 'other' END AS content_type,
  CASE WHEN section IN ('blog', 'news') AND url_id % 8 < 5 THEN 'Author ' || (url_id % 17) END AS author,
  CASE WHEN url_id % 5 = 1 THEN {d.div('url_id', 4)} END AS group_id
FROM (SELECT doc_id AS url_id, CAST(doc_id % 3 + 1 AS INT) AS source_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE lang END AS locale,
  CASE doc_id % 4 WHEN 0 THEN 'blog' WHEN 1 THEN 'news' WHEN 2 THEN 'docs' END AS section,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE '2024-0' || (1 + doc_id % 6) || '-15' END AS lastmod,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '2024-0' || (1 + (doc_id * 5) % 6) || '-20T00:00:00+00:00' END AS last_crawled,
  CASE WHEN doc_id % 4 = 1 THEN '2024-0' || (1 + doc_id % 3) || '-28' ELSE '2023-1' || (doc_id % 3) || '-01' END || 'T00:00:00+00:00' AS first_seen, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS in_source
  FROM {d.t('documents')}) u"""


def crawls(d) -> str:
    return f"""
SELECT crawl_id, url_id, v, crawled_at, status_code, error, body_text, CASE WHEN body_text IS NOT NULL THEN md5(body_text) END AS content_hash,
  'Page ' || url_id AS title FROM (
SELECT doc_id * 3 + v AS crawl_id, doc_id AS url_id, v, '2024-0' || v || '-01T00:00:00+00:00' AS crawled_at,
  CASE WHEN (doc_id + v) % 13 = 0 THEN 500 ELSE 200 END AS status_code, CASE WHEN (doc_id + v) % 17 = 0 THEN 'timeout' END AS error,
  CASE WHEN (doc_id + v) % 13 = 0 OR (doc_id + v) % 17 = 0 THEN NULL
       WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 5 = 0 THEN trim({d.rx_all('text', '[ \\t\\n\\r\\f\\x0B]+', ' ')}) || ' v' || v
       ELSE trim({d.rx_all('text', '[ \\t\\n\\r\\f\\x0B]+', ' ')}) END AS body_text
FROM {d.t('documents')} CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3) vs) c"""


def claims(d) -> str:
    """Latest bodies with planted claims, so that every branch of the detectors is reached."""
    return f"""
SELECT doc_id AS url_id, CAST(doc_id % 3 + 1 AS INT) AS source_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE lang END AS locale,
  trim({d.rx_all('text', '[ \\t\\n\\r\\f\\x0B]+', ' ')})
  || CASE WHEN doc_id % 3 = 0 THEN ' Our platform is offered in ' || (26 + doc_id % 7) || ' languages for teams.' ELSE '' END
  || CASE WHEN doc_id % 4 = 1 THEN ' Every document can be read in ' || (30 + doc_id % 3) || ' languages by default.' ELSE '' END
  || CASE WHEN doc_id % 5 = 2 THEN ' It speaks ' || (40 + doc_id % 4) || ' languages.' ELSE '' END
  || CASE WHEN doc_id % 6 = 3 THEN ' The platform covers ' || (100 + doc_id % 5) || ' regulations worldwide.' ELSE '' END
  || CASE WHEN doc_id % 7 = 4 THEN ' A list names ' || (90 + doc_id % 3) || ' regulations in total.' ELSE '' END
  || CASE WHEN doc_id % 8 = 5 THEN ' Sold in ' || (50 + doc_id % 2) || ' countries and later in ' || (52 + doc_id % 2) || ' countries.' ELSE '' END
  || CASE WHEN doc_id % 9 = 6 THEN ' ' || CASE doc_id % 2 WHEN 0 THEN 'Atlas' ELSE 'Somebody' END || CASE doc_id % 5 WHEN 0 THEN ' has a fixed set of regulations only.' WHEN 1 THEN ' keeps a hard-coded list of regulations.' WHEN 2 THEN ' has a predefined regulation set.'
       WHEN 3 THEN ' says that users cannot add any regulation.' ELSE ' says that no new regulations can be added to a regulation list.' END ELSE '' END
  || CASE WHEN doc_id % 10 = 7 THEN ' Prices start at $' || (10 + doc_id % 90) || ' and save ' || (5 + doc_id % 40) || '% for 2 million users.' ELSE '' END AS body_text
FROM {d.t('documents')}"""


def rules(d) -> str:
    """Rules as stored: pattern lists are JSON text, one of them broken."""
    rows = [
        (1, "of_the", "stale", "other_mismatch", None, '["of the"]', '["and the"]', '["in of"]', None, 60, "high", 1, 1, None, None),
        (2, "licence", "stale", "other_mismatch", "MIT", '["apache license","general public license"]', '["mit license"]', "[]", None, None, None, 0, 1, 1, None),
        (3, "de_la", "stale", "other_mismatch", None, '["de la"]', "not json", '["de las"]', '["en"]', 80, "low", 0, 1, 2, None),
        (4, "languages", "inventory", "language_count", "29", "[]", "[]", "[]", None, None, "high", 0, 1, None, None),
        (5, "countries", "inventory", None, "51", "[]", "[]", "[]", None, None, None, 0, 1, 3, None),
        (6, "rights", "query", "positioning", "All rights reserved", '["rights reserved"]', "[]", "[]", None, None, "medium", 0, 1, 1, '["rights reserved","of the"]'),
        (7, "off", "stale", "other_mismatch", None, '["the"]', "[]", "[]", None, None, "medium", 0, 0, 2, None),
        (8, "version", "query", None, None, "[]", "[]", "[]", None, 200, "critical", 1, 1, None, '["version"]'),
        (9, "license", "query", None, "MIT", "[]", "[]", "[]", None, None, None, 0, 1, 2, "broken"),
    ]

    def lit(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"

    names = "rule_id slug rule_type category correct_value stale_patterns current_patterns allowed_patterns required_context context_window severity english_only enabled product_id search_terms".split()
    selects = [", ".join(f"CAST({lit(v)} AS {'INT' if n in ('rule_id', 'context_window', 'english_only', 'enabled', 'product_id') else 'STRING'}) AS {n}" for n, v in zip(names, r, strict=True)) for r in rows]
    return " UNION ALL ".join(f"SELECT {s}" for s in selects)


def products(d) -> str:
    rows = [(1, 1, "Atlas", 0, "atlas suite,atl"), (2, 1, "Core", 1, "core"), (3, 2, "Beacon", 0, "beacon,the bcn"), (4, 2, "Delta", 1, ""), (5, 3, "Echo", 1, "echo,ECHO,eko")]
    return " UNION ALL ".join(f"SELECT CAST({a} AS INT) AS product_id, CAST({b} AS INT) AS source_id, '{n}' AS name, CAST({f} AS INT) AS is_default, '{al}' AS aliases" for a, b, n, f, al in rows)


def registry(d) -> str:
    """A rule for every page, of the stored forms in turn."""
    return f"""
SELECT CAST(p.page_id AS INT) AS rule_id, r.slug || '_' || p.page_id AS slug, r.rule_type, r.category, r.correct_value, r.stale_patterns, r.current_patterns, r.allowed_patterns, r.required_context,
  r.context_window, r.severity, r.english_only, r.enabled, CASE WHEN r.product_id IS NULL THEN NULL ELSE CAST(p.page_id % 50 AS INT) END AS product_id
FROM {d.t('pages')} p JOIN ({rules(d)}) r ON r.rule_id = p.page_id % 8 + 1"""


def catalog(d) -> str:
    """A product for every page; names and aliases repeat in other cases."""
    return f"""
SELECT CAST(page_id AS INT) AS product_id, CAST(page_id % 3 + 1 AS INT) AS source_id, CASE page_id % 2 WHEN 0 THEN 'Atlas ' || (page_id % 40) ELSE 'Beacon ' || page_id END AS name,
  CAST(CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS INT) AS is_default, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'atlas ' || (page_id % 40) || ',al' || page_id || ',' || regexp_extract(url, '://([^/?#]+)', 1) END AS aliases
FROM {d.t('pages')}"""


def matches(d) -> str:
    return f"""
SELECT CAST(doc_id % 8 + 1 AS INT) AS rule_id, doc_id AS url_id, CAST(0 AS BIGINT) AS external_page_id,
  CASE WHEN toxic = 1 THEN 'unclear' WHEN quality = 1 THEN 'positive' ELSE 'issue' END AS verdict,
  CASE WHEN doc_id % 8 = 4 THEN substr(text, 31, 12) ELSE 'value ' || (doc_id % 23) END AS matched_value, {_evidence(d)} AS evidence, doc_id AS write_seq FROM {d.t('labels')} JOIN {d.t('documents')} USING (doc_id)"""


def _evidence(d) -> str:
    """What a finding quotes: the text's middle up to 400 characters on, so that some need trimming; none for a sixth."""
    return f"CASE WHEN doc_id % 6 = 0 THEN NULL ELSE trim({d.rx_all(f"substr(text, {d.div('length(text)', 2)} + 1, CASE WHEN doc_id % 5 = 1 THEN 400 ELSE 70 END)", '[ \\t\\n\\r\\f\\x0B]+', ' ')}) END"


def issues(d) -> str:
    """Findings with titles of every form, odd severities, all statuses, soft deletes and true duplicates."""
    one = f"""
SELECT doc_id + {{add}} AS issue_id, CAST((doc_id - doc_id % 4) % 3 + 1 AS INT) AS source_id, doc_id - doc_id % 4 AS url_id,
  '2024-0' || (1 + (doc_id * 7 + {{age}}) % 9) || '-1' || (doc_id % 10) || 'T00:00:00+00:00' AS detected_at,
  {_PICK.format(k="doc_id % 10")} AS category,
  CASE doc_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'notice' END AS severity,
  CASE doc_id % 7 WHEN 0 THEN 'llm:a:{{tail}}' || doc_id WHEN 1 THEN 'lang_ctx:m' || (doc_id % 3) || ':' || (doc_id % 40) WHEN 2 THEN 'reg_ctx:m' || (doc_id % 2) || ':9'
    WHEN 3 THEN 'of_the:stale' WHEN 4 THEN 'fact:' || (doc_id % 11) || ' {{tail}}' WHEN 5 THEN 'licence:inconsistent' ELSE 'plain title' END AS title,
  'detail ' || (doc_id % 31) AS detail, {_evidence(d)} AS evidence,
  'expected ' || (doc_id % 3) AS expected, CASE WHEN doc_id % 4 = 1 THEN doc_id - 1 ELSE 0 END AS related_url_id,
  CASE doc_id % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'inventory' ELSE 'llm_screen' END AS detection_method,
  CASE {{st}} % 6 WHEN 0 THEN 'open' WHEN 1 THEN 'fixed' WHEN 2 THEN 'open' WHEN 3 THEN 'ignored' WHEN 4 THEN 'false_positive' ELSE 'unclear' END AS status,
  CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 5 + 1 AS INT) END AS product_id, CASE WHEN doc_id % 8 = 3 THEN 'mv' || (doc_id % 5) END AS matched_value,
  CASE WHEN doc_id % 13 = 0 THEN '2024-10-01T00:00:00+00:00' END AS deleted_at, CASE WHEN doc_id % 10 = 2 THEN 'note ' || doc_id END AS note,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE '2024-0' || (1 + (doc_id + {{age}}) % 9) || '-28T00:00:00+00:00' END AS last_checked_at
FROM {d.t('documents')}"""
    return one.format(add=0, age=0, tail="x", st="doc_id") + " UNION ALL " + one.format(add=1000000000, age=3, tail="y", st="(doc_id + 2)") + " WHERE doc_id % 5 = 0"


def external(d) -> str:
    return f"""
SELECT page_id AS finding_id, CAST(page_id % 3 + 1 AS INT) AS source_id, CASE page_id % 3 WHEN 0 THEN 'factcheck' WHEN 1 THEN 'factcheck' ELSE 'mention' END AS kind,
  url AS external_url, CASE WHEN page_id % 10 = 9 THEN NULL ELSE regexp_extract(url, '://([^/?#]+)', 1) END AS domain, 'snippet ' || page_id AS snippet,
  CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'mismatch' WHEN 2 THEN 'matches' ELSE 'unclear' END AS verdict, 'expected' AS expected,
  CASE page_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'fixed' ELSE 'open' END AS status, CASE page_id % 2 WHEN 0 THEN 'high' ELSE 'low' END AS severity,
  CASE WHEN page_id % 12 = 0 THEN '2024-10-01' END AS deleted_at, CASE page_id % 5 WHEN 0 THEN 'stale_fact' WHEN 1 THEN 'misquote' END AS finding_type,
  CASE WHEN page_id % 6 <> 1 THEN 'reason, "' || page_id || '"' END AS reason, '2024-0' || (1 + page_id % 9) || '-11T00:00:00+00:00' AS created_at FROM {d.t('pages')}"""


def faqs(d) -> str:
    return f"""
SELECT u.conv_id * 100 + u.turn AS faq_id, u.conv_id AS url_id, u.text AS question, a.text AS answer, CASE u.turn % 2 WHEN 0 THEN 'visible' ELSE 'jsonld' END AS source
FROM {d.t('conversations')} u JOIN {d.t('conversations')} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"""


def jobs(d) -> str:
    return f"""
SELECT user_id * 100 + day AS job_id, CAST(user_id % 4 + 1 AS INT) AS source_id, CASE user_id % 3 WHEN 0 THEN 'sync' WHEN 1 THEN 'crawl' ELSE 'facts' END AS job_type,
  CASE n % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'done' WHEN 2 THEN 'error' ELSE 'done' END AS status, n AS total, clicks AS progress, {d.ts('lo')} AS started_at,
  CASE WHEN n % 4 = 0 THEN NULL ELSE {d.ts('hi')} END AS finished_at
FROM (SELECT user_id, CAST(extract(day FROM ts) AS INT) AS day, count(*) AS n, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, date_trunc('second', min(ts)) AS lo, date_trunc('second', max(ts)) AS hi
  FROM {d.t('events')} GROUP BY user_id, CAST(extract(day FROM ts) AS INT)) e"""


def responses(d) -> str:
    """Review responses to each document, of the first and second review and about features: quotes verbatim or altered, some fenced, confidences low or missing."""
    plain = d.rx_all(d.rx_all("text", "[^A-Za-z0-9 ,.]", " "), "[ ]+", " ")
    quote = f"trim(substr(trim({plain}), {d.div('length(text)', 3)} + 1, 40 + doc_id % 200))"
    said = f"CASE WHEN doc_id % 4 = 3 THEN 'never said ' ELSE '' END || CASE WHEN doc_id % 10 = 1 THEN {quote} || ' free trial' ELSE {quote} END"
    level = "CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END"
    return f"""
SELECT doc_id AS url_id, CASE WHEN doc_id % 3 = 0 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN doc_id % 3 = 1 THEN 'Here: ' || j || ' done' ELSE j END AS raw, j AS plain, first, features, body FROM (
SELECT doc_id, trim({plain}) || CASE WHEN doc_id % 10 = 1 THEN ' ' || {quote} || ' free trial' ELSE '' END AS body,
  '{{"claims":[{{"quote":"' || CASE WHEN doc_id % 8 = 6 THEN '' ELSE 'x' END || '"' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE ',"confidence":' || CAST(CAST((doc_id % 100) / 100.0 AS DECIMAL(4, 2)) AS STRING) END || '}}]}}' AS first,
  '{{"claims":[{{"quote":"' || {said} || '"' || CASE doc_id % 6 WHEN 5 THEN '' WHEN 4 THEN ',"problem":"not_available"' ELSE ',"problem":"overstated"' END || ',"severity":"' || {level} || '","feature_id":"f' || (doc_id % 400) || '"}}]}}' AS features,
  '{{"items":[{{"quote":"' || {said} || '","is_real_issue":' || CASE WHEN doc_id % 6 = 5 THEN 'false' ELSE 'true' END
  || ',"category":"' || CASE doc_id % 5 WHEN 0 THEN 'language_count' WHEN 1 THEN 'free_claim' WHEN 2 THEN 'nonsense' ELSE 'positioning' END || '"' || CASE WHEN doc_id % 11 = 4 THEN '' ELSE ',"severity":"' || {level} || '"' END || '}}]}}' AS j
FROM {d.t('documents')}) r"""


def faq_responses(d) -> str:
    """A review response to each question and answer; the quote is the answer's inside, altered for a quarter."""
    quote = f"trim({d.rx_all('substr(answer, 3, 60)', '[^A-Za-z0-9 ,.]', '')})"
    return f"""
SELECT url_id, '{{"items":[{{"quote":"' || CASE WHEN faq_id % 4 = 3 THEN 'never ' ELSE '' END || {quote} || '"' || CASE faq_id % 3 WHEN 0 THEN ',"severity":"low"' WHEN 1 THEN ',"severity":"high"' ELSE '' END
  || CASE WHEN faq_id % 5 = 0 THEN ',"question":""' WHEN faq_id % 5 = 1 THEN '' ELSE ',"question":"' || trim({d.rx_all('substr(question, 1, 50)', '[^A-Za-z0-9 ,.]', '')}) || '"' END || CASE WHEN faq_id % 2 = 0 THEN ',"underlying_category":"free_claim"' ELSE '' END || '}}]}}' AS raw
FROM ({faqs(d)}) f"""


def external_pages(d) -> str:
    return f"SELECT page_id, CAST(page_id % 3 + 1 AS INT) AS source_id, url FROM {d.t('pages')}"


def snippets(d) -> str:
    return f"SELECT page_id * 10 + k AS snippet_id, page_id, CAST(page_id % 3 + 1 AS INT) AS source_id FROM {d.t('pages')} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) n WHERE page_id % 4 <> k"


def queries(d) -> str:
    return f"SELECT doc_id AS query_id, CAST(doc_id % 4 AS INT) AS source_id, 'query ' || source AS query_text FROM {d.t('documents')} WHERE doc_id % 9 = 4"


def profiles(d) -> str:
    return f"SELECT CAST(source_id AS INT) AS source_id, min(url_id) AS profile_id FROM ({urls(d)}) u GROUP BY source_id"


def schedules(d) -> str:
    return f"SELECT user_id AS schedule_id, CAST(user_id % 4 + 1 AS INT) AS source_id, count(*) AS runs FROM {d.t('events')} GROUP BY user_id"


def candidates(d) -> str:
    """External pages as they are found, some not approved yet."""
    return f"SELECT page_id, CAST(page_id % 3 + 1 AS INT) AS source_id, CASE page_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'candidate' END AS fetch_status FROM {d.t('pages')}"


def saved_filters(d) -> str:
    """A saved filter for every tenth document; parts of its model are columns, the model itself is JSON."""
    return f"""
SELECT *, '{{"scopes":{{}},"groups":[{{"mode":"any","field":"category","values":["' || cat || '","free_claim"]}},{{"mode":"none","field":"severity","values":["' || sev || '"]}},{{"mode":"any","field":"url","values":["p' || frag || '"]}},'
  || '{{"mode":"all","field":"unknown","values":["x"]}},{{"mode":"all","field":"detected_at","values":["2024-02|2024-08"]}}]}}' AS model
FROM (SELECT doc_id AS filter_id, CAST(doc_id % 3 + 1 AS INT) AS source_id, CASE WHEN doc_id % 20 = 0 THEN 'findings' ELSE 'crawl' END AS context, 'filter ' || (doc_id % 70) AS name,
  {_PICK.format(k=f"({d.div('doc_id', 10)}) % 10")} AS cat, CASE doc_id % 4 WHEN 0 THEN 'critical' ELSE 'low' END AS sev, CAST({d.div('doc_id', 10)} % 10 AS STRING) AS frag
  FROM {d.t('documents')} WHERE doc_id % 10 = 0) f"""
