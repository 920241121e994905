"""Detectors over page texts: stale facts, claims, contexts, and verdicts from review responses."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factflow.functions.categories import at_least_medium
from factflow.functions.text import context_snippet, context_window, cut, let, regex_matches, staged, with_evidence, with_term_context
from factflow.operators.patterns import holds, pattern_matches
from factflow.operators.postings import Index, search_many
from factflow.sources.folders import checkpointed, written

# Generic numeric claims.
GENERIC = {
    "million/M": r"\b\d[\d.,]*\+?\s*(?:million|billion|M|B)\b",
    "count": r"\b\d[\d.,]*\+?\s*(?:companies|customers|users|organi[sz]ations|clients)\b",
    "percent": r"\b\d[\d.,]*\s*%",
    "price": r"[$€£]\s?\d[\d.,]*",
}
# Categories a review may name, and the wording of free offers.
REVIEW_CATEGORIES = ("database_size", "positioning", "free_claim", "language_count", "region_count", "regulation_count", "feature_claim", "other_mismatch")
TRIAL = r"(?i)free trial|\btrial\b"
FREE = r"(?i)free (?:plan|version|option|tier|forever|account|subscription|edition)|forever free|\bfor free\b|free of charge|free to use|completely free|100% free"


@dataclass(frozen=True)
class Rule:
    """A stale-fact rule. Patterns are regular expressions, case-insensitive; required and allowed ones are looked for in the context."""

    rule_id: int
    slug: str
    stale: Sequence[str]
    current: Sequence[str] = ()
    allowed: Sequence[str] = ()
    required: Sequence[str] = ()
    window: int = 120
    english_only: bool = False
    category: str = "other_mismatch"
    severity: str = "medium"


def _any(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def passes_context(segment: Column, rule: Rule) -> Column:
    ok = _any(segment, rule.required) if rule.required else F.lit(True)
    return ok & ~_any(segment, rule.allowed) if rule.allowed else ok


Rules = DataFrame | Sequence[Rule]
RULE_COLUMNS = "rule_id int, slug string, category string, severity string, english_only boolean, context_window int, stale_patterns array<string>, current_patterns array<string>, required_context array<string>, allowed_patterns array<string>"


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """Rules with the columns of ``RULE_COLUMNS``: a loaded registry, or rules written out in a program."""
    if isinstance(rules, DataFrame):
        return rules.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in RULE_COLUMNS.split(", ")])
    rows = [(r.rule_id, r.slug, r.category, r.severity, r.english_only, r.window, list(r.stale), list(r.current), list(r.required), list(r.allowed)) for r in rules]
    return spark.createDataFrame(rows, RULE_COLUMNS)


def stale_scan(bodies: DataFrame, rules: Rules, proof: bool = False) -> DataFrame:
    """The first passing hit of each rule on each page: (rule_id, slug, category, severity, url_id, verdict, start, end, value, evidence).

    Stale patterns come before current ones, patterns in their order, then offsets. Pages
    are read once for all patterns, whatever their number; a page then meets only the rules
    whose pattern it holds, in a join on the pattern that is as small as the rule table.
    Hits bring the text around them along, the whole text only if ``proof`` (the sentence
    that holds the hit) is wanted.
    """
    table = rule_table(bodies.sparkSession, rules)
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("required_context", "allowed_patterns")}
    kinds = [table.withColumns(lists).select("*", F.lit(k).alias("kind"), F.posexplode(c).alias("place", "pattern")).drop("stale_patterns", "current_patterns") for k, c in enumerate(("stale_patterns", "current_patterns"))]
    wanted = kinds[0].unionByName(kinds[1])
    met = pattern_matches(bodies.select("url_id", "locale", "body_text"), wanted.select("pattern", F.col("context_window").alias("reach")), carried=proof)
    rows = met.join(wanted, "pattern")
    rows = rows.where(~F.coalesce("english_only", F.lit(False)) | F.col("locale").isNull() | (F.col("locale") == "en"))

    def passes(m: Column) -> Column:
        begin = F.greatest(m["start"] - F.col("context_window"), F.lit(0)) - m["seg_start"]
        near = cut(m["seg"], begin, m["end"] + F.col("context_window") - m["seg_start"])
        return let(near, lambda seg: ((F.size("required_context") == 0) | holds(seg, F.col("required_context"))) & ~holds(seg, F.col("allowed_patterns")))

    free = (F.size("required_context") == 0) & (F.size("allowed_patterns") == 0)
    hit = F.when(free, F.get("matches", F.lit(0))).otherwise(F.get(F.filter("matches", passes), F.lit(0)))
    rows = staged(rows, _hit=hit).drop("matches").where("_hit IS NOT NULL")
    if proof:
        rows = with_evidence(rows, "body_text", F.col("_hit.start"), F.col("_hit.end"))
    else:
        rows = rows.withColumn("evidence", F.lit(None).cast("string"))
    found = F.struct("kind", "place", "_hit.start", "_hit.end", "_hit.value", "evidence")
    best = rows.groupBy("rule_id", "slug", "category", "severity", "url_id").agg(F.min(found).alias("h"))
    verdict = F.when(F.col("h.kind") == 0, "issue").otherwise("positive")
    return best.select("rule_id", "slug", F.coalesce("category", F.lit("other_mismatch")).alias("category"), "severity", "url_id", verdict.alias("verdict"), "h.start", "h.end", "h.value", "h.evidence")


def findings_of(hits: DataFrame) -> DataFrame:
    """Stale facts, scanned with their proof, as findings."""
    return hits.withColumn("title", F.concat("slug", F.lit(":stale"))).withColumnRenamed("value", "matched_value")


def claims(bodies: DataFrame, patterns: Mapping[str, Sequence[tuple[str, int]]]) -> DataFrame:
    """Every match of every kind's patterns: (url_id, kind, pattern, start, end, value, quote). Two patterns on one text count twice."""
    def named(kind: str, place: int, pattern: str, group: int) -> Column:
        def of(m: Column) -> Column:
            value = F.regexp_replace(F.trim(m["value"]), "[.,]$", "")
            return F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("pattern"), m["start"].alias("start"), m["end"].alias("end"), value.alias("value"), cut(F.col("body_text"), m["start"], m["end"]).alias("quote"))

        # Most texts have none: a plain match is far cheaper than taking the text apart.
        none = F.array().cast("array<struct<kind:string,pattern:int,start:int,end:int,value:string,quote:string>>")
        return F.when(F.col("body_text").rlike(pattern), F.transform(regex_matches(F.col("body_text"), pattern, group), of)).otherwise(none)

    every = [named(kind, k, p, group) for kind, some in patterns.items() for k, (p, group) in enumerate(some)]
    return bodies.select("url_id", F.explode(F.concat(*every)).alias("m")).select("url_id", "m.*")


def inventory(found: DataFrame) -> DataFrame:
    """Per kind and value: occurrences, pages, and the first page by id with its first quote."""
    first = F.min(F.struct("url_id", "pattern", "start", "quote"))
    return found.groupBy("kind", "value").agg(F.count("*").alias("frequency"), F.count_distinct("url_id").alias("pages"), F.min("url_id").alias("example_url_id"), first["quote"].alias("example_quote"))


def consistency(found: DataFrame, canonical: DataFrame) -> DataFrame:
    """(kind, url_id, value, verdict) against canonical values, compared as strings.

    Each value of a page counts once. Of several, the one that was first seen last on the
    whole site wins, as the last write. The texts are matched once: what is kept of the
    matches is small and cut from them.
    """
    seen = checkpointed(found.join(canonical, "kind").groupBy("kind", "value", "url_id", "canonical").agg(F.min(F.struct("pattern", "start")).alias("at")))
    rank = seen.groupBy("kind", "value").agg(F.min(F.struct("url_id", "at")).alias("first_seen"))
    last = seen.join(rank, ["kind", "value"]).groupBy("kind", "url_id", "canonical").agg(F.max_by("value", "first_seen").alias("value"))
    return last.select("kind", "url_id", "value", F.when(F.col("value") == F.col("canonical"), "positive").otherwise("issue").alias("verdict"))


def consistency_findings(verdicts: DataFrame) -> DataFrame:
    """(url_id, title, severity, status, matched_value) of values that are not the canonical one."""
    return verdicts.where("verdict = 'issue'").select("url_id", F.concat("kind", F.lit(":inconsistent")).alias("title"), F.lit("high").alias("severity"), F.lit("open").alias("status"), F.col("value").alias("matched_value"))


def count_findings(verdicts: DataFrame, prefix: str) -> DataFrame:
    """(url_id, title, severity, status, matched_value) of judged numbers: wrong ones by the context that judged them, undecided ones to be looked at."""
    unclear = F.col("verdict") == "unclear"
    title = F.when(unclear, F.concat(F.lit(f"{prefix}_unclear:"), "number")).otherwise(F.concat(F.lit(f"{prefix}_ctx:"), "method", F.lit(":"), "number"))
    rows = verdicts.where("verdict <> 'positive'").select("url_id", title.alias("title"), F.when(unclear, "medium").otherwise("high").alias("severity"), F.when(unclear, "unclear").otherwise("open").alias("status"), F.col("number").alias("matched_value"))
    return rows.distinct()  # one finding a page and title


# Claims that a list which can grow is closed.
CLOSED = r"(?i)(?:fixed|hard[\s-]?coded|pre[\s-]?defined|cannot (?:add|be added)|no (?:new )?regulations? can be added)\b[^.]{0,40}regulation"


def forbidden(bodies: DataFrame, context: str, pattern: str = CLOSED, radius: int = 160) -> DataFrame:
    """(url_id, start, matched_value) of forbidden claims with the context around them."""
    m = bodies.where(F.col("body_text").rlike(pattern)).select("url_id", "body_text", F.explode(regex_matches(F.col("body_text"), pattern)).alias("m"))
    near = context_window(F.col("body_text"), F.col("m.start"), F.col("m.end"), radius).rlike(context)
    return m.where(near).select("url_id", "m.start", F.col("m.value").alias("matched_value"))


def context_counts(bodies: DataFrame, pattern: str, group: int, contexts: Sequence[tuple[str, str, str, str]], radius: int = 160) -> DataFrame:
    """Numbers judged by the words around them: (url_id, start, number, method, verdict).

    ``contexts`` holds (method, required, forbidden, expected) in order, empty patterns asking
    for nothing; without a fitting one the verdict is unclear. Numbers compare as strings.
    """
    m = bodies.where(F.col("body_text").rlike(pattern)).select("url_id", "body_text", F.explode(regex_matches(F.col("body_text"), pattern, group)).alias("m"))
    m = m.select("url_id", "m.start", F.col("m.value").alias("number"), context_window(F.col("body_text"), F.col("m.start"), F.col("m.end"), radius).alias("seg"))
    method = expected = None
    for name, need, ban, want in contexts:
        ok = (F.col("seg").rlike(need) if need else F.lit(True)) & (~F.col("seg").rlike(ban) if ban else F.lit(True))
        method = F.when(ok, name) if method is None else method.when(ok, name)
        expected = F.when(ok, want) if expected is None else expected.when(ok, want)
    m = m.withColumn("method", method).withColumn("expected", expected)
    verdict = F.when(F.col("method").isNull(), "unclear").when(F.col("number") == F.col("expected"), "positive").otherwise("issue")
    return m.select("url_id", "start", "number", "method", verdict.alias("verdict"))


def response_json(raw: Column) -> Column:
    """The JSON in a response: what a code fence holds, else from the first bracket to the last."""
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)
    sliced = F.regexp_extract(raw, r"(?s)([\[{].*[\]}])", 1)
    return F.when(raw.rlike(r"(?is)```(?:json)?\s*(.*?)```"), F.trim(fenced)).otherwise(sliced)


ITEMS = "struct<items:array<struct<quote:string,is_real_issue:boolean,category:string,severity:string,question:string,underlying_category:string>>>"
CLAIMS = "struct<claims:array<struct<quote:string,confidence:double,problem:string,severity:string,feature_id:string>>>"


def response_rows(responses: DataFrame, field: str, schema: str) -> DataFrame:
    """(url_id and the fields of each entry, and body_text where responses have it) of JSON responses; entries without a quote and broken responses give none."""
    entries, own = F.from_json(response_json(F.col("raw")), schema)[field], [c for c in ("url_id", "body_text") if c in responses.columns]
    return responses.select(*own, F.explode(entries).alias("i")).select(*own, "i.*").where("coalesce(quote, '') <> ''")


def screened(responses: DataFrame) -> DataFrame:
    """Pages on which the first, cheap review saw a claim with a confidence of 0.4 or more."""
    return response_rows(responses, "claims", CLAIMS).where("coalesce(confidence, 0) >= 0.4").select("url_id").distinct()


def _verbatim(items: DataFrame, bodies: DataFrame | None) -> DataFrame:
    """Items whose quote stands word for word on their page; without ``bodies`` they have the page's text with them.

    The null check keeps the planner from a filter on the text alone, which would make it twice.
    """
    rows = items if bodies is None else items.join(bodies.select("url_id", "body_text"), "url_id")
    return rows.where(F.instr(F.coalesce("body_text", F.lit("")), F.col("quote")) > 0)


def reviewed(responses: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """Findings of the second review: real, with a quote that stands word for word on the page, in a known category; free trials are no free claim.

    Texts come from ``bodies`` (url_id, body_text), or with the responses (url_id, raw, body_text), which needs no shuffle.
    """
    items = response_rows(responses, "items", ITEMS).where("is_real_issue")
    category = F.when(F.col("category").isin(*REVIEW_CATEGORIES), F.col("category")).otherwise("other_mismatch")
    items = _verbatim(items.withColumn("category", category), bodies)
    items = items.where(~((F.col("category") == "free_claim") & F.col("quote").rlike(TRIAL) & ~F.col("quote").rlike(FREE)))
    title = F.concat(F.lit("llm:"), "category", F.lit(":"), F.left(F.sha2(F.col("quote").cast("binary"), 256), F.lit(12)))
    return items.select("url_id", "category", F.coalesce("severity", F.lit("medium")).alias("severity"), title.alias("title"), F.col("quote").alias("matched_value"))


def feature_findings(responses: DataFrame, bodies: DataFrame | None, features: DataFrame) -> DataFrame:
    """Findings about features, named by the feature table; an id that it lacks becomes ``?``. Texts as in ``reviewed``."""
    known = features.select(F.col("feature_id"), F.lit(True).alias("known")).distinct()
    items = _verbatim(response_rows(responses, "claims", CLAIMS), bodies).join(known, "feature_id", "left")
    problem = F.coalesce("problem", F.lit("misdescription"))
    severity = F.when((problem == "not_available") | (F.col("severity") == "high"), "high").otherwise("medium")
    title = F.concat(F.lit("feature:"), F.when(F.col("known"), F.col("feature_id")).otherwise("?"), F.lit(":"), problem)
    return items.select("url_id", title.alias("title"), severity.alias("severity"), F.col("quote").alias("matched_value"))


def faq_findings(responses: DataFrame, faqs: DataFrame) -> DataFrame:
    """Findings about answers: the quote stands in the page's answers; severity is medium at least."""
    answers = faqs.groupBy("url_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("faq_id", F.coalesce("answer", F.lit("")).alias("a")))), lambda x: x["a"]), " ").alias("body_text"))
    items = _verbatim(response_rows(responses, "items", ITEMS), answers)
    asked = F.when(F.coalesce("question", F.lit("")) != "", F.col("question")).otherwise(F.col("quote"))
    title = F.concat(F.lit("faq:"), F.coalesce("underlying_category", F.lit("other_mismatch")), F.lit(":"), F.left(asked, F.lit(32)))
    return items.select("url_id", title.alias("title"), at_least_medium(F.coalesce("severity", F.lit("medium"))).alias("severity"), F.col("quote").alias("matched_value"))


def cheap_classify(text: Column, correct: str, stale: Sequence[str], allowed: Sequence[str]) -> Column:
    """mismatch, matches, or null where words alone do not decide."""
    low = F.lower(text)

    def holds(words: Sequence[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w.lower())
        return out

    has_stale, has_allowed = holds(stale), holds(allowed)
    right = low.contains(correct.lower()) if correct else F.lit(False)
    return F.when(has_stale & ~has_allowed, "mismatch").when(has_allowed & ~has_stale & (right | F.lit(not correct)), "matches").when(right & ~has_stale, "matches")


def with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """``rows`` (url_id, verdict) with a reviewer's answer where words did not decide, and unclear where there is none."""
    return rows.join(answers, "url_id", "left").withColumn("verdict", F.coalesce("verdict", "answer", F.lit("unclear"))).drop("answer")


def fact_findings(rows: DataFrame, name: str, correct: str, category: str, severity: str, prefix: str = "fact") -> DataFrame:
    """Findings of pages that contradict a fact."""
    value = F.lit(correct or None).cast("string")
    title = F.lit(f"{prefix}:{name[:48]}")
    return rows.where("verdict = 'mismatch'").select("url_id", title.alias("title"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), value.alias("expected"), value.alias("matched_value"))


def query_rules(index: Index, bodies: DataFrame, rules: DataFrame, answers: DataFrame, k: int = 200) -> DataFrame:
    """Verdicts of saved query rules on the best pages of every scope: (rule_id, slug, category, severity, product_id, scope, url_id, verdict, matched_value, evidence).

    All rules (rule_id, slug, category, severity, correct_value, product_id, search_terms)
    are searched in one pass, by their terms or, without any, their name; the ``k`` best
    pages a rule and scope are asked about. ``answers`` are a reviewer's by rule and page:
    mismatch becomes issue, matches positive, none unclear, and unrelated pages are
    dropped. Evidence is the sentence of the first term, or how the text begins if no term
    stands in it literally. Texts meet their hits after the k best are known.
    """
    terms = F.when(F.size("search_terms") > 0, F.col("search_terms")).otherwise(F.array("slug"))
    wanted = rules.select("rule_id", "slug", F.coalesce("category", F.lit("other_mismatch")).alias("category"), "severity", "product_id", "correct_value", terms.alias("terms"))
    best = search_many(index, wanted.select(F.col("rule_id").alias("search_id"), "terms"), k)
    met = best.select(F.col("search_id").alias("rule_id"), "scope", "url_id").join(wanted, "rule_id")
    judged = written(met.join(answers, ["rule_id", "url_id"], "left").where("coalesce(answer, '') <> 'unrelated'"))  # few rows, so that texts need no shuffle
    verdict = F.when(F.col("answer") == "mismatch", "issue").when(F.col("answer") == "matches", "positive").otherwise("unclear")
    shown = with_term_context(judged.join(bodies.select("url_id", "body_text"), "url_id"), "body_text", F.col("terms"))
    evidence = F.regexp_replace(F.coalesce("snippet", F.left("body_text", F.lit(240))), "</?mark>", "")
    value = F.when(F.col("answer").isNotNull() & (F.col("answer") != "unclear"), F.col("correct_value"))
    return shown.select("rule_id", "slug", "category", "severity", "product_id", "scope", "url_id", verdict.alias("verdict"), value.alias("matched_value"), evidence.alias("evidence"))


def query_rule_findings(verdicts: DataFrame) -> DataFrame:
    """(scope, url_id, title, category, severity, expected, product_id, evidence) of pages that contradict a saved rule."""
    return verdicts.where("verdict = 'issue'").select("scope", "url_id", F.concat(F.lit("rule:"), "slug").alias("title"), "category", "severity", F.col("matched_value").alias("expected"), "product_id", "evidence")


# What a reviewer writes for no value.
NO_VALUE = ("", "null", "none", "n/a", "unknown")


def interpreted(facts: DataFrame, column: str, products: DataFrame) -> DataFrame:
    """A read fact, cleaned: category, correct_value, terms (the text where there are none), vague, product_id.

    The product is one whose name or alias the text holds, a special one before the
    default, longer aliases first. The product table is small and becomes one constant row.
    """
    f = lambda c: F.col(f"{column}.{c}")
    value = F.trim(f("correct_value"))
    correct = F.when(~F.lower(value).isin(*NO_VALUE), value)
    terms = F.filter(F.transform(f("terms"), lambda x: F.trim(x)), lambda x: x != "")
    names = products.select("product_id", "is_default", F.explode(F.split(F.lower(F.concat_ws(",", "name", "aliases")), ",")).alias("a")).where("a <> ''")
    ranked = names.agg(F.sort_array(F.collect_list(F.struct("is_default", (-F.char_length("a")).alias("n"), "product_id", "a"))).alias("_names"))
    out = staged(facts, _text=F.lower(f("text"))).join(F.broadcast(ranked))
    product = F.get(F.filter("_names", lambda p: F.contains(F.col("_text"), p["a"])), F.lit(0))["product_id"]
    category = F.when(f("category").isin(*REVIEW_CATEGORIES), f("category")).otherwise("other_mismatch")
    out = out.withColumns({"category": category, "correct_value": correct, "terms": F.when(F.size(terms) > 0, terms).otherwise(F.array(f("text"))), "vague": correct.isNull(), "product_id": product})
    return out.drop("_text", "_names")


def stale_findings(bodies: DataFrame, rules: Rules) -> DataFrame:
    """Findings of stale facts with the sentence that proves them."""
    return findings_of(stale_scan(bodies, rules, proof=True).where("verdict = 'issue'")).select("url_id", "title", "category", "severity", "matched_value", "evidence")


def finding_context(findings: DataFrame, bodies: DataFrame, radius: int = 400) -> DataFrame:
    """``findings`` (issue_id, url_id, matched_value, evidence) with the text around them and what was found there.

    Looked for on the page are the matched value, then the first 60 characters of the
    evidence without its ellipses. Where neither stands there, the context is the evidence;
    without a page text there is none.
    """
    needle = F.trim(F.coalesce("matched_value", F.lit("")))
    probe = F.left(F.trim(F.regexp_replace(F.coalesce("evidence", F.lit("")), "^…+|…+$", "")), F.lit(60))
    rows = findings.join(bodies.select("url_id", F.col("body_text").alias("_b")), "url_id", "left")
    rows = staged(rows, _needle=needle, _probe=probe)
    rows = staged(rows, _m=F.when(F.col("_needle") != "", F.instr("_b", F.col("_needle"))).otherwise(0), _e=F.when(F.col("_probe") != "", F.instr("_b", F.col("_probe"))).otherwise(0))
    valued = F.col("_m") > 0
    rows = staged(rows, _at=F.when(valued, F.col("_m")).otherwise(F.col("_e")) - 1, _n=F.char_length(F.when(valued, F.col("_needle")).otherwise(F.col("_probe"))))
    near = context_snippet(F.col("_b"), F.col("_at"), F.col("_at") + F.col("_n"), radius)
    context = F.when(F.col("_b").isNull(), None).when(F.col("_at") < 0, F.col("evidence")).otherwise(near)
    matched = F.when(valued, F.col("_needle")).when(F.col("_e") > 0, F.col("_probe"))
    return rows.select(*findings.columns, context.alias("context"), matched.alias("matched"))


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
