"""A site's sync as a stream: raw pages in, the verdicts and findings of all detectors out.

Each micro-batch parses the pages that arrive and runs the detectors that look at one page
at a time. What they find are small rows; texts are written once, by batch, and never
read again by later batches. The state is one row a page (its newest version) and the rows
found on it, in buckets by page, written as version k by batch k from version k - 1: a
batch that is tried again writes the same, reads one version, however many ran before, and
shuffles its own rows only.

Verdicts that depend on the whole site (which value was seen first, which detector wrote
last) are drawn from the state's rows when a run ends, and so is what became fixed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.functions.text import normalize
from factflow.operators import detect as K
from factflow.operators import pages as B
from factflow.operators.snapshots import latest
from factflow.operators.state import merge_findings
from factflow.operators.stored import Stored

RAW = "url_id long, locale string, html string, version long"
PAGES = "url_id long, version long"
FOUND = "url_id long, detector string, rule_id int, name string, verdict string, value string, place int, start int, method string, category string, severity string, evidence string"
FINDINGS = (
    "url_id long, category string, title string, related_url_id long, severity string, detail string, evidence string, expected string, matched_value string, "
    "detection_method string, detected_at string, status string, last_checked_at string, deleted_at string"
)
#: The order in which detectors write: of two verdicts on one rule and page the later one counts.
STALE, CONSISTENCY, COUNTS, FORBIDDEN = range(4)


@dataclass(frozen=True)
class Counts:
    """Numbers that are judged by the words around them; contexts as ``context_counts`` takes them."""

    rule_id: int
    prefix: str
    category: str
    pattern: str
    group: int
    contexts: Sequence[tuple[str, str, str, str]]


@dataclass(frozen=True)
class Detectors:
    """``canonical`` has (kind, rule_id, canonical, category) of claims that must agree on the whole site; ``forbidden`` (title, category, context)."""

    rules: K.Rules
    claims: Mapping[str, Sequence[tuple[str, int]]]
    canonical: DataFrame
    counts: Sequence[Counts] = ()
    forbidden: Sequence[tuple[str, str, str]] = ()


def _rows(df: DataFrame, detector: str, **columns) -> DataFrame:
    """In the columns of ``FOUND``, null where a detector has none."""
    own = {"detector": F.lit(detector), **columns}
    fields = [f.split() for f in FOUND.split(", ")]
    return df.select(*[(own[n] if n in own else F.col(n) if n in df.columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields])


def looked_at(pages: DataFrame, detectors: Detectors) -> DataFrame:
    """What the detectors find on pages (url_id, locale, body_text), each page by itself."""
    out = _rows(K.stale_scan(pages, detectors.rules, proof=True), "stale", name=F.col("slug"))
    if detectors.claims:
        out = out.unionByName(_rows(K.claims(pages, detectors.claims), "claim", name=F.col("kind"), place=F.col("pattern")))
    for c in detectors.counts:
        out = out.unionByName(_rows(K.context_counts(pages, c.pattern, c.group, c.contexts), "count", rule_id=F.lit(c.rule_id), name=F.lit(c.prefix), value=F.col("number"), category=F.lit(c.category)))
    for title, category, context in detectors.forbidden:
        out = out.unionByName(_rows(K.forbidden(pages, context), "forbidden", name=F.lit(title), verdict=F.lit("issue"), value=F.col("matched_value"), category=F.lit(category), severity=F.lit("high")))
    return out


#: Buckets of the state; see ``Stored``.
BUCKETS = 16


def _tables(state: str, buckets: int) -> tuple[Stored, Stored]:
    return Stored(f"{state}/pages", PAGES, ["url_id"], buckets), Stored(f"{state}/found", FOUND, ["url_id"], buckets)


def ingest(spark: SparkSession, landing: str, state: str, detectors: Detectors, files: int = 16, buckets: int = BUCKETS) -> None:
    """Takes in all files of raw pages waiting in ``landing``; of a page the newest version counts, also across batches and runs."""
    pages, found = _tables(state, buckets)

    def without(old: DataFrame, new: DataFrame) -> DataFrame:
        """The old rows of pages that the batch does not bring; never broadcast, for a batch may be a whole site."""
        return old.join(pages.placed(new.select("url_id")).hint("merge"), "url_id", "left_anti")

    def one(batch: DataFrame, k: int) -> None:
        newest = latest(batch, ["url_id"], ["version"])
        known = pages.read(spark, k - 1)
        newest = pages.placed(newest).join(known.select("url_id", F.col("version").alias("known")).hint("merge"), "url_id", "left")
        fresh = newest.where("known IS NULL OR version >= known").drop("known")
        body = B.extract(fresh.where("html IS NOT NULL"), "url_id").select(F.col("page_id").alias("url_id"), normalize(F.col("body")).alias("body_text"))
        fresh.select("url_id", "locale", "version").join(body, "url_id", "left").write.mode("overwrite").parquet(f"{state}/texts/batch={k}")
        texts = spark.read.parquet(f"{state}/texts/batch={k}")
        own = texts.select("url_id", "version")
        pages.write(without(known, own).unionByName(pages.placed(own)), k)
        looked = looked_at(texts.where("coalesce(body_text, '') <> ''"), detectors)
        found.write(without(found.read(spark, k - 1), own).unionByName(found.placed(looked)), k)
        texts.agg(F.count("*").alias("pages"), F.count_if(F.coalesce("body_text", F.lit("")) == "").alias("unreadable")).write.mode("overwrite").parquet(f"{state}/batches/batch={k}")
        for table in (pages, found):  # version k - 1 is needed if this batch is tried again
            table.drop(spark, k - 2)

    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).parquet(landing)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{state}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, state: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(pages, what is found on them) after the last batch."""
    last = spark.read.parquet(f"{state}/batches").agg(F.max("batch")).first()[0]
    pages, found = _tables(state, buckets)
    return pages.read(spark, last), found.read(spark, last)


def texts(spark: SparkSession, state: str) -> DataFrame:
    """(url_id, locale, version, body_text) of every page's newest version."""
    pages, _ = current(spark, state)
    return latest(spark.read.parquet(f"{state}/texts").join(pages, ["url_id", "version"]), ["url_id"], ["batch"]).drop("batch")


def _consistent(found: DataFrame, detectors: Detectors) -> DataFrame:
    claims = found.where("detector = 'claim'").select("url_id", F.col("name").alias("kind"), "value", F.col("place").alias("pattern"), "start")
    return K.consistency(claims, detectors.canonical.select("kind", "canonical"))


def verdicts(found: DataFrame, detectors: Detectors) -> DataFrame:
    """(rule_id, url_id, verdict, matched_value, evidence): of all detectors, the last write of each rule and page."""
    columns = ["rule_id", "url_id", "verdict", F.col("value").alias("matched_value"), "evidence"]
    out = found.where("detector = 'stale'").select(*columns, F.lit(STALE).alias("rank"), F.lit(0).alias("seq"))
    judged = _consistent(found, detectors).join(detectors.canonical.select("kind", "rule_id"), "kind")
    out = out.unionByName(judged.withColumn("evidence", F.lit(None).cast("string")).select(*columns, F.lit(CONSISTENCY).alias("rank"), F.lit(0).alias("seq")))
    out = out.unionByName(found.where("detector = 'count'").select(*columns, F.lit(COUNTS).alias("rank"), F.col("start").alias("seq")))
    return latest(out, ["rule_id", "url_id"], ["rank", "seq"]).drop("rank", "seq")


def run_findings(found: DataFrame, detectors: Detectors, run_at: str) -> DataFrame:
    """Findings as the detectors write them, with ``write_seq``; several of one key are left to the merge."""
    stale = found.where("detector = 'stale' AND verdict = 'issue'").select("url_id", F.concat("name", F.lit(":stale")).alias("title"), "category", "severity", F.lit("open").alias("status"), F.col("value").alias("matched_value"), "evidence", F.lit("regex").alias("method"), F.lit(STALE).alias("write_seq"))
    kinds = detectors.canonical.select(F.concat("kind", F.lit(":inconsistent")).alias("title"), F.coalesce("category", F.lit("other_mismatch")).alias("category"), F.col("canonical").alias("expected"))
    consistent = K.consistency_findings(_consistent(found, detectors)).join(kinds, "title").withColumns({"evidence": F.lit(None).cast("string"), "method": F.lit("inventory"), "write_seq": F.lit(CONSISTENCY)})
    parts = [stale, consistent]
    for c in detectors.counts:
        judged = found.where((F.col("detector") == "count") & (F.col("name") == c.prefix)).select("url_id", F.col("value").alias("number"), "method", "verdict")
        parts.append(K.count_findings(judged, c.prefix).withColumns({"category": F.lit(c.category), "evidence": F.lit(None).cast("string"), "method": F.lit("context"), "write_seq": F.lit(COUNTS)}))
    banned = found.where("detector = 'forbidden'")
    banned = latest(banned, ["url_id", "name", "category"], ["start"])
    parts.append(banned.select("url_id", F.col("name").alias("title"), "category", "severity", F.lit("open").alias("status"), F.col("value").alias("matched_value"), "evidence", F.lit("context").alias("method"), F.lit(FORBIDDEN).alias("write_seq")))
    out = None
    for p in parts:
        expected = F.col("expected") if "expected" in p.columns else F.lit(None)
        one = p.select("url_id", "category", "title", F.lit(0).cast("long").alias("related_url_id"), "severity", F.lit(None).cast("string").alias("detail"), "evidence", expected.cast("string").alias("expected"), "matched_value", F.col("method").alias("detection_method"), F.lit(run_at).alias("detected_at"), "status", F.lit(None).cast("string").alias("last_checked_at"), F.lit(None).cast("string").alias("deleted_at"), F.col("write_seq").cast("long").alias("write_seq"))
        out = one if out is None else out.unionByName(one)
    return out


def finish(spark: SparkSession, state: str, detectors: Detectors, run_at: str, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, findings) at the end of a run: findings are merged into ``old``; open ones that no detector of the run wrote again become fixed.

    Of pages that this run did not see the last known version counts, so their findings
    are written again as well. Ignored and deleted findings keep what a person decided.
    """
    _, found = current(spark, state)
    new = run_findings(found, detectors, run_at)
    table = spark.createDataFrame([], FINDINGS) if old is None else old
    merged = merge_findings(table, new)
    lost = (F.col("status") == "open") & (F.col("detected_at") < run_at) & F.col("detection_method").isin("regex", "inventory", "context")
    return verdicts(found, detectors), merged.withColumn("status", F.when(lost, "fixed").otherwise(F.col("status")))

