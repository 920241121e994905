"""Incremental sync: page snapshots arrive as files and become verdicts and findings, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.operators.detect import Rules, findings_of, stale_scan
from factflow.operators.snapshots import latest
from factflow.operators.state import FINDING_KEY, merge_findings

SNAPSHOT = "url_id long, locale string, body_text string, version long"
VERDICTS = "rule_id int, slug string, url_id long, verdict string, version long"
FINDINGS = "url_id long, category string, title string, related_url_id long, severity string, detail string, evidence string, expected string, matched_value string, status string, last_checked_at string, deleted_at string"


def sync(spark: SparkSession, landing: str, state: str, rules: Rules, files: int = 2) -> DataFrame:
    """Process all files waiting in ``landing``, ``files`` a batch, and return the merged verdicts.

    Each micro-batch is written under its own batch id, so a batch that is tried again
    overwrites itself. Of several batches the newest page version counts; pages that no
    longer have a hit lose their verdicts, for the pages seen are written as well. Findings
    are the run's writes, merged into a table when it is read (``findings``).
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        newest = latest(batch, ["url_id"], ["version"])
        hits = stale_scan(newest.where("body_text IS NOT NULL"), rules, proof=True).join(newest.select("url_id", "version"), "url_id")
        hits.write.mode("overwrite").parquet(f"{state}/hits/batch={batch_id}")
        hits = spark.read.parquet(f"{state}/hits/batch={batch_id}")
        hits.select("rule_id", "slug", "url_id", "verdict", "version").write.mode("overwrite").parquet(f"{state}/verdicts/batch={batch_id}")
        found = findings_of(hits.where("verdict = 'issue'")).select("url_id", "category", "title", "severity", "evidence", "matched_value", "version")
        found.write.mode("overwrite").parquet(f"{state}/findings/batch={batch_id}")
        batch.groupBy("url_id").agg(F.max("version").alias("version")).write.mode("overwrite").parquet(f"{state}/seen/batch={batch_id}")
        batch.agg(F.count("*").alias("pages"), F.count_if(F.col("body_text").isNull()).alias("errors")).write.mode("overwrite").parquet(f"{state}/metrics/batch={batch_id}")

    stream = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", files).parquet(landing)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{state}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return merged(spark, state)


def _newest(spark: SparkSession, state: str, table: str, schema: str) -> DataFrame:
    """Rows of a table that belong to the newest version seen of their page."""
    seen = spark.read.schema("url_id long, version long").parquet(f"{state}/seen").groupBy("url_id").agg(F.max("version").alias("version"))
    return spark.read.schema(schema).parquet(f"{state}/{table}").join(seen, ["url_id", "version"]).distinct()


def merged(spark: SparkSession, state: str) -> DataFrame:
    """The verdicts of each page's newest version."""
    return _newest(spark, state, "verdicts", VERDICTS).select("rule_id", "slug", "url_id", "verdict", "version")


def findings(spark: SparkSession, state: str, old: DataFrame | None = None) -> DataFrame:
    """The findings table ``old`` (or an empty one) with the run's findings merged in."""
    new = _newest(spark, state, "findings", "url_id long, category string, title string, severity string, evidence string, matched_value string, version long")
    new = new.select("url_id", "category", "title", F.lit(0).cast("long").alias("related_url_id"), "severity", *[F.lit(None).cast("string").alias(c) for c in ("detail", "expected", "last_checked_at")], "evidence", "matched_value", F.lit("open").alias("status"), F.col("version").alias("write_seq"))
    table = spark.createDataFrame([], FINDINGS) if old is None else old
    return merge_findings(latest(table, FINDING_KEY, ["status"]), new)


def metrics(spark: SparkSession, state: str) -> DataFrame:
    """pages and errors of all batches; issue and positive verdicts that stand."""
    rows = spark.read.schema("pages long, errors long").parquet(f"{state}/metrics")
    counts = merged(spark, state).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("issue", "positive")])
    return rows.agg(F.sum("pages").alias("pages"), F.sum("errors").alias("errors")).join(counts)  # two single rows
