"""Newest rows, differences between snapshots, and counts of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` of each key: one combined aggregate, no sort. Ties need a unique last column."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    best = rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def readable(crawls: DataFrame) -> DataFrame:
    """Latest crawls with a text; the text is looked at after the latest one is picked."""
    return latest(crawls, ["url_id"], ["crawl_id"]).where("coalesce(body_text, '') <> ''")


def with_previous_hash(crawls: DataFrame) -> DataFrame:
    w = Window.partitionBy("url_id").orderBy("crawl_id")
    return crawls.withColumn("previous_hash", F.lag("content_hash").over(w))


def set_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): new or removed."""
    b, a = before.select(key).distinct(), after.select(key).distinct()
    new, gone = a.join(b, key, "left_anti"), b.join(a, key, "left_anti")
    return new.withColumn("change", F.lit("new")).unionByName(gone.withColumn("change", F.lit("removed")))


def needs_change(lastmod: Column, last_crawled: Column) -> Column:
    """Never crawled, or modified since; unknown dates of a crawled page count as unchanged."""
    return last_crawled.isNull() | F.coalesce(lastmod > last_crawled, F.lit(False))


def sync_message(urls: DataFrame) -> DataFrame:
    """One message for each source: what a sync would do."""
    n = urls.groupBy("source_id").agg(
        F.count("*").alias("total"), F.count("last_crawled").alias("crawled"),
        F.count_if(F.col("last_crawled").isNotNull() & F.coalesce(F.col("lastmod") > F.col("last_crawled"), F.lit(False))).alias("updated"),
    )
    missing = F.col("total") - F.col("crawled")
    said = F.when(F.col("crawled") == 0, "Never synced").when(missing > 0, F.concat(missing, F.lit(" never synced"))).when(F.col("updated") > 0, F.concat("updated", F.lit(" updated"))).otherwise("up to date")
    return n.select("source_id", "total", "crawled", "updated", said.alias("message"))


def batches(rows: DataFrame, key: str, order: str, size: int, width: int = 4096) -> DataFrame:
    """``rows`` with ``batch``, the number of its run of ``size`` rows of the key in the order of an integer column.

    Rows are numbered inside ranges of ``width`` values, to which the counts of the ranges
    before them are added, so a key with most rows is spread over many tasks.
    """
    own = rows.withColumn("_range", F.floor(F.col(order) / width))
    counts = own.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)) + F.col("_before") - 1
    return own.join(before, [key, "_range"]).withColumn("batch", F.floor(place / size)).drop("_range", "_before")
