"""Landed files and texts as rows: sitemaps, URL lists, robots texts, rule registries."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.functions.text import SPACE, json_strings
from factflow.functions.urls import host, registrable_domain
from factflow.operators import graph

ENTRY = "array<struct<loc:string,lastmod:string,link:array<struct<_rel:string,_href:string>>>>"


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod, alternates) of sitemap files; ``.gz`` files are read as they are. For bytes without such a name see ``unpacked``."""
    schema = "loc string, lastmod string, `xhtml:link` array<struct<_rel:string,_href:string>>"
    rows = spark.read.format("xml").option("rowTag", "url").schema(schema).load(path)
    return rows.select(F.trim("loc").alias("loc"), F.trim("lastmod").alias("lastmod"), alternates(F.col("xhtml:link")).alias("alternates")).where("coalesce(loc, '') <> ''")


def alternates(links: Column) -> Column:
    hrefs = F.transform(F.filter(links, lambda x: F.lower(x["_rel"]) == "alternate"), lambda x: x["_href"])
    return F.coalesce(hrefs, F.array().cast("array<string>"))


def sitemap_texts(docs: DataFrame, column: str = "xml") -> DataFrame:
    """(loc, lastmod, alternates) of sitemaps held as texts; broken ones give no row. Tag prefixes do not count."""
    plain = F.regexp_replace(column, r"<(/?)[A-Za-z0-9]+:", "<$1")
    entries = F.from_xml(plain, F.lit(f"url {ENTRY}"))["url"]
    rows = docs.select(*[c for c in docs.columns if c != column], F.explode(entries).alias("u"))
    rows = rows.select(*[c for c in docs.columns if c != column], F.trim("u.loc").alias("loc"), F.trim("u.lastmod").alias("lastmod"), alternates(F.col("u.link")).alias("alternates"))
    return rows.where("coalesce(loc, '') <> ''")


def _recoded(docs: DataFrame, column: str, kind: str, change) -> DataFrame:
    """``docs`` with one column changed value by value, in Arrow batches."""
    fields = [f"`{c}` {kind if c == column else docs.schema[c].dataType.simpleString()}" for c in docs.columns]
    to = pa.string() if kind == "string" else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            values = pa.array([None if x is None else change(x) for x in b.column(at).to_pylist()], to)
            yield pa.RecordBatch.from_arrays([values if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, ", ".join(fields))


def unpacked(docs: DataFrame, column: str) -> DataFrame:
    """Fetched bytes as text: gzip is known by its first two bytes, whatever the name says; broken UTF-8 gives U+FFFD, a broken archive no text."""

    def change(x: bytes) -> str | None:
        try:
            return (gzip.decompress(x) if x[:2] == b"\x1f\x8b" else bytes(x)).decode("utf-8", "replace")
        except (OSError, EOFError):
            return None

    return _recoded(docs, column, "string", change)


def packed(docs: DataFrame, column: str, zipped: Column) -> DataFrame:
    """The other way: texts as bytes, gzip where ``zipped``."""
    plain = docs.where(~zipped).withColumn(column, F.encode(column, "UTF-8"))
    return plain.unionByName(_recoded(docs.where(zipped), column, "binary", lambda x: gzip.compress(x.encode())))


def alternate_pairs(entries: DataFrame) -> DataFrame:
    """(a, b): each entry's URL with each of its alternates."""
    return entries.select(F.col("loc").alias("a"), F.explode("alternates").alias("b"))


def ingest_stats(entries: DataFrame, primary: str) -> DataFrame:
    """total and on_domain of different URLs, external alternates as often as they occur, and groups of alternates."""
    pairs = alternate_pairs(entries)
    own = lambda c: registrable_domain(host(F.col(c))) == primary
    urls = entries.select(F.col("loc").alias("url")).unionByName(pairs.select(F.col("b").alias("url"))).distinct()
    total = urls.agg(F.count("*").alias("total"), F.count_if(own("url")).alias("on_domain"))
    groups = graph.groups(pairs).agg(F.coalesce(F.max("group"), F.lit(0)).alias("groups"))
    return total.join(pairs.agg(F.count_if(~F.coalesce(own("b"), F.lit(False))).alias("external"))).join(groups)  # three single rows


def expanded(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of all sitemaps (sitemap, xml) that indexes lead to from the roots.

    Each sitemap is visited once, an index adds its children only, and children that were
    not fetched add nothing.
    """
    plain = F.regexp_replace("xml", r"<(/?)[A-Za-z0-9]+:", "<$1")
    listed = F.explode(F.from_xml(plain, F.lit("sitemap array<struct<loc:string>>"))["sitemap"])
    children = docs.select(F.col("sitemap").alias("src"), listed.alias("s")).select("src", F.trim("s.loc").alias("dst")).where("coalesce(dst, '') <> ''")
    reached = graph.discover(children, roots.select(F.col("sitemap").alias("node")), None).select(F.col("node").alias("sitemap"))
    leaves = docs.join(reached, "sitemap").join(children.select(F.col("src").alias("sitemap")).distinct(), "sitemap", "left_anti")
    return sitemap_texts(leaves)


def url_list(lines: DataFrame, column: str = "value", csv: bool = False) -> DataFrame:
    """URLs of a list: of each line, or with ``csv`` of its first cell (quotes understood), what starts with http; comments and blanks are skipped."""
    first = F.from_csv(F.col(column), F.lit("url string"), {"escape": '"', "mode": "PERMISSIVE"})["url"] if csv else F.col(column)
    return lines.select(F.regexp_replace(first, rf"^{SPACE}+|{SPACE}+$", "").alias("url")).where(F.lower("url").startswith("http"))


def robots_sitemaps(texts: DataFrame, column: str) -> DataFrame:
    """Sitemap lines of robots texts."""
    return texts.withColumn("sitemap", F.explode(F.regexp_extract_all(column, F.lit(r"(?im)^sitemap:\s*(\S+)"), F.lit(1)))).drop(column)


def load_rules(rules: DataFrame, products: DataFrame, product_id: int | None = None, enabled_only: bool = True) -> DataFrame:
    """Rules with parsed patterns, defaults and product names; those of one product include the company-wide ones."""
    lists = [c for c in ("stale_patterns", "current_patterns", "allowed_patterns", "required_context", "search_terms") if c in rules.columns]
    out = rules.where("enabled = 1") if enabled_only else rules
    if product_id is not None:
        out = out.where(F.col("product_id").isNull() | (F.col("product_id") == product_id))
    out = out.withColumns({c: json_strings(F.col(c)) for c in lists})
    out = out.withColumns({
        "rule_type": F.coalesce("rule_type", F.lit("stale")), "context_window": F.coalesce("context_window", F.lit(120)), "severity": F.coalesce("severity", F.lit("medium")),
        "canonical_value": F.when(F.col("rule_type") == "inventory", F.col("correct_value")),
    })
    return out.join(products.select("product_id", F.col("name").alias("product_name")), "product_id", "left")


def rules_context(rules: DataFrame) -> DataFrame:
    """(product, rules, context): loaded rules as lines of text in rule order, each with at most four allowed patterns."""
    product = F.coalesce("product_name", F.lit("any product"))
    allowed = F.when(F.size("allowed_patterns") > 0, F.concat(F.lit(" ALLOWED (not an issue): "), F.array_join(F.slice("allowed_patterns", 1, 4), "; "), F.lit("."))).otherwise("")
    line = F.concat(F.lit("- ["), "slug", F.lit(" / "), F.coalesce("category", F.lit("")), F.lit(" / product: "), product, F.lit("]. Correct value: "), F.coalesce("correct_value", F.lit("TBD")), F.lit("."), allowed)
    lines = rules.groupBy(product.alias("product")).agg(F.sort_array(F.collect_list(F.struct("rule_id", line.alias("line")))).alias("l"))
    return lines.select("product", F.size("l").cast("long").alias("rules"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


def features_context(features: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, context): features as lines of text in id order; ``(none)`` for a source without any."""
    note = F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit(" NOTE: "), "notes")).otherwise("")
    line = F.concat(F.lit("- ["), "slug", F.lit("] "), "name", F.lit(" — status="), "status", F.lit(". "), F.coalesce("description", F.lit("")), note)
    lines = features.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("feature_id", line.alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return sources.select("source_id").join(lines, "source_id", "left").select("source_id", F.coalesce(text, F.lit("(none)")).alias("context"))
