"""Full-text search: a token table, phrases and BM25."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factflow.functions.text import staged
from factflow.sources.folders import checkpointed

K1, B = 1.2, 0.75
#: Marks that stand behind their letter in decomposed texts.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def _bases() -> dict[str, str]:
    """Letters with marks and the letters they fold to, by the decompositions of Unicode."""
    found = {}
    for c in map(chr, range(0x80, 0x10000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.category(c).startswith("L") and all(map(unicodedata.combining, parts[1:])):
            found[c] = parts[0]
    return found


BASES = _bases()
ACCENTED, PLAIN = "".join(BASES) + MARKS, "".join(BASES.values())


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """Case and marks folded, cut at everything but letters and digits."""
    return F.filter(F.split(F.translate(lowered(text), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def line(low: Column) -> Column:
    """The tokens of a ``lowered`` text as one text, with a space between them; plain ASCII is not looked through for marks."""
    plain = F.regexp_replace(low, "[^a-z0-9]+", " ")
    folded = F.regexp_replace(F.translate(low, ACCENTED, PLAIN), r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.when(F.octet_length(low) == F.char_length(low), plain).otherwise(folded))


def words_of(text: Column) -> Column:
    """How many tokens a ``line`` has."""
    return F.when(text == "", 0).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


FIELDS = ("title", "meta", "h1", "faqs", "body")


def documents(pages: DataFrame, faqs: DataFrame) -> DataFrame:
    """(url_id and ``FIELDS``) of pages (url_id, title, meta, h1s, body) with a body; heads, and questions with answers, are one text each."""
    pair = F.concat_ws(" ", "question", "answer")
    asked = faqs.groupBy("url_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("faq_id", pair.alias("t")))), lambda x: x["t"]), " ").alias("faqs"))
    own = pages.where("coalesce(body, '') <> ''").join(asked, "url_id", "left")
    return own.select("url_id", "title", "meta", F.array_join("h1s", " ").alias("h1"), "faqs", "body")


def index(pages: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(url_id, field, pos, token) of pages in one scan; written by its caller, bucketed by token."""
    listed = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("ts")) for f in fields]))
    return pages.select("url_id", listed.alias("f")).select("url_id", "f.field", F.posexplode("f.ts").alias("pos", "token"))


def phrase_counts(pages: DataFrame, column: str, phrases: Sequence[str]) -> DataFrame:
    """(url_id, size, tf_0, tf_1, ...): tokens of a field, and places of each phrase in it; each text is cut into tokens once, no join."""
    rows = staged(pages.select("url_id", column), _ts=tokens(F.col(column)))
    rows = staged(rows, _line=F.concat(F.lit(" "), F.array_join("_ts", "  "), F.lit(" ")))
    counts = []
    for k, p in enumerate(phrases):
        needle = " " + "  ".join(fold(p)) + " "
        counts.append(((F.char_length("_line") - F.char_length(F.replace(F.col("_line"), F.lit(needle), F.lit("")))) / len(needle)).cast("int").alias(f"tf_{k}"))
    return rows.select("url_id", F.size("_ts").alias("size"), *counts)


_FOLD = str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, MARKS)


def fold(phrase: str) -> list[str]:
    """The same for a search term in a program."""
    return [t for t in re.split(r"[\W_]+", phrase.lower().translate(_FOLD)) if t]


def bm25(pages: DataFrame, column: str, phrases: Sequence[str], limit: int | None = 200) -> DataFrame:
    """Pages with any of the phrases by BM25, best first, ties by url_id: (url_id, score)."""
    counts = checkpointed(phrase_counts(pages, column, phrases))  # a few numbers a page, used for the frequencies and for the scores
    stats = counts.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"tf_{k}") > 0).alias(f"df_{k}") for k in range(len(phrases))])
    score = F.lit(0.0)
    for k in range(len(phrases)):
        df, tf = F.col(f"df_{k}"), F.col(f"tf_{k}")
        idf = F.greatest(F.ln((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    hits = counts.where(" OR ".join(f"tf_{k} > 0" for k in range(len(phrases))))
    out = hits.join(F.broadcast(stats)).select("url_id", F.round(score, 6).alias("score"))  # stats is one row
    return out.orderBy(F.desc("score"), "url_id").limit(limit) if limit else out


def expanded_terms(raw: Column, terms: Column, most: int = 10) -> Column:
    """The raw query, then the terms, without repeats in any case, at most ``most``."""
    every = F.filter(F.concat(F.array(raw), terms), lambda t: F.trim(t) != "")
    kept = F.aggregate(
        every, F.array().cast("array<string>"),
        lambda acc, t: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc).otherwise(F.array_append(acc, t)),
    )
    return F.slice(kept, 1, most)
