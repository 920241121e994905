"""Text, number and evidence expressions. Offsets count code points from 0."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators below it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
ENDERS = r"([.!?…]+)(?=[\s\x1c-\x1f\x85\p{Z}]|$)|([。！？।]+)"
_OPEN, _CLOSE = "\x01", "\x02"


def normalize(text: Column) -> Column:
    """White space runs become one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_MATCH = "array<struct<start:int,end:int,value:string>>"
_RUN = 64


def regex_matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """Array of (start, end, value) of all matches; value is a group of the match. The pattern may be a column.

    The matches are marked in one replacement and the text cut at the marks, so starts
    come from the lengths of what precedes them. The mark characters are removed first.
    Matches are added up in runs of ``_RUN``, each from the place where it begins, so long
    texts with many matches copy little.
    """
    plain = F.translate(text, _OPEN + _CLOSE, "")
    pieces = F.split(F.regexp_replace(plain, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN)

    def added(run: Column, begin: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(begin.alias("at"), F.array().cast(_MATCH).alias("found")),
            lambda acc, part: F.struct(
                (acc["at"] + F.char_length(part) - 1).alias("at"),
                F.array_append(
                    acc["found"],
                    F.struct(acc["at"].alias("start"), (acc["at"] + F.char_length(F.substring_index(part, _CLOSE, 1))).alias("end"), F.substring_index(part, _CLOSE, 1).alias("value")),
                ).alias("found"),
            ),
        )["found"]

    def begins(runs: Column, first: Column) -> Column:
        return F.aggregate(
            runs,
            F.struct(F.char_length(first).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, run: F.struct((acc["at"] + F.char_length(F.array_join(run, "")) - F.size(run)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        )["out"]

    def read(parts: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 2) / _RUN).cast("int")), lambda k: F.slice(parts, k * _RUN + 2, F.lit(_RUN)))
        found = let(runs, lambda r: F.flatten(F.zip_with(r, begins(r, F.element_at(parts, 1)), added)))
        return F.when(F.size(parts) > 1, found).otherwise(F.array().cast(_MATCH))

    found = let(pieces, read)
    return found if group == 0 else F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.regexp_extract(m["value"], pattern, group).alias("value")))


def context_window(text: Column, start: Column, end: Column, radius: int | Column) -> Column:
    """The text from ``radius`` before a match to ``radius`` behind it."""
    return cut(text, F.greatest(start - radius, F.lit(0)), end + radius)


def context_snippet(text: Column, start: Column, end: Column, radius: int) -> Column:
    """The same with cut words dropped and an ellipsis at each cut end, normalised."""
    n = F.char_length(text)
    lo, hi = F.greatest(start - radius, F.lit(0)), F.least(end + radius, n)
    s = cut(text, lo, hi)
    s = F.when(lo > 0, F.concat(F.lit("…"), F.regexp_replace(s, rf"\A(?:(?!{SPACE})(?s:.))*{SPACE}", ""))).otherwise(s)
    s = F.when(hi < n, F.concat(F.regexp_replace(s, rf"{SPACE}(?:(?!{SPACE})(?s:.))*\z", ""), F.lit("…"))).otherwise(s)
    return normalize(s)


def sentence_ends(text: Column) -> Column:
    """Offsets just behind each sentence end; a point between two digits is none."""
    found = regex_matches(text, ENDERS)
    real = F.filter(
        found,
        lambda m: ~(
            m["value"].startswith(".")
            & F.substring(text, m["start"], F.when(m["start"] > 0, 1).otherwise(0)).rlike(r"^\p{Nd}")
            & F.regexp_replace(F.substring(text, m["end"] + 1, 3), rf"\A{SPACE}+", "").rlike(r"\A\p{Nd}")
        ),
    )
    return F.transform(real, lambda m: m["end"])


def with_evidence(df: DataFrame, text: str, start: Column, end: Column, out: str = "evidence", most: int = 300) -> DataFrame:
    """Adds the sentences around the match [start, end) of a text column.

    One more sentence if they are under 40 characters, a window of 120 around the match if
    over ``most``. Steps are columns of their own, so that nothing is computed twice.
    """
    c, n = F.col(f"`{text}`"), F.char_length(f"`{text}`")
    ends, lo, hi = F.col("_ends"), F.col("_lo"), F.col("_hi")
    first = F.greatest(F.lit(0), F.least(start, n)).cast("int")
    df = staged(df, _ends=sentence_ends(c), _s=first, _e=F.greatest(first, F.least(end, n)).cast("int"))
    df = staged(df, _lo=F.coalesce(F.array_max(F.filter(ends, lambda x: x <= F.col("_s"))), F.lit(0)), _hi=F.coalesce(F.array_min(F.filter(ends, lambda x: x >= F.col("_e"))), n))
    df = staged(df, _sent=_strip(cut(c, lo, hi)), _wide=_strip(cut(c, lo, F.coalesce(F.array_min(F.filter(ends, lambda x: x > hi)), n))))
    short = (F.char_length("_sent") < 40) & (hi < n) & (F.char_length("_wide") <= most)
    best = F.when(short, F.col("_wide")).otherwise(F.col("_sent"))
    lost = ~F.contains(F.col("_sent"), cut(c, F.col("_s"), F.col("_e"))) | (F.char_length(best) > most)
    shown = F.when(n == 0, "").when(lost, context_snippet(c, F.col("_s"), F.col("_e"), 120)).otherwise(normalize(best))
    return staged(df, **{out: shown}).drop("_ends", "_s", "_e", "_lo", "_hi", "_sent", "_wide")


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row, which keeps later uses from copying their expressions."""
    return df.withColumn("_stage", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).select("*", *[F.col(f"_stage.{n}").alias(n) for n in columns]).drop("_stage")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def with_trimmed_evidence(df: DataFrame, text: str, matched: Column, out: str = "trimmed", most: int = 300) -> DataFrame:
    """Adds stored evidence cut to the sentence of ``matched``, or to its middle one; a short single sentence stays."""
    core, middle = F.col("_core"), F.floor(F.char_length("_core") / 2).cast("int")
    df = staged(df, _core=_strip(F.regexp_replace(_strip(F.coalesce(F.col(f"`{text}`"), F.lit(""))), "^…+|…+$", "")))
    df = staged(df, _at=F.when(F.coalesce(matched, F.lit("")) != "", F.position(matched, core)).otherwise(0))
    found = F.col("_at") > 0
    df = staged(df, _short=(F.char_length(core) <= most) & (F.size(sentence_ends(core)) <= 1))
    df = with_evidence(df, "_core", F.when(found, F.col("_at") - 1).otherwise(middle), F.when(found, F.col("_at") - 1 + F.char_length(matched)).otherwise(middle + 1), "_cut", most)
    return df.withColumn(out, F.when(F.col("_short"), normalize(core)).otherwise(F.col("_cut"))).drop("_core", "_at", "_short", "_cut")


def evidence_core(evidence: Column, length: int = 80) -> Column:
    """What is looked for on a page again: no marks, no ellipses at the ends, normalised, cut."""
    bare = F.regexp_replace(F.coalesce(evidence, F.lit("")), "</?mark>", "")
    return F.left(normalize(F.regexp_replace(bare, "^[… ]+|[… ]+$", "")), F.lit(length))


def with_term_context(df: DataFrame, text: str, terms: Sequence[str] | Column, out: str = "snippet", most: int = 300) -> DataFrame:
    """Adds evidence around the earliest of the terms (the first listed of equals), the term marked; null without one. The terms may be a column."""
    some = terms if isinstance(terms, Column) else F.array(*map(F.lit, terms))
    df = staged(df, _low=F.lower(f"`{text}`"), _terms=some)
    places = F.transform("_terms", lambda t, k: F.struct(F.instr(F.col("_low"), F.lower(t)).alias("at"), k.alias("k"), F.char_length(t).alias("n")))
    df = staged(df, _f=F.array_min(F.filter(places, lambda p: (p["at"] > 0) & (p["n"] > 0))))
    df = with_evidence(df, text, F.coalesce(F.col("_f.at") - 1, F.lit(0)), F.coalesce(F.col("_f.at") - 1 + F.col("_f.n"), F.lit(0)), "_ev", most)
    term = F.get("_terms", F.col("_f.k"))
    at, ev, n = F.position(F.lower(term), F.lower("_ev")), F.col("_ev"), F.col("_f.n")
    marked = F.concat(F.left(ev, at - 1), F.lit("<mark>"), F.substring(ev, at, n), F.lit("</mark>"), F.substring(ev, at + n, F.char_length(ev)))
    return df.withColumn(out, F.when(F.col("_f").isNotNull(), F.when(at > 0, marked).otherwise(ev))).drop("_f", "_ev", "_low", "_terms")


def fact_rule_of(title: Column) -> Column:
    """The rule a finding's title names: two parts for review and context findings, else what stands before the first colon."""
    two = title.startswith("llm:") | title.startswith("lang_ctx:") | title.startswith("reg_ctx:")
    return F.when(two, F.substring_index(title, ":", 2)).otherwise(F.substring_index(title, ":", 1))


def clean_term(term: Column) -> Column:
    """A search term without characters that mean something to a search."""
    return F.trim(F.regexp_replace(term, rf"[^\p{{L}}\p{{N}}\p{{M}}_{SPACE[1:-1]}+.,%$-]", " "))


def split_terms(text: Column) -> Column:
    """Terms by line if there is a line break, else by comma; trimmed, empty ones dropped."""
    parts = F.when(F.contains(text, F.lit("\n")), F.split(text, "\n")).otherwise(F.split(text, ","))
    return F.filter(F.transform(parts, _strip), lambda t: t != "")


def first_number(text: Column) -> Column:
    """The first run of up to three digits, empty without one."""
    return F.regexp_extract(text, r"\d{1,3}", 0)


def json_strings(text: Column) -> Column:
    """A JSON array of strings; null, broken and other JSON give an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


# What a byline begins with, and what separates a date or role from its name.
BYLINE_PREFIX = r"(?i)^\s*(?:by|written by|author|posted by|words by)\b[:\s]*"
BYLINE_TAIL = r"(?i)\s*(?:[|•·–—]|,|\bon\b).*$"


def clean_author(name: Column) -> Column:
    """A byline without its prefix and without date or role behind a separator; null if empty or over 80 characters."""
    bare = F.regexp_replace(normalize(name), BYLINE_PREFIX, "")
    bare = F.regexp_replace(F.regexp_replace(bare, BYLINE_TAIL, ""), r"^[ \-–—|,·•]+|[ \-–—|,·•]+$", "")
    return F.when((F.char_length(bare) > 0) & (F.char_length(bare) <= 80), bare)


# Words of messages, by class.
DNS, SSL, CONNECTION = ("name or service", "nodename", "getaddrinfo"), ("certificate", "ssl", "tls"), ("connection",)


def error_class(name: Column, message: Column) -> Column:
    """timeout, dns, ssl or connection by an exception's name and message, tested in this order; else the name itself."""
    kind, words = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))

    def says(*some: str) -> Column:
        return words.rlike("|".join(some))

    return (
        F.when(kind.contains("timeout") | says("timeout"), "timeout")
        .when(says(*DNS), "dns")
        .when(says(*SSL), "ssl")
        .when(kind.contains("connect") | says(*CONNECTION), "connection")
        .otherwise(F.concat(F.lit("network: "), name))
    )
