"""Many patterns over many texts at once, in any case, with the places where they stand.

Plain words form one automaton: a text is read once whatever their number. Real
expressions are run by the engine itself, many in one alternation first and one by one
only on the texts that the alternation meets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factflow.functions.text import cut, regex_matches, staged

META = re.compile(r"[\\.^$*+?{}\[\]|()]")
ALONE = re.compile(r"\\[1-9k]|\(\?<[A-Za-z]|\\Q")  # numbers of groups would change, or a quote would not end
TOGETHER, PER_AUTOMATON = 32, 200_000
STEP = 256  # texts whose matches are held at once
MATCHES = "array<struct<start:int,end:int,value:string,seg:string,seg_start:int>>"


class _Fold(dict):
    """Letters as a case-insensitive expression compares them, one for one, so places stay where they are."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        up = c.upper() if len(c.upper()) == 1 else c
        low = "i" if c == "\u0130" else up.lower() if len(up.lower()) == 1 else up
        self[code] = ord(low)
        return self[code]


_FOLD = _Fold()


def folded(text: str) -> str:
    return text.translate(_FOLD)


def _found(words: Sequence[tuple[str, int]], text_column: str, carried: bool):
    """Batches with a row for each text and word in it, with its text if ``carried``; ``words`` are (pattern, reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for k, (p, _) in enumerate(words):
            by.setdefault(folded(p), []).append(k)
        for low, ks in by.items():
            machine.add_word(low, (len(low), tuple(ks)))
        machine.make_automaton()
        names = pa.array([p for p, _ in words], pa.string())
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("seg", pa.string()), ("seg_start", pa.int32())])
        for b in (whole.slice(k, STEP) for whole in batches for k in range(0, whole.num_rows, STEP)):
            row, which, some = [], [], []
            for i, text in enumerate(b.column(text_column).to_pylist()):
                met: dict[int, list[int]] = {}
                for last, (n, ks) in machine.iter(folded(text)) if text and by else ():
                    for k in ks:
                        starts = met.setdefault(k, [])
                        if not starts or starts[-1] + n <= last + 1 - n:  # as an expression goes on behind its match
                            starts.append(last + 1 - n)
                for k, starts in met.items():
                    p, reach = words[k]
                    row.append(i)
                    which.append(k)
                    some.append([{"start": s, "end": s + len(p), "value": text[s : s + len(p)], "seg": text[max(0, s - reach) : s + len(p) + reach], "seg_start": max(0, s - reach)} for s in starts])
            at = pa.array(row, pa.int64())
            kept = {n: b.column(n).take(at) for n in b.schema.names if carried or n != text_column}
            yield pa.RecordBatch.from_arrays([*kept.values(), names.take(pa.array(which, pa.int64())), pa.array(some, pa.list_(kind))], names=[*kept, "pattern", "matches"])

    return run


def alternation(patterns: Sequence[str]) -> str:
    return "(?iu)" + "|".join(f"(?:{p})" for p in patterns)


def expressions_met(text: Column, patterns: Sequence[str]) -> Column:
    """The expressions that a text matches, as an array; literals only, so each is compiled once a task."""
    groups = [[p] for p in patterns if ALONE.search(p)]
    rest = [p for p in patterns if not ALONE.search(p)]
    groups += [rest[k : k + TOGETHER] for k in range(0, len(rest), TOGETHER)]
    none = F.array().cast("array<string>")
    one = lambda p: F.when(text.rlike(f"(?iu){p}"), F.lit(p))
    found = [F.when(text.rlike(alternation(g)), F.array_compact(F.array(*map(one, g)))).otherwise(none) for g in groups]
    return F.concat(*found) if found else none


def pattern_matches(rows: DataFrame, patterns: DataFrame, text: str = "body_text", carried: bool = True) -> DataFrame:
    """``rows`` with (pattern, matches), a row for each of the different ``patterns`` (pattern, reach) that a text holds.

    Matches of a pattern do not overlap; each has its place, its text and the text up to
    ``reach`` characters around it. The patterns are configuration: they go to the driver
    and from there to the tasks, at most ``PER_AUTOMATON`` in one automaton (beyond that the
    texts are read once more for each further one). A null text holds nothing, an empty
    pattern is none. The text itself goes along if it is ``carried``.
    """
    wanted = [(r.pattern, r.reach) for r in patterns.where("pattern <> ''").groupBy("pattern").agg(F.max("reach").cast("int").alias("reach")).orderBy("pattern").collect()]
    plain = [w for w in wanted if not META.search(w[0])]
    other = [w for w in wanted if META.search(w[0])]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if carried or f.name != text)
    parts = [rows.mapInArrow(_found(plain[k : k + PER_AUTOMATON], text, carried), f"{kinds}, pattern string, matches {MATCHES}") for k in range(0, max(1, len(plain)), PER_AUTOMATON)]
    if other:
        c = F.col(f"`{text}`")
        reach = F.create_map(*[F.lit(x) for w in other for x in w])
        met = rows.where(c.isNotNull()).withColumn("pattern", F.explode(expressions_met(c, [p for p, _ in other])))
        met = staged(met, _m=regex_matches(c, F.concat(F.lit("(?iu:"), "pattern", F.lit(")"))), _reach=reach[F.col("pattern")])
        begin = lambda m: F.greatest(m["start"] - F.col("_reach"), F.lit(0))
        shown = F.transform("_m", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), cut(c, begin(m), m["end"] + F.col("_reach")).alias("seg"), begin(m).alias("seg_start")))
        parts.append(met.withColumn("matches", shown.cast(MATCHES)).drop("_m", "_reach", *([] if carried else [text])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def holds(segment: Column, patterns: Column) -> Column:
    """Whether a segment holds any of an array of patterns, in any case; plain words in plain texts need no expression."""
    plain = lambda x: F.octet_length(x) == F.char_length(x)
    word = lambda p: plain(p) & ~p.rlike(META.pattern)
    return F.exists(patterns, lambda p: F.when(word(p) & plain(segment), F.contains(F.lower(segment), F.lower(p))).otherwise(F.rlike(segment, F.concat(F.lit("(?iu)"), p))))
