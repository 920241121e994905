"""How filters interact: what each would remove at each place of each order.

Every filter has a table of its own with the ids that fail it. The survivors of a set of
filters are the members without those ids (left-anti joins), what a filter removes after
that set are the survivors among its ids (left-semi join). Which order the filters before
it had does not matter, so 2**k sets stand for all k! orders.

A set of filters is a column of the members, not a plan of its own: one row a member and
set meets each id table once, and a filter's ids only take rows away whose set holds it.
All tables are dealt by key, so nothing but members and ids is shuffled, and each once.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factflow.llm.shared import written

_SPACE, _GAP = " \t\n\x0b\f\r", "[ \t\n\x0b\f\r]+"


def contract_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text, but for repeated texts: too short, repeated words, capitals, symbols."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.split(trimmed, _GAP)
    n = F.when(trimmed == "", 0).otherwise(F.size(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": (trimmed != "") & (100 * F.size(F.array_distinct(words)) < 50 * n),
        "C": 100 * capitals > 3 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(key, id, part, text_digest, one column a filter): what the audit needs of each row, from one scan of the texts.

    ``key`` is a digest of id and text, never null. A null text counts as empty, a null
    part as the empty string.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    named = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("-"))
    key = F.unhex(F.md5(F.concat(named, F.lit("|"), digest).cast("binary")))
    return own.select(key.alias("key"), "id", "part", F.unhex(digest).alias("text_digest"), *[c.alias(f) for f, c in contract_filters(F.col("text")).items()])


def repeated(rows: DataFrame) -> DataFrame:
    """Keys of rows whose text also has a smaller id, anywhere in the table: all but the first id of each text.

    The first ids are counted per text with partial sums; the join back is on text and id
    together, so no group of copies meets in one task.
    """
    named = rows.where("id IS NOT NULL")
    first = named.groupBy("text_digest").agg(F.min("id").alias("id"))
    return named.join(first, ["text_digest", "id"], "left_anti").select("key")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, part, good, toxic) of all rows; an id with several labels has each of them, one without any none."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    found = rows.where("id IS NOT NULL").join(known, "id", "left").select("key", "part", *flags)
    return found.unionByName(rows.where("id IS NULL").select("key", "part", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def survivors(members: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """Members of every set of filters that no filter of the set removes; ``prefix`` has a bit for each filter in the set."""
    names = list(failing)
    out = members.repartition("key").withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))))
    for k, name in enumerate(names):
        gone = failing[name].select(F.col("key").alias("gone"))
        out = out.join(gone, (F.col("key") == F.col("gone")) & (F.col("prefix").bitwiseAND(1 << k) != 0), "left_anti")
    return out


def removals(left: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """Survivors of a set that the filter ``f`` outside the set removes next; ``f`` is its place among the filters."""
    every = None
    for k, ids in enumerate(failing.values()):
        one = ids.select(F.col("key").alias("gone"), F.lit(1 << k).alias("bit"))
        every = one if every is None else every.unionByName(one)
    rows = left.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(len(failing) - 1)))).where("shiftright(prefix, f) & 1 = 0")
    # Joined on the key alone, by which both sides are dealt already.
    return rows.join(every, (F.col("key") == F.col("gone")) & F.expr("shiftleft(1, f) & bit <> 0"), "left_semi")


def audit(members: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """One row a part, order of the filters and step, with zeros: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``members`` are (key, part, good, toxic), ``failing`` has one table (key) a filter, none
    with a key twice; rows that share a key are counted each. At most eight filters, for all
    their orders are listed. Without members there are no parts and no rows.
    """
    names = list(failing)
    failing = {f: written(ids.select("key").distinct()) for f, ids in failing.items()}
    left = survivors(members, failing)
    number = F.count("*").alias("n")
    kept = left.groupBy("part", "prefix").agg(number)
    lost = removals(left, failing).groupBy("part", "prefix", "f").agg(number, F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    kept, lost = written(kept), written(lost)  # a few numbers a part

    spark = members.sparkSession
    steps = []
    for order in permutations(range(len(names))):
        seen = 0
        for step, f in enumerate(order, 1):
            steps.append((len(steps), "".join(names[k] for k in order), step, f, seen, seen | 1 << f, ((1 << len(names)) - 1) ^ (1 << f)))
            seen |= 1 << f
    orders = F.broadcast(spark.createDataFrame(steps, "at int, filter_order string, step int, f int, prefix int, after int, others int"))
    rows = kept.where("prefix = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("at")).join(orders, "at")  # k! * k steps a part
    removed = lost.select("part", "f", "prefix", F.col("n").alias("removed"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"))
    alone = lost.select("part", "f", F.col("prefix").alias("others"), F.col("n").alias("unique_fails"))
    fails = lost.where("prefix = 0").select("part", "f", F.col("n").alias("fails"))
    after = kept.select("part", F.col("prefix").alias("after"), F.col("n").alias("kept"))
    rows = rows.join(removed, ["part", "f", "prefix"], "left").join(alone, ["part", "f", "others"], "left").join(fails, ["part", "f"], "left").join(after, ["part", "after"], "left")
    counts = ["kept", "removed", "unique_fails", "good_lost", "toxic_lost", "fails"]
    rows = rows.select("part", "filter_order", "step", "f", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    shapley = rows.groupBy("part", "f").agg(F.sum("removed").alias("shapley"))
    redundant = (F.col("fails") - F.col("removed")).alias("redundant")
    return rows.join(shapley, ["part", "f"]).select("part", "filter_order", "step", "kept", "removed", redundant, "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over ``docs`` (doc_id, text, lang): short, repetitive, shouting, symbols, copies of a smaller id.

    Ids may be null (such rows copy nothing and have no labels) or repeat (rows equal in id
    and text count each, and are no copies of each other). Other columns are ignored.
    """
    rows = written(facts(docs))
    failing = {f: rows.where(f).select("key") for f in "ABCD"} | {"E": repeated(rows)}
    return audit(labelled(rows, labels), failing)
