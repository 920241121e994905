"""The written index, searches with skipped blocks, many searches at once, bounded best rows."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from factflow.operators import best, postings, search
from factflow.sources.folders import scratch

K1, B = 1.2, 0.75


def toks(text):
    return [t for t in re.split(r"[\W_]+", "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not "̀" <= c <= "ͯ")) if t]


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    words = ["the"] * 30 + ["of"] * 20 + ["license", "licence", "Größe", "la", "rights", "reserved"] * 2 + [f"w{k}" for k in range(200)]
    rows = [(k, k % 3, " ".join(rng.choices(words, k=rng.choice([0, 3, 20, 80, 400]))), rng.choice([None, "of the", "Title of", "la la la"])) for k in range(n)]
    return [*rows, (n, 0, "", None), (n + 1, 1, None, ""), (n + 2, 1, "license, LICENSE; license!", "Größe"), (n + 3, 2, "rights. Reserved rights", "reserved")]


def brute(rows, phrases, k, scope=None):
    """BM25 over fields body and title; a phrase stands inside one field, occurrences may overlap."""
    fields = {i: [toks(body), toks(title)] for i, _, body, title in rows}
    size = {i: sum(map(len, f)) for i, f in fields.items()}
    mean = sum(size.values()) / len(size)

    def count(f, p):
        return sum(f[j : j + len(p)] == p for j in range(len(f) - len(p) + 1)) if p else 0

    tf = [{i: sum(count(f, toks(p)) for f in fs) for i, fs in fields.items()} for p in phrases]
    score = {}
    for t in tf:
        df = sum(v > 0 for v in t.values())
        idf = max(math.log((len(rows) - df + 0.5) / (df + 0.5)), 1e-6)
        for i, v in t.items():
            if v:
                score[i] = score.get(i, 0) + idf * v * (K1 + 1) / (v + K1 * (1 - B + B * size[i] / mean))
    scopes = {i: s for i, s, _, _ in rows}
    found = [(-round(v, 6), i) for i, v in score.items() if scope is None or scopes[i] == scope]
    return [(i, -s) for s, i in sorted(found)[:k]]


@pytest.fixture(scope="module")
def built(spark):
    rows = corpus()
    pages = spark.createDataFrame(rows, "url_id long, scope int, body string, title string").repartition(3)
    return rows, postings.write_index(pages, ["body", "title"], scratch(spark, "index"), buckets=8, chunk=4)


def same(got, want):
    assert [i for i, _ in got] == [i for i, _ in want] or sorted(got) == sorted(want)
    assert all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(got, want, strict=True))


@pytest.mark.parametrize("phrases, k, scope", [
    (["license"], 5, None), (["license", "w7", "groesse"], 10, 1), (["the"], 7, 2), (["of the"], 12, None), (["license", "of the", "Größe"], 9, 0), (["la la"], 50, None),
    (["rights reserved", "!!!"], 300, None), (["absent", "absent too"], 5, None), (["..."], 5, None), (["the", "of", "w1", "w2", "w3"], 3, None), (["license"], 5, 9),
])
def test_search_matches_brute_force(spark, built, phrases, k, scope):
    rows, index = built
    got = [tuple(r) for r in postings.search(index, spark, phrases, k, scope).collect()]
    same(got, brute(rows, phrases, k, scope))


def test_a_search_opens_its_buckets_and_skips_chunks(spark, built, monkeypatch):
    rows, index = built
    df = postings.search(index, spark, ["license"], 2)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*token", plan) and "places" not in plan
    monkeypatch.setattr(postings, "FIRST", 1)
    for k in (1, 2, 30):
        same([tuple(r) for r in postings.search(index, spark, ["license", "w5"], k).collect()], brute(rows, ["license", "w5"], k))


def test_many_searches_equal_single_ones(spark, built):
    rows, index = built
    asked = [(1, ["license"]), (2, ["license", "of the"]), (3, ["la la", "la"]), (4, ["absent"]), (5, []), (6, ["w1", "w2 ", "Größe", "w1"]), (7, ["...", "rights reserved"])]
    got = {}
    for r in postings.search_many(index, spark.createDataFrame(asked, "search_id int, terms array<string>"), 4).collect():
        got.setdefault((r.search_id, r.scope), []).append((r.rank, r.url_id, r.score))
    want = {}
    for i, terms in asked:
        for scope in range(3):
            if found := brute(rows, terms, 4, scope):
                want[i, scope] = [(k, *f) for k, f in enumerate(found, 1)]
    assert got.keys() == want.keys()
    for key, some in got.items():
        same([(i, s) for _, i, s in sorted(some)], [(i, s) for _, i, s in want[key]])
        assert sorted(r for r, _, _ in some) == list(range(1, len(some) + 1))


def test_equal_searches_are_one_until_the_end(spark, built, monkeypatch):
    rows, index = built
    given = []

    def counted(scores, *args):
        given.append(scores.count())
        return best.best_of(scores, *args)

    monkeypatch.setattr(postings, "best_of", counted)
    asked = spark.createDataFrame([(k, ["the", "w7"]) for k in range(50)], "search_id int, terms array<string>")
    got = {}
    for r in postings.search_many(index, asked, 4).collect():
        got.setdefault((r.search_id, r.scope), []).append((r.rank, r.url_id, r.score))
    assert max(given) <= len(rows)
    for scope in range(3):
        for k in (0, 49):
            same([(i, s) for _, i, s in sorted(got[k, scope])], brute(rows, ["the", "w7"], 4, scope))


def shuffled(spark):
    """Rows written to shuffles by all stages so far."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize("part", [1 << 21, 500, 1])  # one part a file, some, one a page
def test_many_searches_in_many_parts(spark, built, monkeypatch, part):
    monkeypatch.setattr(postings, "PART_TOKENS", part)
    rows, index = built
    rng = random.Random(part)
    words = ["the", "of", "la", "license", "of the", "the of the", "Größe", "la la", *[f"w{k}" for k in range(30)]]
    asked = [(k, rng.choices(words, k=rng.choice([1, 2, 2, 3]))) for k in range(60)]
    got = {}
    for r in postings.search_many(index, spark.createDataFrame(asked, "search_id int, terms array<string>"), 3).collect():
        got.setdefault((r.search_id, r.scope), []).append((r.rank, r.url_id, r.score))
    want = {(k, scope): found for k, terms in asked for scope in range(3) if (found := brute(rows, terms, 3, scope))}
    assert got.keys() == want.keys()
    for key, some in got.items():
        same([(i, s) for _, i, s in sorted(some)], want[key])


def test_pairs_of_searches_and_pages_are_not_shuffled(spark):
    rng = random.Random(3)
    words = [f"c{k}" for k in range(26)]
    pages = spark.createDataFrame([(k, 0, " ".join(rng.sample(words, 22))) for k in range(400)], "url_id long, scope int, body string").coalesce(2)
    index = postings.write_index(pages, ["body"], scratch(spark, "index"))
    asked = spark.createDataFrame([(26 * i + j, [words[i], words[j]]) for i in range(26) for j in range(i)], "search_id int, terms array<string>")
    before = shuffled(spark)
    assert postings.search_many(index, asked, 2).count() == 325 * 2
    assert shuffled(spark) - before < 20_000  # 325 searches meet more than 90,000 pages


def test_query_rules_do_not_shuffle_the_places_of_their_terms(spark):
    from factflow.operators.detect import query_rule_findings, query_rules

    pages = spark.createDataFrame([(k, 0, f"All rights reserved by w{k} of the firm. More.") for k in range(3000)], "url_id long, scope int, body_text string").coalesce(2)
    index = postings.write_index(pages, ["body_text"], scratch(spark, "index"))
    rules = spark.createDataFrame([(1, "r", None, "high", "MIT", 7, ["rights reserved", "of the"])], "rule_id int, slug string, category string, severity string, correct_value string, product_id int, search_terms array<string>")
    answers = spark.createDataFrame([(1, k, "mismatch") for k in range(4)], "rule_id int, url_id long, answer string")
    before = shuffled(spark)
    found = query_rule_findings(query_rules(index, pages, rules, answers, 3)).collect()
    assert sorted((r.url_id, r.title, r.expected, r.evidence) for r in found) == [(k, "rule:r", "MIT", f"All rights reserved by w{k} of the firm. More.") for k in range(3)]
    assert shuffled(spark) - before < 1000


def test_texts_alone_are_enough_for_many_searches(spark):
    rows = corpus(seed=4, n=60)
    pages = spark.createDataFrame(rows, "url_id long, scope int, body string, title string")
    index = postings.write_texts(pages, ["body", "title"], scratch(spark, "index"))
    asked = spark.createDataFrame([(0, ["la la", "the"])], "search_id int, terms array<string>")
    got = postings.search_many(index, asked, 5).collect()
    for scope in range(3):
        same([(r.url_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.scope == scope], brute(rows, ["la la", "the"], 5, scope))
    full = postings.write_blocks(index, spark)
    same([tuple(r) for r in postings.search(full, spark, ["la la", "the"], 5, 1).collect()], brute(rows, ["la la", "the"], 5, 1))


def test_texts_are_not_shuffled_for_the_best_pages(spark):
    from factflow.plans import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["run_fact_counts"](spark, "/root/testdata/sf0.001")
        plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"BroadcastHashJoin .*LeftSemi", plan) and not re.search(r"SortMergeJoin .*LeftSemi", plan)


def test_empty_index(spark):
    none = spark.createDataFrame([], "url_id long, scope int, body string")
    index = postings.write_index(none, ["body"], scratch(spark, "index"))
    assert index.pages == 0
    index = postings.write_index(spark.createDataFrame([(1, 1, None)], "url_id long, scope int, body string"), ["body"], scratch(spark, "index"))
    assert index.pages == 1


def test_an_index_of_many_parts_moves_texts_once_and_broadcasts_few_kinds(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def seen(self, path, *args, **kind):
        if path.endswith("/postings"):
            plans.append(spark.sparkContext._jvm.PythonSQLUtils.explainString(self._df._jdf.queryExecution(), "simple"))
        return write(self, path, *args, **kind)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    rows = corpus(seed=2)
    pages = spark.createDataFrame(rows, "url_id long, scope int, body string, title string").repartition(3)
    for part, kinds in ((100, 1 << 16), (100, 0)):  # many parts, many files a bucket; kinds joined by a shuffle
        monkeypatch.setattr(postings, "PART_TOKENS", part)
        monkeypatch.setattr(postings, "KINDS", kinds)
        index = postings.write_index(pages, ["body", "title"], scratch(spark, "index"), buckets=2, chunk=4)
        same([tuple(r) for r in postings.search(index, spark, ["license", "of the", "w5"], 9).collect()], brute(rows, ["license", "of the", "w5"], 9))
        want = {}
        for _, _, *texts in rows:
            for field, ts in zip(("body", "title"), map(toks, texts), strict=True):
                for t in set(ts):
                    n, df = want.get((field, t), (0, 0))
                    want[field, t] = n + ts.count(t), df + 1
        assert {(r.field, r.token): (r.n, r.df) for r in postings.field_counts(index.blocks(spark), ["body", "title"]).collect()} == want
    assert len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plans[0])) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_folding_equals_decomposition():
    for c in map(chr, range(0x80, 0x10000)):
        parts = unicodedata.normalize("NFD", c)
        if unicodedata.category(c).startswith("L") and len(parts) > 1 and all(map(unicodedata.combining, parts[1:])):
            assert c.translate(search._FOLD) == parts[0]
    assert search.fold("Ő ş Ž ấ é Ünder_score") == ["o", "s", "z", "a", "e", "under", "score"]


def test_lines_hold_the_tokens(spark):
    texts = [None, "", " .", "A b-C_9", "  The END. ", "Ő ş Ž Tiếng Việt é Ünder_score ΆΣ 中文 x2", "½ ² İx ẞ ŉ \u0301a", "a\u00a0b\u2003c"]
    low = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("low", search.lowered(F.col("t")))
    for r in low.select("t", search.line(F.col("low")).alias("line"), search.tokens(F.col("t")).alias("ts")).withColumn("n", search.words_of(F.col("line"))).collect():
        assert r.line == " ".join(r.ts) and r.n == len(r.ts)


def test_tokens_fold_marks(spark):
    text = "Ő ş Ž Tiếng Việt é Ünder_score ΆΣ 中文 x2"
    assert spark.createDataFrame([(text,)], "t string").select(search.tokens(F.col("t"))).first()[0] == search.fold(text)


@pytest.mark.parametrize("held, most", [(1 << 16, 1 << 20), (7, 1 << 20), (7, 5)])
def test_best_rows_match_brute_force(spark, monkeypatch, held, most):
    monkeypatch.setattr(best, "HELD", held)
    monkeypatch.setattr(best, "MOST", most)
    rng = random.Random(held)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([1, 2]), rng.randint(0, 9) / 2, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, h int, v double, k int").repartition(3)
    want = set()
    for key in {(g, h) for g, h, _, _ in rows}:
        some = sorted((-v, k) for g, h, v, k in rows if (g, h) == key)[:4]
        want |= {(*key, -v, k, r) for r, (v, k) in enumerate(some, 1)}
    assert {tuple(r) for r in best.best_of(df, ["g", "h"], [("v", False), ("k", True)], 4, "rank").collect()} == want
    assert best.best_of(df.where("false"), ["g"], [("k", True)], 2).count() == 0
