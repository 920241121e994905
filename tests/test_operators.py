"""Properties and golden cases of the library's own operators."""

from pyspark.sql import functions as F

from factflow.functions import text as X
from factflow.operators import filters, graph, pages, state
from factflow.sources import landed

SCHEMA = "issue_id long, source_id int, url_id long, category string, title string, related_url_id long, severity string, detail string, evidence string, expected string, matched_value string, status string, detected_at string, deleted_at string, last_checked_at string"


def finding(i, **more):
    row = dict(issue_id=i, source_id=1, url_id=1, category="faq", title="a:b", related_url_id=0, severity="high", detail="d", evidence="e", expected="x", matched_value="m", status="open", detected_at="2024-01-01", deleted_at=None, last_checked_at=None)
    return tuple((row | more).values())


def test_rule_names_of_titles(spark):
    titles = ["database_size:stale", "llm:language_count:abc", "lang_ctx:all documents:29", "plain"]
    got = spark.createDataFrame([(t,) for t in titles], "t string").select(X.fact_rule_of(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == ["database_size", "llm:language_count", "lang_ctx:all documents", "plain"]


def test_sentence_ends_skip_decimals_and_take_cjk(spark):
    text = "We have 17.5 million. It costs 17. 5 euro! 完了。Next"
    ends = spark.createDataFrame([(text,)], "t string").select(X.sentence_ends(F.col("t")).alias("e")).first().e
    assert [text[:k][-1] for k in ends] == [".", "!", "。"]


def test_evidence_holds_its_match_and_stays_short(spark):
    rows = [(k, "word " * k + "the claim of 29 languages stands. " + "tail " * k) for k in (0, 3, 40, 400)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = X.with_evidence(df, "t", F.instr("t", "29 languages") - 1, F.instr("t", "29 languages") + 11).collect()
    assert all("29 languages" in r.evidence and len(r.evidence) <= 302 for r in got)


def test_merging_twice_changes_nothing(spark):
    old = spark.createDataFrame([finding(1), finding(2, url_id=2, status="ignored"), finding(3, url_id=3, deleted_at="2024-02-02"), finding(4, url_id=4, deleted_at="2024-02-02", evidence=None)], SCHEMA)
    new = spark.createDataFrame([finding(5, evidence="other"), finding(6, url_id=2), finding(7, url_id=3, evidence="other"), finding(8, url_id=4), finding(9, url_id=9)], SCHEMA).withColumn("write_seq", F.col("issue_id"))
    once = state.merge_findings(old, new)
    twice = state.merge_findings(once, new)
    rows = {r.url_id: r for r in once.collect()}
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert (rows[1].evidence, rows[2].status, rows[3].deleted_at, rows[9].status) == ("other", "ignored", None, "open")
    assert (rows[4].status, rows[4].deleted_at) == ("open", "2024-02-02")


def test_collapse_leaves_no_true_duplicate(spark):
    df = spark.createDataFrame([finding(1, status="fixed"), finding(2, title="a:c", status="open", last_checked_at="z"), finding(3, evidence=None), finding(4, evidence=None, status="unclear"), finding(5, deleted_at="x")], SCHEMA)
    got = {r.issue_id: r for r in state.collapse_duplicates(df).collect()}
    assert set(got) == {1, 3, 5} and got[1].status == "open" and got[1].last_checked_at == "z"


def test_filter_groups_fold_from_the_left(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "x", "u"), ("b", "y", "v")], "category string, severity string, status string")
    model = {"groups": [{"mode": "all", "field": "category", "values": ["a"]}, {"mode": "any", "field": "severity", "values": ["y"]}, {"mode": "none", "field": "status", "values": ["w"]}]}
    assert df.where(filters.compile_model(model, filters.FINDINGS)).count() == 1  # the null status is dropped by NOT as well
    assert df.where(filters.compile_model({"groups": []}, filters.FINDINGS)).count() == 3


def test_groups_of_a_long_chain(spark):
    edges = spark.range(60).where("id % 20 <> 19").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.groups(edges).groupBy("group").count().collect()
    assert sorted(r["count"] for r in got) == [20, 20, 20]
    assert graph.groups(edges.where("false")).count() == 0


def test_sitemaps_and_lists(spark, tmp_path):
    xml = '<urlset xmlns:xhtml="x"><url><loc> http://a/ </loc><xhtml:link rel="ALTERNATE" href="http://b/"/><xhtml:link rel="next" href="n"/></url><url><lastmod>1</lastmod></url></urlset>'
    import gzip

    (tmp_path / "s.xml.gz").write_bytes(gzip.compress(xml.encode()))
    assert [tuple(r) for r in landed.sitemap_files(spark, str(tmp_path)).collect()] == [("http://a/", None, ["http://b/"])]
    texts = spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "k int, xml string")
    assert [tuple(r) for r in landed.sitemap_texts(texts).collect()] == [(1, "http://a/", None, ["http://b/"])]
    lines = spark.createDataFrame([("# http://c",), (" HTTP://d ",), ('"http://e",1',), ("",), (None,), ('" http://f,""g"" ",x,y',), ("x,http://h",)], "value string")
    assert [r.url for r in landed.url_list(lines, csv=True).collect()] == ["HTTP://d", "http://e", 'http://f,"g"']
    assert [r.url for r in landed.url_list(lines).collect()] == ["HTTP://d"]


def test_pages_with_odd_markup(spark):
    html = "<title> T </title><nav>no</nav><div>a<p>b<br>c</div><section>longer text here</section><dl><dt>q</dt><dd>a</dd></dl>"
    title, h1, _, _, _, _, body, _, faqs = pages.page(html)
    assert (title, h1, body, faqs) == ("T", [], "longer text here", [("q", "a", "visible")])
    df = spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")
    assert [r.body for r in pages.extract(df).collect()] == ["", ""]


def test_deletion_takes_all_that_hangs_on_a_row(spark):
    import pytest as pt

    from factflow.operators import cascade as D

    keys = (D.Key("page", "site", "site", "id"), D.Key("rule", "site", "site", "id"), D.Key("hit", "page", "page", "id"), D.Key("hit", "rule", "rule", "id"), D.Key("note", "hit", "hit", "id"))
    assert D.parents_first(keys) == ["site", "page", "rule", "hit", "note"]
    with pt.raises(ValueError):
        D.parents_first([D.Key("a", "b", "b", "id"), D.Key("b", "a", "a", "id")])
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    tables = {
        "site": make([(1, "x"), (2, "y"), (None, "z")], "id int, name string"), "page": make([(10, 1), (11, 2), (12, None), (13, 9)], "id int, site int"), "rule": make([(20, 1), (21, None)], "id int, site int"),
        "hit": make([(30, 10, 20), (31, 11, 20), (32, 11, 21), (33, 12, None), (34, 10, 21), (35, 99, None)], "id int, page int, rule int"), "note": make([(40, 30), (41, 31), (42, 32), (43, None), (44, 34)], "id int, hit int"), "other": make([(1,)], "id int"),
    }
    left, gone = D.delete(tables, "site", F.col("id") == 1, keys)
    ids = lambda some: {n: sorted(r.id for r in df.collect() if r.id is not None) for n, df in some.items()}
    assert ids(gone) == {"site": [1], "page": [10], "rule": [20], "hit": [30, 31, 34], "note": [40, 41, 44]}
    assert ids(left) == {"site": [2], "page": [11, 12, 13], "rule": [21], "hit": [32, 33, 35], "note": [42, 43]}
    assert left["site"].count() == 2
    assert {r.part: r.n for r in D.orphans(left, keys).collect()} == {"page.site": 1, "rule.site": 0, "hit.page": 1, "hit.rule": 0, "note.hit": 0}
    same, none = D.delete(tables, "site", F.col("id") == 7, keys)
    assert not any(ids(none).values()) and {n: len(v) for n, v in ids(same).items()} == {"site": 2, "page": 4, "rule": 2, "hit": 6, "note": 5}


def test_saved_filters_select_as_single_ones_do(spark, monkeypatch):
    import json
    import random

    import pytest as pt

    rng = random.Random(3)
    value = {"category": lambda: rng.choice("abc"), "url": lambda: rng.choice(["x", "y1", "%"]), "not_url": lambda: rng.choice(["x", "2"]), "detected_at": lambda: rng.choice(["2024-02|", "|2024-05", "|", "2024-03|2024-04"]), "unknown": lambda: "q"}
    models = {k: {"groups": [{"mode": rng.choice(["all", "any", "none"]), "field": (f := rng.choice(list(value))), "values": [value[f]() for _ in range(rng.randint(0, 3))]} for _ in range(rng.randint(0, 4))]} for k in range(60)}
    saved = [(k, json.dumps(m)) for k, m in models.items()] + [(100, "broken"), (101, None), (102, "[1]"), (103, '{"groups": []}')]
    rows = [(k, rng.choice(["a", "b", None]), rng.choice(["x/y1", "y2", None]), rng.choice([None, "2024-01-05", "2024-03-09", "2024-05-31T10:00:00"])) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, category string, url string, detected_at string")
    table = spark.createDataFrame(saved, "filter_id int, model string")
    got = {r.k: set(r.filter_ids) for r in filters.with_saved_filters(df, table, filters.FINDINGS).collect()}
    want = {k: set() for k in range(40)}
    for i, m in [*models.items(), (101, {}), (103, {})]:
        for r in df.where(filters.compile_model(m, filters.FINDINGS)).collect():
            want[r.k].add(i)
    assert got == want
    counts = {r.filter_id: r.n for r in filters.saved_filter_counts(df, table, filters.FINDINGS).collect()}
    assert counts == {i: sum(i in w for w in want.values()) for i, _ in saved} and 0 < sum(counts.values())
    assert {tuple(r) for r in filters.saved_filter_counts(df.where("false"), table, filters.FINDINGS).collect()} == {(i, 0) for i, _ in saved}
    assert filters.saved_filter_counts(df, table.where("false"), filters.FINDINGS).count() == 0
    monkeypatch.setattr(filters, "MOST_FILTERS", 5)
    with pt.raises(ValueError):
        filters.saved_models(table)


def test_counts_of_more_filters_than_a_plan_holds(spark, monkeypatch):
    import json

    monkeypatch.setattr(filters, "MOST_FILTERS", 5)
    groups = lambda k: [{"mode": "any", "field": "category", "values": [f"c{k % 50}", 7]}, {"mode": "none", "field": "url", "values": [f"/{k % 3}"]}, {"mode": "any", "field": "detected_at", "values": ["|", f"2024-0{k % 9 + 1}|"]}]
    table = spark.createDataFrame([(k, json.dumps({"groups": groups(k)})) for k in range(400)], "filter_id int, model string")
    rows = [(f"c{k % 60}" if k % 7 else None, f"x/{k % 4}", f"2024-0{k % 9 + 1}-05" if k % 5 else None) for k in range(90)]
    df = spark.createDataFrame(rows, "category string, url string, detected_at string")
    counts = {r.filter_id: r.n for r in filters.saved_filter_counts(df, table, filters.FINDINGS).collect()}
    assert len(counts) == 400
    for k in (0, 7, 31, 52, 399):
        assert counts[k] == df.where(filters.compile_model({"groups": groups(k)}, filters.FINDINGS)).count()


def test_pages_are_parsed_a_few_at_a_time():
    import pandas as pd

    frames = list(pages.parsed(iter([pd.DataFrame({"page_id": range(1000), "html": ["<title>t</title><p>x"] * 1000})])))
    assert max(map(len, frames)) <= pages.STEP and [i for f in frames for i in f["page_id"]] == list(range(1000))


def test_matches_are_held_a_few_texts_at_a_time():
    import pyarrow as pa

    from factflow.operators import patterns

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["of the"] * 1000)], names=["url_id", "body_text"])
    for carried in (True, False):
        out = list(patterns._found([("the", 9)], "body_text", carried)(iter([batch])))
        assert max(b.num_rows for b in out) <= patterns.STEP and sum(b.num_rows for b in out) == 1000
        assert ("body_text" in out[0].schema.names) == carried


def test_landed_files_grow_in_number():
    from factflow.plans import sites

    for rows in (0, 400, 20_000, 100_001, 6_000_000):
        n = sites.landing_files(rows)
        assert n % 2 == 0 and n >= 4 and rows / n <= sites.ROWS_A_FILE


def test_optional_end_tags():
    def pairs(html):
        return [p[:2] for p in pages.page(html)[-1]]

    assert pairs("<dl><dt>Q1<dd>A1<dt>Q2<dd>A2</dl>") == [("Q1", "A1"), ("Q2", "A2")]
    tree = lambda html: shape(parsed(html).root)

    def parsed(html):
        t = pages._Tree()
        t.feed(html)
        t.close()
        return t

    def shape(node):
        inside = "".join(p if isinstance(p, str) else shape(p) for p in node.parts)
        return f"{node.tag}({inside})" if node.tag else inside

    assert tree("<p>a<p>b<div>c</div>d") == "p(a)p(b)div(c)d"
    assert tree("<p>a<span>b<ul><li>c<li>d<ul><li>e</ul>f<li>g</ul>h") == "p(aspan(b))ul(li(c)li(dul(li(e))f)li(g))h"
    assert tree("<table><tr><td>1<td>2<tr><th>3<td><table><tr><td>x</table>4<tbody><tr><td>5</table>6") == "table(tr(td(1)td(2))tr(th(3)td(table(tr(td(x)))4))tbody(tr(td(5))))6"
    assert tree("<select><option>a<option>b<optgroup><option>c<optgroup><option>d</select>e") == "select(option(a)option(b)optgroup(option(c))optgroup(option(d)))e"
    assert tree("<div><table><tr><td>a</div>b</table>c</div>d") == "div(table(tr(td(ab)))c)d"
    assert tree("<button><p>a<div>b</button>c") == "button(p(a)div(b))c"
    assert tree("<dl><div><dt>a<dd>b</div><dt>c</dl>") == "dl(div(dt(a)dd(b))dt(c))"
    assert tree("a<br/>b<div/>c</div>d") == "abr()bdiv(c)d"


def test_links_resolve_as_browsers_do(spark):
    from urllib.parse import urljoin

    from factflow.functions.urls import resolve

    bases = ["http://a/b/c/d;p?q", "https://www.x.com", "https://www.x.com/", "https://x.com/a/b/?k=1#f", "http://x.com/a?b/c"]
    refs = "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x . ./ .. ../ ../g ../.. ../../ ../../g ../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/../y g?y/../x g#s/./x http://g/../a //h.com/../x/. mailto:a@b.c tel:1 ? /%C3%A9/é/.. HTTP://B/x http:g http:/g/.. https:?z".split() + ["", "  /sp ace ", "a b"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for x in rows.select("b", "r", resolve(F.col("b"), F.col("r")).alias("x")).collect():
        assert x.x == urljoin(x.b, x.r.strip()).split("#")[0], (x.b, x.r)


def test_links_of_pages(spark):
    html = """<base href="/deep/er/"><!-- <a href="/no"> --><script>"<a href='/no'>"</script><a href='x?a=1&amp;b=2#f'>1</a><A HREF=../y>2</A><a name=n>3</a><a href="">4</a>
    <a href="//sub.site.com/z">5</a><a href="https://other.com/">6</a><a href="mailto:a@site.com">7</a><a href="https://admin.site.com/p">8</a><a href="../y#q">9</a>"""
    df = spark.createDataFrame([(1, "https://www.site.com/a/b", html), (2, "https://site.com/", None), (3, None, html)], "page_id long, url string, html string")
    top, deep = "https://www.site.com/a/", "https://www.site.com/deep/"
    assert {tuple(r)[::2] for r in pages.links(df, ["admin.site.com"]).collect()} == {(1, top + "x?a=1&b=2"), (1, "https://www.site.com/y"), (1, "https://sub.site.com/z")}
    assert {r.link for r in pages.links(df, ["ADMIN.site.com"], heed_base=True).collect()} == {deep + "er/x?a=1&b=2", deep + "y", "https://sub.site.com/z"}
    assert pages.links(df.where("false")).count() == 0


def test_a_thousand_rules_in_one_scan(spark):
    """Patterns of words and real expressions, with contexts, against plain regular expressions."""
    import random
    import re

    from factflow.operators import detect as K

    rng = random.Random(2)
    words = ["".join(rng.choices("abcde", k=3)) for _ in range(150)]
    rules = []
    for k in range(1000):
        stale = [" ".join(rng.choices(words, k=rng.choice([1, 2])))] if k % 10 else [rf"{rng.choice(words)}\s+(?:x|{rng.choice(words)})"]
        current = [rng.choice(words)] if k % 3 == 0 else []
        rules.append(K.Rule(k, f"r{k}", stale, current, [rng.choice(words)] if k % 4 == 0 else [], [rng.choice(words)] if k % 5 == 0 else [], window=rng.choice([5, 30]), english_only=k % 7 == 0))
    bodies = [(k, "en" if k % 2 else "de", " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, k=rng.choice([0, 20, 120])))) for k in range(30)]
    want = {}
    for url_id, locale, body in bodies:
        for r in rules:
            if r.english_only and locale != "en":
                continue
            hits = []
            for kind, some in enumerate((r.stale, r.current)):
                for place, p in enumerate(some):
                    for m in re.finditer(p, body, re.I):
                        seg = body[max(0, m.start() - r.window) : m.end() + r.window]
                        if (not r.required or any(re.search(x, seg, re.I) for x in r.required)) and not any(re.search(x, seg, re.I) for x in r.allowed):
                            hits.append((kind, place, m.start(), m.end(), m[0]))
            if hits:
                want[r.rule_id, url_id] = min(hits)
    df = spark.createDataFrame(bodies, "url_id long, locale string, body_text string")
    got = {(h.rule_id, h.url_id): (int(h.verdict == "positive"), h.start, h.end, h.value) for h in K.stale_scan(df, rules).collect()}
    assert got == {k: (h[0], *h[2:]) for k, h in want.items()} and len(got) > 500
    assert K.stale_scan(df, rules[:0]).count() == 0 and K.stale_scan(df.where("false"), rules).count() == 0


def test_patterns_match_as_expressions_do(spark, monkeypatch):
    """Words in one automaton (or several), expressions in alternations, against one expression at a time."""
    import random
    import re

    from factflow.operators import patterns

    rng = random.Random(4)
    words = ["aa", "a a", "ab", "bab", "b", "éa", "ΣΑ", "ß", "Straße", "i", "k", "ab ab", "x" * 30]
    real = [r"(a)\1", r"b+a", r"a{3,}", r"[ab]é", r"a|xyz", r"\bk\b"]
    texts = ["".join(rng.choices(["a", "b", " ", "A", "B", "é", "É", "σα", "ΣΑ", "ß", "STRASSE", "straße", "k", "\u212a", "i"], k=rng.randint(0, 40))) for _ in range(60)] + ["", None, "aaaa AAAA", "x" * 95]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, body_text string").repartition(3)
    asked = spark.createDataFrame([(p, 3) for p in words + real] + [("ab", 1), ("", 9), (None, 2)], "pattern string, reach int")
    want = {}
    for k, t in enumerate(texts):
        for p in words + real:
            found = [(m.start(), m.end(), m[0], t[max(0, m.start() - 3) : m.end() + 3], max(0, m.start() - 3)) for m in re.finditer(p, t or "", re.I) if p]
            if found:
                want[k, p] = found
    for most in (200_000, 4):
        monkeypatch.setattr(patterns, "PER_AUTOMATON", most)
        got = {(r.k, r.pattern): [tuple(m) for m in r.matches] for r in patterns.pattern_matches(df, asked).collect()}
        assert got == want
    assert patterns.pattern_matches(df, asked.where("false")).count() == 0 and patterns.pattern_matches(df.where("false"), asked).count() == 0
    held = df.where("k = 62").select(*[patterns.holds(F.col("body_text"), F.array(F.lit(p))).alias(p) for p in ("AA a", "b", "a{4}", "é")]).first()
    assert tuple(held) == (True, False, True, False)


def test_many_matches_of_one_text(spark):
    import re

    text = "ab12 c3 ddd4567 " * 500 + "9"
    df = spark.createDataFrame([(text,), ("",), ("none",), (None,), ("7",)], "t string")
    got = [r.m for r in df.select(X.regex_matches(F.col("t"), r"\d+").alias("m")).collect()]
    assert [[(m.start, m.end, m.value) for m in g or []] for g in got] == [[(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", t or "")] for t in (text, "", "none", None, "7")]


def test_batches_are_numbered_across_ranges(spark):
    from factflow.operators import snapshots

    rows = [(k % 3, u) for k in range(3) for u in range(k, 9000, 7)]
    got = snapshots.batches(spark.createDataFrame(rows, "r int, u long"), "r", "u", 10, width=500).collect()
    for r in range(3):
        own = sorted(u for k, u in rows if k == r)
        assert {(x.u, x.batch) for x in got if x.r == r} == {(u, k // 10) for k, u in enumerate(own)}


def test_edits_keep_the_first_snapshot(spark):
    rows = spark.createDataFrame([(1, "high", "faq", "x", None, False, None), (2, "low", "faq", None, None, None, None)], "issue_id long, severity string, category string, expected string, note string, edited boolean, original_snapshot string")
    kept = ("severity", "category", "expected")
    once = state.edit(rows, spark.createDataFrame([(1, "low"), (9, "low")], "issue_id long, severity string"), "issue_id", kept)
    twice = state.edit(once, spark.createDataFrame([(1, "medium")], "issue_id long, severity string"), "issue_id", kept)
    got = {r.issue_id: r for r in twice.collect()}
    assert (got[1].severity, got[1].edited, got[1].original_snapshot) == ("medium", True, '{"severity":"high","category":"faq","expected":"x"}')
    assert (got[2].severity, got[2].edited, got[2].original_snapshot) == ("low", False, None)


def test_fetched_bytes_are_known_by_their_content(spark):
    import gzip

    docs = spark.createDataFrame([(1, bytearray(gzip.compress(b"<a/>"))), (2, bytearray(b"<b/>")), (3, None), (4, bytearray(b"\x1f\x8bbroken"))], "k int, xml binary")
    assert [(r.k, r.xml) for r in landed.unpacked(docs, "xml").orderBy("k").collect()] == [(1, "<a/>"), (2, "<b/>"), (3, None), (4, None)]


def test_authors_and_answers_of_every_form(spark):
    html = [
        '<script type="application/ld+json">{"@type":"Question","name":"q?","acceptedAnswer":"plain <b>text</b>"}</script><script type="application/ld+json">[{"@type":"BlogPosting","author":["By Ann, Editor",{"name":"Bo"},[{"name":"ANN"}]]}]</script>',
        '<meta name="author" content="https://x"><div class="page-byline-x">Posted by: Cy | 3 May</div>',
        "<article>Intro. By Dee O'Neil-Smith and others</article><details>no summary</details>",
        '<script type="application/ld+json">{broken</script><meta name="author" content=" ">',
    ]
    got = pages.extract(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).orderBy("page_id").collect()
    assert [r.author for r in got] == ["Ann; Bo", "Cy", "Dee O'Neil-Smith", None]
    assert [tuple(f) for f in got[0].faqs] == [("q?", "plain text", "jsonld")] and not got[2].faqs


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from factflow.sources.folders import shared_folder

    conf = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d))))


def test_texts_that_come_with_their_responses_are_not_shuffled(spark):
    from factflow.operators import detect as K

    said = lambda q: '{"items":[{"quote":"' + q + '","is_real_issue":true,"category":"positioning"}]}'
    rows = [(1, said("of the"), "end of the day"), (2, said("of the"), None), (3, said("never"), "end of the day"), (4, said(""), "x"), (5, said("."), "a. b"), (6, None, "y")]
    responses = spark.createDataFrame(rows, "url_id long, raw string, body_text string")
    got = K.reviewed(responses)
    joined = K.reviewed(responses.select("url_id", "raw"), responses.select("url_id", "body_text"))
    assert sorted(got.collect()) == sorted(joined.collect()) and sorted(r.url_id for r in got.collect()) == [1, 5]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
