"""Near duplicates, repeated passages, decontamination: brute force and edge cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from factflow.llm import components, decontam, minhash, repeats, rlz, suffix
from factflow.llm import vectext as V

DOCS = "/root/testdata/sf0.001/documents.parquet"


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, id int, key string").withColumnRenamed("key", "core")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets if i is not None}


def near_copies():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(6):
        text = [rng.choice(words) for _ in range(rng.choice([4, 60, 200]))]
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 10 * base, " ".join(copy)))
    return [*rows, (900, None), (901, ""), (902, "  \n"), (903, "One two"), (904, "one  TWO"), (905, "x " * 50000), (906, "x " * 50000), (907, "Ä\u00a0b É\x1cf ü"), (908, "Ä\u00a0B É\x1cf ü"), (909, "ä\u00a0b É\x1cf ü")]


def test_components_match_brute_force(spark):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_given_documents_match_brute_force(spark):
    t = pq.read_table(DOCS, columns=["doc_id", "text"])
    rows = list(zip(*t.to_pydict().values(), strict=True))
    assert any(not x.isascii() for _, x in rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(table(spark, []).where("false")).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "q r s t u v"), (3, "other words of this row here")]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("3", "3", True), ("None", "None", True)]


def test_a_key_far_over_the_block_size(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_a_large_key_of_texts_with_a_common_part(spark, monkeypatch):
    """Texts that share seven tenths meet in a key, but not under their rarest shingles; copies among them are linked."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng, near = random.Random(6), []
    common, rows = [f"c{k}" for k in range(140)], []
    for k in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((1000 - k, " ".join(common + own)))
        if k % 5 == 0:
            for at in (3, 30, 57)[: 1 + k % 3]:
                rows.append((2000 + len(rows), " ".join(common + own[:at] + ["edited"] + own[at + 1 :])))
    rows += [(1, "a b c d e f"), (1, rows[0][1]), (None, rows[0][1]), (3, None)]
    whole = minhash._in_large_keys

    def seen(hot, roots, sets, percent):
        rare = minhash._rarest(hot, percent)
        near.append((hot.count(), rare.groupBy("key").count().agg(F.max("count")).first()[0]))
        return whole(hot, roots, sets, percent)

    monkeypatch.setattr(minhash, "_in_large_keys", seen)
    got = {}
    for r in minhash.near_duplicates(table(spark, rows)).where("doc_id IS NOT NULL AND doc_id <> 1").collect():
        got[r.doc_id] = (r.n_shingles, r.component_id)
    want = brute_components([r for r in rows if r[0] not in (1, None)])
    one = want[1000][1]
    want = {i: (n, 1 if c == one else c) for i, (n, c) in want.items()}  # document 1 repeats the text of 1000 in one of its rows
    assert got == want
    assert near and near[0][0] > 150 and near[0][1] < 16, near


def test_a_large_key_of_texts_just_below_the_threshold(spark, monkeypatch):
    """Copies of one text with an edit each are not linked unless their edits meet; those pairs are not joined with their sets."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng, pairs = random.Random(3), []
    words, rows = [f"c{k}" for k in range(120)], []
    for k in range(150):
        at = rng.randrange(5, 115)
        rows.append((k, " ".join([*words[:at], f"e{k}", *words[at + 1 :]])))
    whole = minhash._confirmed

    def seen(near, sets, percent):
        pairs.append(near.count())
        return whole(near, sets, percent)

    monkeypatch.setattr(minhash, "_confirmed", seen)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert max(pairs) < 16 * len(rows), pairs


def test_links_of_a_group_are_those_of_its_pairs():
    rng = np.random.default_rng(4)
    for _ in range(60):
        middle = rng.choice(10**6, rng.integers(5, 60), replace=False)
        sets = [np.unique(np.concatenate((rng.permutation(middle)[: rng.integers(1, len(middle) + 1)], rng.integers(0, 40, rng.integers(0, 6))))) for _ in range(rng.integers(2, 40))]
        n, c = np.array([len(s) for s in sets]), np.arange(len(sets))
        for a, b in minhash._linked(np.concatenate(sets), n, c, lambda k, m=len(sets): np.arange(k + 1, m), 85):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= 85 * (n[a] + n[b] - both)
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                assert c[a] == c[b] or 100 * both < 85 * (n[a] + n[b] - both)


def test_pigeonhole_guarantee():
    """Any two signatures at distance of at most 2 * CHUNKS - 1 share a key."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, minhash.KEYED, dtype=np.uint64)
        b = a.copy()
        at = rng.choice(minhash.KEYED, 2 * minhash.CHUNKS - 1, replace=False)
        b[at] ^= np.uint64(1)
        keys = minhash._keys(np.stack([a, b]).reshape(2, minhash.CHUNKS, minhash.WIDTH)).reshape(2, -1)
        assert (keys[0] == keys[1]).any()


def test_components_of_a_path_and_a_star(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.range(101, 140).select(F.col("id").alias("a"), F.lit(100).cast("long").alias("b")))
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    assert components.components(edges.where("false")).count() == 0


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(2000):
        s = [rng.randint(0, rng.choice([0, 1, 3])) for _ in range(rng.randint(0, 24))]
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda k: s[k:])


def brute_repeats(rows, units, window):
    seen = {}
    for n, (_, t) in enumerate(rows):
        u = units(t)
        for k in range(len(u) - window + 1):
            seen.setdefault(tuple(u[k : k + window]), []).append((n, k))
    gone = [[False] * len(units(t)) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for n, k in places:
                gone[n][k : k + window] = [True] * window
    return gone


def passages():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(120)) for _ in range(3)]
    rows = []
    for k in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        if k % 3 == 0:
            s = shared[k % 2]
            lo = rng.randint(0, 200)
            parts += [s[lo : lo + rng.choice([380, 420, 500])], " ".join(word() for _ in range(20))]
        rows.append((k, "\n".join(parts)))
    return [*rows, (50, None), (51, ""), (52, "ab " * 900), (53, "ab " * 300), (54, rows[0][1]), (55, rows[0][1]), (None, shared[2]), (56, shared[2] + "x"), (57, "short"), (57, "short")]


@pytest.mark.parametrize("hot", [1, 10**6])
def test_repeated_bytes_match_brute_force(spark, hot):
    rows = passages()
    gone = brute_repeats(rows, lambda t: list((t or "").encode()), 400)
    want = sorted((str(i), len(g), sum(g), hashlib.sha256(bytes(b for b, x in zip((t or "").encode(), g, strict=True) if not x)).hexdigest()) for (i, t), g in zip(rows, gone, strict=True))
    got = suffix.digests(suffix.remove_repeats(table(spark, rows), hot=hot)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == want
    assert suffix.remove_repeats(table(spark, []).where("false"), hot=hot).count() == 0


@pytest.mark.parametrize(("window", "hot"), [(400, 10**6), (400, 1), (254, 10**6), (254, 1), (130, 20)])
def test_spans_of_any_window_match_brute_force(spark, window, hot):
    rng = random.Random(window)
    zeros = "".join(rng.choice("\x00\x01") for _ in range(700))
    rows = [*passages(), (60, zeros), (61, zeros[3:650]), (62, zeros[:500] + "\x00"), (63, zeros[:500]), (64, "\x00" * 900), (65, "é" * 450), (66, "a" * 20 + "é" * 300)]
    gone = brute_repeats(rows, lambda t: list((t or "").encode()), window)
    want = []
    for (i, t), g in zip(rows, gone, strict=True):
        kept = bytes(b for b, x in zip((t or "").encode(), g, strict=True) if not x)
        want.append((str(i), len(g), sum(g), sum(x and not y for x, y in zip(g, [False, *g], strict=False)), hashlib.sha256(kept).hexdigest()))
    got = suffix.digests(suffix.remove_repeats(table(spark, rows), hot=hot, window=window)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


@pytest.mark.parametrize(("window", "passage", "hot"), [(400, 254, 10**6), (400, 254, 1), (300, 130, 20)])
def test_passages_beside_windows_match_brute_force(spark, window, passage, hot):
    """One pass for two lengths: a passage of 51 short words is found, and removed only under a whole window."""
    rng = random.Random(passage)
    planted = " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(51))
    long = "".join(rng.choices("abc ", k=1100))
    rows = [*passages(), (70, "one " + planted + " two"), (71, "x" * 90 + planted), (72, long), (73, "y" + long[200:610]), (74, long[300:600]), (75, long[300:600]), (76, "é" * 450), (77, long[-401:]), (78, planted[:-1]), (79, "p" * 50 + long[500 : 490 + window]), (80, "q" * 60 + long[500 : 490 + window])]
    end = "".join(rng.choices("defg", k=window - 1))  # texts that end alike, too short for a window
    rows += [(81, "r" * 99 + end), (82, "s" * 70 + end)]
    units = lambda t: list((t or "").encode())
    want = []
    for (i, t), g, p in zip(rows, brute_repeats(rows, units, window), brute_repeats(rows, units, passage), strict=True):
        kept = bytes(b for b, x in zip(units(t), g, strict=True) if not x)
        want.append((str(i), len(g), sum(g), sum(x and not y for x, y in zip(g, [False, *g], strict=False)), hashlib.sha256(kept).hexdigest(), sum(p)))
    got = suffix.digests(suffix.remove_repeats(table(spark, rows), hot=hot, window=window, passage=passage)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_in_passages) for r in got) == sorted(want)
    assert all(r.n_in_passages >= len(planted) and r.n_removed == 0 for r in got if r.doc_id in (70, 71))


def test_hot_groups_of_many_cores_match_brute_force(spark, monkeypatch):
    """More hot cores than are looked for in place: the texts are shuffled for them."""
    monkeypatch.setattr(repeats, "HOT_CORES", 0)
    test_spans_of_any_window_match_brute_force(spark, 254, 1)


def test_a_large_group_takes_little_memory():
    """Thousands of stretches of one group, each with its own surroundings."""
    import tracemalloc

    rng = np.random.default_rng(0)
    n, s = 3000, suffix.SCHEME
    core = rng.integers(97, 123, s.core, dtype=np.uint8)
    around = rng.integers(97, 123, (n, s.spread - 1 + s.window), dtype=np.uint8)
    around[:, s.spread - 1 : s.spread - 1 + s.core] = core
    around[: n // 2, 100:700] = around[0, 100:700]
    g = repeats.Groups(np.zeros(n, np.int64), np.full(n, s.spread - 1), np.zeros(n, np.int64), np.ones(n, np.int64), around.reshape(-1), np.arange(n + 1) * around.shape[1])
    tracemalloc.start()
    rows, lo, hi = suffix.repeated_windows(g, s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(rows.tolist()) == list(range(n // 2))
    for got, first in ((-lo, s.spread - 1 - 100), (hi, 700 - s.spread + 1)):  # by chance, some neighbours of the shared part agree too
        assert first <= got.min() and got.max() < first + 9
    assert peak < 50 << 20


@pytest.mark.parametrize("hot", [1, 10**6])
def test_repeated_words_match_brute_force(spark, hot):
    rows = passages()
    words = lambda t: [w for w in __import__("re").split("[ \t-\r]+", t or "") if w]
    gone = brute_repeats(rows, words, 35)
    want = sorted((str(i), len(g), sum(g), " ".join(w for w, x in zip(words(t), g, strict=True) if not x)) for (i, t), g in zip(rows, gone, strict=True))
    got = rlz.remove_repeats(table(spark, rows), hot=hot).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == want


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    raw = np.frombuffer(bytes(random.Random(2).choices(b"abc ", k=9000)), np.uint8)
    bounds = np.array([0, 100, 8500, 9000])
    whole = repeats.anchors(V._CODES[False][raw], bounds, suffix.SCHEME)
    monkeypatch.setattr(repeats, "PIECE", 1500)
    cut = repeats.anchors(V._CODES[False][raw], bounds, suffix.SCHEME)

    def starts(found):
        return {(t, s, p) for t, p, a, b, _ in zip(*found, strict=True) for s in range(a, b + 1)}

    assert starts(whole) == starts(cut)


def test_stage_form_keeps_columns_and_whole_characters(spark):
    out = suffix.without_repeats(table(spark, passages()))
    assert out.columns == ["doc_id", "text", "id", "core"] and out.count() == len(passages())


def test_leaks_are_found_with_other_numbers_and_clean_text_is_not(spark):
    item = "A train leaves Paris at 9 km from the old station and meets Anna after 45 minutes of slow travel north"
    docs = [
        (1, "intro words here. " + item + " and more text behind it"), (2, item.upper()), (3, "before: " + item.replace("9", "12.5").replace("45", "70").replace("Paris", "Berlin") + " after"),
        (4, "a train of thought leaves the station and meets a friend"), (5, None), (6, ""), (7, item.replace("9", "45").replace("45 minutes", "3 minutes")), (None, item), (8, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"),
    ]
    bench = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "1 2 3 4 5 6 7 8 9 10", "x"), (10, "too short", "x")], "item_id long, text string, id string")
    for rows in (10**6, 0):
        got = decontam.contaminated(table(spark, docs), bench, broadcast_rows=rows).collect()
        assert {(r.doc_id, r.item_id) for r in got} >= {(1, 7), (3, 7), (None, 7)}
        assert not {r.doc_id for r in got} & {4, 5, 6, 8}
        assert {r.doc_id: r.changed for r in got}[3] and not {r.doc_id: r.changed for r in got}[1]
    assert decontam.contaminated(table(spark, []).where("false"), bench).count() == 0
    assert decontam.contaminated(table(spark, docs), bench.where("false")).count() == 0


def test_given_leaks_match_verbatim_search(spark):
    d = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    b = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pydict()
    want = {i for i, t in zip(d["doc_id"], d["text"], strict=True) if any(x in t for x in b["text"])}
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    got = {r.doc_id for r in decontam.contaminated(docs, bench).collect()}
    assert want <= got and len(got) <= len(want) + 2


@pytest.mark.parametrize("most", [10**6, 0])
def test_items_full_of_slots_and_short_ones(spark, most):
    """Questions dense in numbers are found with other numbers, short items and rows of numbers word for word only."""
    item, longer, equations = "Compute 12 + 34 * 5 - 6 for x = 7", "Add the numbers 3 5 7 11 13 17 19 23 29 31 37 41 and name their sum", "Solve 3 x + 4 y = 10 and 2 x - 5 y = 1"
    docs = [
        (1, f"see: {item}."), (2, f"see: {item.replace('34', '35')}"), (3, f"well, {longer} now"), (4, "3 5 7 11 13 17 19 23 29"), (5, None), (6, "first: Solve 8 x + 9 y = 30 and 7 x - 6 y = 15, then rest"),
        (7, "they ask: what is 2 + 2?"), (8, "what is 2 + 3"), (9, "numbers 5 6 7 8 9 10 11 12 13 14"), (10, "4 5 6 7 8 9 10 11 12"), (11, "Compute 1 + 1 * 1 - 1 for x = 1"), (12, "Solve 3 x + 3 y = 3 and 9 x - 3 y = 1"), (13, "2 + 2 is what"),
    ]
    bench = spark.createDataFrame([(1, item), (2, longer), (3, equations), (4, "What is 2 + 2"), (5, "5 6 7 8 9 10 11 12 13"), (6, "x"), (7, ""), (8, None)], "item_id long, text string")
    got = decontam.contaminated(table(spark, docs), bench, broadcast_rows=most, short_items=True).collect()
    assert {(r.doc_id, r.item_id) for r in got if not r.short} == {(r.doc_id, r.item_id) for r in decontam.contaminated(table(spark, docs), bench, broadcast_rows=most).collect()}
    # Document 12 asks with the same letters but not with a value for each value, document 11 with one value for several.
    assert sorted((r.doc_id, r.item_id, r.n_covered == r.n_tokens, r.changed, r.short) for r in got) == [
        (1, 1, True, False, False), (2, 1, True, True, False), (3, 2, True, False, False), (6, 3, True, True, False), (7, 4, True, False, True), (9, 5, True, False, True), (11, 1, True, True, False), (12, 3, True, True, False),
    ]


@pytest.mark.parametrize("most", [10**6, 0])
def test_verbatim_copies_are_found_in_any_case_and_place(spark, most):
    item = "A train leaves Paris at 9 km from the old station and meets Anna after 45 minutes of slow travel north"
    short, accents = "What is the boiling point there", "Où est né le poète Élie Ñandú de Бабель selon Ạnh"
    docs = [
        (1, item.upper()), (2, item.lower()), (3, "They asked What is the boiling point there and left"), (4, accents.upper()), (5, accents.lower()),
        (6, "A train leaves Paris on time and meets nobody at all"), (7, item.title()),
    ]
    bench = spark.createDataFrame([(7, item), (8, short), (9, accents)], "item_id long, text string")
    got = decontam.contaminated(table(spark, docs), bench, broadcast_rows=most).collect()
    assert sorted((r.doc_id, r.item_id, r.n_covered == r.n_tokens) for r in got) == [(1, 7, True), (2, 7, True), (3, 8, True), (4, 9, True), (5, 9, True), (7, 7, True)]


def brute_templates(docs, items):
    """Contaminated pairs by plain dictionaries of windows, for ASCII texts."""
    import re

    def read(text):
        out, last = [], 0
        for m in re.finditer(r"[0-9A-Za-z]+(?:(?<=[0-9])[.,](?=[0-9])[0-9A-Za-z]+)*", text):
            w = m[0]
            opens = not out or any(c in '.!?\n:;"|' for c in text[last : m.start()])
            kind = "N" if w[0].isdigit() else "U" if w.lower() in decontam.UNITS else "P" if not opens and re.match("[A-Z][a-z]", w) else None
            out.append((w.lower(), kind))
            last = m.end()
        return out

    def windows(tokens, width, verbatim):
        for k in range(len(tokens) - width + 1):
            part = tokens[k : k + width]
            yield k, tuple(w if verbatim or not kind else (kind,) for w, kind in part), [w for w, kind in part if kind]

    found = set()
    for item_id, text in items:
        item = read(text)
        width = min(decontam.WIDTH, len(item))
        if width < decontam.SHORTEST or all(kind for _, kind in item):
            continue
        asked = [(True, k, w, []) for k, w, _ in windows(item, width, True)] + [(False, k, w, s) for k, w, s in windows(item, width, False) if 0 < len(s) < width]
        for doc_id, body in docs:
            tokens, shifts = read(body), {}
            held = {v: {} for v in (True, False)}
            for v in held:
                for k, w, s in windows(tokens, width, v):
                    held[v].setdefault(w, []).append((k, s))
            for v, place, w, s in asked:
                for at, theirs in held[v].get(w, ()):
                    one = shifts.setdefault(at - place, (set(), set(), set()))
                    one[0].update(range(place, place + width))
                    one[1].update(range(place, place + width) if v else ())
                    one[2].update(() if v else zip(s, theirs, strict=True))
            # Verbatim windows bind the slots of the item to themselves.
            for v, place, w, s in asked:
                if v:
                    own = [x for x, kind in item[place : place + width] if kind]
                    for at, _ in held[True].get(w, ()):
                        shifts[at - place][2].update((x, x) for x in own)
            covered = set()
            for every, equal, pairs in shifts.values():
                covered |= every if len(pairs) == len({a for a, _ in pairs}) else equal
            if covered and len(covered) >= decontam.COVER * len(item):
                found.add((doc_id, item_id, len(covered)))
    return found


def test_templates_match_brute_force(spark):
    d = pq.read_table(DOCS, columns=["doc_id", "text"]).to_pydict()
    b = pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pydict()
    items = [(i, t) for i, t in zip(b["item_id"], b["text"], strict=True) if t.isascii()]
    items += [(10**6, "A train leaves Paris at 9 km from the old station and meets Anna after 45 minutes of slow travel north"), (10**6 + 1, "If 3 boxes hold 12 pens how many pens are in 7 boxes"), (10**6 + 2, "1 2 3 4 5 6 7 8 9")]
    docs = [(i, t) for i, t in zip(d["doc_id"], d["text"], strict=True) if t and t.isascii()]
    rng, more = random.Random(4), []
    for k, (_, text) in enumerate(items * 3):
        changed = "".join(c if not c.isdigit() or rng.random() < 0.5 else rng.choice("0123456789") for c in text)
        words = changed.split()
        if k % 3 == 0 and len(words) > 6:
            words[rng.randrange(len(words))] = "Other"
        more.append((10**7 + k, f"some words first. {' '.join(words)} and more"))
    docs += more
    want = brute_templates(docs, items)
    got = decontam.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_covered) for r in got} == want and len(want) > len(items)
