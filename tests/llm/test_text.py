"""Tokenizers, files, language, licences, quality, chat: reference results and edge cases."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factflow.llm import bpe, chat, langid, licenses, quality, tokenfiles
from factflow.llm.queries import ORACLES, QUERIES, vocabulary_file

DIR = "/root/testdata/sf0.001"
BYTES, WORDS = vocabulary_file("byte_bpe_50k.json"), vocabulary_file("word_bpe_49k.json")
ODD = [None, "", " ", "a<|endoftext|>b  c\n\n d\t\te  x\x1cy \u0085 z'sll 123abc 中文字 🎉 don't", "a" * 5000, "  lead", "trail  ", "ſ ﬁ İ ΣΑΣ é é ① ²    x", "\x00\x01"]


def table(spark, texts):
    return spark.createDataFrame([(k, t, 0, "z") for k, t in enumerate(texts)], "doc_id long, text string, id int, tokens string")


def given():
    return pq.read_table(f"{DIR}/documents.parquet", columns=["text"])["text"].to_pylist()


def fuzz(n=400):
    rng = random.Random(4)
    some = [*"abteh'.,!019 \n\t", " ", " ", "é", "中", "🎉", "\xa0", " ", "́", "Σ", "İ", "_"]
    return ["".join(rng.choices(some, k=rng.randint(1, 50))) for _ in range(n)]


def test_byte_bpe_equals_the_library(spark):
    texts = [*ODD, *given(), *fuzz()]
    t = Tokenizer.from_file(BYTES)
    got = bpe.decode(bpe.encode(table(spark, texts), BYTES), BYTES).collect()
    for r in got:
        want = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == t.decode(want, skip_special_tokens=False)
    assert bpe.encode(table(spark, [None]).where("false"), BYTES).count() == 0


def test_pairs_are_judged_as_the_merges_do():
    v = bpe.vocabulary(BYTES)
    rng = random.Random(5)
    pairs = [(rng.randrange(256, 50000), rng.randrange(256, 50000)) for _ in range(3000)]
    import numpy as np

    a, b = np.array(pairs).T
    whole = v.whole(a) & v.whole(b)
    for (x, y), ok, w in zip(pairs, v.compatible(a, b), whole, strict=True):
        if w:
            assert ok == (v.merged(v.bytes[x] + v.bytes[y]) == [x, y])


def test_token_files_round_trip(spark, tmp_path):
    texts = [*ODD, *given(), *fuzz()]
    t = Tokenizer.from_file(WORDS)
    docs = table(spark, texts)
    shards = tokenfiles.write(docs, f"file://{tmp_path}/a", WORDS)
    got = sorted(tokenfiles.read(shards).collect(), key=lambda r: r.doc_id)
    start = 0
    for r in got:
        ids = [int.from_bytes(r.tokens[k : k + 4], "little") for k in range(0, len(r.tokens), 4)]
        assert ids == [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.start == start
        start += len(ids)
    few = tokenfiles.read(shards, wanted=[3, 5]).collect()
    assert sorted(few) == [r for r in got if r.doc_id in (3, 5)]
    odd = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    again = tokenfiles.read(tokenfiles.write(odd, f"file://{tmp_path}/b", WORDS)).collect()
    assert [r.doc_id for r in sorted(again, key=lambda r: r.start)] == [None, 1, 1]
    assert tokenfiles.read(tokenfiles.write(odd.where("false"), f"file://{tmp_path}/c", WORDS)).count() == 0


def test_a_damaged_frame_is_noticed(tmp_path):
    data = bytearray(tokenfiles.shard_bytes([1, 2], [b"abcd" * 50, b"efgh" * 50]))
    import pyarrow as pa

    assert tokenfiles.Shard(pa.BufferReader(bytes(data))).tokens(1) == b"efgh" * 50
    s = tokenfiles.Shard(pa.BufferReader(bytes(data)))
    data[int(s.at[1]) + int(s.packed[1]) - 3] ^= 0xFF
    with pytest.raises(Exception):
        tokenfiles.Shard(pa.BufferReader(bytes(data))).tokens(1)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out AND lang_pred <> 'und'")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    model = langid.fit(docs.limit(0))
    odd = {r.doc_id: r for r in langid.predict(table(spark, ["abc", None, "12 3!"]), model).collect()}
    assert {r.lang_pred for r in odd.values()} == {"und"}


def test_a_prediction_does_not_depend_on_its_neighbours(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.fit(docs)
    together = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.predict(docs.coalesce(1), model).collect()}
    apart = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.predict(docs.repartition(50), model).collect()}
    assert together == apart


def test_licences(spark):
    texts = [
        "x ALL rights,reserved. cc-by cc by", None, "", "Licensed under the Apache License, Version 2.0.", "licence of apache", "General Public License general public license",
        "Released under the MIT License.", "all rights\nreserved" + " pad" * 30000, "this is licensed under the GNU General Public License, version 3.", "nothing to see",
    ]
    got = {r.doc_id: r for r in licenses.scan_corpus(table(spark, texts)).collect()}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for k, t in enumerate(texts):
        w = word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        places = sorted(p for phrase in licenses.BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split())
        assert (got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert set(filter(None, got[k].base_labels.split(","))) <= set(filter(None, got[k].labels.split(",")))
    assert got[0].base_labels == "cc-by,reserved" and got[3].labels == "apache-2.0" and got[6].labels == "mit" and got[8].labels == "gpl,gpl-3.0" and got[9].labels == "" and got[4].labels == ""
    assert licenses.scan_corpus(table(spark, texts).where("false")).count() == 0


def test_quality_counts_match_brute_force(spark):
    texts = [*ODD, *given(), "a b c a b c\n\n x \n x \nx", "# * $ % & | < >", "w " * 60]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in quality.judge(docs, None).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
        hit = {i + d for i, x in enumerate(windows) if x in twice for d in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    field = quality.fit(docs, labels)
    got = quality.judge(docs, field).join(labels, "doc_id").where("NOT base_failed")
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count()
    assert bad.where("NOT kept").count() >= 0.8 * bad.count()
    assert quality.fit(docs, labels.where("quality = 1")) is None
    assert quality.kept_rows(docs, field).count() == quality.judge(docs, field).where("kept").count()


def test_viterbi_matches_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    f = quality.Field(rng.normal(size=(quality.FEATURES, 2)), rng.normal(size=(2, 2)))
    x, bounds = rng.normal(size=(13, quality.FEATURES)), np.array([0, 5, 5, 6, 13])
    got, score = f.labels(x, bounds), x @ f.emission
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        paths = itertools.product((0, 1), repeat=hi - lo)
        best = max(paths, key=lambda p: sum(score[lo + k, s] for k, s in enumerate(p)) + sum(f.transition[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(got[lo:hi]) == best


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", r"a\b\\", "<s><s>", None, "", "[[INST]INST]", "<<SYS>><</SYS>>[SEP][OTHER]", "x" * 100000]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "tool", None, "a[SEP]\\<s>"], texts, strict=True))]
    rows += [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "assistant", "a"), (4, 0, "user", "q"), (4, 0, "user", "q"), (None, 5, "user", "n"), (None, None, "user", "m")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.segments(turns))).collect()}
    assert [(t.role, t.text) for t in got[1].turns_read] == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert list(got[1].loss_texts) == [texts[2], texts[4]] and not got[1].valid
    assert got[2].valid and not got[3].valid and not got[4].valid and got[4].n_turns == 2
    assert [t.text for t in got[None].turns_read] == ["m", "n"]
    assert "</s>[INST] ok" not in got[1].formatted
    assert chat.segments(turns.where("false")).count() == 0


def test_chat_equals_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DIR}/conversations.parquet'")
    cur = c.execute(ORACLES["op3_chat_format"])
    want = sorted(tuple(dict(zip([d[0] for d in cur.description], r, strict=True))[k] for k in sorted(d[0] for d in cur.description)) for r in cur.fetchall())
    df = QUERIES["op3_chat_format"](spark, DIR)
    assert sorted(tuple(r[k] for k in sorted(df.columns)) for r in df.collect()) == want


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in p.STAGES][0] == "quality rules"
    kept = p.quality_rules(spark, docs, DIR)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    unique = p.near_dedup(spark, kept, DIR)
    assert unique.columns == docs.columns and unique.count() <= kept.count()
    clean = p.decontamination(spark, unique, DIR)
    assert clean.columns == docs.columns and 0 < clean.count() < unique.count()
    assert p.run(spark, DIR).count() > 0


def test_pipeline_judges_rows_not_ids(spark):
    import corpus_pipeline as p

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, a), (None, b), (5, a), (3, a), (3, a), (3, b), (3, c), (7, c), (8, None), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = p.near_dedup(spark, docs, DIR)
    assert got.columns == docs.columns
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([(None, a), (None, b), (3, a), (3, b), (3, c), (8, None), (None, None)], "doc_id long, text string").collect()))

    item = pq.read_table(f"{DIR}/benchmark.parquet", columns=["text"])["text"][0].as_py()
    rows = [(None, f"before {item} after"), (None, b), (1, item), (1, a), (2, a), (None, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = p.decontamination(spark, docs, DIR).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, b), (1, a), (2, a), (None, None)]))


def test_a_file_keeps_all_its_licences(spark):
    notices = [f"{text}." for _, text, _ in licenses.TEMPLATES]
    whole = " Notice follows: ".join(notices)
    texts = [
        whole, whole.upper(), " ".join(reversed(notices)), f"{notices[3]} {notices[4]} Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC 4.0",
        "hereby granted " * 40 + notices[0], notices[0] * 3, "the mit license", "gnu general public license version 3",
    ]
    common = ["licensed under cc by the nc 4 0 version of apache mit license"] * 200
    found = licenses.templates()
    for rest in ([], common):
        got = {r.doc_id: r for r in licenses.scan_corpus(table(spark, texts + rest)).collect()}
        for k, t in enumerate(texts):
            w = re.findall("[0-9a-z]+", t.lower())
            want = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in f" {' '.join(w)} "}
            for x in found:
                for start in range(-len(x.words), len(w)):
                    same = [0 <= start + j < len(w) and w[start + j] == y for j, y in enumerate(x.words)]
                    if sum(same) >= licenses.LEAST_SHARE * len(same) and all(all(same[a:b]) for a, b in x.keys):
                        want.add(x.label)
            assert got[k].labels == ",".join(sorted(want)), (k, len(rest))
    assert {x.label for x in found} <= set(got[0].labels.split(",")) and "cc-by-nc-4.0" in got[3].labels


def test_pipeline_links_near_copies_from_080(spark):
    import random

    import corpus_pipeline as p

    rng, rows = random.Random(8), []
    for k in range(48):
        words = [f"w{rng.randrange(10**6)}" for _ in range(49 + k % 16)]
        copy = [*words[:20], "edited", *words[21:]]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, copy))
        assert 0.8 <= len(a & b) / len(a | b) < 0.85
    rows += [(200, rows[0][1] + " one two three four five six seven eight nine ten eleven twelve thirteen")]
    got = p.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), DIR).collect()
    assert sorted(r.doc_id for r in got) == [*range(0, 96, 2), 200]


def test_pipeline_cuts_repeated_passages_of_51_words(spark):
    import random

    import corpus_pipeline as p

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.choice([3, 4, 5, 6, 7])))
    text = lambda n: " ".join(word() for _ in range(n))
    passages, rows = [text(51) for _ in range(6)], []
    for k in range(24):
        rows.append((k, f"{text(40)} {passages[k % 6]} {text(60)}", len(rows)))
    rows += [(100 + k, text(120), 0) for k in range(10)] + [(None, None, None), (None, "", 0), (None, passages[0], 0), (200, "short", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = p.suffix_dedup(spark, docs, DIR)
    assert got.columns == docs.columns and got.count() == len(rows)
    left = got.collect()
    assert not any(x in (r.text or "") for r in left for x in passages)
    before = dict((i, t) for i, t, _ in rows if i is not None)
    for r in left:
        if r.doc_id is not None and r.doc_id >= 100:
            assert r.text == before[r.doc_id]
        elif r.doc_id is not None:
            head, tail = before[r.doc_id].split(passages[r.doc_id % 6])
            assert r.text.startswith(head[:-5]) and r.text.endswith(tail[5:])  # neighbours may agree by chance
        assert r.n_chars == len(r.text)


def test_pipeline_of_odd_tables(spark):
    """Every stage takes an empty table, and columns that are named like its own."""
    import corpus_pipeline as p

    names = "doc_id long, text string, lang string, id long, fp long, core long, spans string, ids string, decoded string, component_id long, key string, item_id long"
    long = "word and line " * 20000
    rows = [(1, " ".join(f"w{k}" for k in range(80)), "en", 1, 1, 1, "s", "i", "d", 1, "k", 1), (None, None, None, None, None, None, None, None, None, None, None, None), (2, long, "en", 2, 2, 2, "", "", "", 2, "", 2)]
    docs = spark.createDataFrame(rows, names)
    for name, stage in p.STAGES[:-1]:
        for d in (docs, docs.where("false")):
            got = stage(spark, d, DIR)
            if name != "suffix-array dedup":
                assert got.columns == d.columns, name
            assert got.count() <= d.count(), name
    got = p.encoding(spark, docs, DIR)
    assert got.count() == 3 and p.encoding(spark, docs.where("false"), DIR).count() == 0


def test_very_long_texts(spark):
    """Runs of letters without a space, and many short lines, take a moment each."""
    import random
    import time

    rng = random.Random(3)
    letters = "".join(rng.choices("abcdefgh", k=1_000_000))
    v, start = bpe.vocabulary(BYTES), time.time()
    small = letters[:5000].encode()
    assert v._merged_by_heap(small) == Tokenizer.from_file(BYTES).encode(letters[:5000], add_special_tokens=False).ids
    got = bpe.encode(table(spark, [letters]), BYTES).first().ids
    assert got == Tokenizer.from_file(BYTES).encode(letters, add_special_tokens=False).ids
    docs = table(spark, ["\n".join(rng.choices(["one", "two", "#", "x9"], k=1_000_000)), "der hund und die katze " * 500_000])
    model = langid.fit(spark.read.parquet(f"{DIR}/documents.parquet"))
    assert langid.predict(docs, model).where("score > 0").count() == 2
    assert quality.judge(docs, quality.Field(*_random_field())).count() == 2
    assert time.time() - start < 120


def _random_field():
    import numpy as np

    rng = np.random.default_rng(6)
    return rng.normal(size=(quality.FEATURES, 2)), rng.normal(size=(2, 2))


def test_viterbi_in_blocks_equals_viterbi_in_step(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    f = quality.Field(*_random_field())
    bounds = np.cumsum([0, 5, 0, 1, 2, 3, 77, 400, 401, 1000])
    x = rng.normal(size=(bounds[-1], quality.FEATURES))
    one = f.labels(x, bounds)
    monkeypatch.setattr(quality, "IN_STEP", 0)
    assert (f.labels(x, bounds) == one).all()


def test_language_counts_do_not_depend_on_segments(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["ein Satz über Bäume", None, "", "a", "the quick brown fox " * 30])
    whole = langid.counts(texts)
    monkeypatch.setattr(langid, "SEGMENT", 7)
    cut = langid.counts(texts)
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(whole, cut, strict=True))


def test_odd_tables_of_the_text_operators(spark):
    """Empty tables, null columns, repeated rows and columns named like the operators' own."""
    from factflow.llm import decontam, minhash

    odd = spark.createDataFrame(
        [(None, None, 1, "a", 0.5, True), (1, None, 2, "b", None, None), (1, "the cat sat", None, None, 1.0, False), (1, "the cat sat", None, None, 1.0, False), (2, "  ", 0, "", 0.0, True)],
        "doc_id long, text string, id int, ids string, score double, kept boolean",
    )
    none = odd.where("false")
    field = quality.Field(*_random_field())
    for f in (None, field):
        assert quality.judge(none, f).count() == 0 and quality.judge(odd, f).count() == 5
        assert quality.kept_rows(odd, f).columns == odd.columns and quality.kept_rows(none, f).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (1, None)], "doc_id long, quality int")
    assert quality.fit(none, labels) is None and quality.fit(odd, labels.where("false")) is None
    assert langid.fit(none.withColumn("lang", F.lit("en"))) is None
    model = langid.fit(odd.withColumn("lang", F.lit("en")))
    assert langid.predict(none, model).count() == 0
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.predict(odd, model).collect())
    assert got == [("1", "en"), ("1", "en"), ("1", "und"), ("2", "und"), ("None", "und")]
    assert licenses.scan_corpus(odd).count() == 5 and licenses.scan_corpus(none).count() == 0
    twice = bpe.decode(bpe.encode(odd, BYTES), BYTES)
    assert twice.columns.count("ids") == 1 and sorted(r.decoded for r in twice.collect()) == ["", "", "  ", "the cat sat", "the cat sat"]
    kept = bpe.encode(odd, BYTES, ids_col="tokens")
    assert {"ids", "tokens"} <= set(kept.columns) and kept.where("ids = 'a'").count() == 1
    bench = spark.createDataFrame([(1, "the cat sat on the mat today")], "item_id long, text string")
    assert decontam.contaminated(odd, bench).count() == 0
    assert minhash.near_duplicates(odd).count() == 5


def test_equal_scores_take_the_first_language():
    import numpy as np
    import pyarrow as pa

    model = langid.Model(["de", "en"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros(2), 1.0, 0.0)
    best, p = model.scores(pa.array(["abc", "", None]))
    assert best.tolist() == [0, 0, 0] and np.allclose(p, 0.5)


def test_segments_of_token_files_equal_the_library(monkeypatch):
    """Whole texts, and texts cut in many parts, over everything that a chunk may hold; two hashes that clash too."""
    import numpy as np
    import pyarrow as pa

    from factflow.llm import vectext as V

    t = Tokenizer.from_file(WORDS)
    rng = random.Random(11)
    some = [*"abzAZ'.,!?;:#$%&*0 9-_/\n\t<≠", "é", "É", "ß", "ÿ", "Ÿ", "×", "÷", "µ", "é", "中", "🎉", "\xa0", " ", "İ", "Σ", "<|endoftext|>", "don't", "The", "über,"]
    texts = [None, "", *("".join(rng.choices(some, k=rng.randint(1, 60))) for _ in range(600)), " ".join(rng.choices(["alpha", "Beta,", "über!", "x9", "…"], k=5000))]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]

    def ids(table):
        parts = [(np.concatenate(([0], np.cumsum(n))), v) for n, v in table.encoded(pa.array(texts))]
        return [[x for at, v in parts for x in v[at[k] : at[k + 1]].tolist()] for k in range(len(texts))]

    table = tokenfiles.TokenTable(WORDS)
    assert ids(table) == want and ids(table) == want
    monkeypatch.setattr(V, "SEGMENT", 300)
    assert ids(tokenfiles.TokenTable(WORDS)) == want
    table = tokenfiles.TokenTable(WORDS)
    ids(table)
    table.rows = np.roll(table.rows, 1)  # every hash now leads to another segment
    assert ids(table) == want
    monkeypatch.setattr(tokenfiles, "CACHE", 10)
    assert ids(tokenfiles.TokenTable(WORDS)) == want


def test_fits_are_bounded_by_rows(spark, monkeypatch):
    """A repeated id, an id with both labels and repeated rows do not grow what reaches the driver; order does not matter."""
    good, bad = "A plain sentence of many words stands here.\nAnother line goes on with it.", "Buy | now | $$$\nBuy | now | $$$"
    rows = [(1, good + f" {k}") for k in range(400)] + [(2, bad)] * 30 + [(k, (good if k % 2 else bad) + f" {k}") for k in range(3, 60)] + [(None, good), (70, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (None, 1), (70, 1)] + [(k, k % 2) for k in range(3, 60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda some: seen.append(sorted((y, f.tobytes()) for f, y in some)))
    for d, l in ((docs, labels), (docs.repartition(7), labels.repartition(5))):
        quality.fit(d, l, sample=20)
    assert seen[0] == seen[1] and len(seen[0]) <= 40
    seen.clear()
    quality.fit(docs, labels)
    assert len(seen[0]) == 60  # ids 1 to 59 and 70, one row each

    seen.clear()
    monkeypatch.setattr(langid, "train", lambda some: seen.append(sorted((lang, b.tobytes(), c.tobytes()) for b, c, lang in some)))
    spoken = docs.withColumn("lang", F.when(F.col("text").startswith("Buy"), "xx").otherwise("en"))
    for d in (spoken, spoken.repartition(7)):
        langid.fit(d, per_lang=25)
    assert seen[0] == seen[1] and max(sum(x[0] == k for x in seen[0]) for k in ("en", "xx")) <= 25 and sum(x[0] == "en" for x in seen[0]) == 25


def test_language_scores_match_a_count_by_hand(spark):
    """Mean of the subwords' rows, bias, temperature and softmax, worked out subword by subword."""
    import math

    import numpy as np

    rng = np.random.default_rng(9)
    langs, table_, bias, heat, least = ["aa", "bb", "cc"], rng.normal(0, 3, (langid.BUCKETS, 3)).astype(np.float32), np.array([0.1, -0.2, 0.05]), 0.7, 0.5
    model = langid.Model(langs, table_, bias, heat, least)
    texts = [*ODD, "ÀÉ", "Żółć ő ş", "x", "12 a", "A", *fuzz(120), *[t[:300] for t in given()[:40]]]
    got = {r.doc_id: r for r in langid.predict(table(spark, texts), model).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
            continue
        codes = [c + 32 if 65 <= c <= 90 else 32 if c < 128 and not 97 <= c <= 122 else c for c in t.encode()]
        total, n = [0.0] * 3, 0
        for size in (1, 2, 3, 4):
            for at in range(len(codes) - size + 1):
                gram = codes[at : at + size]
                if gram[0] != 32 or gram[-1] != 32:
                    bucket = (int.from_bytes(bytes(gram), "big") + size) * 0x9E3779B97F4A7C15 % 2**64 >> 49
                    total = [x + float(y) for x, y in zip(total, table_[bucket], strict=True)]
                    n += 1
        z = [(x / n + b) / heat for x, b in zip(total, bias, strict=True)]
        e = [math.exp(x - max(z)) for x in z]
        p = max(e) / sum(e)
        assert got[k].lang_pred == langs[e.index(max(e))] and abs(got[k].score - p) < 1e-9 and got[k].rejected == (p < least), k
