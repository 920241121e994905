"""Periodic runs, filter audit, exact top-k: brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from factflow.llm import audit, runs, topk
from factflow.llm import vectext as V
from factflow.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=6, times=4):
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                best.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(rng, k, n):
    out = []
    while len(out) < n:
        out += [rng.randrange(k) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
    return out


@pytest.mark.parametrize("times", [2, 3, 4])
def test_runs_match_brute_force(times):
    rng = random.Random(times)
    for _ in range(300):
        texts = [periodic(rng, rng.choice([1, 2, 3, 9]), rng.randint(0, 50)) for _ in range(rng.randint(1, 4))]
        h = V.mix(np.array([x for t in texts for x in t], np.uint64) + np.uint64(7))
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        got = [(a, b - a, q) for a, b, q in zip(*[x.tolist() for x in runs.runs_of(h, bounds, 6, times)], strict=True)]
        assert got == [(s + b, n, q) for t, b in zip(texts, bounds.tolist(), strict=False) for s, n, q in brute_runs(t, 6, times)]


def test_expansion_in_parts_changes_nothing(monkeypatch):
    rng = random.Random(9)
    w = periodic(rng, 2, 3000)
    h, bounds = V.mix(np.array(w, np.uint64)), np.array([0, len(w)])
    whole = [x.tolist() for x in runs.runs_of(h, bounds)]
    monkeypatch.setattr(runs, "EXPAND", 50)
    assert [x.tolist() for x in runs.runs_of(h, bounds)] == whole
    assert list(zip(whole[0], whole[1], strict=True)) == [(s, s + n) for s, n, _ in brute_runs(w)]


def test_suffix_order_and_smaller_values():
    rng = random.Random(2)
    for n in (1, 2, 7, 60):
        s = [rng.randrange(1, 4) for _ in range(n)] + [0]
        assert runs.suffix_order(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        v = [rng.randrange(5) for _ in range(n)]
        want = [max((j for j in range(k) if v[j] < v[k]), default=-1) for k in range(n)]
        assert runs.previous_smaller(np.array(v)).tolist() == want


ODD = [None, "", " \n", "one", "la la la la la la", "la la la la la", "a b a b a b a b a", "x y\tx\ny x y\x0bx y z z z z z z é é é é é é", "A a A a A a A a", " lead la la la la la la "]


def test_runs_of_odd_tables(spark):
    rows = [(None, "na " * 8, 1, [1]), (5, "na " * 8, 1, None), (5, "na " * 8, 2, None), *[(k + 10, t, 0, []) for k, t in enumerate(ODD)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, runs array<int>")
    got = runs.detect(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 10}
    for k, t in enumerate(ODD):
        w = WORD.findall(t or "")
        found = brute_runs(w)
        assert [tuple(x) for x in by[k + 10].runs] == found and by[k + 10].n_words == len(w)
        assert by[k + 10].collapsed == collapsed(w, found)
    assert [tuple(r.runs[0]) for r in got if r.doc_id in (None, 5)] == [(0, 8, 1)] * 3
    assert runs.digests(runs.detect(docs.where("false"))).count() == 0


@pytest.mark.parametrize("text, want", [("a " * 500_000, (0, 500_000, 1)), ("b c d e f g h " * 70_000, (0, 490_000, 7)), ("w" * 2_000_000, None)])
def test_runs_of_long_texts(spark, text, want):
    got = runs.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == ([want] if want else [])


def planted(i, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(i).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def test_op11_matches_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, DIR).collect()}
    docs = pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(docs)
    many = 0
    for d in docs:
        w, r = planted(d["doc_id"], d["text"]), got[d["doc_id"]]
        found = brute_runs(w)
        many += bool(found)
        assert r.n_runs == len(found)
        top = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == top
        assert r.exponent_milli == (math.floor(1000 * top[1] / top[2]) if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda x: (x[0], x[2]))).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
    assert many > 5


def test_longest_run_compares_exactly_and_breaks_ties(spark):
    rows = [([(9, 8, 2), (4, 12, 3), (1, 6, 2)],), ([(3, 1000000001, 3), (7, 1000000000, 3)],), ([(5, 8, 2), (5, 4, 1)],), ([],)]
    df = spark.createDataFrame(rows, f"runs array<{runs.RUN}>")
    assert [r[0] and tuple(r[0]) for r in df.select(runs.longest(F.col("runs"))).collect()] == [(4, 12, 3), (3, 1000000001, 3), (5, 4, 1), None]


# Filter audit


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    members = []
    for i, t, part in rows:
        w = WORD.findall(t or "")
        text = t or ""
        fails = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search(r"[#$%&*|]", text), i is not None and first[text] < i), strict=True) if x}
        members.append((part or "", fails, any(q == 1 for k, q, _ in labels if k == i and i is not None), any(x == 1 for k, _, x in labels if k == i and i is not None)))
    out = {}
    for part in {m[0] for m in members}:
        own = [m for m in members if m[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                every = [m for m in own if f in m[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(every) - len(gone), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = total[v[6]] if isinstance(v[6], str) else v[6]
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit_of_odd_tables_matches_brute_force(spark):
    rng = random.Random(6)
    words = ["alpha", "Beta", "GAMMA", "d#", "é", "x"]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([3, 60, 250]))), rng.choice(["en", "fr", None])) for k in range(40)]
    rows += [(100 + k, rows[3][1], "en") for k in range(9)] + [(200, None, None), (201, "", "fr"), (202, "  ", "fr"), (203, " ".join(f"w{k}" for k in range(300)), "en"), (204, "ok " * 200000, "de")]
    rows += [(None, rows[3][1], "en"), (None, None, "en"), (5, rows[5][1], rows[5][2]), (5, "another", "en"), (7, rows[7][1], "zz")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 50, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (300, 1, 1), (6, None, None)]
    docs = spark.createDataFrame([(*r, "key", 1) for r in rows], "doc_id long, text string, lang string, key string, prefix int")
    named = spark.createDataFrame([(a, b, int(c) if c is not None else None, "p") for a, b, c in labels], "doc_id long, quality int, toxic int, part string")
    got = audited(audit.audit_documents(docs, named))
    assert got == brute_audit(rows, labels)
    assert audit.audit_documents(docs.where("false"), named).count() == 0
    without = audited(audit.audit_documents(docs, named.where("false")))
    assert {k: v[:4] for k, v in without.items()} == {k: v[:4] for k, v in got.items()} and not any(v[4] or v[5] for v in without.values())


# Exact top-k


def brute_top(rows, k=5, every=50):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            kept[i] = min(kept.get(i, q), q)
    out = set()
    for i, q in kept.items():
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in kept.items() if j != i)
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)}
    return out


def vectors(seed=1, n=700, d=16):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, d)]) for i in range(n)]
    same = rows[3][1]
    rows += [(n + k, list(same)) for k in range(30)] + [(1000 + k, [0.0] * d) for k in range(8)]
    rows += [(2000, None), (2050, []), (2100, [0.5, None]), (2150, [float("nan")] * d), (2200, [float("inf")]), (None, same), (2250, [1.0, -2.5]), (2300, [3.0] * (d + 4)), (50, same), (50, rows[50][1])]
    return rows


@pytest.mark.parametrize("shard, block", [(8192, 1024), (64, 5)])
def test_top_k_matches_brute_force(spark, shard, block):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, shard string").repartition(5)
    got = {tuple(r) for r in topk.top_k(df, F.col("id") % 50 == 0, shard=shard, block=block).collect()}
    assert got == brute_top(rows)
    assert topk.top_k(df.where("false"), F.col("id") % 50 == 0).count() == 0


def test_top_k_with_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-1.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, F.col("id") % 50 == 0).collect()} == {(0, 1, 1, -65536), (0, 2, 2, -65536)}
    assert topk.top_k(df.where("vec_id = 0"), F.col("id") % 50 == 0).count() == 0


def test_reading_stops_on_proof():
    """Where few components are large, a fraction of the postings proves the result."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = (rng.normal(0, 1, (4000, 32)) ** 5).astype(np.int64)
    table = pa.table({"id": pa.array(np.arange(4000)), "vector": pa.array(x.tolist(), pa.list_(pa.int64()))})
    shard = topk.Shard(topk._indexed((pa.scalar(0),), table))
    read = 0
    for own in range(0, 4000, 200):
        ids, scores, n = shard.best(own, x[own], 5)
        exact = x @ x[own]
        exact[own] = -(1 << 62)
        want = np.lexsort((np.arange(4000), -exact))[:5]
        assert ids.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
        read += n
    assert read < 0.5 * 20 * x.size
