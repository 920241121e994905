"""Tables in buckets: merges that leave the stored side where it is, JSON-LD of every form."""

import re

import pytest
from pyspark.sql import functions as F

from factflow.operators import pages, state
from factflow.operators.stored import Stored

SCHEMA = "url_id long, kind string, verdict string, seen int"


@pytest.fixture
def table(tmp_path):
    return Stored(str(tmp_path / "table"), SCHEMA, ["url_id", "kind"], 8)


def upsert(old, new):
    return state.merge(old, new, ["url_id", "kind"], new_first=["verdict"])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("partitions", ["4", "200"])
def test_a_merge_shuffles_the_new_rows_only(spark, table, no_broadcast, partitions):
    old = spark.range(500).select(F.col("id").alias("url_id"), F.lit("a").alias("kind"), F.lit("old").alias("verdict"), F.lit(1).alias("seen"))
    # An int key and a constant one, as a run may bring them.
    new = spark.range(400, 600).select(F.col("id").cast("int").alias("url_id"), F.lit("a").alias("kind"), F.lit("new").alias("verdict"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        stored = table.write(table.placed(old), 0)
        for joined in (upsert(stored, table.placed(new)), stored.join(table.placed(new.select("url_id", "kind")), ["url_id", "kind"], "left_anti")):
            plan = plan_of(joined)
            assert len(re.findall("Exchange", plan)) == 1 and "Bucketed: true" in plan, plan
        after = table.change(spark, 0, new, upsert)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r.url_id: (r.verdict, r.seen) for r in after.collect()}
    assert got == {k: ("new" if k >= 400 else "old", 1 if k < 500 else None) for k in range(600)}
    assert after.inputFiles() and len(after.inputFiles()) <= 8


def test_findings_merge_in_place(spark, tmp_path, no_broadcast):
    schema = "url_id long, category string, title string, related_url_id long, severity string, evidence string, status string, deleted_at string"
    table = Stored(str(tmp_path / "findings"), schema, state.FINDING_KEY, 8)
    old = [(1, "c", "t", 0, "low", "e", "ignored", None), (2, "c", "t", 0, "low", "e", "open", None), (None, "c", "t", 0, "low", "e", "open", None)]
    run = spark.createDataFrame([(1, "c", "t", "high", "e", "open", None, 1), (3, "c", "t", "low", "x", "open", None, 1), (3, "c", "t", "high", "y", "open", None, 2)], "url_id long, category string, title string, severity string, evidence string, status string, deleted_at string, write_seq long").withColumn("related_url_id", F.lit(0).cast("long"))
    stored = table.write(table.placed(spark.createDataFrame(old, schema)), 0)
    plan = plan_of(state.merge_findings(stored, table.placed(run)))
    # The run's rows are shuffled twice (for their last write, for the join), the stored ones, the join's first side, not at all.
    assert "Exchange" not in plan[: plan.index("FileScan")] and "Bucketed: true" in plan, plan
    got = table.change(spark, 0, run, state.merge_findings).collect()
    assert {(r.url_id, r.status, r.severity, r.evidence) for r in got} == {(1, "ignored", "high", "e"), (2, "open", "low", "e"), (None, "open", "low", "e"), (3, "open", "high", "y")}


def test_versions_replays_and_other_sessions(spark, table):
    row = lambda k, v: spark.createDataFrame([(k, "x", v, 1)], SCHEMA)
    assert table.read(spark, -1).count() == 0
    table.write(table.placed(row(1, "a")), 0)
    for _ in range(2):  # the same batch twice
        second = table.change(spark, 0, row(2, "b"), upsert)
        assert sorted(r.url_id for r in second.collect()) == [1, 2]
    # A session that knows the folder only.
    for v in (0, 1):
        spark.sql(f"DROP TABLE {table._name(v)}")
    again = table.read(spark, 1)
    assert sorted(r.url_id for r in again.collect()) == [1, 2]
    assert again.where("url_id = 2 AND kind = 'x'").first().verdict == "b"
    table.drop(spark, 0)
    table.drop(spark, 0)
    assert table.read(spark, 1).count() == 2
    empty = table.change(spark, 1, row(1, "a").limit(0), upsert)
    assert empty.count() == 2
    for table, version in ((table, 0), (Stored(table.path, SCHEMA, table.keys, 4), 1)):
        with pytest.raises(FileNotFoundError):
            table.read(spark, version)


DOCUMENTS = [
    '{"@type":"Question","name":"q?","acceptedAnswer":"plain <b>text</b>"}',
    '[{"@type":"BlogPosting","author":["By Ann, Editor",{"name":"Bo"},[{"name":"ANN"},[["Deep"]]]]}]',
    "{broken", "", "null", "3", '"x"', "[]",
    '{"@graph":[{"hasPart":{"@type":["X","Question"],"name":0,"question":"two\\u00a0 x","suggestedAnswer":[{"text":"one"},{"text":"b"}],"mainEntity":[[{"@type":"Question","name":true,"acceptedAnswer":{"text":5}}]]}},{"@type":"Question","name":"later","acceptedAnswer":[[["deep"]]]}]}',
    '{"@type":"Question","name":"a","name":"b","acceptedAnswer":{"text":null},"hasPart":null}',
    '{"@type":"Report","author":null}', '{"@type":5,"mainEntity":{"@type":"Question","question":"q3"}}',
    "[" * 300 + '{"@type":"Question","name":"far","acceptedAnswer":"down"}' + "]" * 300,
]


def test_json_of_every_form_and_depth(spark):
    html = "".join(f'<script type="application/ld+json">{d}</script>' for d in DOCUMENTS)
    rows = spark.createDataFrame([(1, html), (2, None), (3, "<dl><dt>a<dd>b</dl>")], "page_id long, html string")
    got = {r.page_id: r for r in pages.parts(rows).collect()}
    want = [("q?", "plain text"), ("two x", "one"), ("True", "5"), ("later", "deep"), ("b", ""), ("q3", ""), ("far", "down")]
    assert [tuple(p)[:2] for p in got[1].pairs] == want and all(p.source == "jsonld" for p in got[1].pairs)
    assert [n for d in got[1].names.data for n in d] == ["By Ann, Editor", "Bo", "ANN", "Deep"]
    assert got[2].pairs == [] and [tuple(p) for p in got[3].pairs] == [("a", "b", "visible")]
