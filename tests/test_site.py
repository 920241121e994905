"""The sync of a whole site: batches, replays and later runs against one run over the newest pages."""

import os

from pyspark.sql import functions as F

from factflow.operators import detect as K
from factflow.streaming import site

LANGUAGES = r"(\d+) languages"


def detectors(spark):
    rules = [K.Rule(1, "old", ["old name"], ["new name"], allowed=["never"], window=10), K.Rule(2, "both", ["languages"])]
    canonical = spark.createDataFrame([("languages", 2, "7", None)], "kind string, rule_id int, canonical string, category string")
    counts = (site.Counts(3, "lang", "language_count", LANGUAGES, 1, [("app", "(?i)app", "", "7")]),)
    return site.Detectors(rules, {"languages": [(LANGUAGES, 1)]}, canonical, counts, [("closed", "feature_claim", "(?i)atlas")])


def rows(df, *drop):
    return sorted(map(str, df.drop(*drop).collect()))


def test_sync_equals_one_run_over_the_newest_pages(spark, tmp_path):
    landing, state, d = str(tmp_path / "landing"), str(tmp_path / "state"), detectors(spark)

    def land(pages):
        spark.createDataFrame(pages, site.RAW).coalesce(1).write.mode("append").parquet(landing)

    land([(1, "en", "<p>The old name & 7 languages in the app</p>", 1), (2, None, "<p>8 languages. An old name", 1), (3, "en", None, 1)])
    land([(1, "en", "<p>new name</p>", 2), (4, "fr", "<main>Atlas has a fixed set of regulations</main>7 languages", 1), (2, None, "<p>stale", 0), (5, "en", "", 1)])
    site.ingest(spark, landing, state, d, files=1)
    _, first = site.finish(spark, state, d, "2024-05-01")
    first.write.parquet(f"{state}/first")
    first = spark.read.parquet(f"{state}/first")
    assert {(r.url_id, r.title, r.status) for r in first.collect()} == {(2, "old:stale", "open"), (2, "both:stale", "open"), (2, "languages:inconsistent", "open"), (2, "lang_unclear:8", "unclear"), (4, "closed", "open")}

    # A later run: page 2 is mended, page 4 stays as it is, page 6 is new; a person ignored what was found on page 4.
    land([(2, None, "<p>7 languages of the app", 2), (6, "en", "<p>old name, 9 languages in our app", 1), (6, "en", "<p>older", 0)])
    site.ingest(spark, landing, state, d, files=1)
    decided = first.withColumn("status", F.when(F.col("title") == "closed", "ignored").otherwise(F.col("status")))
    verdicts, findings = site.finish(spark, state, d, "2024-06-01", decided)
    status = {(r.url_id, r.title): r.status for r in findings.collect()}
    assert status[2, "old:stale"] == "fixed" and status[4, "closed"] == "ignored" and status[6, "old:stale"] == status[6, "lang_ctx:app:9"] == "open" and status[2, "both:stale"] == "open"

    newest = site.texts(spark, state)
    assert {r.url_id: r.version for r in newest.collect()} == {1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
    _, found = site.current(spark, state)
    at_once = site.looked_at(newest.where("body_text IS NOT NULL").select("url_id", "locale", "body_text"), d)
    assert rows(found) == rows(at_once)
    want = rows(site.verdicts(at_once, d))
    assert rows(verdicts) == want

    # The last batch again, as after a lost commit: nothing changes, and no more than two versions of the state are there.
    last = max(int(f) for f in os.listdir(f"{state}/progress/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{state}/progress/commits/{f}"):
            os.remove(f"{state}/progress/commits/{f}")
    site.ingest(spark, landing, state, d, files=1)
    assert rows(site.current(spark, state)[1]) == rows(at_once) and rows(site.finish(spark, state, d, "2024-06-01", decided)[0]) == want
    assert len([f for f in os.listdir(f"{state}/found") if f.startswith("v=")]) <= 2
