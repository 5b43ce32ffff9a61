"""Connectors, streams and the batch run."""

import json

from pyspark.sql import functions as F

from brightvane import pipeline
from brightvane.functions.text import short_hash
from brightvane.plans import textual
from brightvane.plans.views import view
from brightvane.sources import landing
from brightvane.streaming import incremental

NOW = F.lit("2024-01-31 00:00:00").cast("timestamp")


def test_feed(spark, tmp_path):
    item = "<item><title>T{0}</title><link>https://e.com/{0}</link><description>&lt;p&gt;Text of {0}&lt;/p&gt;</description><pubDate>{1}</pubDate></item>"
    body = item.format(1, "Tue, 30 Jan 2024 10:00:00 GMT") + item.format(2, "Sun, 01 Jan 2023 10:00:00 GMT") + "<item><title>no link</title></item>" + item.format(3, "")
    (tmp_path / "f.xml").write_text(f"<rss><channel>{body}</channel></rss>")
    got = landing.feed_items(spark, str(tmp_path / "f.xml"), NOW).orderBy("position").collect()
    assert [(r.title, r.summary) for r in got] == [("T1", "Text of 1"), ("T3", "Text of 3")]


def test_search_and_social(spark, tmp_path):
    results = [{"url": u, "title": "t", "snippet": "s", "date": "2024-01-30"} for u in ("https://x.com/ann/status/1", "https://x.com/ann/status/1?utm_source=q", "https://bad.com/1", "https://x.com/ann")]
    (tmp_path / "s.json").write_text(json.dumps({"query": "q", "results": results}))
    items = landing.search_items(spark, str(tmp_path / "s.json"), blocked=("bad.com",))
    rows = {r.source_url: r for r in landing.social_reasons(items, NOW).collect()}
    assert len(rows) == 2 and rows["https://x.com/ann/status/1"].drop_reason is None and rows["https://x.com/ann"].drop_reason == "not_a_post"


def test_manual_and_outcome(spark):
    rows = landing.manual_items(spark.createDataFrame([("note", "First line\nrest", None), ("note", " ", None)], "kind string, text string, url string")).collect()
    assert len(rows) == 1 and rows[0].title == "First line" and rows[0].source_url.startswith("manual://note/")
    df = spark.createDataFrame([(200, "https://a.com", "fine", True, 0.0), (403, "https://a.com", "", True, 0.0), (200, "https://a.com", "", False, 0.0), (200, "https://a.com", "", True, 99.0), (500, "https://a.com", "", True, 0.0)], "c int, u string, b string, r boolean, w double")
    assert [r[0] for r in df.select(landing.fetch_outcome(*[F.col(x) for x in "cubrw"])).collect()] == ["fetched", "skipped_access_restricted", "skipped_robots", "skipped_crawl_delay_deferred", "error"]


def test_manual_items_more_than_once_a_session(spark):
    entries = spark.createDataFrame([("note", "First ﬁ line\nrest", None)], "kind string, text string, url string")
    urls = {landing.manual_items(entries).first().source_url for _ in range(3)}
    plain = entries.select(short_hash(F.lit("First fi line\nrest"), 16)).first()[0]
    assert urls == {f"manual://note/{plain}"}


def test_stream_sees_each_url_once(spark, tmp_path):
    rows = [("https://a.com/1", "2024-01-01 00:00:00"), ("http://www.a.com/1/?utm_source=x", "2024-01-01 01:00:00"), ("https://a.com/2", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "source_url string, t string").select("source_url", F.col("t").cast("timestamp").alias("t")).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = incremental.first_seen_stream(incremental.new_files(spark, str(tmp_path / "in"), "source_url string, t timestamp"), "t")
    incremental.run_available(stream, str(tmp_path / "ck"), lambda df, _: seen.extend(r.source_url for r in df.collect()))
    assert len(seen) == 2


def test_breaker(spark):
    calls = [("c", i, ok, soft) for i, (ok, soft) in enumerate([(False, False), (False, True), (False, False), (False, False), (False, False), (True, False)])]
    got = incremental.breaker(spark.createDataFrame(calls, "client string, at int, ok boolean, recoverable boolean")).orderBy("at").collect()
    assert [r.disabled for r in got] == [False, False, False, False, True, True]


def test_batch_run(spark, sf_dir):
    done = pipeline.run(view(spark, sf_dir, "m_sources").where("source_id < 40"), textual.KNOWN, NOW)
    assert not done.errors and set(done.stages) == set(pipeline.STAGES) and pipeline.run_log(spark, done).first().signals > 0
    broken = pipeline.run(spark.range(1), textual.KNOWN, NOW)
    assert broken.errors and not pipeline.may_write()
