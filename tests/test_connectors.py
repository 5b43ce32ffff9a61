"""Robots rules, feeds, the data source of connectors, and table functions."""

import json
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from brightvane.functions import tables
from brightvane.sources import connectors, feeds, robots

NOW = F.lit("2024-01-31 00:00:00").cast("timestamp")


def rules_of(spark, text):
    return robots.robots_rules(spark.createDataFrame([("a.com", 200, text)], "host string, status int, body string"))


def test_groups_of_agents(spark):
    rules, groups = rules_of(spark, "Disallow: /orphan\nUser-agent: A # c\nUSER-AGENT : b\nDisallow: /x\nCrawl-delay: soon\ncrawl-delay: 3\n\nAllow: /x/y\nUser-agent: *\nDisallow:\nUser-agent: a\nDisallow: /z*\r\nnonsense\nDisallow: no-slash\nUser-agent:\nDisallow: /w")
    assert {(r.agent, r.allow, r.pattern) for r in rules.collect()} == {("a", False, "/x"), ("b", False, "/x"), ("a", True, "/x/y"), ("b", True, "/x/y"), ("a", False, "/z*")}
    assert {(r.agent, r.crawl_delay) for r in groups.collect()} == {("a", 3.0), ("b", 3.0), ("*", None)}


def allowed_by_definition(path, rules):
    best = None
    for allow, pattern in rules:
        shape = ".*".join(map(re.escape, (pattern[:-1] if pattern.endswith("$") else pattern).split("*"))) + ("$" if pattern.endswith("$") else "")
        if re.match(shape, path, re.DOTALL) and (best is None or (len(pattern), allow) > best):
            best = (len(pattern), allow)
    return best is None or best[1]


def test_longest_pattern_decides(spark):
    rules = [(False, "/"), (True, "/a"), (False, "/a/*.gif$"), (True, "/a/*x*.gif"), (False, "/*?"), (True, "/b$"), (False, "*/end"), (False, "/c+(d)"), (True, "/**deep"), (False, "/a/"), (True, "/a/")]
    text = "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules)
    paths = ["/", "/a", "/a/1.gif", "/a/1x.gif", "/a/1.gif2", "/b", "/b/", "/b?q=1", "/c+(d)e", "/ccd", "/x/end", "/a/end", "/very/deep", "/a/x?.gif", "/a\nb"]
    urls = spark.createDataFrame([(i, "https://www.A.com" + p) for i, p in enumerate(paths)] + [(90, "https://a.com?x"), (91, None), (92, "http://b.com/"), (93, "https://a.com/a#/x?y")], "i int, url string")
    files = spark.createDataFrame([("a.com", 200, text), ("b.com", 503, "User-agent: *\nDisallow: /")], "host string, status int, body string")
    got = {r.i: (r.robots_allowed, r.robots_reason) for r in robots.permitted(urls, files, "Bot").collect()}
    assert {i: got[i][0] for i in range(len(paths))} == {i: allowed_by_definition(p, rules) for i, p in enumerate(paths)}
    assert got[90][0] is False and got[91] == (False, "unparseable host") and got[92] == (True, "no robots.txt published") and got[93][0] is True


def test_own_group_or_that_for_all(spark):
    files = spark.createDataFrame([("a.com", 200, "User-agent: bright\nDisallow: /\nUser-agent: brightbot\nDisallow: /p\nCrawl-delay: 9\nUser-agent: *\nDisallow: /p/q\nCrawl-delay: 1")], "host string, status int, body string")
    urls = spark.createDataFrame([("https://a.com/p/q",), ("https://a.com/p/r",), ("https://a.com/s",)], "url string")
    got = {r.url[-3:]: (r.robots_allowed, r.crawl_delay) for r in robots.permitted(urls, files, "BrightBot/2").collect()}
    assert got == {"p/q": (False, 9.0), "p/r": (True, 9.0), "m/s": (True, 9.0)}
    assert {r.crawl_delay for r in robots.permitted(urls, files, "Other").collect()} == {1.0}


FEED = """<rss xmlns:dc="d"><channel><item><title>A</title><link>https://e.com/1</link><author>ann@e.com</author></item><atom:entry xmlns:atom="a"><title>B</title><id>https://e.com/2</id><author><name/></author><author><name>Bo</name></author><published>2024-01-30T00:00:00+02:00</published></atom:entry>
<item><title>broken &nope; <b></title></item><item><title>C</title><link>ftp://e.com/3</link></item><item><title/><guid isPermaLink="true">http://e.com/4</guid><dc:date>2024-01-29</dc:date><description>&lt;i&gt;long text&lt;/i&gt;</description></item></channel></rss>"""


def feed_table(spark, *bodies):
    return spark.createDataFrame([(f"f{i}", f"u{i}", b) for i, b in enumerate(bodies)], "feed_name string, feed_url string, body string")


def test_mixed_feeds(spark):
    got = feeds.feed_items(feed_table(spark, FEED, None, "no xml"), NOW).orderBy("position").collect()
    assert [(r.position, r.source_url, r.title, r.author, r.summary) for r in got] == [(1, "https://e.com/1", "A", "ann@e.com", ""), (2, "https://e.com/2", "B", "Bo", ""), (3, "https://e.com/4", None, None, "long text")]
    assert str(got[1].published_at) == "2024-01-29 22:00:00"
    report = {r.feed_name: (r.entries, r.kept, r.ok, r.problem) for r in feeds.feed_report(feed_table(spark, FEED, None, "no xml"), NOW, per_feed=2).collect()}
    assert report == {"f0": (5, 2, True, None), "f1": (0, 0, False, "not fetched"), "f2": (0, 0, False, "no entries in feed")}


def test_entries_are_cut_at_their_first_end(spark):
    plain = re.compile(r"(<((?:\w+:)?(?:item|entry))(?:\s[^>]*)?>.*?</\2>)", re.DOTALL)
    bodies = [
        "<item>a</item><item>b", "<item a='1'\n>x</entry></item>y<entry></entry>", "<a:item>1</item></a:item><item></item >", "<item><item>1</item></item><entry>2</entry>", "<items>x</items><item/><item>z</item>",
        "<entry>< </entr></entry", "<item><![CDATA[</entry>]]></item><item>\n<</item>", "<item>" + "<b/>" * 100_000 + "</item>", "<item>" + "x<" * 1000, "",
    ]
    got = {r.feed_name: r.entries for r in feeds.feed_report(feed_table(spark, *bodies), NOW).collect()}
    assert got == {f"f{i}": len(plain.findall(b)) for i, b in enumerate(bodies)}


def test_only_kept_entries_are_read_and_each_step_is_done_once(spark):
    item = "<item><title>{0}</title><link> https://www.e.com/{0}?utm_source=x </link><pubDate>{1}</pubDate><description>&lt;p&gt; a &lt;b&gt;word&lt;/b&gt; {0}&lt;/p&gt;</description></item>"
    body = "".join(item.format(i, d) for i, d in enumerate(["Tue, 30 Jan 2024 10:00:00 GMT", "Sun, 01 Jan 2023 10:00:00 GMT", "Mon, 29 Jan 2024 10:00:00 GMT", "soon"]))
    items = feeds.feed_items(feed_table(spark, body), NOW, per_feed=2)
    assert [(r.position, r.source_url, r.title, r.summary) for r in items.orderBy("position").collect()] == [(1, "https://e.com/0", "0", "a word 0"), (2, "https://e.com/2", "2", "a word 2")]
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    # to take out marks and to trim a link, once an item
    assert plan.count("<[^>]*>") == 1 and plan.count(r"(?U)^\s+|\s+$") == 1


def test_feeds_from_files(spark, tmp_path):
    (tmp_path / "one.xml").write_text(FEED)
    got = feeds.read_feeds(spark, str(tmp_path)).collect()
    assert [(r.feed_name, r.body) for r in got] == [("one", FEED)] and got[0].feed_url.endswith("one.xml")


@pytest.fixture
def landed(tmp_path):
    for k in range(3):
        pq.write_table(pa.table({"id": list(range(100 * k, 100 * k + 100)), "url": [f"https://e.com/{i}" for i in range(100 * k, 100 * k + 100)]}), tmp_path / f"{k}.parquet", row_group_size=50)
    return str(tmp_path)


def test_filters_reach_the_connector(spark, landed):
    connectors.register(spark)
    whole = spark.read.format("brightvane").options(connector="parquet", path=landed).load()
    assert whole.count() == 300 and whole.rdd.getNumPartitions() == 6
    some = whole.where("place >= 120 and place < 130 and title is null")
    assert sorted(r.place for r in some.collect()) == list(range(120, 130)) and some.rdd.getNumPartitions() == 1
    assert whole.where("source_url in ('https://e.com/7', 'https://e.com/250')").count() == 2


def test_what_goes_wrong_is_a_row(spark, tmp_path, landed):
    connectors.register(spark)
    (tmp_path / "bad.parquet").write_text("no parquet")
    read = lambda **o: spark.read.format("brightvane").options(**o).load()
    (row,) = read(connector="parquet").collect()
    assert row.outcome == "not_configured" and "path" in row.message
    (tmp_path / "f.xml").write_text(FEED)
    rows = {r.title or r.outcome: r for r in read(connector="feeds", feeds=json.dumps([{"name": "good", "url": "u", "path": str(tmp_path / "f.xml")}, {"name": "gone", "path": "/nowhere"}])).collect()}
    assert rows["good"].summary == FEED and rows["error"].outcome == "error" and "/nowhere" in rows["error"].message
    assert [r.title for r in read(connector="feeds", feeds=json.dumps([{"name": "good", "path": str(tmp_path / "f.xml")}, {"name": "gone", "path": "/nowhere"}])).where("title = 'good'").collect()] == ["good"]
    with pytest.raises(Exception, match="no connector"):
        read(connector="nothing").collect()


def test_table_functions(spark):
    tables.register(spark)
    rows = spark.sql("SELECT * FROM find_terms('The cat, the CATS and a cat-the', 'cat|the')").collect()
    assert [(r.place, r.term, r.char_start) for r in rows] == [(0, "the", 0), (1, "cat", 4), (2, "the", 9), (3, "cat", 24), (4, "the", 28)]
    assert spark.sql("SELECT * FROM find_terms(NULL, 'a')").count() == 0
    talk = spark.createDataFrame([(1, 2, "a", "x y"), (1, 1, "a", "z"), (1, 3, "b", None), (1, 4, "a", "w"), (2, 1, None, "q"), (2, 2, None, "")], "c long, t int, who string, said string")
    got = spark.sql("SELECT * FROM speaker_runs(TABLE({t}), 'c', 't', 'who', 'said')", t=talk).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [(1, 0, "a", 2, 3), (1, 1, "b", 1, 0), (1, 2, "a", 1, 1), (2, 0, None, 2, 1)]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM speaker_runs(TABLE({t}), 'c', 't', 'nobody', 'said')", t=talk)
