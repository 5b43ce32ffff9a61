"""Connectors, feeds, robots rules and table functions (A-01, A-02, A-06, A-10, O-09, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.text import any_of
from ..functions.urls import domain_of
from ..registry import query
from ..sources import connectors, feeds, robots
from .functions import _CLEAN
from .ranking import as_of
from .views import AS_OF

AGENT = "BrightBot/2.1 (+https://example.org/bot)"
#: A host's file by the length of its name modulo 4; the first kind has none.
_FILES = (
    None,
    "User-agent: *  # all\r\nDisallow: /fr/\r\nAllow: /fr/*5\r\nDisallow: /*?page=\r\nDisallow: /*.html$\r\nDisallow:\r\nCrawl-delay: 5\r\n",
    "user-agent: other\nuser-agent: brightbot\nDisallow: /\nAllow: /en/\nDisallow: /en/*7\ncrawl-delay: 2.5\n\nUser-agent: *\nDisallow: /e\nAllow: /en\nCrawl-delay: 600\n",
    "# nothing for us\nSitemap: https://x/s.xml\nUser-agent: elsebot\nDisallow: /\nUser-agent: *\nDisallow: /de/$\nDisallow: /*/*2\nAllow: /*/*2$\n",
)


def _like(*rules: tuple[str, bool, int]) -> str:
    """The verdict of rules (LIKE pattern, allow, length): the longest that matches, an allowing one first."""
    order = sorted(rules, key=lambda r: (-r[2], not r[1]))
    return "CASE " + " ".join(f"WHEN path LIKE '{like}' THEN {str(allow).lower()}" for like, allow, _ in order) + " ELSE true END"


_ALL_1 = _like(("/fr/%", False, 4), ("/fr/%5%", True, 6), ("/%?page=%", False, 8), ("/%.html", False, 8))
_OWN_2, _ALL_2 = _like(("/%", False, 1), ("/en/%", True, 4), ("/en/%7%", False, 6)), _like(("/e%", False, 2), ("/en%", True, 3))
_ALL_3 = _like(("/de/", False, 5), ("/%/%2%", False, 5), ("/%/%2", True, 6))


@query(rf"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://(?:www[.])?([^/:?#]+)', 1)) AS host, regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '#.*$', '') AS path FROM pages), k AS (SELECT page_id, length(host) % 4 AS kind, CASE WHEN path = '' OR starts_with(path, '?') THEN '/' || path ELSE path END AS path FROM p),
    v AS (SELECT *, CASE kind WHEN 0 THEN true WHEN 1 THEN {_ALL_1} WHEN 2 THEN {_OWN_2} OR {_ALL_2} ELSE {_ALL_3} END AS robots_allowed FROM k)
    SELECT page_id, robots_allowed, CASE WHEN kind = 0 THEN 'no robots.txt published' WHEN robots_allowed THEN 'allowed by robots.txt' ELSE 'disallowed by robots.txt' END AS robots_reason, CASE kind WHEN 1 THEN 5e0 WHEN 2 THEN 25e-1 END AS crawl_delay FROM v""")
def a10_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    hosts = pages.select(domain_of(F.col("url")).alias("host")).distinct()
    kind = F.length("host") % 4
    files = hosts.select("host", F.when(kind == 0, 404).otherwise(200).alias("status"), F.when(kind == 1, _FILES[1]).when(kind == 2, _FILES[2]).when(kind == 3, _FILES[3]).alias("body"))
    return robots.permitted(pages, files, AGENT).select("page_id", "robots_allowed", "robots_reason", "crawl_delay")


def _documents_as_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a feed of one RSS item, an Atom entry, one of a video, one too old, one undated and one without a link; a source's name is the feed's."""
    doc = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # few texts have such a character, and to look for it is cheaper
    bare = F.when(any_of(F.col("text"), "<>[]"), F.regexp_replace("text", r"[<>\[\]]", " ")).otherwise(F.col("text"))
    text, number = F.concat(F.lit("<![CDATA[<p>"), bare, F.lit("</p>]]>")), F.col("doc_id").cast("string")
    parts = (
        '<?xml version="1.0"?><feed xmlns:dc="d" xmlns:media="m" xmlns:yt="y"><title>t</title>\n<item><title> First &amp; ', number, "</title><link>https://www.e.org/a/", number, "/?utm_source=x</link><dc:creator>Ann ", number,
        "</dc:creator><category>news</category><category> ", F.col("lang"), " </category><description>", text, "</description><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate></item>\n",
        '<entry><id>tag:', number, '</id><title type="html">Second</title><link rel="self" href="https://e.org/self"/><link rel="alternate" href="https://e.org/b/', number, '"/><author><email>x</email></author><author><name>Bob</name></author><category term="atom"/><updated>2024-01-20T08:30:00Z</updated><content type="html">', text, "</content></entry>\n",
        "<entry><title>Film ", number, '</title><link href="https://www.youtube.com/watch?v=', F.lpad(number, 11, "v"), '"/><published>2024-01-02T00:00:00Z</published><yt:videoId>', F.lpad(number, 11, "v"), "</yt:videoId><media:group><media:description>About the film.</media:description></media:group></entry>",
        "<item><title>Old</title><link>https://e.org/old</link><pubDate>Sun, 01 Jan 2023 10:00:00 GMT</pubDate></item><item><guid>https://e.org/undated/", number, "</guid><author>Cy</author></item><item><title>No link</title></item></feed>",
    )
    return doc.select(F.col("source").alias("feed_name"), F.concat(F.lit("https://e.org/feed/"), number).alias("feed_url"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("body"))


_BODY = _CLEAN.format("' ' || regexp_replace(text, '[<>\\[\\]]', ' ', 'g') || ' '")


@query(f"""WITH d AS (SELECT doc_id, source, lang, sha256({_BODY}) AS summary FROM documents),
    e AS (SELECT *, unnest([1, 2, 3, 4]) AS position FROM d)
    SELECT 'https://e.org/feed/' || doc_id AS feed_url, source AS feed_name, position::INTEGER AS position, CASE position WHEN 1 THEN 'https://e.org/a/' || doc_id WHEN 2 THEN 'https://e.org/b/' || doc_id WHEN 3 THEN 'https://youtube.com/watch?v=' || lpad(doc_id::VARCHAR, 11, 'v') ELSE 'https://e.org/undated/' || doc_id END AS source_url,
    CASE position WHEN 1 THEN 'First & ' || doc_id WHEN 2 THEN 'Second' WHEN 3 THEN 'Film ' || doc_id END AS title, CASE position WHEN 1 THEN 'Ann ' || doc_id WHEN 2 THEN 'Bob' WHEN 4 THEN 'Cy' END AS author, CASE position WHEN 3 THEN sha256('About the film.') WHEN 4 THEN sha256('') ELSE summary END AS summary,
    CASE position WHEN 1 THEN make_timestamp(1706608800000000) WHEN 2 THEN make_timestamp(1705739400000000) WHEN 3 THEN make_timestamp(1704153600000000) END AS published_at, CASE position WHEN 1 THEN 'news,' || lang WHEN 2 THEN 'atom' ELSE '' END AS tags FROM e""")
def a02_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = feeds.feed_items(_documents_as_feeds(spark, sf_dir), as_of())
    return items.select("feed_url", "feed_name", "position", "source_url", "title", "author", F.sha2("summary", 256).alias("summary"), "published_at", F.array_join("tags", ",").alias("tags"))


@query("SELECT 'https://www.youtube.com/watch?v=' || lpad(doc_id::VARCHAR, 11, 'v') AS source_url, 'Film ' || doc_id AS title, source AS author, 'Film ' || doc_id || chr(10) || chr(10) || 'About the film.' AS summary FROM documents")
def a06_channel_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.channel_items(_documents_as_feeds(spark, sf_dir)).select("source_url", "title", "author", "summary")


@query(f"SELECT 'https://e.org/feed/' || doc_id AS feed_url, source AS feed_name, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 1 ELSE 6 END::INTEGER AS entries, CASE WHEN doc_id % 4 < 2 THEN 0 ELSE 2 END::INTEGER AS kept, doc_id % 4 > 0 AS ok, CASE WHEN doc_id % 4 = 0 THEN 'no entries in feed' WHEN doc_id % 4 = 1 THEN 'no entries within the 45-day window' END AS problem FROM documents WHERE {AS_OF} > 0")
def o09_feed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a feed in four is empty, and another has only an old item; two entries a feed are kept at most
    kind = F.regexp_extract("feed_url", r"(\d+)$", 1).cast("long") % 4
    some = _documents_as_feeds(spark, sf_dir).withColumn("body", F.when(kind == 0, "<rss/>").when(kind == 1, F.regexp_extract("body", r"(<item><title>Old.*?</item>)", 1)).otherwise(F.col("body")))
    return feeds.feed_report(some, as_of(), per_feed=2)


@query("SELECT 'parquet' AS connector, 'item' AS outcome, page_id AS place, url AS source_url, sha256(html) AS summary FROM pages UNION ALL SELECT 'feeds', 'not_configured', NULL, NULL, NULL UNION ALL SELECT 'feeds', 'error', NULL, NULL, NULL")
def a01_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connector over landed pages, one that is not set up, and one whose file is missing: each gives rows."""
    connectors.register(spark)
    read = lambda **options: spark.read.format("brightvane").options(**options).load()
    pages = read(connector="parquet", path=f"{sf_dir}/pages.parquet", key="page_id", summary="html")
    every = pages.union(read(connector="feeds")).union(read(connector="feeds", feeds='[{"name": "gone", "path": "/nowhere/feed.xml"}]'))
    return every.select("connector", "outcome", "place", "source_url", F.sha2("summary", 256).alias("summary"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\pL\pM\pN_]+'), lambda x: x IN ('the', 'und', 'les', 'que')) AS l FROM documents) SELECT doc_id, unnest(range(len(l)))::INTEGER AS place, unnest(l) AS term FROM w""")
def n06_find_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    return spark.sql("SELECT doc_id, f.place, f.term FROM {d}, LATERAL find_terms(text, 'the|und|les|que') f", d=spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query(r"""WITH s AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run FROM s)
    SELECT conv_id, run::BIGINT AS run, min(role) AS role, count(*) AS "rows", sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS words FROM r GROUP BY conv_id, run""")
def n07_speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    return spark.sql("SELECT * FROM speaker_runs(TABLE({c}), 'conv_id', 'turn', 'role', 'text')", c=spark.read.parquet(f"{sf_dir}/conversations.parquet"))
