"""Connectors over landed files (A-01 to A-18). What a network client would fetch is read from files; every connector gives items and never raises on a bad record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import any_of, clean_text, content_hash, word_count
from ..functions.urls import domain_of, is_allowed, is_http_url, normalize_url, social_handle, under
from ..shared import settle
from .snapshots import commit_snapshot, read_snapshot

ITEM = "source_type string, source_url string, title string, author string, summary string, published_at timestamp, position int"
REDDIT_LEAST_WORDS = 20


def _items(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    base = {"source_type": F.lit(kind), "title": F.lit(None).cast("string"), "author": F.lit(None).cast("string"), "summary": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp"), "position": F.lit(0)} | columns
    return df.select(*[base[n].cast(t).alias(n) for n, t in (x.split() for x in ITEM.split(", "))])


def _when(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3}, ", ""), "GMT$", "+0000")
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")))


def feed_items(spark: SparkSession, path: str, as_of: Column, per_feed: int = 15, lookback_days: int = 45) -> DataFrame:
    """A-02: items of RSS files, one feed a file: the first `per_feed` with a web link, undated or recent."""
    schema = "title string, link string, author string, description string, pubDate string"
    raw = spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(schema).load(path)
    raw = raw.withColumn("_feed", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    summary = clean_text(F.regexp_replace(F.col("description"), "<[^>]*>", " "))
    items = raw.select("_feed", "_at", "title", F.trim("link").alias("link"), "author", summary.alias("summary"), _when(F.col("pubDate")).alias("at"))
    items = items.where(is_http_url(F.col("link"))).where(F.col("at").isNull() | (F.col("at") >= as_of - F.make_dt_interval(F.lit(lookback_days))))
    items = items.withColumn("_rn", F.row_number().over(Window.partitionBy("_feed").orderBy("_at"))).where(F.col("_rn") <= per_feed)
    return _items(items, "rss", source_url=F.col("link"), title=F.col("title"), author=F.col("author"), summary=F.col("summary"), published_at=F.col("at"), position=F.col("_rn"))


def search_items(spark: SparkSession, path: str, blocked: Sequence[str] = (), per_query: int = 8) -> DataFrame:
    """A-03: results of web searches landed as JSON lines {query, results:[{url,title,snippet,date}]}."""
    return search_rows(spark.read.schema(SEARCH).json(path), blocked, per_query)


SEARCH = "query string, results array<struct<url:string,title:string,snippet:string,date:string>>"


def search_rows(found: DataFrame, blocked: Sequence[str] = (), per_query: int = 8) -> DataFrame:
    """A-03 over rows of the schema SEARCH: each URL once, blocked domains dropped."""
    raw = found.select("query", F.posexplode("results").alias("rank", "r")).where(F.col("rank") < per_query)
    rows = raw.select("query", "rank", F.col("r.url").alias("url"), F.col("r.title").alias("title"), F.col("r.snippet").alias("snippet"), _when(F.col("r.date")).alias("at"))
    rows = rows.where(is_http_url(F.col("url")) & ~under(domain_of(F.col("url")), blocked)).withColumn("_n", normalize_url(F.col("url")))
    rows = rows.groupBy("_n").agg(F.min_by(F.struct("query", "rank", "url", "title", "snippet", "at"), F.struct("query", "rank")).alias("_f")).select("_f.*")
    return _items(rows, "web_search", source_url=F.col("url"), title=F.col("title"), summary=F.col("snippet"), published_at=F.col("at"), position=F.col("rank"))


def social_reasons(items: DataFrame, as_of: Column, max_age_days: int = 120, hosts: Sequence[str] = lists.SOCIAL_HOSTS) -> DataFrame:
    """A-04: items with their handle and the reason they are dropped, or null: off the platform, no post, undated, too old."""
    url = F.col("source_url")
    reason = (
        F.when(~under(domain_of(url), hosts), "off_platform").when(~any_of(F.lower(url), lists.POST_MARKERS), "not_a_post").when(F.col("published_at").isNull(), "undated")
        .when(F.col("published_at") < as_of - F.make_dt_interval(F.lit(max_age_days)), "too_old")
    )
    return items.withColumn("drop_reason", reason).withColumn("author", F.coalesce("author", social_handle(url)))


def reddit_items(spark: SparkSession, path: str, as_of: Column, lookback_days: int = 45) -> DataFrame:
    """A-05: posts landed as JSON lines {url,title,author,selftext,created_utc}."""
    return reddit_rows(spark.read.schema("url string, title string, author string, selftext string, created_utc double").json(path), as_of, lookback_days)


def reddit_rows(posts: DataFrame, as_of: Column, lookback_days: int = 45) -> DataFrame:
    """A-05 over rows: old posts and those of under 20 words dropped."""
    at = F.timestamp_seconds("created_utc")
    rows = posts.where(at >= as_of - F.make_dt_interval(F.lit(lookback_days))).where(word_count(F.col("selftext")) >= REDDIT_LEAST_WORDS)
    return _items(rows, "reddit", source_url=F.col("url"), title=F.col("title"), author=F.concat(F.lit("u/"), F.col("author")), summary=F.col("selftext"), published_at=at)


def video_items(spark: SparkSession, path: str) -> DataFrame:
    """A-06: videos landed as JSON lines {id,title,description,channel,published}."""
    return video_rows(spark.read.schema("id string, title string, description string, channel string, published string").json(path))


def video_rows(videos: DataFrame) -> DataFrame:
    """A-06 over rows: the body is title and description."""
    rows = videos.where("id is not null")
    return _items(rows, "youtube", source_url=F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("id")), title=F.col("title"), author=F.col("channel"), summary=F.concat_ws("\n\n", "title", "description"), published_at=_when(F.col("published")))


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, allowed: Sequence[str], blocked: Sequence[str] = (), per_section: int = 12, min_words: int = 90) -> DataFrame:
    """A-07: stored pages(url, text) reached from seeds(section, url) over links(url, target), breadth first: section, url, depth, text.

    A section's first `per_section` pages that exist are looked at, of which those
    with enough words are given. The search goes on until each section has that many
    or no links are left; every round reaches a page more, so it ends.
    """
    url = lambda c: normalize_url(F.col(c)).alias(c)
    stored = pages.select(url("url"), "text").groupBy("url").agg(F.first("text").alias("text"))
    near = settle(links.select(url("url"), url("target")).where(is_allowed(F.col("target"), allowed, blocked)).distinct())
    reached = frontier = settle(seeds.select("section", url("url"), F.lit(0).alias("depth")).distinct())
    depth = 0
    while True:
        there = reached.join(stored.select("url"), "url", "left_semi").groupBy("section").agg(F.count(F.lit(1)).alias("_n"))
        short = reached.select("section").distinct().join(there.where(F.col("_n") >= per_section), "section", "left_anti")
        depth += 1
        after = frontier.join(short, "section", "left_semi").join(stored.select("url"), "url", "left_semi").join(near, "url").select("section", F.col("target").alias("url"), F.lit(depth).alias("depth")).distinct()
        frontier = settle(after.join(reached.select("section", "url"), ["section", "url"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = settle(reached.union(frontier))
    found = reached.join(stored, "url")
    w = Window.partitionBy("section").orderBy("depth", "url")
    return found.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= per_section) & (word_count(F.col("text")) >= min_words)).select("section", "url", "depth", "text")


def manual_items(entries: DataFrame) -> DataFrame:
    """A-08: entries(kind, text, url): a URL is made from the text's hash where there is none; the title is the first line, cut at 120. Empty texts are dropped."""
    text = clean_text(F.col("text"))
    rows = entries.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_clean", text).withColumn("_line", F.regexp_extract("_clean", r"^([^\n]*)", 1))
    given = normalize_url(F.col("url"))
    # the clean text is composed already; to compose it again may leave a Python function unplanned
    made = F.concat(F.lit("manual://"), F.col("kind"), F.lit("/"), F.left(content_hash(F.col("_clean"), compose=False), F.lit(16)))
    title = F.when(F.length("_line") > 120, F.concat(F.left("_line", F.lit(120)), F.lit("…"))).otherwise(F.col("_line"))
    return _items(rows, "manual", source_url=F.when(given != "", given).otherwise(made), title=title, summary=F.left("_clean", F.lit(400)))


def fetch_outcome(status_code: Column, url: Column, body: Column, robots_allowed: Column, wait_seconds: Column, blocked: Sequence[str] = (), max_wait: float = 30.0, restricted: Sequence[str] = ("captcha", "enable javascript", "subscribe to continue", "access denied")) -> Column:
    """A-09, A-10: what a stored response counts as: the first rule that applies."""
    return (
        F.when(~is_http_url(url), "skipped_bad_scheme").when(under(domain_of(url), blocked), "skipped_blocklist").when(~F.coalesce(robots_allowed, F.lit(True)), "skipped_robots").when(wait_seconds > max_wait, "skipped_crawl_delay_deferred")
        .when(status_code.isin(401, 402, 403), "skipped_access_restricted").when(F.coalesce(status_code, F.lit(0)) != 200, "error").when(any_of(F.lower(F.coalesce(body, F.lit(""))), restricted), "skipped_access_restricted").otherwise("fetched")
    )


def voice_seeds(sources: DataFrame, have: DataFrame, domain: str, n: int = 10, least: int = 150, marks: Sequence[str] = ("/blog/", "/news/", "/story/")) -> DataFrame:
    """A-18: long own texts, preferred paths first, longest first, without those already there."""
    rank = F.coalesce(*[F.when(F.contains("source_url", F.lit(m)), F.lit(i)) for i, m in enumerate(marks)], F.lit(len(marks)))
    rows = sources.where(under(F.col("source_domain"), (domain,)) & (word_count(F.col("cleaned_text")) >= least)).join(have.select("source_url"), "source_url", "left_anti")
    return rows.orderBy(rank, F.desc(F.length("cleaned_text")), "source_id").limit(n)


def feed_health(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """O-09: entries of each configured feed(name, url), and whether it works."""
    counts = items.groupBy(domain_of(F.col("source_url")).alias("_d")).agg(F.count(F.lit(1)).alias("entries"))
    return feeds.join(counts, domain_of(F.col("url")) == F.col("_d"), "left").select("name", "url", F.coalesce("entries", F.lit(0)).alias("entries"), (F.coalesce("entries", F.lit(0)) > 0).alias("ok"))


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """A-16: brief rows (section, rank, title) as the lines of one document, in order."""
    lines = rows.select("section", "rank", F.concat(F.lit("- "), F.col("title")).alias("line"))
    heads = rows.select("section").distinct().select("section", F.lit(0).alias("rank"), F.concat(F.lit("\n## "), F.initcap("section")).alias("line"))
    return lines.union(heads).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "rank", "line"))), lambda x: x["line"]), "\n").alias("_b")).select(F.concat(F.lit(f"# {title}\n"), F.col("_b")).alias("value"))


def json_summary(rows: DataFrame) -> DataFrame:
    """A-17: each row as a line of JSON."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def read_table(spark: SparkSession, path: str | None = None, url: str | None = None, table: str | None = None) -> DataFrame:
    """A-12: a stored table: by path the last snapshot of `replace_table`, or plain Parquet; or a database's by JDBC."""
    if path is None:
        return spark.read.format("jdbc").option("url", url).option("dbtable", table).load()
    current = read_snapshot(spark, path)
    return spark.read.parquet(path) if current is None else current


def replace_table(df: DataFrame, path: str) -> int:
    """A-13: a table is replaced as a whole; df may read it. Readers by `read_table` see the old rows or the new ones, at any moment."""
    return commit_snapshot(df, path)
