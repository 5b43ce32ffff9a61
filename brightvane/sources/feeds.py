"""Feeds of any kind (A-02, A-06, O-09): RSS items and Atom entries of a document in their order, and what each feed gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, let
from ..functions.urls import is_http_url, normalize_url, video_id
from .landing import _items, _when

#: Elements that bear an entry, with or without a namespace prefix, up to their first end: from one `<` to the next.
_BLOCK = r"(?s)(<((?:\w+:)?(?:item|entry))(?:\s[^>]*)?>(?:[^<]*<(?!/\2>))*+[^<]*</\2>)"
_TEXT = "struct<_VALUE:string,_type:string>"
#: What is read of an entry, whatever the kind of its feed: names keep their prefixes, attributes begin with `_`.
ENTRY = (
    f"title {_TEXT}, link array<struct<_VALUE:string,_href:string,_rel:string>>, guid struct<_VALUE:string>, id string, author array<struct<_VALUE:string,name:string>>, `dc:creator` array<string>,"
    f" description {_TEXT}, summary {_TEXT}, content {_TEXT}, `content:encoded` string, pubDate string, published string, updated string, `dc:date` string, created string,"
    " category array<struct<_VALUE:string,_term:string>>, `yt:videoId` string, `media:group` struct<`media:description`:string,`media:thumbnail`:array<struct<_url:string>>>"
)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed documents (feed_name, feed_url, body), one a file."""
    name = F.col("_metadata.file_name")
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("feed_name"), F.col("_metadata.file_path").alias("feed_url"), F.col("value").alias("body"))


def _given(c: Column) -> Column:
    """A trimmed text, or null for an empty one."""
    return F.nullif(F.trim(c), F.lit(""))


def _key(e: Column) -> Column:
    """What decides on a parsed entry: its link and its date, beside the entry itself.

    A link is the first of: an element's text, an alternate (or unmarked) reference,
    the id. The date is the first of publication, update and creation that can be read.
    """
    references = F.filter(e["link"], lambda x: x["_href"].isNotNull() & F.coalesce(x["_rel"], F.lit("alternate")).isin("alternate"))
    texts = F.filter(e["link"], lambda x: _given(x["_VALUE"]).isNotNull())
    link = F.coalesce(_given(F.get(texts, F.lit(0))["_VALUE"]), _given(F.get(references, F.lit(0))["_href"]), _given(e["id"]), _given(e["guid"]["_VALUE"]))
    at = F.coalesce(*[_when(e[c]) for c in ("pubDate", "published", "dc:date", "updated", "created")])
    return F.struct(link.alias("link"), at.alias("published_at"), e.alias("e"))


def _fields(k: Column) -> Column:
    """What an entry gives whose key is known.

    The author is the first named one, or the creator; tags are categories with a
    term or a text; the summary has no marks, but is not cleaned yet. What cannot be
    parsed has nulls.
    """
    e = k["e"]
    people = F.filter(F.concat(F.transform(F.coalesce(e["author"], F.array().cast("array<struct<_VALUE:string,name:string>>")), lambda a: F.coalesce(_given(a["name"]), _given(a["_VALUE"]))), F.coalesce(e["dc:creator"], F.array().cast("array<string>"))), lambda a: _given(a).isNotNull())
    tags = F.filter(F.transform(F.coalesce(e["category"], F.array().cast("array<struct<_VALUE:string,_term:string>>")), lambda c: F.coalesce(_given(c["_term"]), _given(c["_VALUE"]))), lambda t: t.isNotNull())
    summary = F.coalesce(*[_given(c) for c in (e["summary"]["_VALUE"], e["description"]["_VALUE"], e["content"]["_VALUE"], e["content:encoded"], e["media:group"]["media:description"])], F.lit(""))
    bare = let(summary, lambda s: F.when(F.contains(s, F.lit("<")), F.regexp_replace(s, "<[^>]*>", " ")).otherwise(s))
    thumbnail = F.get(e["media:group"]["media:thumbnail"], F.lit(0))["_url"]
    return F.struct(
        _given(e["title"]["_VALUE"]).alias("title"), k["link"].alias("link"), F.get(people, F.lit(0)).alias("author"), bare.alias("summary"), k["published_at"].alias("published_at"), tags.alias("tags"), e["yt:videoId"].alias("video"), thumbnail.alias("thumbnail")
    )


def _entries() -> Column:
    """The keys of the entries of `body` in document order: a feed is one row, so its entries are bounded by it and nothing is shuffled. A null body has none."""
    blocks = F.coalesce(F.regexp_extract_all(F.col("body"), F.lit(_BLOCK), 1), F.array().cast("array<string>"))
    return F.transform(F.transform(blocks, lambda x: F.from_xml(x, ENTRY, {"mode": "PERMISSIVE"})), _key)


def _recent(as_of: Column, lookback_days: int):
    return lambda e: is_http_url(e["link"]) & (e["published_at"].isNull() | (e["published_at"] >= as_of - F.make_dt_interval(F.lit(lookback_days))))


def feed_items(feeds: DataFrame, as_of: Column, per_feed: int = 15, lookback_days: int = 45) -> DataFrame:
    """A-02: of each feed the first `per_feed` entries with a web link that are undated or recent: items with feed_name, feed_url and tags."""
    kept = F.slice(F.filter(_entries(), _recent(as_of, lookback_days)), 1, per_feed)
    rows = feeds.select("feed_name", "feed_url", F.posexplode(F.transform(kept, _fields)).alias("at", "e"))
    return rows.select("feed_name", "feed_url", (F.col("at") + 1).alias("position"), normalize_url(F.col("e.link")).alias("source_url"), F.lit("rss").alias("source_type"), "e.title", "e.author", clean_text(F.col("e.summary")).alias("summary"), "e.published_at", "e.tags")


def channel_items(feeds: DataFrame, per_channel: int = 8) -> DataFrame:
    """A-06 without a key: the first entries of each channel's feed that name a video; the author is the entry's or else the channel."""
    first = F.slice(_entries(), 1, per_channel)
    rows = feeds.select("feed_name", "feed_url", F.explode(F.transform(first, _fields)).alias("e")).withColumn("_id", F.coalesce(video_id(F.col("e.link")), F.col("e.video"))).where("_id is not null and _id <> ''")
    items = rows.select("feed_name", "feed_url", "_id", "e.*")
    summary = let(clean_text(F.col("summary")), lambda s: F.nullif(s, F.lit("")))
    return _items(items, "youtube", source_url=F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("_id")), title=F.col("title"), author=F.coalesce("author", "feed_name"), summary=F.concat_ws("\n\n", "title", summary), published_at=F.col("published_at"))


def feed_report(feeds: DataFrame, as_of: Column, per_feed: int = 15, lookback_days: int = 45) -> DataFrame:
    """O-09: for each feed, by its URL, the entries found and kept, whether it works, and the reason if it gave nothing."""
    n, kept = F.size("entries"), F.least(F.size(F.filter("entries", _recent(as_of, lookback_days))), F.lit(per_feed))
    problem = F.when(F.col("body").isNull(), "not fetched").when(n == 0, "no entries in feed").when(kept == 0, F.lit(f"no entries within the {lookback_days}-day window"))
    decided = F.transform(_entries(), lambda k: F.struct(k["link"].alias("link"), k["published_at"].alias("published_at")))
    return feeds.withColumn("entries", decided).select("feed_name", "feed_url", n.alias("entries"), kept.alias("kept"), (n > 0).alias("ok"), problem.alias("problem"))
