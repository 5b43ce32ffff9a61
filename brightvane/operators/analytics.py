"""Ranked and filtered views (J-01 to J-23)."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import is_aggregator, is_first_party, platform
from ..shared import settle
from .briefs import no_conversation


def dashboard_counters(sources: DataFrame, signals: DataFrame, themes: DataFrame, opportunities: DataFrame, drafts: DataFrame, watchlist: DataFrame, voice: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """J-01: one row of counts, with the id, start, stored rows and errors of the last run (null if there is none); a pass per table."""
    since = lambda hours: F.count_if(F.col("discovered_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    parts = [
        sources.agg(
            F.count(F.lit(1)).alias("total_sources"), since(24).alias("sources_24h"), since(168).alias("sources_7d"), F.count_if(F.col("status").isin("needs_review", "error")).alias("needs_review"),
            F.count_if(F.col("status").startswith("skipped_")).alias("policy_skipped"), F.countDistinct("source_domain").alias("distinct_domains"),
        ),
        signals.agg(F.count(F.lit(1)).alias("extracted_signals")),
        themes.agg(F.count(F.lit(1)).alias("themes"), F.count_if(F.col("trend_status").isin("rising", "emerging")).alias("rising_themes")),
        opportunities.agg(F.count(F.lit(1)).alias("opportunities")),
        drafts.agg(F.count_if(F.col("approval_status") == "pending_review").alias("drafts_pending"), F.count_if(F.col("approval_status") == "approved").alias("drafts_approved")),
        watchlist.agg(F.count_if(F.col("review_status") == "unreviewed").alias("watchlist_unreviewed")),
        voice.agg(F.count_if("approved_for_voice_library").alias("voice_examples")),
        runs.agg(F.max_by(F.struct("run_id", "started_at", "stored", F.size("errors").alias("errors")), F.struct("started_at", "run_id")).alias("_r")).select(*[F.col(f"_r.{c}").alias(f"last_run_{c}") for c in ("run_id", "started_at", "stored", "errors")]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # each is a single row
    return out


def source_library(sources: DataFrame, signals: DataFrame, statuses: Sequence[str] = (), types: Sequence[str] = (), domains: Sequence[str] = (), themes: Sequence[str] = (), industries: Sequence[str] = (), since: Column | None = None, min_score: float | None = None, search: str | None = None, limit: int | None = 200) -> DataFrame:
    """J-02: sources with their signals if any, filtered, newest first. Filters come before the limit; a search is literal."""
    rows = sources.join(signals, "source_id", "left")
    for column, values in (("status", statuses), ("source_type", types), ("source_domain", domains)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    if themes:
        rows = rows.where(F.col("primary_theme").isin(*themes) | F.coalesce(F.arrays_overlap("secondary_themes", F.array(*map(F.lit, themes))), F.lit(False)))
    if industries:
        rows = rows.where(F.arrays_overlap("industries", F.array(*map(F.lit, industries))))
    if since is not None:
        rows = rows.where(F.coalesce("published_at", "discovered_at") >= since)
    if min_score is not None:
        rows = rows.where(F.col("opportunity_score") >= min_score)
    if search:
        low = F.lit(search.lower())
        rows = rows.where(F.contains(F.lower("title"), low) | F.contains(F.lower("source_domain"), low))
    rows = rows.orderBy(F.desc_nulls_last("discovered_at"), "source_id")
    return rows.limit(limit) if limit else rows


def source_detail(sources: DataFrame, signals: DataFrame, source_id: int) -> DataFrame:
    """J-03"""
    return sources.where(F.col("source_id") == source_id).join(signals, "source_id", "left")


def diversify(rows: DataFrame, limit: int, per_domain: int = 2, order: Sequence[Column] | None = None) -> DataFrame:
    """J-04: in score order, at most `per_domain` of each domain; where that leaves under min(3, limit) rows, up to `limit` of each.

    Rows are cut per domain before the final sort, so a large domain costs a partial sort only.
    """
    order = list(order or (F.desc_nulls_last("opportunity_score"), F.col("source_id")))
    by_domain = Window.partitionBy(F.coalesce("source_domain", F.lit(""))).orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(by_domain)).where(F.col("_rank") <= limit)
    thin = ranked.agg((F.count_if(F.col("_rank") <= per_domain) < min(3, limit)).alias("_thin"))
    kept = ranked.crossJoin(F.broadcast(thin)).where(F.col("_thin") | (F.col("_rank") <= per_domain))
    return kept.drop("_rank", "_thin").orderBy(*order).limit(limit)


def prefer(rows: DataFrame, keep: Column) -> DataFrame:
    """The rows that satisfy `keep`, or all of them if none does."""
    flag = rows.agg(F.max(F.coalesce(keep, F.lit(False))).alias("_some"))
    return rows.crossJoin(F.broadcast(flag)).where(F.coalesce(keep, F.lit(False)) | ~F.col("_some")).drop("_some")


def top_signals(sources: DataFrame, signals: DataFrame, limit: int = 10, min_relevance: float = 4.0, own: Sequence[str] = (), overfetch: int = 6, per_domain: int = 2) -> DataFrame:
    """J-05: the best-scored relevant signals without aggregators and own pages, spread over domains.

    A gate, an over-fetch or a filter that would leave nothing is lifted.
    """
    s = sources.select("source_id", "title", "source_url", "source_domain", "published_at")
    g = signals.select("source_id", "primary_theme", "opportunity_score", "risk_score", "market_relevance", "evidence_strength", "is_promotional")
    rows = prefer(s.join(g, "source_id"), F.col("market_relevance") >= min_relevance)
    # a few rows from here on, which are read several times
    rows = settle(rows.orderBy(F.desc_nulls_last("opportunity_score"), "source_id").limit(limit * overfetch))
    rows = prefer(rows, ~is_aggregator(F.col("source_domain")))
    rows = prefer(rows, ~is_first_party(F.col("source_domain"), own))
    return diversify(rows, limit, per_domain)


def filter_options(sources: DataFrame, signals: DataFrame) -> DataFrame:
    """J-06: (field, value) of all values to filter by."""
    parts = [sources.select(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("source_type", "status", "source_domain")]
    parts += [signals.select(F.lit("theme").alias("field"), F.col("primary_theme").alias("value")), signals.select(F.lit("industry").alias("field"), F.explode("industries").alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def themes_table(themes: DataFrame, min_sources: int = 1) -> DataFrame:
    """J-07"""
    return themes.where(F.col("source_count") >= min_sources).orderBy(F.desc("source_count"), "slug")


def opportunities_list(opportunities: DataFrame, themes: DataFrame, drafts: DataFrame, statuses: Sequence[str] = ()) -> DataFrame:
    """J-08: opportunities with their theme's name and status and their number of drafts."""
    rows = opportunities.where(F.col("status").isin(*statuses)) if statuses else opportunities
    counts = drafts.groupBy("opportunity_id").agg(F.count(F.lit(1)).alias("drafts"))
    named = themes.select(F.col("slug").alias("theme_slug"), F.col("name").alias("theme"), "trend_status")
    rows = rows.join(named, "theme_slug", "left").join(counts, "opportunity_id", "left")
    return rows.withColumn("drafts", F.coalesce("drafts", F.lit(0)).cast("long")).withColumn("source_count", F.size("source_ids"))


def featured_opportunity(opportunities: DataFrame, sources: DataFrame, signals: DataFrame, drafts: DataFrame, own: Sequence[str] = (), min_relevance: float = 6.0, min_points: int = 3) -> DataFrame:
    """J-09: the one opportunity to lead with, and its rank: corroboration, points and drafts weigh as well as its score."""
    rows = opportunities.where((F.col("status") != "archived") & (F.col("points") >= min_points) & (F.size("source_ids") > 0))
    member = rows.select("opportunity_id", F.explode(F.array_distinct("source_ids")).alias("source_id"))
    facts = sources.select("source_id", "source_domain").join(signals.select("source_id", "market_relevance", "is_promotional", F.lit(True).alias("_signal")), "source_id", "left")
    outside = F.when((F.col("source_domain") != "") & ~is_first_party(F.col("source_domain"), own), F.col("source_domain"))
    agg = member.join(facts, "source_id").groupBy("opportunity_id").agg(F.countDistinct(outside).alias("domains"), F.count_if(outside.isNotNull() & ~F.col("is_promotional")).alias("independent"), F.avg("market_relevance").alias("relevance"))
    drafted = drafts.select("opportunity_id").distinct().withColumn("has_draft", F.lit(True))
    joined = rows.join(agg, "opportunity_id").join(drafted, "opportunity_id", "left").where(F.col("relevance") >= min_relevance)
    some = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rank = (
        some("opportunity_score") * 0.30 + some("confidence_score") * 0.25 + F.col("relevance") * 4 + F.least("domains", F.lit(5)) * 8 + F.least("independent", F.lit(4)) * 6
        + F.least("points", F.lit(5)) * 4 + F.when(F.col("has_draft"), 12).otherwise(0) - some("risk_score") * 0.15
    )
    return joined.select("opportunity_id", F.round(rank, 6).alias("rank")).orderBy(F.desc("rank"), "opportunity_id").limit(1)


def opportunity_detail(opportunities: DataFrame, sources: DataFrame, drafts: DataFrame, opportunity_id: int) -> DataFrame:
    """J-10: one opportunity with its sources and drafts as arrays."""
    one = opportunities.where(F.col("opportunity_id") == opportunity_id)
    cited = one.select("opportunity_id", F.explode_outer("source_ids").alias("source_id")).join(sources.select("source_id", "title", "source_domain"), "source_id").groupBy("opportunity_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "title", "source_domain"))).alias("sources"))
    written = drafts.where(F.col("opportunity_id") == opportunity_id).groupBy("opportunity_id").agg(F.array_sort(F.collect_list(F.struct("draft_id", "approval_status"))).alias("drafts"))
    return one.join(cited, "opportunity_id", "left").join(written, "opportunity_id", "left")


def set_status(rows: DataFrame, changes: DataFrame, key: str, column: str, allowed: Sequence[str], stamp: Column | None = None) -> DataFrame:
    """J-11: rows with the statuses of changes(key, value); a value that is not allowed raises."""
    checked = changes.select(F.col(key), F.when(F.col("value").isin(*allowed), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.col("value")))).alias("_value"))
    out = rows.join(checked, key, "left").withColumn(column, F.coalesce("_value", column))
    if stamp is not None:
        out = out.withColumn("updated_at", F.when(F.col("_value").isNotNull(), stamp))
    return out.drop("_value")


def latest(rows: DataFrame, order: str, limit: int, key: str) -> DataFrame:
    """J-12: the newest rows of a list."""
    return rows.orderBy(F.desc_nulls_last(order), key).limit(limit)


def best_brief_window(sources: DataFrame, signals: DataFrame, as_of: Column, windows: Sequence[int] = (24, 48, 72, 168, 720), least: int = 3) -> DataFrame:
    """J-13: the first window in hours with enough analysed sources, else the last. One pass."""
    rows = sources.select("source_id", "discovered_at").join(signals.select("source_id"), "source_id")
    counts = rows.agg(*[F.count_if(F.col("discovered_at") >= as_of - F.make_dt_interval(hours=F.lit(h))).alias(f"n{h}") for h in windows])
    return counts.select(F.coalesce(*[F.when(F.col(f"n{h}") >= least, F.lit(h)) for h in windows], F.lit(windows[-1])).alias("window_hours"))


def discovery_queries(sources: DataFrame, limit: int = 12) -> DataFrame:
    """J-14"""
    rows = sources.where(F.col("search_query").isNotNull() & (F.col("search_query") != ""))
    return rows.groupBy("search_query").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "search_query").limit(limit)


def agent_activity(runs: DataFrame) -> DataFrame:
    """J-15: a row per connector of each run, from the JSON of its stages, most candidates first."""
    stages = F.from_json("stages", "map<string,struct<connectors:map<string,struct<candidates:long,errors:long>>>>")
    rows = runs.select("run_id", (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))).alias("_us"), F.explode(F.map_entries(stages)).alias("stage"))
    rows = rows.select("run_id", (F.col("_us") / 1e6).alias("seconds"), F.col("stage.key").alias("stage"), F.explode(F.map_entries("stage.value.connectors")).alias("c"))
    return rows.select("run_id", "seconds", "stage", F.col("c.key").alias("connector"), F.col("c.value.candidates").alias("candidates"), F.col("c.value.errors").alias("errors")).orderBy("run_id", F.desc("candidates"), "connector")


def social_stats(sources: DataFrame, signals: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """J-16: (measure, n): analysed posts, those of each platform, and those rejected as vendors' or as irrelevant."""
    posts = sources.where(F.col("source_type").isin("social_public", "reddit")).join(signals.select("source_id", "market_relevance", "is_promotional"), "source_id")
    where, reason = platform(F.col("source_url")), F.coalesce(no_conversation(own), F.lit(""))
    flags = F.array(F.lit("analysed"), F.when(where != "other", F.concat(F.lit("on "), where)), F.when(F.contains(reason, F.lit("vendor")), "rejected_vendor").when(F.contains(reason, F.lit("relevance")), "rejected_relevance"))
    return posts.select(F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("measure")).groupBy("measure").agg(F.count(F.lit(1)).alias("n"))


def daily_brief(sources: DataFrame, signals: DataFrame, themes: DataFrame, opportunities: DataFrame, drafts: DataFrame, watchlist: DataFrame, as_of: Column, hours: int = 48, limit: int = 5) -> DataFrame:
    """J-17: (section, rank, item, text) of the brief.

    Signals found within `hours`, without aggregators and spread over domains; rising
    and emerging themes (stable ones where there are none); the best opportunities
    not archived; unreviewed items of the watchlist and drafts that wait, newest
    first; and at most 20 warnings about what these sections show.
    """
    row = lambda df, name, order, item, text: df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(F.lit(name).alias("section"), "rank", F.col(item).cast("string").alias("item"), text.alias("text"))
    best = sources.where(F.col("discovered_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))).select("source_id", "title", "source_domain").join(signals.select("source_id", "opportunity_score", "verification_notes"), "source_id")
    order = [F.desc_nulls_last("opportunity_score"), F.col("source_id")]
    best = settle(diversify(best.orderBy(*order).limit(3 * limit).where(~is_aggregator(F.col("source_domain"))), limit))
    hot = prefer(themes.where(F.col("trend_status").isin("rising", "emerging", "stable")), F.col("trend_status") != "stable").orderBy(F.desc("source_count"), F.desc("average_market_relevance"), "slug").limit(3)
    chosen = opportunities.where(F.col("status") != "archived").orderBy(F.desc_nulls_last("opportunity_score"), "opportunity_id").limit(limit)
    watched = watchlist.where(F.col("review_status") == "unreviewed").orderBy(F.desc("discovered_at"), "item_id").limit(5)
    pending = drafts.where(F.col("approval_status") == "pending_review").orderBy(F.desc("created_at"), "draft_id").limit(6)
    # each section is a handful of rows from here on
    sections = [
        row(best, "signal", order, "source_id", F.coalesce("title", F.lit("(untitled)"))), row(hot, "theme", [F.desc("source_count"), F.desc("average_market_relevance"), "slug"], "slug", F.col("name")),
        row(chosen, "opportunity", [F.desc_nulls_last("opportunity_score"), "opportunity_id"], "opportunity_id", F.col("title")), row(watched, "watchlist", [F.desc("discovered_at"), "item_id"], "item_id", F.col("priority")),
        row(pending, "draft", [F.desc("created_at"), "draft_id"], "draft_id", F.concat(F.col("unsupported").cast("string"), F.lit(" unsupported"))),
    ]
    told = lambda kind, key, text: F.concat(F.lit(f"[{kind} #"), F.col(key).cast("string"), F.lit("] "), text)
    noted = best.select(F.lit(1).alias("_part"), F.row_number().over(Window.orderBy(*order)).alias("_at"), "source_id", F.posexplode(F.slice("verification_notes", 1, 2)).alias("_k", "_note")).select("_part", "_at", "_k", F.col("source_id").cast("string").alias("item"), told("source", "source_id", F.col("_note")).alias("text"))
    whole = lambda c: F.format_string("%.0f", F.bround(c))
    risky = F.when(F.coalesce("risk_score", F.lit(0.0)) >= 50, told("opportunity", "opportunity_id", F.concat(F.lit("Risk score "), whole("risk_score"), F.lit("/100 — review risk notes before drafting."))))
    thin = F.when(F.coalesce("confidence_score", F.lit(0.0)) < 45, told("opportunity", "opportunity_id", F.concat(F.lit("Confidence "), whole(F.coalesce("confidence_score", F.lit(0.0))), F.lit("/100 — evidence base is thin."))))
    doubts = chosen.select(F.lit(2), F.row_number().over(Window.orderBy(F.desc_nulls_last("opportunity_score"), "opportunity_id")).alias("_at"), F.col("opportunity_id").cast("string").alias("item"), F.posexplode(F.array(risky, thin)).alias("_k", "text")).where("text is not null").select(F.lit(2), "_at", "_k", "item", "text")
    loose = pending.where("unsupported > 0").select(F.lit(3), F.row_number().over(Window.orderBy(F.desc("created_at"), "draft_id")), F.lit(0), F.col("draft_id").cast("string"), told("draft", "draft_id", F.concat(F.col("unsupported").cast("string"), F.lit(" unsupported sentence(s) flagged."))))
    warned = noted.union(doubts).union(loose).withColumn("rank", F.row_number().over(Window.orderBy("_part", "_at", "_k"))).where("rank <= 20").select(F.lit("warning").alias("section"), "rank", "item", "text")
    return functools.reduce(DataFrame.union, [*sections, warned])


def status_counts(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """J-20, J-21: counts by status, with zero for those that do not occur."""
    wanted = rows.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, position int")
    return wanted.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, "position", F.coalesce("n", F.lit(0)).alias("n"))


def deliverables(sources: DataFrame, signals: DataFrame) -> DataFrame:
    """J-22: (kind, key, n): sources by type and by status, signals, passages and quotes."""
    by = lambda c: sources.groupBy(F.lit(c).alias("kind"), F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    sums = signals.agg(F.count(F.lit(1)).alias("signals"), F.coalesce(F.sum("passages"), F.lit(0)).alias("passages"), F.coalesce(F.sum("quotes"), F.lit(0)).alias("quotes"))
    tall = sums.select(F.expr("stack(3, 'signals', signals, 'passages', cast(passages as bigint), 'quotes', cast(quotes as bigint)) as (key, n)")).select(F.lit("total").alias("kind"), "key", "n")
    return by("source_type").union(by("status")).union(tall)


def problem_rows(sources: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """J-23: rows that need a look, and whether they are our own."""
    bad = F.col("status").isin("error", "needs_review") | F.col("status").startswith("skipped_")
    return sources.where(bad).select("source_id", "status", "source_domain", is_first_party(F.col("source_domain"), own).alias("is_own"))
