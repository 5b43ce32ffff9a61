"""Themes and their trends (I-01 to I-12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import age_days
from ..functions.text import rounded, slugify

METRICS = ("market_relevance", "speaker_relevance", "evidence_strength", "business_impact", "novelty")


def theme_rows(signals: DataFrame, sources: DataFrame, fold: bool = True) -> DataFrame:
    """I-01 to I-03: a row per signal and theme, with its position: the primary one first, then the secondary ones in order.

    Sources and signals meet by id once; only the columns used go along.
    """
    s = signals.select("source_id", "primary_theme", "secondary_themes", "industries", *METRICS)
    o = sources.select("source_id", "source_domain", F.coalesce("published_at", "discovered_at").alias("at"))
    names = F.concat(F.array("primary_theme"), F.coalesce("secondary_themes", F.array().cast("array<string>")))
    names = F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))
    return s.join(o, "source_id").select("*", F.posexplode(names).alias("position", "theme")).withColumn("slug", slugify(F.col("theme"), fold=fold))


def theme_trends(signals: DataFrame, sources: DataFrame, as_of: Column, current_days: int = 21, previous_days: int = 21, min_sources: int = 2, min_domains: int = 2, fold: bool = True) -> DataFrame:
    """I-04 to I-09: one row per theme: counts, period counts, weighted averages, growth, recency and status.

    Averages weigh the first theme of a signal 1 and others 0.5, over the number of
    rows. Period counts are of rows. One shuffle of narrow rows by slug.
    """
    rows = theme_rows(signals, sources, fold)
    start = as_of - F.make_dt_interval(F.lit(current_days))
    before = start - F.make_dt_interval(F.lit(previous_days))
    weight = F.when(F.col("position") == 0, 1.0).otherwise(0.5)
    grouped = rows.groupBy("slug").agg(
        F.min("theme").alias("name"), F.countDistinct("source_id").alias("source_count"),
        F.countDistinct(F.when(F.col("source_domain") != "", F.col("source_domain"))).alias("distinct_domain_count"),
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
        F.count_if(F.col("at") >= start).alias("current_period_count"), F.count_if((F.col("at") < start) & (F.col("at") >= before)).alias("previous_period_count"),
        *[rounded(rounded(F.avg(F.coalesce(F.col(m), F.lit(0.0)) * weight), 6), 2).alias(f"average_{m}") for m in METRICS],
    )
    # a theme's industries are counted from pairs, so that none is gathered with all its rows
    named = rows.select("slug", F.explode("industries").alias("industry")).distinct().groupBy("slug").agg(F.count(F.lit(1)).cast("int").alias("distinct_industry_count"))
    grouped = grouped.join(named, "slug", "left").withColumn("distinct_industry_count", F.coalesce("distinct_industry_count", F.lit(0)))
    now, past = F.col("current_period_count"), F.col("previous_period_count")
    growth = F.when(past == 0, now.cast("double")).otherwise(rounded((now - past) / past, 3))
    out = grouped.withColumn("growth_rate", growth).withColumn("recency_days", rounded(age_days(F.col("last_seen"), as_of), 1))
    return out.withColumn("trend_status", classify(F.col("source_count"), F.col("distinct_domain_count"), now, past, F.col("growth_rate"), F.col("average_novelty"), F.col("first_seen"), start, min_sources, min_domains))


def classify(sources: Column, domains: Column, now: Column, past: Column, growth: Column, novelty: Column, first_seen: Column, start: Column, min_sources: int = 2, min_domains: int = 2) -> Column:
    """I-08: rules in order; the first that holds decides."""
    return (
        F.when((sources < min_sources) | (domains < min_domains), "low_confidence").when((first_seen >= start) & (now >= min_sources), "emerging")
        .when((sources >= 6) & (novelty < 4.0), "saturated").when((now >= 3) & (growth >= 0.5), "rising").when((past >= 2) & (growth <= -0.4), "declining").otherwise("stable")
    )


def rationale(status: Column, sources: Column, domains: Column, now: Column, past: Column, min_sources: int = 2) -> Column:
    """A sentence for a status."""
    n = lambda c: c.cast("string")
    return (
        F.when((status == "low_confidence") & (sources < min_sources), F.concat(F.lit("Only "), n(sources), F.lit(f" source(s), under the floor of {min_sources}.")))
        .when(status == "low_confidence", F.concat(n(sources), F.lit(" source(s) but only "), n(domains), F.lit(" distinct domain(s).")))
        .when(status == "emerging", F.concat(F.lit("First seen in the current period, with "), n(now), F.lit(" source(s) over "), n(domains), F.lit(" domain(s).")))
        .when(status == "saturated", F.concat(n(sources), F.lit(" sources of low novelty.")))
        .otherwise(F.concat(n(now), F.lit(" source(s) this period against "), n(past), F.lit(" last period.")))
    )


def upsert_themes(old: DataFrame, new: DataFrame) -> DataFrame:
    """I-10: new rows replace old ones of their slug; themes that vanish stay."""
    return new.unionByName(old.join(new.select("slug"), "slug", "left_anti"), allowMissingColumns=True)


def report(themes: DataFrame) -> DataFrame:
    """I-11: the names with each status that is reported, and how many."""
    told = themes.where(F.col("trend_status").isin("rising", "emerging", "low_confidence"))
    return told.groupBy("trend_status").agg(F.count(F.lit(1)).alias("themes"), F.array_sort(F.collect_list("name")).alias("names"))


def theme_sources(signals: DataFrame, sources: DataFrame, theme: str, limit: int = 50) -> DataFrame:
    """I-12: members of a theme, primary ones first, then by score."""
    member = (F.col("primary_theme") == theme) | F.array_contains("secondary_themes", theme)
    rows = signals.where(F.coalesce(member, F.lit(False))).withColumn("is_primary", F.coalesce(F.col("primary_theme") == theme, F.lit(False)))
    joined = rows.join(sources.select("source_id", "title", "source_domain"), "source_id")
    return joined.select("source_id", "title", "source_domain", "is_primary", "opportunity_score").orderBy(F.desc("is_primary"), F.desc_nulls_last("opportunity_score"), "source_id").limit(limit)


def top_themes(themes: DataFrame, statuses: Sequence[str] = (), limit: int = 14) -> DataFrame:
    """J-18"""
    rows = themes.where(F.col("trend_status").isin(*statuses)) if statuses else themes
    return rows.orderBy(F.desc("source_count"), "slug").limit(limit)


def rising_panel(themes: DataFrame, limit: int = 4, pool: int = 5) -> DataFrame:
    """J-19: rising and emerging themes; where there are none, the largest ones."""
    hot = F.col("trend_status").isin("rising", "emerging")
    flagged = themes.withColumn("_hot", hot).crossJoin(F.broadcast(themes.agg(F.max(hot).alias("_any"))))
    rows = flagged.where(F.col("_hot") | ~F.col("_any")).orderBy(F.desc("source_count"), "slug").limit(pool)
    return rows.orderBy(F.desc("source_count"), "slug").limit(limit).drop("_hot", "_any")


def ordered_first(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
