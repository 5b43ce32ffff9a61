"""Engagement, evidence and briefs (K-01 to K-18)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.labels import count_label
from ..functions.text import any_of, loose, truncate, word_count
from ..functions.urls import is_first_party, normalize_url, under
from ..shared import settle
from . import scoring, templates
from .taxonomy import Phrases, Theme

MIN_ENGAGEMENT, PROMOTABLE, LEAST_SCORE, MOST_BRIEFS = 6.0, ("rising", "emerging", "stable", "saturated", "declining"), 55.0, 12


def no_conversation(own: Sequence[str] = ()) -> Column:
    """K-01: why a source is no conversation to join, or null; the first reason that holds."""
    host, url = F.lower(F.coalesce("source_domain", F.lit(""))), F.lower(F.coalesce("source_url", F.lit("")))
    holds = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(url, m))
    return (
        F.when(under(host, (*own[:1], *lists.NO_CONVERSATION_DOMAINS)), "company or job-board domain")
        .when(under(host, lists.SOCIAL_HOSTS) & ~holds(lists.POST_MARKERS), "social profile or landing page").when(under(host, own), "own property")
        .when(holds(lists.NO_CONVERSATION_PATHS), "job listing, pricing or product page").when(F.coalesce("is_promotional", F.lit(False)), "vendor marketing")
        .when(F.coalesce("market_relevance", F.lit(0.0)) < MIN_ENGAGEMENT, "relevance below the bar")
        .when((F.trim(F.coalesce("author", F.lit(""))) == "") & F.col("published_at").isNull(), "no author and no date")
    )


def watchlist(sources: DataFrame, signals: DataFrame, rising: DataFrame, existing: DataFrame, as_of: Column, limit: int = 6, min_relevance: float = 4.0, recent_days: int = 45, own: Sequence[str] = ()) -> DataFrame:
    """K-02: conversations worth joining. The limit comes before known URLs are skipped.

    A source counts by its publication date or else by when it was found, and as
    rising by its first theme or any other; `rising` has the names of such themes.
    """
    rows = sources.select("source_id", "title", "author", "source_url", "source_domain", "published_at", "discovered_at").join(signals.select("source_id", "primary_theme", "secondary_themes", "market_relevance", "speaker_relevance", "freshness", "opportunity_score", "is_promotional", *[c for c in ("industries", "customer_problem", "primary_claim") if c in signals.columns]), "source_id").where(F.col("market_relevance") >= min_relevance)
    pool = rows.orderBy(F.desc("market_relevance"), F.desc("opportunity_score"), "source_id").limit(max(30 * limit, 120))
    since = F.coalesce("published_at", "discovered_at")
    pool = pool.where(since.isNull() | (since >= as_of - F.make_dt_interval(F.lit(recent_days)))).where(no_conversation(own).isNull())
    # the pool is bounded, and so are the themes it names
    named = pool.select("source_id", F.explode(F.array_union(F.array("primary_theme"), F.coalesce("secondary_themes", F.array().cast("array<string>")))).alias("name"))
    hot = named.join(rising.select("name"), "name", "left_semi").select("source_id", F.lit(1).alias("is_rising")).distinct()
    ranked = pool.join(hot, "source_id", "left").withColumn("is_rising", F.coalesce("is_rising", F.lit(0))).withColumn("named", F.coalesce((F.col("author") != "").cast("int"), F.lit(0)))
    best = ranked.orderBy(F.desc("is_rising"), F.desc("named"), F.desc("market_relevance"), F.desc("opportunity_score"), "source_id").limit(limit)
    known = existing.select(normalize_url(F.col("source_url")).alias("_url"))
    return best.join(known, normalize_url(best["source_url"]) == known["_url"], "left_anti").withColumn("priority", priority(F.col("is_rising") == 1))


def priority(rising: Column) -> Column:
    """K-03: high for a rising theme's source that is relevant to market and speaker (14 of 20) and fresh; medium from 11 on."""
    score = F.coalesce("market_relevance", F.lit(0.0)) + F.coalesce("speaker_relevance", F.lit(0.0))
    return F.when(rising & (score >= 14) & (F.coalesce("freshness", F.lit(0.0)) >= 6), "high").when(score >= 11, "medium").otherwise("low")


def connection(industries: Column, relevance: Column) -> Column:
    """K-03: how a source bears on the company: by its served industries, named in order, by its category, or by theme only."""
    served = F.array_sort(F.array_intersect(F.coalesce(industries, F.array().cast("array<string>")), F.array(*map(F.lit, lists.CORE_INDUSTRIES))))
    text = templates.CONNECTION_INDUSTRY.split("{industries}")
    named = F.concat(F.lit(text[0]), F.array_join(served, ", "), F.lit(text[1]))
    return F.when(F.size(served) > 0, named).when(F.coalesce(relevance, F.lit(0.0)) >= 7, templates.CONNECTION_CATEGORY).otherwise(templates.CONNECTION_THEME)


def angle(problem: Column, claim: Column) -> Column:
    """K-03: what to say: about the source's problem, or else its claim, or only if there is something specific."""
    said = F.coalesce(F.nullif(F.trim(problem), F.lit("")), F.nullif(F.trim(claim), F.lit("")))
    text = templates.ANGLE_CLAIM.split("{claim}")
    return F.when(said.isNotNull(), F.concat(F.lit(text[0]), truncate(said, 160), F.lit(text[1]))).otherwise(templates.ANGLE_NONE)


def theme_evidence(signals: DataFrame, sources: DataFrame, themes: DataFrame, limit: int = 25) -> DataFrame:
    """K-04: tall evidence (slug, kind, source_id, source_domain, is_promotional, text, detail, place) of the best `limit` members of each theme.

    Passages and quotes only where verbatim; the detail is a quote's speaker or a
    figure's value; the place is the order of members and within them.
    """
    member = signals.withColumn("theme", F.explode(F.array_distinct(F.concat(F.array("primary_theme"), "secondary_themes")))).join(themes.select(F.col("name").alias("theme"), "slug"), "theme")
    w = Window.partitionBy("slug").orderBy(F.desc_nulls_last("opportunity_score"), "source_id")
    member = member.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).join(sources.select("source_id", "source_domain"), "source_id")
    part = lambda kind, text, detail=None: F.struct(F.lit(kind).alias("kind"), text.alias("text"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
    every = F.concat(
        F.transform(F.filter("supporting_evidence", lambda x: x["verified_verbatim"] & (x["passage"] != "")), lambda x: part("passage", x["passage"])), F.transform(F.filter("notable_quotes", lambda x: x["verified_verbatim"] & (x["quote"] != "")), lambda x: part("quote", x["quote"], x["speaker"])),
        F.transform(F.filter("numerical_claims", lambda x: x["value"] != ""), lambda x: part("number", F.coalesce(x["context"], F.lit("")), x["value"])), F.transform(F.filter(F.array("customer_problem"), lambda x: x != ""), lambda x: part("problem", x)), F.transform(F.filter(F.array("primary_claim"), lambda x: x != ""), lambda x: part("claim", x)),
    )
    rows = member.select("slug", "source_id", "source_domain", "is_promotional", "_rn", F.posexplode(every).alias("_at", "e"))
    return rows.select("slug", "source_id", "source_domain", "is_promotional", "e.kind", "e.text", "e.detail", (F.col("_rn") * 10000 + F.col("_at")).alias("place"))


def dominant_industries(members: DataFrame, top: int = 3) -> DataFrame:
    """K-05: per theme the industries named by max(2, a fifth) of its members, most first."""
    counts = members.groupBy("slug").agg(F.countDistinct("source_id").alias("members"))
    rows = members.select("slug", "source_id", F.explode("industries").alias("industry")).where("industry <> 'Cross-industry'").groupBy("slug", "industry").agg(F.countDistinct("source_id").alias("n"))
    rows = rows.join(counts, "slug").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("members") / 5)))
    w = Window.partitionBy("slug").orderBy(F.desc("n"), "industry")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("slug", "industry", "n", "rank")


def passage_quality(text: Column, terms: Column, wrong: Column, promotional: Column) -> Column:
    """K-06: how well a passage supports a theme, given how many of the theme's terms it holds and whether it holds one in the wrong sense."""
    n = word_count(text)
    score = (
        F.when(terms == 0, -8.0).otherwise(F.least(terms, F.lit(3)) * 4.0) + F.when(promotional, 0.0).otherwise(3.0) - F.when(any_of(F.lower(text), lists.MARKETING_TELLS), 4.0).otherwise(0.0)
        + F.when(text.rlike(r"\d"), 1.5).otherwise(0.0) + F.when(n.between(12, 45), 1.0).otherwise(0.0)
    )
    return F.when(wrong, -10.0).otherwise(score)


def quote_quality(text: Column, terms: Column, wrong: Column, promotional: Column, speaker: Column) -> Column:
    """K-07"""
    n = word_count(text)
    score = (
        F.when(terms == 0, -5.0).otherwise(0.0) + F.when(F.coalesce(speaker, F.lit("")) != "", 3.0).otherwise(0.0) + F.when(text.rlike(r"\d"), 2.0).otherwise(0.0) - F.when(any_of(F.lower(text), lists.MARKETING_TELLS), 5.0).otherwise(0.0)
        + F.when(n < 8, -3.0).when(n.between(10, 45), 1.5).otherwise(0.0) + F.when(promotional, 0.0).otherwise(1.0)
    )
    return F.when(wrong, -10.0).otherwise(score)


def term_counts(text: Column, slug: Column, themes: Sequence[Theme]) -> tuple[Column, Column]:
    """How many of its theme's terms (strong ones and keywords, each once) a text holds, and whether it holds one of the theme's negative words."""
    p = Phrases(text)
    terms, wrong = F.lit(0), F.lit(False)
    for t in themes:
        terms = F.when(slug == t.slug, p.number(tuple(dict.fromkeys((*t.strong, *t.keywords))))).otherwise(terms)
        wrong = F.when(slug == t.slug, p.any(t.negative)).otherwise(wrong)
    return terms, wrong


def rank_evidence(evidence: DataFrame, terms: Column, wrong: Column) -> DataFrame:
    """K-08: evidence of `theme_evidence` in order by kind, with its quality.

    Passages by quality, those of none dropped where a theme has others; quotes by
    quality; figures, problems and claims only on theme and in the right sense,
    independent ones first, figures with the longest context first.
    """
    text, sold = F.col("text"), F.coalesce("is_promotional", F.lit(False))
    scored = evidence.withColumn("terms", terms).withColumn("wrong", wrong)
    scored = scored.withColumn("quality", F.when(F.col("kind") == "passage", passage_quality(text, F.col("terms"), F.col("wrong"), sold)).when(F.col("kind") == "quote", quote_quality(text, F.col("terms"), F.col("wrong"), sold, F.col("detail"))))
    good = (F.col("kind") == "passage") & (F.col("quality") > 0)
    # a theme's evidence is bounded by its members
    kept = scored.withColumn("_some", F.max(good).over(Window.partitionBy("slug"))).where(F.when(F.col("kind") == "passage", good | ~F.col("_some")).when(F.col("kind") == "quote", F.lit(True)).otherwise((F.col("terms") > 0) & ~F.col("wrong"))).drop("_some")
    longest = F.when(F.col("kind") == "number", -F.length("text")).otherwise(0)
    w = Window.partitionBy("slug", "kind").orderBy(F.desc_nulls_last("quality"), F.when(F.col("quality").isNull(), sold), longest, "place")
    return kept.withColumn("rank", F.row_number().over(w))


def supporting_points(evidence: DataFrame, target: int = 5, least: int = 3, most: int = 250) -> DataFrame:
    """K-09: passages in rank order, one per source first, then sources again while there are under `least`; each passage once.

    Greedy over two keys, so by theme in Arrow. Only the first `most` passages of a
    theme are looked at: `theme_evidence` gives no more.
    """
    ready = evidence.where("kind = 'passage'").where(F.col("rank") <= most).select("slug", "source_id", "text", "rank", F.left(loose(F.col("text")), F.lit(120)).alias("_key"))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        chosen, keys, sources = [], set(), set()
        for again in (False, True):
            for r in rows.sort_values("rank").itertuples():
                full = len(chosen) >= (least if again else target)
                if not full and r._5 not in keys and (again or r.source_id not in sources):
                    keys.add(r._5)
                    sources.add(r.source_id)
                    chosen.append((r.slug, r.source_id, r.text, len(chosen) + 1))
        return pd.DataFrame(chosen, columns=["slug", "source_id", "text", "point"])

    return ready.groupBy("slug").applyInPandas(pick, "slug string, source_id long, text string, point int")


def hook(evidence: DataFrame) -> DataFrame:
    """K-10: per theme the best opening (slug, hook, step) from ranked evidence: the first quote if of quality 2 or more, the first figure if independent or the only one, an independent problem, any problem."""
    alone = F.count_if(F.col("kind") == "number").over(Window.partitionBy("slug")) == 1
    sold, first = F.coalesce("is_promotional", F.lit(False)), F.col("rank") == 1
    usable = (
        F.when((F.col("kind") == "quote") & first & (F.col("quality") >= 2.0), 1).when((F.col("kind") == "number") & first & (~sold | alone), 2)
        .when((F.col("kind") == "problem") & ~sold, 3).when((F.col("kind") == "problem") & first, 4)
    )
    cited = F.concat(F.lit("(source #"), F.col("source_id").cast("string"))
    said = F.concat(F.lit("“"), truncate(F.col("text"), 180), F.lit("”"), F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" — "), F.col("detail"))).otherwise(""), F.lit(" "), cited, F.lit(")"))
    figure = F.concat(F.col("detail"), F.lit(" — from “"), truncate(F.col("text"), 150), F.lit("” "), cited, F.lit("; verify before use)."))
    rows = evidence.withColumn("step", usable).where("step is not null")
    w = Window.partitionBy("slug").orderBy("step", "rank")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("slug", F.when(F.col("step") == 1, said).when(F.col("step") == 2, figure).otherwise(truncate(F.col("text"), 190)).alias("hook"), "step")


def hook_without_evidence(name: Column, sources: Column, domains: Column) -> Column:
    """K-10: the opening of a theme for which `hook` has none."""
    return F.concat(name, F.lit(": a pattern visible across "), count_label(sources, "public source"), F.lit(" from "), count_label(domains, "domain"), F.lit("."))


def match_stored_passage(claims: DataFrame, passages: DataFrame, least: int = 40, window: int = 20) -> DataFrame:
    """K-13: claims joined to the first passage that contains them or that they contain, at `least` characters or more.

    Both sides are keyed by their character windows' hashes at word starts, so that
    only texts that share one are compared. Keys meet without the texts, which are
    fetched for what met: else each text is copied once for each of its words.
    """
    starts = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"(?:^|(?<= ))(?=(.{{{window}}}))"), 1), lambda x: F.xxhash64(x)))
    keys = lambda df, of, c: df.select(of, F.explode(starts(loose(F.col(c)))).alias("_k"))
    met = keys(claims, "claim_id", "claim").join(keys(passages, "passage_id", "passage"), "_k").select("claim_id", "passage_id").distinct()
    met = settle(met)
    a = claims.join(met.select("claim_id").distinct(), "claim_id", "left_semi").select("claim_id", loose(F.col("claim")).alias("_c"))
    b = passages.select("passage_id", loose(F.col("passage")).alias("_p"))
    long = (F.length("_c") >= least) & (F.length("_p") >= least)
    pairs = a.join(met, "claim_id").join(b, "passage_id").where(long & (F.contains("_c", F.col("_p")) | F.contains("_p", F.col("_c"))))
    return pairs.groupBy("claim_id").agg(F.min("passage_id").alias("passage_id"))


def score_brief(members: DataFrame) -> DataFrame:
    """K-14: per theme the mean components of its members, their weighted score, and the confidence."""
    means = members.groupBy("slug").agg(*[F.avg(k).alias(k) for k in lists.WEIGHTS], F.countDistinct("source_domain").alias("domains"), F.countDistinct("source_id").alias("sources"), F.sum("passages").alias("passages"), F.count("published_at").alias("dated"))
    score, _ = scoring.opportunity({k: F.col(k) for k in lists.WEIGHTS})
    return means.select("slug", score.alias("opportunity_score"), scoring.confidence(F.col("domains"), F.col("passages"), F.col("evidence_strength"), F.col("sources"), F.col("dated") > 0).alias("confidence_score"))


def promote(themes: DataFrame, scores: DataFrame, evidence_count: DataFrame, least: float = LEAST_SCORE, most: int = MOST_BRIEFS) -> DataFrame:
    """K-15: themes in order with the reason they are skipped, or null for those written; the cap counts written ones."""
    rows = themes.join(scores, "slug", "left").join(evidence_count, "slug", "left")
    reason = (
        F.when(~F.col("trend_status").isin(*PROMOTABLE), "status").when(F.coalesce("evidence", F.lit(0)) == 0, "no evidence").when(F.coalesce("opportunity_score", F.lit(0.0)) < least, "score")
    )
    order = [F.desc("average_market_relevance"), F.desc("source_count"), F.col("slug")]
    # one theme is one row here: the running count is over themes, not sources
    written = F.count_if(reason.isNull()).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("skip_reason", F.coalesce(reason, F.when(written > most, "cap"))).select("slug", "opportunity_score", "skip_reason")


def persist_opportunities(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """K-16: a theme's new brief replaces its latest one, unless that is approved, in review or archived."""
    w = Window.partitionBy("theme_slug").orderBy(F.desc("opportunity_id"))
    latest = old.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("theme_slug", F.col("opportunity_id").alias("_old"), F.col("status").alias("_status"))
    held = F.coalesce(F.col("_status").isin("approved", "review", "archived"), F.lit(False)) & F.lit(not force)
    use = new.join(latest, "theme_slug", "left").where(~held)
    return old.join(use.select(F.col("_old").alias("opportunity_id")), "opportunity_id", "left_anti").unionByName(use.drop("_old", "_status"), allowMissingColumns=True)


def retire_stale(opportunities: DataFrame, promoted: DataFrame) -> DataFrame:
    """K-17: opportunities of themes no longer promoted are archived; approved ones are only noted."""
    live = promoted.select(F.col("slug").alias("theme_slug"), F.lit(True).alias("_live")).distinct()
    rows = opportunities.join(live, "theme_slug", "left")
    gone = F.col("_live").isNull()
    return rows.withColumn("note", F.when(gone & (F.col("status") == "approved"), "theme no longer promoted")).withColumn("status", F.when(gone & (F.col("status") != "approved"), "archived").otherwise(F.col("status"))).drop("_live")


def reconcile_statuses(opportunities: DataFrame, drafts: DataFrame) -> DataFrame:
    """K-18: drafting without a draft goes back to ready_for_brief."""
    have = drafts.select("opportunity_id").distinct().withColumn("_has", F.lit(True))
    rows = opportunities.join(have, "opportunity_id", "left")
    return rows.withColumn("status", F.when((F.col("status") == "drafting") & F.col("_has").isNull(), "ready_for_brief").otherwise(F.col("status"))).drop("_has")


def independent(domain: Column, promotional: Column, own: Sequence[str]) -> Column:
    return ~promotional & ~is_first_party(domain, own)
