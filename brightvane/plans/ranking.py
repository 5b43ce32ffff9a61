"""Themes, scores and ranked views (H, I, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..operators import analytics, scoring, trends
from ..registry import query
from .views import AS_OF, OWN_DOMAINS, oracle, view

_NOW = f"make_timestamp({AS_OF}000000)"
_OWN = " OR ".join(f"source_domain = '{d}' OR ends_with(source_domain, '.{d}')" for d in OWN_DOMAINS)


def as_of():
    return F.timestamp_seconds(F.lit(AS_OF))


def _themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.theme_trends(view(spark, sf_dir, "m_signals"), view(spark, sf_dir, "m_sources"), as_of())


THEMES = f"""t_rows AS (
  SELECT DISTINCT ON (s.source_id, u.theme) s.*, o.source_domain, coalesce(o.published_at, o.discovered_at) AS seen, u.theme, u.pos,
         lower(replace(u.theme, ' ', '-')) AS slug
  FROM m_signals s JOIN m_sources o ON s.source_id = o.source_id
  CROSS JOIN LATERAL (SELECT unnest(list_filter(list_concat([s.primary_theme], s.secondary_themes), lambda x: x IS NOT NULL)) AS theme,
                             unnest(range(len(list_filter(list_concat([s.primary_theme], s.secondary_themes), lambda x: x IS NOT NULL)))) AS pos) u
  ORDER BY s.source_id, u.theme, u.pos),
t_w AS (SELECT *, CASE WHEN pos = 0 THEN 1e0 ELSE 5e-1 END AS w FROM t_rows),
t_agg AS (
  SELECT slug, min(theme) AS name, count(DISTINCT source_id) AS source_count, count(DISTINCT source_domain) AS distinct_domain_count,
    min(seen) AS first_seen, max(seen) AS last_seen,
    count(*) FILTER (WHERE seen >= {_NOW} - INTERVAL 21 DAY) AS current_period_count,
    count(*) FILTER (WHERE seen < {_NOW} - INTERVAL 21 DAY AND seen >= {_NOW} - INTERVAL 42 DAY) AS previous_period_count,
    round(round(avg(market_relevance * w), 6), 2) AS average_market_relevance, round(round(avg(speaker_relevance * w), 6), 2) AS average_speaker_relevance,
    round(round(avg(evidence_strength * w), 6), 2) AS average_evidence_strength, round(round(avg(business_impact * w), 6), 2) AS average_business_impact, round(round(avg(novelty * w), 6), 2) AS average_novelty
  FROM t_w GROUP BY slug),
t_ind AS (SELECT slug, count(DISTINCT i) AS distinct_industry_count FROM (SELECT slug, unnest(industries) AS i FROM t_w) GROUP BY slug),
t_growth AS (SELECT a.*, i.distinct_industry_count, CASE WHEN previous_period_count = 0 THEN CAST(current_period_count AS DOUBLE)
    ELSE round((current_period_count - previous_period_count) / CAST(previous_period_count AS DOUBLE), 3) END AS growth_rate,
    round((epoch_us({_NOW}) - epoch_us(last_seen)) / 86400e6, 1) AS recency_days FROM t_agg a JOIN t_ind i ON a.slug = i.slug),
t AS (SELECT *, CASE WHEN source_count < 2 OR distinct_domain_count < 2 THEN 'low_confidence'
    WHEN first_seen >= {_NOW} - INTERVAL 21 DAY AND current_period_count >= 2 THEN 'emerging' WHEN source_count >= 6 AND average_novelty < 4 THEN 'saturated'
    WHEN current_period_count >= 3 AND growth_rate >= 0.5 THEN 'rising' WHEN previous_period_count >= 2 AND growth_rate <= -0.4 THEN 'declining' ELSE 'stable' END AS trend_status FROM t_growth)"""


@query(oracle(f"WITH {THEMES} SELECT slug, name, source_count, distinct_domain_count, distinct_industry_count, epoch(first_seen)::BIGINT AS first_seen, epoch(last_seen)::BIGINT AS last_seen, current_period_count, previous_period_count, average_market_relevance, average_speaker_relevance, average_evidence_strength, average_business_impact, average_novelty, growth_rate, recency_days, trend_status FROM t"))
def i08_theme_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _themes(spark, sf_dir)
    return t.withColumn("first_seen", F.unix_seconds("first_seen")).withColumn("last_seen", F.unix_seconds("last_seen")).withColumn("distinct_industry_count", F.col("distinct_industry_count").cast("long"))


@query(oracle(f"WITH {THEMES} SELECT trend_status, count(*) AS themes, string_agg(name, ',' ORDER BY name) AS names FROM t WHERE trend_status IN ('rising', 'emerging', 'low_confidence') GROUP BY trend_status"))
def i11_trend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.report(_themes(spark, sf_dir)).withColumn("names", F.array_join("names", ","))


@query(oracle("SELECT s.source_id, o.source_domain, coalesce(s.primary_theme = 'Theme 5', false) AS is_primary, s.opportunity_score FROM m_signals s JOIN m_sources o ON s.source_id = o.source_id WHERE coalesce(s.primary_theme = 'Theme 5', false) OR list_contains(s.secondary_themes, 'Theme 5') ORDER BY is_primary DESC, s.opportunity_score DESC, s.source_id LIMIT 50"))
def i12_theme_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.theme_sources(view(spark, sf_dir, "m_signals"), view(spark, sf_dir, "m_sources"), "Theme 5").drop("title")


@query(oracle(f"WITH {THEMES} SELECT slug, source_count, trend_status FROM t WHERE trend_status IN ('saturated', 'stable', 'declining') ORDER BY source_count DESC, slug LIMIT 14"))
def j18_trend_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.top_themes(_themes(spark, sf_dir), ("saturated", "stable", "declining")).select("slug", "source_count", "trend_status")


@query(oracle(f"WITH {THEMES}, f AS (SELECT *, trend_status IN ('rising', 'emerging') AS hot, max(trend_status IN ('rising', 'emerging')) OVER () AS anyone FROM t) SELECT slug, source_count FROM f WHERE hot OR NOT anyone ORDER BY source_count DESC, slug LIMIT 4"))
def j19_rising_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.rising_panel(_themes(spark, sf_dir)).select("slug", "source_count")


@query(oracle(f"WITH {THEMES} SELECT slug, source_count, trend_status FROM t WHERE source_count >= 20"))
def j07_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.themes_table(_themes(spark, sf_dir), 20).select("slug", "source_count", "trend_status")


@query(oracle(f"""SELECT source_id, CASE WHEN published_at IS NULL THEN 4e0 WHEN a <= 7 THEN 1e1 WHEN a >= 120 THEN 0e0 ELSE round(greatest(1e1 * (1e0 - (a - 7) / 113), 0e0), 2) END AS freshness
    FROM (SELECT source_id, published_at, (epoch_us({_NOW}) - epoch_us(published_at)) / 86400e6 AS a FROM m_sources)"""))
def h01_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "m_sources")
    return s.select("source_id", scoring.freshness(F.col("published_at"), as_of()).alias("freshness"))


_SUM = "least(market_relevance, 1e1) * 0.25e0 * 1e1 + least(speaker_relevance, 1e1) * 0.2e0 * 1e1 + least(evidence_strength, 1e1) * 0.2e0 * 1e1 + least(freshness, 1e1) * 0.15e0 * 1e1 + least(novelty, 1e1) * 0.1e0 * 1e1 + least(business_impact, 1e1) * 0.1e0 * 1e1"


@query(oracle(f"SELECT source_id, round(round({_SUM}, 6), 1) AS score, CASE WHEN round(round({_SUM}, 6), 1) >= 80 THEN 'Strong' WHEN round(round({_SUM}, 6), 1) >= 65 THEN 'Promising' WHEN round(round({_SUM}, 6), 1) >= 50 THEN 'Moderate' ELSE 'Weak' END AS band FROM m_signals"))
def h02_opportunity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "m_signals")
    _, rows = scoring.opportunity({k: F.col(k) for k in scoring.lists.WEIGHTS})
    raw = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["raw_0_10"] * x["weight"] * 10.0)
    score = F.round(F.round(raw, 6), 1)
    return s.select("source_id", score.alias("score"), scoring.score_band(score).alias("band"))


@query(oracle("""SELECT source_id, least(CASE WHEN evidence_strength < 4 THEN 18 ELSE 0 END + CASE WHEN is_promotional THEN 10 ELSE 0 END + CASE WHEN primary_theme IS NULL THEN 8 ELSE 0 END + CASE WHEN novelty < 3 THEN 10 ELSE 0 END, 100)::DOUBLE AS risk,
    CASE WHEN least(CASE WHEN evidence_strength < 4 THEN 18 ELSE 0 END + CASE WHEN is_promotional THEN 10 ELSE 0 END + CASE WHEN primary_theme IS NULL THEN 8 ELSE 0 END + CASE WHEN novelty < 3 THEN 10 ELSE 0 END, 100) <= 24 THEN 'Low' ELSE 'Moderate' END AS band FROM m_signals"""))
def h03_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "m_signals")
    total, band, _ = scoring.risk({"weak_sourcing": F.col("evidence_strength") < 4, "promotional_source": F.col("is_promotional"), "unlisted": F.col("primary_theme").isNull(), "overused_narrative": F.col("novelty") < 3})
    return s.select("source_id", total.alias("risk"), band.alias("band"))


@query(oracle("""SELECT source_id, round(least((least((source_id % 5) / 3e0, 1e0) * 30 + least(passages / 4e0, 1e0) * 25 + evidence_strength / 1e1 * 30 + least((source_id % 8) / 5e0, 1e0) * 15) * CASE WHEN source_id % 5 <= 1 THEN 0.65e0 ELSE 1e0 END * CASE WHEN source_id % 3 = 0 THEN 0.9e0 ELSE 1e0 END, 1e2), 1) AS confidence FROM m_signals"""))
def h04_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, i = view(spark, sf_dir, "m_signals"), F.col("source_id")
    return s.select("source_id", scoring.confidence(i % 5, F.col("passages"), F.col("evidence_strength"), i % 8, i % 3 != 0).alias("confidence"))


@query(oracle(f"""WITH {THEMES} SELECT count(*) AS total_sources, count(*) FILTER (WHERE discovered_at >= {_NOW} - INTERVAL 24 HOUR) AS sources_24h, count(*) FILTER (WHERE discovered_at >= {_NOW} - INTERVAL 168 HOUR) AS sources_7d,
    count(*) FILTER (WHERE status IN ('needs_review', 'error')) AS needs_review, count(*) FILTER (WHERE starts_with(status, 'skipped_')) AS policy_skipped, count(DISTINCT source_domain) AS distinct_domains,
    (SELECT count(*) FROM m_signals) AS extracted_signals, (SELECT count(*) FROM t) AS themes, (SELECT count(*) FROM t WHERE trend_status IN ('rising', 'emerging')) AS rising_themes, (SELECT count(*) FROM m_opportunities) AS opportunities,
    (SELECT count(*) FROM m_drafts WHERE approval_status = 'pending_review') AS drafts_pending, (SELECT count(*) FROM m_drafts WHERE approval_status = 'approved') AS drafts_approved, (SELECT count(*) FROM m_watchlist WHERE review_status = 'unreviewed') AS watchlist_unreviewed, (SELECT count(*) FROM m_voice WHERE approved_for_voice_library) AS voice_examples,
    r.run_id AS last_run_run_id, r.started_at AS last_run_started_at, r.stored AS last_run_stored, len(r.errors)::INTEGER AS last_run_errors FROM m_sources, (SELECT * FROM m_runs ORDER BY started_at DESC, run_id DESC LIMIT 1) r GROUP BY ALL"""))
def j01_dashboard_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda n: view(spark, sf_dir, n)
    return analytics.dashboard_counters(v("m_sources"), v("m_signals"), _themes(spark, sf_dir), v("m_opportunities"), v("m_drafts"), v("m_watchlist"), v("m_voice"), v("m_runs"), as_of())


@query(oracle(f"""SELECT o.source_id, o.status, o.source_domain, s.primary_theme, s.opportunity_score FROM m_sources o LEFT JOIN m_signals s ON o.source_id = s.source_id
    WHERE o.status IN ('extracted', 'fetched') AND (s.primary_theme IN ('Theme 1', 'Theme 2') OR list_has_any(s.secondary_themes, ['Theme 1', 'Theme 2'])) AND list_has_any(s.industries, ['industry 1'])
      AND coalesce(o.published_at, o.discovered_at) >= {_NOW} - INTERVAL 100 DAY AND s.opportunity_score >= 10 ORDER BY o.discovered_at DESC, o.source_id LIMIT 200"""))
def j02_source_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.source_library(view(spark, sf_dir, "m_sources"), view(spark, sf_dir, "m_signals"), statuses=("extracted", "fetched"), themes=("Theme 1", "Theme 2"), industries=("industry 1",), since=as_of() - F.expr("interval 100 days"), min_score=10.0)
    return rows.select("source_id", "status", "source_domain", "primary_theme", "opportunity_score")


@query(oracle("SELECT o.source_id, o.status, o.source_domain, s.primary_theme FROM m_sources o LEFT JOIN m_signals s ON o.source_id = s.source_id WHERE o.source_id = 42"))
def j03_source_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.source_detail(view(spark, sf_dir, "m_sources"), view(spark, sf_dir, "m_signals"), 42).select("source_id", "status", "source_domain", "primary_theme")


@query(oracle(f"""WITH b AS (SELECT o.source_id, o.source_domain, s.opportunity_score, s.market_relevance FROM m_sources o JOIN m_signals s ON o.source_id = s.source_id WHERE s.market_relevance >= 4 ORDER BY s.opportunity_score DESC, o.source_id LIMIT 60),
    c AS (SELECT *, ({_OWN}) AS own, max(NOT ({_OWN})) OVER () AS anyone FROM b), d AS (SELECT * FROM c WHERE NOT own OR NOT anyone),
    e AS (SELECT *, row_number() OVER (PARTITION BY source_domain ORDER BY opportunity_score DESC, source_id) AS rn FROM d), f AS (SELECT *, (SELECT count(*) FROM e WHERE rn <= 2) < 3 AS thin FROM e)
    SELECT source_id, source_domain, opportunity_score, market_relevance FROM f WHERE thin OR rn <= 2 ORDER BY opportunity_score DESC, source_id LIMIT 10"""))
def j05_top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_signals(view(spark, sf_dir, "m_sources"), view(spark, sf_dir, "m_signals"), own=OWN_DOMAINS).select("source_id", "source_domain", "opportunity_score", "market_relevance")


@query(oracle("""SELECT DISTINCT 'source_type' AS field, source_type AS value FROM m_sources UNION SELECT 'status', status FROM m_sources UNION SELECT 'source_domain', source_domain FROM m_sources
    UNION SELECT 'theme', primary_theme FROM m_signals WHERE primary_theme IS NOT NULL UNION SELECT 'industry', unnest(industries) FROM m_signals"""))
def j06_filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.filter_options(view(spark, sf_dir, "m_sources"), view(spark, sf_dir, "m_signals"))


@query(oracle(f"""WITH {THEMES}, n AS (SELECT opportunity_id, count(*) AS drafts FROM m_drafts GROUP BY opportunity_id) SELECT o.opportunity_id, o.status, t.name AS theme, t.trend_status, coalesce(n.drafts, 0)::BIGINT AS drafts, len(o.source_ids)::INTEGER AS source_count
    FROM m_opportunities o LEFT JOIN t ON o.theme_slug = t.slug LEFT JOIN n ON o.opportunity_id = n.opportunity_id WHERE o.status IN ('ready_for_brief', 'drafting')"""))
def j08_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.opportunities_list(view(spark, sf_dir, "m_opportunities"), _themes(spark, sf_dir), view(spark, sf_dir, "m_drafts"), ("ready_for_brief", "drafting"))
    return rows.select("opportunity_id", "status", "theme", "trend_status", "drafts", "source_count")


@query(oracle(f"""WITH m AS (SELECT o.opportunity_id, o.opportunity_score, o.confidence_score, o.risk_score, o.points, unnest(o.source_ids) AS source_id FROM m_opportunities o WHERE o.status <> 'archived' AND o.points >= 3),
    f AS (SELECT m.*, CASE WHEN NOT ({_OWN}) THEN r.source_domain END AS outside, s.is_promotional, s.market_relevance FROM m JOIN m_sources r ON m.source_id = r.source_id LEFT JOIN m_signals s ON m.source_id = s.source_id),
    a AS (SELECT opportunity_id, any_value(opportunity_score) AS os, any_value(confidence_score) AS cs, any_value(risk_score) AS rs, any_value(points) AS pt, count(DISTINCT outside) AS d, count(*) FILTER (WHERE outside IS NOT NULL AND NOT is_promotional) AS i, avg(market_relevance) AS r FROM f GROUP BY opportunity_id),
    k AS (SELECT a.opportunity_id, round(os * 0.3e0 + cs * 0.25e0 + r * 4 + least(d, 5) * 8 + least(i, 4) * 6 + least(pt, 5) * 4 + CASE WHEN a.opportunity_id IN (SELECT opportunity_id FROM m_drafts) THEN 12 ELSE 0 END - rs * 0.15e0, 6) AS rank FROM a WHERE r >= 6)
    SELECT opportunity_id, rank FROM k ORDER BY rank DESC, opportunity_id LIMIT 1"""))
def j09_featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda n: view(spark, sf_dir, n)
    return analytics.featured_opportunity(v("m_opportunities"), v("m_sources"), v("m_signals"), v("m_drafts"), OWN_DOMAINS)


@query(oracle(f"""SELECT coalesce({", ".join(f"CASE WHEN count(*) FILTER (WHERE discovered_at >= {_NOW} - INTERVAL {h} HOUR) >= 3 THEN {h} END" for h in (24, 48, 72, 168, 720))}, 720)::INTEGER AS window_hours FROM m_sources o JOIN m_signals s ON o.source_id = s.source_id"""))
def j13_brief_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.best_brief_window(view(spark, sf_dir, "m_sources"), view(spark, sf_dir, "m_signals"), as_of())


@query(oracle("SELECT search_query, count(*) AS n FROM m_items GROUP BY search_query ORDER BY n DESC, search_query LIMIT 12"))
def j14_discovery_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.discovery_queries(view(spark, sf_dir, "m_items"))


_SOCIAL = "SELECT * REPLACE (CASE source_id % 4 WHEN 0 THEN 'https://www.linkedin.com/posts/a-' || source_id WHEN 1 THEN 'https://x.com/a/status/' || source_id ELSE source_url END AS source_url) FROM m_sources WHERE source_type IN ('social_public', 'reddit')"


@query(oracle(f"""WITH p AS ({_SOCIAL}), j AS (SELECT lower(p.source_url) AS u, p.source_domain AS d, p.author, p.published_at, s.* FROM p JOIN m_signals s ON p.source_id = s.source_id),
    r AS (SELECT *, CASE WHEN {" OR ".join(f"d = '{x}' OR ends_with(d, '.{x}')" for x in OWN_DOMAINS)} THEN 'own' WHEN {" OR ".join(f"contains(u, '{x}')" for x in lists.NO_CONVERSATION_PATHS)} THEN 'path' WHEN is_promotional THEN 'vendor' WHEN market_relevance < 6 THEN 'relevance' END AS why FROM j)
    SELECT measure, count(*) AS n FROM (SELECT unnest(['analysed', CASE WHEN contains(u, 'linkedin.com') THEN 'on linkedin' WHEN contains(u, 'x.com') OR contains(u, 'twitter.com') THEN 'on x' WHEN contains(u, 'reddit.com') THEN 'on reddit' END, CASE WHEN why IN ('vendor', 'relevance') THEN 'rejected_' || why END]) AS measure FROM r) WHERE measure IS NOT NULL GROUP BY measure"""))
def j16_social_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("source_id") % 4
    link = F.when(k == 0, F.concat(F.lit("https://www.linkedin.com/posts/a-"), "source_id")).when(k == 1, F.concat(F.lit("https://x.com/a/status/"), "source_id")).otherwise(F.col("source_url"))
    return analytics.social_stats(view(spark, sf_dir, "m_sources").withColumn("source_url", link), view(spark, sf_dir, "m_signals"), OWN_DOMAINS)


@query(oracle(f"""WITH {THEMES}, b AS (SELECT o.source_id, o.title, o.source_domain, s.opportunity_score, s.verification_notes FROM m_sources o JOIN m_signals s ON o.source_id = s.source_id WHERE o.discovered_at >= {_NOW} - INTERVAL 48 HOUR ORDER BY s.opportunity_score DESC, o.source_id LIMIT 15),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_domain ORDER BY opportunity_score DESC, source_id) AS k FROM b), n AS (SELECT * FROM r WHERE k <= 2 OR (SELECT count(*) FROM r WHERE k <= 2) < 3 ORDER BY opportunity_score DESC, source_id LIMIT 5),
    h AS (SELECT * FROM t WHERE trend_status IN ('rising', 'emerging') OR (trend_status = 'stable' AND NOT EXISTS (SELECT 1 FROM t WHERE trend_status IN ('rising', 'emerging'))) ORDER BY source_count DESC, average_market_relevance DESC, slug LIMIT 3),
    o AS (SELECT * FROM m_opportunities WHERE status <> 'archived' ORDER BY opportunity_score DESC, opportunity_id LIMIT 5), w AS (SELECT * FROM m_watchlist WHERE review_status = 'unreviewed' ORDER BY discovered_at DESC, item_id LIMIT 5), d AS (SELECT * FROM m_drafts WHERE approval_status = 'pending_review' ORDER BY created_at DESC, draft_id LIMIT 6),
    x AS (SELECT 1 AS part, row_number() OVER (ORDER BY opportunity_score DESC, source_id) AS place, unnest([0, 1]) AS k, source_id::VARCHAR AS item, '[source #' || source_id || '] ' || unnest(verification_notes[1:2]) AS text FROM n
        UNION ALL SELECT 2, row_number() OVER (ORDER BY opportunity_score DESC, opportunity_id), unnest([0, 1]), opportunity_id::VARCHAR, '[opportunity #' || opportunity_id || '] ' || unnest([CASE WHEN risk_score >= 50 THEN 'Risk score ' || round_even(risk_score, 0)::INTEGER || '/100 — review risk notes before drafting.' END, CASE WHEN confidence_score < 45 THEN 'Confidence ' || round_even(confidence_score, 0)::INTEGER || '/100 — evidence base is thin.' END]) FROM o
        UNION ALL SELECT 3, row_number() OVER (ORDER BY created_at DESC, draft_id), 0, draft_id::VARCHAR, '[draft #' || draft_id || '] ' || unsupported || ' unsupported sentence(s) flagged.' FROM d WHERE unsupported > 0)
    SELECT 'signal' AS section, row_number() OVER (ORDER BY opportunity_score DESC, source_id)::INTEGER AS rank, source_id::VARCHAR AS item, coalesce(title, '(untitled)') AS text FROM n
    UNION ALL SELECT 'theme', row_number() OVER (ORDER BY source_count DESC, average_market_relevance DESC, slug), slug, name FROM h UNION ALL SELECT 'opportunity', row_number() OVER (ORDER BY opportunity_score DESC, opportunity_id), opportunity_id::VARCHAR, title FROM o
    UNION ALL SELECT 'watchlist', row_number() OVER (ORDER BY discovered_at DESC, item_id), item_id::VARCHAR, priority FROM w UNION ALL SELECT 'draft', row_number() OVER (ORDER BY created_at DESC, draft_id), draft_id::VARCHAR, unsupported || ' unsupported' FROM d
    UNION ALL SELECT 'warning', rank, item, text FROM (SELECT row_number() OVER (ORDER BY part, place, k) AS rank, item, text FROM x WHERE text IS NOT NULL) WHERE rank <= 20"""))
def j17_daily_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda n: view(spark, sf_dir, n)
    return analytics.daily_brief(v("m_sources"), v("m_signals"), _themes(spark, sf_dir), v("m_opportunities"), v("m_drafts"), v("m_watchlist"), as_of())


_KANBAN = ("new", "ready_for_brief", "drafting", "review", "approved", "published", "archived")


@query(oracle(f"SELECT v.status, (v.position - 1)::INTEGER AS position, count(o.opportunity_id) AS n FROM (SELECT unnest({list(_KANBAN)}) AS status, unnest(range(1, 8)) AS position) v LEFT JOIN m_opportunities o ON o.status = v.status GROUP BY v.status, v.position"))
def j20_kanban(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.status_counts(view(spark, sf_dir, "m_opportunities"), "status", _KANBAN)


@query(oracle("SELECT v.priority, v.position::INTEGER AS position, count(w.item_id) AS n FROM (VALUES ('high', 0), ('medium', 1), ('low', 2)) v(priority, position) LEFT JOIN m_watchlist w ON w.priority = v.priority GROUP BY v.priority, v.position"))
def j21_watchlist_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.status_counts(view(spark, sf_dir, "m_watchlist"), "priority", ("high", "medium", "low"))


@query(oracle("""SELECT 'source_type' AS kind, source_type AS key, count(*) AS n FROM m_sources GROUP BY source_type UNION ALL SELECT 'status', status, count(*) FROM m_sources GROUP BY status
    UNION ALL SELECT 'total', 'signals', count(*) FROM m_signals UNION ALL SELECT 'total', 'passages', sum(passages)::BIGINT FROM m_signals UNION ALL SELECT 'total', 'quotes', sum(quotes)::BIGINT FROM m_signals"""))
def j22_deliverables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.deliverables(view(spark, sf_dir, "m_sources"), view(spark, sf_dir, "m_signals"))


@query(oracle(f"SELECT source_id, status, source_domain, ({_OWN}) AS is_own FROM m_sources WHERE status IN ('error', 'needs_review') OR starts_with(status, 'skipped_')"))
def j23_problem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.problem_rows(view(spark, sf_dir, "m_sources"), OWN_DOMAINS)
