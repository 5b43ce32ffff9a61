"""Duplicates, evidence, briefs, audits and notes (A, E, K, M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import content_hash
from ..operators import audit, briefs, dedupe, trends, voice
from ..registry import query
from .functions import _PLAIN, _SENTENCES, _list, _shingles, _words
from .ranking import THEMES, as_of
from .views import AS_OF, OWN_DOMAINS, oracle, view


# sources without their texts, which would move with them to meet their pages


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "m_sources", content_hash=F.when(F.col("text") != "", content_hash(F.col("text"))))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("source_id"), F.col("text").alias("cleaned_text"))


@query(oracle(rf"""WITH h AS (SELECT source_id, {_PLAIN.format('cleaned_text')} AS n FROM m_sources WHERE cleaned_text <> ''), k AS (SELECT source_id, min(source_id) OVER (PARTITION BY n) AS matched_id FROM h) SELECT source_id, matched_id, 'content_hash' AS method FROM k WHERE source_id <> matched_id"""))
def e02_hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.hash_duplicates(_hashed(spark, sf_dir)).select("source_id", "matched_id", "method")


# the items' URLs are in their normal form but for what is added here
@query(oracle("SELECT arrival AS source_id, m AS matched_id, 'canonical_url' AS method, 1e0 AS score FROM (SELECT arrival, min(arrival) OVER (PARTITION BY source_url) AS m FROM m_items) WHERE arrival <> m"))
def e01_url_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "m_items").withColumnRenamed("arrival", "source_id")
    shape = F.when(F.col("source_id") % 3 == 0, F.concat(F.replace("source_url", F.lit("https://"), F.lit("HTTP://www.")), F.lit("/?utm_source=a#b"))).otherwise(F.col("source_url"))
    return dedupe.url_duplicates(items.withColumn("source_url", shape))


@query()
def e03_title_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.title_duplicates(view(spark, sf_dir, "m_sources"))


@query(oracle(f"""WITH b AS (SELECT source_id, source_domain, {_words(_PLAIN.format('cleaned_text'))} AS w FROM m_sources WHERE len(regexp_extract_all(cleaned_text, '\\S+')) >= 120), s AS (SELECT source_id, source_domain, {_shingles('w')} AS s FROM b),
    e AS (SELECT source_id, source_domain, len(s) AS n, unnest(s) AS k FROM s), p AS (SELECT a.source_id, c.source_id AS matched_id, any_value(a.n) AS n, any_value(c.n) AS m, count(*) AS shared FROM e a JOIN e c ON a.source_domain = c.source_domain AND a.k = c.k AND c.source_id < a.source_id GROUP BY a.source_id, c.source_id),
    j AS (SELECT source_id, matched_id, shared / (n + m - shared)::DOUBLE AS score FROM p) SELECT source_id, matched_id, 'body' AS method, round(score, 9) AS score FROM j WHERE score >= 0.72 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, matched_id) = 1"""))
def e04_body_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.body_duplicates(view(spark, sf_dir, "m_sources"), texts=_texts(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(oracle(f"""WITH h AS (SELECT source_id, {_PLAIN.format('cleaned_text')} AS n FROM m_sources), g AS (SELECT source_id, n, row_number() OVER (PARTITION BY n ORDER BY source_id) AS k FROM h)
    SELECT source_id, k % 2 = 1 AS kept FROM g"""))
def e08_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # chains: each text is paired with the one before it that is equal, so every second one stays
    h = view(spark, sf_dir, "m_sources").select("source_id", content_hash(F.col("cleaned_text")).alias("h"))
    pairs = h.withColumn("matched_id", F.lag("source_id").over(Window.partitionBy("h").orderBy("source_id"))).where("matched_id is not null")
    return dedupe.keep_greedily(pairs, h)


@query()
def e05_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _hashed(spark, sf_dir)
    return dedupe.verdicts(dedupe.url_duplicates(s), dedupe.hash_duplicates(s), dedupe.title_duplicates(s), dedupe.body_duplicates(s, texts=_texts(spark, sf_dir)))


@query(oracle("""WITH m AS (SELECT *, min(arrival) OVER (PARTITION BY source_url) AS keep_id FROM m_items), q AS (SELECT keep_id, search_query, min(arrival) AS a FROM m GROUP BY keep_id, search_query), c AS (SELECT keep_id, source_type, min(arrival) AS a FROM m GROUP BY keep_id, source_type)
    SELECT m.keep_id, count(*) - 1 AS rediscovery_count, (SELECT string_agg(search_query, '|' ORDER BY a) FROM q WHERE q.keep_id = m.keep_id) AS queries, (SELECT string_agg(source_type, '|' ORDER BY a) FROM c WHERE c.keep_id = m.keep_id) AS channels FROM m GROUP BY m.keep_id"""))
def e07_rediscoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "m_items").withColumnRenamed("arrival", "source_id")
    first = items.groupBy("source_url").agg(F.min("source_id").alias("matched_id"))
    verdict = items.join(first, "source_url").where("source_id <> matched_id").select("source_id", "matched_id")
    out = dedupe.merge_rediscoveries(items, verdict)
    return out.select("keep_id", "rediscovery_count", F.array_join("queries", "|").alias("queries"), F.array_join("channels", "|").alias("channels"))


@query(oracle("SELECT arrival, source_url FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY arrival) AS rn FROM m_items) WHERE rn = 1"))
def e10_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_seen(view(spark, sf_dir, "m_items")).select("arrival", "source_url")


_LEAD = "CASE source_type WHEN 'first_party' THEN 0 WHEN 'manual' THEN 1 WHEN 'youtube' THEN 2 WHEN 'web_search' THEN 3 WHEN 'rss' THEN 4 ELSE 5 END"


@query(oracle(f"SELECT arrival, source_type, row_number() OVER (PARTITION BY source_type ORDER BY coalesce(published_at, make_timestamp(0)) DESC, arrival)::INTEGER AS turn, {_LEAD} AS lead FROM m_items"))
def e11_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.interleave(view(spark, sf_dir, "m_items")).select("arrival", "source_type", "turn", "lead")


@query(oracle(f"SELECT arrival, source_type FROM (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY coalesce(published_at, make_timestamp(0)) DESC, arrival) AS turn, {_LEAD} AS lead FROM m_items) ORDER BY turn, lead, source_type, arrival LIMIT 60"))
def e12_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.capped(view(spark, sf_dir, "m_items"), 60).select("arrival", "source_type")


@query(oracle(r"""SELECT source_id, CASE WHEN status = 'fetched' AND w < 80 THEN 'needs_review' WHEN starts_with(status, 'skipped_') AND w >= 40 THEN 'summary_only' ELSE status END AS stored FROM (SELECT source_id, status, len(regexp_extract_all(cleaned_text, '\S+')) AS w FROM m_sources)"""))
def e13_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "m_sources")
    return s.select("source_id", dedupe.ingest_status(F.col("status"), dedupe.word_count(F.col("cleaned_text"))).alias("stored"))


_OWN_ANY = " OR ".join(f"source_domain = '{d}' OR ends_with(source_domain, '.{d}')" for d in OWN_DOMAINS)
_PATHS = " OR ".join(f"contains(lower(source_url), '{p}')" for p in briefs.lists.NO_CONVERSATION_PATHS)
_REASON = f"""CASE WHEN source_domain = '{OWN_DOMAINS[0]}' OR ends_with(source_domain, '.{OWN_DOMAINS[0]}') THEN 'company or job-board domain' WHEN {_OWN_ANY} THEN 'own property' WHEN {_PATHS} THEN 'job listing, pricing or product page'
    WHEN is_promotional THEN 'vendor marketing' WHEN market_relevance < 6 THEN 'relevance below the bar' WHEN author IS NULL AND published_at IS NULL THEN 'no author and no date' END"""


@query(oracle(f"SELECT o.source_id, {_REASON} AS reason FROM m_sources o JOIN m_signals s ON o.source_id = s.source_id"))
def k01_engagement_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "m_sources").join(view(spark, sf_dir, "m_signals"), "source_id")
    return rows.select("source_id", briefs.no_conversation(OWN_DOMAINS).alias("reason"))


@query(oracle(f"""WITH {THEMES}, p AS (SELECT o.*, s.primary_theme, s.secondary_themes, s.market_relevance, s.speaker_relevance, s.freshness, s.opportunity_score, s.is_promotional FROM m_sources o JOIN m_signals s ON o.source_id = s.source_id WHERE s.market_relevance >= 4 ORDER BY s.market_relevance DESC, s.opportunity_score DESC, o.source_id LIMIT 180),
    g AS (SELECT *, {_REASON} AS reason, EXISTS (SELECT 1 FROM t WHERE trend_status IN ('rising', 'emerging') AND (name = primary_theme OR list_contains(secondary_themes, name)))::INTEGER AS is_rising, (author IS NOT NULL)::INTEGER AS named FROM p WHERE coalesce(published_at, discovered_at) >= make_timestamp({AS_OF}000000) - INTERVAL 45 DAY),
    b AS (SELECT * FROM g WHERE reason IS NULL ORDER BY is_rising DESC, named DESC, market_relevance DESC, opportunity_score DESC, source_id LIMIT 6)
    SELECT source_id, is_rising, named, CASE WHEN is_rising = 1 AND market_relevance + speaker_relevance >= 14 AND freshness >= 6 THEN 'high' WHEN market_relevance + speaker_relevance >= 11 THEN 'medium' ELSE 'low' END AS priority FROM b WHERE source_id % 5 <> 2"""))
def k02_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, g = view(spark, sf_dir, "m_sources"), view(spark, sf_dir, "m_signals")
    rising = trends.theme_trends(g, s, as_of()).where(F.col("trend_status").isin("rising", "emerging"))
    known = s.where("source_id % 5 = 2").select(F.concat("source_url", F.lit("?utm_source=x")).alias("source_url"))
    return briefs.watchlist(s, g, rising, known, as_of(), own=OWN_DOMAINS).select("source_id", "is_rising", "named", "priority")


@query(oracle("""WITH m AS (SELECT source_id, primary_theme AS slug, unnest(list_distinct(industries)) AS industry FROM m_signals WHERE primary_theme IS NOT NULL), n AS (SELECT slug, count(DISTINCT source_id) AS members FROM m GROUP BY slug), c AS (SELECT slug, industry, count(DISTINCT source_id) AS n FROM m GROUP BY slug, industry),
    r AS (SELECT c.*, row_number() OVER (PARTITION BY c.slug ORDER BY c.n DESC, industry)::INTEGER AS rank FROM c JOIN n ON c.slug = n.slug WHERE c.n >= greatest(2, n.members // 5)) SELECT slug, industry, n, rank FROM r WHERE rank <= 3"""))
def k05_dominant_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefs.dominant_industries(view(spark, sf_dir, "m_signals").where("primary_theme is not null").withColumnRenamed("primary_theme", "slug"))


@query(oracle(f"""WITH {THEMES}, e AS (SELECT *, CASE WHEN trend_status NOT IN ('rising', 'emerging', 'stable', 'saturated', 'declining') THEN 'status' WHEN source_count % 7 = 0 THEN 'no evidence' WHEN average_market_relevance * 15 < 55 THEN 'score' END AS r FROM t),
    w AS (SELECT *, count(*) FILTER (WHERE r IS NULL) OVER (ORDER BY average_market_relevance DESC, source_count DESC, slug ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT slug, coalesce(r, CASE WHEN k > 3 THEN 'cap' END) AS skip_reason FROM w"""))
def k15_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trends.theme_trends(view(spark, sf_dir, "m_signals"), view(spark, sf_dir, "m_sources"), as_of())
    scores = t.select("slug", (F.col("average_market_relevance") * 15).alias("opportunity_score"))
    evidence = t.select("slug", (F.col("source_count") % 7).alias("evidence"))
    return briefs.promote(t, scores, evidence, most=3).select("slug", "skip_reason")


@query(oracle("SELECT o.opportunity_id, CASE WHEN o.status = 'drafting' AND o.opportunity_id NOT IN (SELECT opportunity_id FROM m_drafts) THEN 'ready_for_brief' ELSE o.status END AS status FROM m_opportunities o"))
def k18_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefs.reconcile_statuses(view(spark, sf_dir, "m_opportunities"), view(spark, sf_dir, "m_drafts")).select("opportunity_id", "status")


@query(oracle("SELECT o.opportunity_id, CASE WHEN o.theme_slug NOT IN ('theme-1', 'theme-2', 'theme-3') AND o.status <> 'approved' THEN 'archived' ELSE o.status END AS status, CASE WHEN o.theme_slug NOT IN ('theme-1', 'theme-2', 'theme-3') AND o.status = 'approved' THEN 'theme no longer promoted' END AS note FROM m_opportunities o"))
def k17_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = spark.createDataFrame([("theme-1",), ("theme-2",), ("theme-3",)], "slug string")
    return briefs.retire_stale(view(spark, sf_dir, "m_opportunities"), live).select("opportunity_id", "status", "note")


def _drafts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document as a draft, and every benchmark item as evidence for all of them."""
    drafts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("draft_id"), F.col("text").alias("draft_text"))
    return drafts, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))


_META = lists.META_LINE.replace("'", "''")
_UNITS = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents), m AS (SELECT doc_id, line, trim(x) AS x FROM l WHERE trim(x) <> '' AND NOT regexp_matches(trim(x), '{_META}')),
    b AS (SELECT doc_id, line, trim(regexp_replace(regexp_replace(x, '^\s*(?:[-—•*]|[0-9]+\.)\s*', ''), '^\*+|\*+$', '', 'g')) AS x FROM m), f AS (SELECT doc_id, line, x, {_SENTENCES.format('x')} AS s FROM b WHERE x <> ''),
    u0 AS (SELECT doc_id, line, unnest(CASE WHEN len(s) > 0 THEN s ELSE [x] END) AS s, unnest(range(greatest(len(s), 1))) AS k FROM f), u1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS id, lower(trim(s)) AS low FROM u0),
    u AS (SELECT *, left(regexp_replace(low, '^["“”'' ]+|["“”'' ]+$', '', 'g'), 60) AS head, list_filter(list_distinct(regexp_extract_all(low, '[a-z'']{{4,}}')), lambda t: NOT list_contains({_list(lists.AUDIT_STOPWORDS)}, t)) AS tokens FROM u1 WHERE len(regexp_extract_all(low, '\S+')) >= 4),
    p AS (SELECT item_id, lower(text) AS p, list_distinct(regexp_extract_all(lower(text), '[a-z'']{{4,}}')) AS t FROM benchmark), c AS (SELECT string_agg(p, ' ' ORDER BY item_id) AS corpus FROM p),
    h AS (SELECT doc_id, id, unnest(tokens) AS t FROM u), i AS (SELECT item_id, unnest(t) AS t FROM p), o AS (SELECT doc_id, id, max(n) AS best FROM (SELECT h.doc_id, h.id, i.item_id, count(*) AS n FROM h JOIN i ON h.t = i.t GROUP BY ALL) GROUP BY ALL), j AS (SELECT doc_id, id, count(*) AS n FROM h WHERE t IN (SELECT t FROM i) GROUP BY ALL),
    v AS (SELECT u.*, coalesce(o.best, 0) / greatest(len(u.tokens), 1)::DOUBLE AS overlap, coalesce(j.n, 0) / greatest(len(u.tokens), 1)::DOUBLE AS joint, c.corpus FROM u CROSS JOIN c LEFT JOIN o ON u.doc_id = o.doc_id AND u.id = o.id LEFT JOIN j ON u.doc_id = j.doc_id AND u.id = j.id),
    w AS (SELECT *, CASE WHEN head <> '' AND contains(corpus, head) THEN 'supported' WHEN list_bool_or(list_transform({_list(lists.OPINION)}, lambda x: contains(low, x))) THEN 'opinion' WHEN list_bool_or(list_transform({_list(lists.FUTURE)}, lambda x: starts_with(low, x) OR contains(low, ' ' || x))) AND NOT contains(low, '?') THEN 'unverifiable'
        WHEN len(tokens) = 0 THEN NULL WHEN overlap >= 0.6e0 THEN 'supported' WHEN overlap >= 0.35e0 THEN 'partially_supported' WHEN joint >= 0.75e0 THEN 'partially_supported' ELSE 'unsupported' END AS status FROM v)"""


@query(f"""WITH {_UNITS}, n AS (SELECT doc_id AS draft_id, count(*) FILTER (WHERE status = 'supported') AS supported, count(*) FILTER (WHERE status = 'partially_supported') AS partially_supported, count(*) FILTER (WHERE status = 'unsupported') AS unsupported, count(*) FILTER (WHERE status = 'opinion') AS opinion, count(*) FILTER (WHERE status = 'unverifiable') AS unverifiable FROM w WHERE status IS NOT NULL GROUP BY doc_id)
    SELECT *, CASE WHEN supported + partially_supported + unsupported > 0 THEN round((supported + 0.5e0 * partially_supported) / (supported + partially_supported + unsupported) * 100, 1) ELSE 0e0 END AS evidence_score FROM n""")
def k20_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_scores(audit.audit_shared(*_drafts(spark, sf_dir)))


_MADE = "text || CASE doc_id % 4 WHEN 0 THEN ' Sales grew 41% to 1,204 in 2019, or 7.' WHEN 1 THEN ' They call it a “' || left(text, 40) || '” and a game-changer.' ELSE '' END"


@query(rf"""WITH d AS (SELECT doc_id, {_MADE} AS t FROM documents), c AS (SELECT string_agg(lower(text), ' ' ORDER BY item_id) AS corpus FROM benchmark), k AS (SELECT corpus, regexp_extract_all(corpus, '\b[0-9][0-9,.]*%?\b') AS known FROM c),
    n AS (SELECT d.*, k.*, list_distinct(regexp_extract_all(t, '\b[0-9][0-9,.]*%?\b')) AS numbers, regexp_extract_all(t, '[“"]([^”"]{{20,}})[”"]', 1) AS quotes FROM d CROSS JOIN k)
    SELECT doc_id AS draft_id, list_sort(list_filter(numbers, lambda x: NOT list_contains(known, x) AND NOT regexp_full_match(replace(x, ',', ''), '(19|20)[0-9]{{2}}') AND length(replace(x, '%', '')) > 1)) AS invented_numbers, list_filter(quotes, lambda q: NOT contains(corpus, left(lower(q), 60))) AS invented_quotes,
    list_filter({_list(lists.BANNED)}, lambda b: contains(lower(t), b)) AS banned_phrases FROM n""")
def k21_fabrications(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, items = _drafts(spark, sf_dir)
    k = F.col("draft_id") % 4
    added = F.when(k == 0, " Sales grew 41% to 1,204 in 2019, or 7.").when(k == 1, F.concat(F.lit(" They call it a “"), F.left("draft_text", F.lit(40)), F.lit("” and a game-changer."))).otherwise("")
    return audit.fabrications_shared(made.withColumn("draft_text", F.concat("draft_text", added)), items)


@query(oracle("SELECT d.draft_id, u.source_id, m.source_url FROM m_drafts d JOIN m_opportunities o ON d.opportunity_id = o.opportunity_id CROSS JOIN LATERAL (SELECT unnest(o.source_ids) AS source_id) u JOIN m_sources m ON u.source_id = m.source_id"))
def k25_source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.source_links(view(spark, sf_dir, "m_drafts"), view(spark, sf_dir, "m_opportunities"), view(spark, sf_dir, "m_sources")).select("draft_id", "source_id", "source_url")


_FIGURE = lists.FIGURE.replace("'", "''")
# letters beyond ASCII stand as `x` where a pattern asks for word borders, which RE2 knows of ASCII only
_BORDERS = "regexp_replace({0}, '[^\\x00-\\x7f]', 'x', 'g')"


def _any(c: str, patterns: tuple[str, ...]) -> str:
    return f"regexp_matches({_BORDERS.format(c)}, '{'|'.join(f'(?:{p})' for p in patterns)}')".replace("isn'?t", "isn''?t").replace("it'?s", "it''?s").replace("don'?t", "don''?t")


_VOICE = rf"""t0 AS (SELECT doc_id, trim(text) AS t FROM documents), t1 AS (SELECT *, {_SENTENCES.format('t')} AS s, list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS p1, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p2, regexp_extract_all(t, '\S+') AS w, lower(t) AS low FROM t0 WHERE t <> ''),
    t2 AS (SELECT *, CASE WHEN len(p1) > 1 THEN p1 ELSE p2 END AS p, CASE WHEN len(s) > 0 THEN list_transform(s, lambda x: len(regexp_extract_all(x, '\S+'))) ELSE [0] END AS n FROM t1), q0 AS (SELECT doc_id, unnest(p) AS x FROM t2), q1 AS (SELECT doc_id, greatest(len({_SENTENCES.format('x')}), 1) AS d FROM q0), q AS (SELECT doc_id, median(d) AS depth FROM q1 GROUP BY doc_id),
    t3 AS (SELECT t2.*, q.depth, split_part(coalesce(p[1], ''), chr(10), 1) AS line FROM t2 JOIN q ON t2.doc_id = q.doc_id), t4 AS (SELECT *, CASE WHEN len(regexp_extract_all(line, '\S+')) <= 30 THEN line ELSE coalesce(s[1], '') END AS hook, len(regexp_extract_all({_BORDERS.format('t')}, '{_FIGURE}')) AS figures FROM t3),
    a AS (SELECT doc_id AS example_id, len(w)::INTEGER AS word_count, len(s)::INTEGER AS sentence_count, len(p)::INTEGER AS paragraph_count, round(list_median(n), 1) AS median_sentence_words, round(list_avg(n), 1) AS mean_sentence_words, list_max(n)::INTEGER AS max_sentence_words, round(depth, 1) AS median_paragraph_sentences,
        round(len(list_filter(n, lambda x: x <= 12)) / greatest(len(n), 1)::DOUBLE, 2) AS short_sentence_share, len(list_filter(n, lambda x: x <= 5)) > 0 AS uses_fragments, hook, len(regexp_extract_all(hook, '\S+'))::INTEGER AS hook_words, ends_with(trim(hook), '?') AS hook_is_question, regexp_matches({_BORDERS.format('hook')}, '{_FIGURE}') AS hook_has_number,
        figures::INTEGER AS number_count, round(figures / greatest(len(w), 1)::DOUBLE * 100, 2) AS numbers_per_100_words, {_any('low', lists.CONTRAST)} AS uses_contrast, list_filter(s, lambda x: {_any('lower(x)', lists.CONTRAST)})[1:2] AS contrast_examples, list_bool_or(list_transform({_list(lists.STORIES)}, lambda f: contains(low, f))) AS uses_customer_story,
        regexp_matches({_BORDERS.format('low')}, '\b(i|we|our|my)\b') AS uses_first_person, list_filter({_list(lists.HYPE)}, lambda f: contains(low, f)) AS hype_terms, {_any('low', lists.CALLS)} AS cta_present, list_filter(s, lambda x: {_any('lower(x)', lists.CALLS)})[1:2] AS cta_sentences, len(list_filter(s, lambda x: ends_with(trim(x), '?')))::INTEGER AS question_count,
        round(len(list_filter(w, lambda x: length(regexp_replace(x, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')) >= 9)) / greatest(len(w), 1)::DOUBLE, 3) AS long_word_share, []::VARCHAR[] AS themes, coalesce(s[-1], '') AS closing_sentence FROM t4)"""


def _voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return voice.analyse(docs.select(F.col("doc_id").alias("example_id"), "text"))


@query(f"WITH {_VOICE} SELECT * FROM a")
def m01_voice_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voice(spark, sf_dir)


@query(f"""WITH {_VOICE}, g AS (SELECT count(*) AS n, count(*) FILTER (WHERE example_id % 3 = 1) AS f, round(median(median_sentence_words), 1) AS ms, round(median(median_paragraph_sentences), 1) AS mp, round(median(word_count), 1) AS mw, median(median_sentence_words) AS rhythm, median(long_word_share) AS ml, avg(long_word_share) AS al,
        avg((number_count > 0)::INTEGER) AS num, avg(uses_contrast::INTEGER) AS con, avg(uses_first_person::INTEGER) AS per, max(uses_fragments) AS frag, count(*) FILTER (WHERE hook_is_question) AS q, count(*) FILTER (WHERE hook_has_number) AS h, count(*) FILTER (WHERE hook_words <= 10) AS b, list_sort(list_distinct(flatten(list(hype_terms)))) AS hype FROM a)
    SELECT n AS approved_example_count, f AS founder_example_count, n - f AS company_example_count, 'derived' AS status, ms AS median_sentence_words, mp AS median_paragraph_sentences, mw AS median_word_count, frag AS uses_fragments, hype AS hype_terms_found, (SELECT list(hook ORDER BY example_id)[1:5] FROM a WHERE hook <> '') AS example_hooks,
    list_filter([CASE WHEN q > 0 THEN q || '/' || n || ' open with a question' END, CASE WHEN h > 0 THEN h || '/' || n || ' open with a figure' END, CASE WHEN b > 0 THEN b || '/' || n || ' open with a line of 10 words or fewer' END], lambda x: x IS NOT NULL) AS hook_patterns, round_even(con * 100, 0)::INTEGER || '% of examples use an explicit contrast construction.' AS use_of_contrast,
    CASE WHEN rhythm <= 16 THEN 'concise' ELSE 'measured' END || CASE WHEN per >= 0.6 THEN ', first-person' ELSE ', third-person' END || CASE WHEN len(hype) > 0 THEN ', occasionally promotional' ELSE ', hype-free' END || CASE WHEN con >= 0.4 THEN ', argues by contrast' ELSE '' END || ' (derived from ' || n || ' example(s))' AS tone,
    CASE WHEN al < 0.12 THEN 'none' WHEN al < 0.18 THEN 'light' WHEN al < 0.25 THEN 'moderate' ELSE 'heavy' END || ' (mean long-word share ' || printf('%.1f', round_even(al * 100, 1)) || '% across the approved examples)' AS technical_detail_level,
    list_filter([CASE WHEN ms <= 20 THEN 'Direct' END, CASE WHEN ml <= 0.22 THEN 'Clear' END, CASE WHEN mp <= 3 THEN 'Uses short paragraphs' END, CASE WHEN len(hype) = 0 THEN 'Avoids generic AI hype' END, CASE WHEN num >= 0.5 THEN 'Prefers measurable impact' END], lambda x: x IS NOT NULL) AS confirmed_assumptions, NULL::VARCHAR AS coverage_warning, NULL::VARCHAR AS provenance_warning FROM g""")
def m04_voice_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = _voice(spark, sf_dir)
    # of the ids alone, so that no text is read for it
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("example_id"))
    kinds = ids.select("example_id", F.when(F.col("example_id") % 3 == 0, "blog_post").when(F.col("example_id") % 3 == 1, "interview").otherwise("other").alias("content_type"))
    return voice.voice_guide(measured, kinds).select(
        "approved_example_count", "founder_example_count", "company_example_count", "status", "median_sentence_words", "median_paragraph_sentences", "median_word_count", "uses_fragments", "hype_terms_found", "example_hooks", "hook_patterns", "use_of_contrast", "tone", "technical_detail_level", "confirmed_assumptions",
        "coverage_warning", "provenance_warning",
    )


@query(f"""WITH {_VOICE} SELECT example_id, hook_words || '-word opening' || CASE WHEN hook_is_question THEN '; question hook' ELSE '' END || CASE WHEN hook_has_number THEN '; leads with a figure' ELSE '' END || CASE WHEN hook_words <= 10 THEN '; short declarative' ELSE '' END AS hook_style,
    'Median ' || median_sentence_words || ' words per sentence; ' || round_even(short_sentence_share * 100, 0)::INTEGER || '% of sentences are 12 words or fewer; median ' || median_paragraph_sentences || ' sentence(s) per paragraph.' AS sentence_style, number_count || ' figure(s) (' || numbers_per_100_words || ' per 100 words); ' || CASE WHEN uses_customer_story THEN 'includes a customer example.' ELSE 'no customer example present.' END AS evidence_style,
    CASE WHEN uses_first_person THEN 'first person' ELSE 'impersonal' END || CASE WHEN uses_contrast THEN '; uses contrast framing' ELSE '' END || CASE WHEN len(hype_terms) > 0 THEN '; contains hype vocabulary: ' || array_to_string(hype_terms, ', ') ELSE '; no hype vocabulary detected' END || CASE WHEN cta_present THEN '; ends with an invitation to respond' ELSE '' END || CASE WHEN question_count > 0 THEN '; ' || question_count || ' question(s)' ELSE '' END AS tone_notes FROM a""")
def m06_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice.describe(_voice(spark, sf_dir))


_TALK = rf"""r AS (SELECT conv_id, turn, unnest(string_split(CASE WHEN turn % 2 = 0 THEN 'Ann Éa: ' ELSE '' END || text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS k FROM conversations), l AS (SELECT conv_id, turn, k, trim(x) AS x FROM r WHERE trim(x) <> ''),
    s AS (SELECT *, trim(regexp_extract(x, '^\s*([A-Z][\pL\pM\pN_ .''-]{{1,40}}?)\s*:\s*(.+)$', 1)) AS name, trim(regexp_extract(x, '^\s*([A-Z][\pL\pM\pN_ .''-]{{1,40}}?)\s*:\s*(.+)$', 2)) AS rest FROM l), m AS (SELECT conv_id, turn, k, CASE WHEN name <> '' THEN name END AS speaker, CASE WHEN name <> '' THEN rest ELSE x END AS text FROM s),
    c AS (SELECT *, lower(text) AS low, len(regexp_extract_all(text, '\S+')) AS n FROM m), d AS (SELECT *, n >= 5 AND contains(low, 'the ') AS decided, n >= 5 AND (contains(low, 'und ') OR contains(low, 'la ')) AS acted FROM c),
    e AS (SELECT conv_id, turn, k, speaker, text, unnest([CASE WHEN decided THEN 'decision' WHEN acted THEN 'action' END, CASE WHEN ends_with(text, '?') AND n >= 5 THEN 'question' END, CASE WHEN n BETWEEN 12 AND 45 THEN 'quote' END]) AS kind FROM d),
    z AS (SELECT conv_id, kind, row_number() OVER (PARTITION BY conv_id, kind ORDER BY CASE WHEN kind = 'quote' THEN -length(text) ELSE 0 END, turn, k) AS rank, speaker, text FROM e WHERE kind IS NOT NULL), b AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, k) AS body FROM m GROUP BY conv_id), v AS (SELECT conv_id, array_to_string(({_SENTENCES.format('body')})[1:3], ' ') AS said FROM b)"""


@query(f"""WITH {_TALK} SELECT conv_id, kind, rank::INTEGER AS rank, speaker, text FROM z WHERE rank <= CASE kind WHEN 'action' THEN 8 WHEN 'quote' THEN 4 ELSE 6 END UNION ALL SELECT conv_id, 'summary', 1, NULL, CASE WHEN said <> '' THEN said ELSE '(transcript too short to summarise)' END FROM v""")
def m08_meeting_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    named = talk.withColumn("text", F.concat(F.when(F.col("turn") % 2 == 0, "Ann Éa: ").otherwise(""), F.col("text")))
    return voice.meeting_notes(voice.speaker_lines(named), decisions=("the ",), actions=("und ", "la "))


@query(r"SELECT conv_id, sum(n)::BIGINT AS words, sum(n) >= 60 AS accepted FROM (SELECT conv_id, len(regexp_extract_all(text, '\S+')) AS n FROM conversations) GROUP BY conv_id HAVING sum(n) > 0")
def m09_meeting_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return voice.meeting_gate(rows).where("words > 0")
