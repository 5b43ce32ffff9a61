"""Connectors, classification, sentence picks, evidence and brief queries (A, F, G, I, J, K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import extract_numerical_claims, prose_sentences
from ..operators import analytics, briefs, extraction, taxonomy, trends
from ..operators.taxonomy import Theme
from ..registry import query
from ..sources import landing
from .functions import _CLEAN, _LOOSE, _PLAIN, _PROSE, _list
from .ranking import THEMES as TREND_SQL
from .ranking import as_of
from .textual import KNOWN, THEMES
from .views import AS_OF, OWN_DOMAINS, oracle, view

_NOW = f"make_timestamp({AS_OF}000000)"
_TOKENS = r"string_split_regex(lower({0}), '[^\pL\pM\pN_]+')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _once(word: str) -> str:
    return f"['{word}', '{word}s']"


# A: connectors over rows in the form in which they are landed


@query(oracle(f"""WITH q AS (SELECT search_query, min(arrival) AS a, list(struct_pack(a := arrival, u := source_url) ORDER BY arrival)[1:12] AS r FROM m_items GROUP BY search_query), e AS (SELECT search_query, unnest(r) AS r, unnest(range(len(r))) AS rank FROM q),
    k AS (SELECT *, r.u AS url FROM e WHERE rank < 8 AND NOT regexp_matches(r.u, '^https://host7[.]')) SELECT url AS source_url, 'hit ' || r.a AS title, rank::INTEGER AS position FROM k QUALIFY row_number() OVER (PARTITION BY url ORDER BY search_query, rank) = 1"""))
def a03_search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "m_items")
    # what a provider would return: the first 12 hits of each query
    hit = F.struct("arrival", F.col("source_url").alias("url"), F.concat(F.lit("hit "), "arrival").alias("title"), F.lit("s").alias("snippet"), F.lit(None).cast("string").alias("date"))
    found = items.groupBy(F.col("search_query").alias("query")).agg(F.slice(F.array_sort(F.collect_list(hit)), 1, 12).alias("results"))
    return landing.search_rows(found, blocked=("host7.example.com",)).select("source_url", "title", "position")


@query(oracle(f"""WITH s AS (SELECT source_id, published_at, author, CASE source_id % 4 WHEN 0 THEN 'https://www.linkedin.com/posts/jo-' || source_id || '_x' WHEN 1 THEN 'https://x.com/jo' || source_id || '/status/9' WHEN 2 THEN 'https://linkedin.com/in/jo' ELSE source_url END AS u FROM m_sources)
    SELECT source_id, CASE WHEN source_id % 4 = 3 THEN 'off_platform' WHEN source_id % 4 = 2 THEN 'not_a_post' WHEN published_at IS NULL THEN 'undated' WHEN published_at < {_NOW} - INTERVAL 120 DAY THEN 'too_old' END AS drop_reason, coalesce(author, CASE source_id % 4 WHEN 0 THEN 'jo-' || source_id WHEN 1 THEN 'jo' || source_id END) AS author FROM s"""))
def a04_social_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("source_id") % 4, F.col("source_id").cast("string")
    link = F.when(k == 0, F.concat(F.lit("https://www.linkedin.com/posts/jo-"), n, F.lit("_x"))).when(k == 1, F.concat(F.lit("https://x.com/jo"), n, F.lit("/status/9"))).when(k == 2, "https://linkedin.com/in/jo").otherwise(F.col("source_url"))
    return landing.social_reasons(view(spark, sf_dir, "m_sources").withColumn("source_url", link), as_of()).select("source_id", "drop_reason", "author")


@query(oracle(rf"""SELECT source_url, 'u/' || coalesce(author, 'x') AS author, published_at FROM (SELECT *, len(regexp_extract_all(cleaned_text, '\S+')) AS n FROM m_sources) WHERE n >= 20 AND published_at >= {_NOW} - INTERVAL 45 DAY"""))
def a05_reddit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "m_sources")
    posts = s.select(F.col("source_url").alias("url"), "title", F.coalesce("author", F.lit("x")).alias("author"), F.col("cleaned_text").alias("selftext"), F.unix_seconds("published_at").cast("double").alias("created_utc"))
    return landing.reddit_rows(posts, as_of()).select("source_url", "author", "published_at")


@query(oracle("SELECT 'https://www.youtube.com/watch?v=v' || source_id AS source_url, author, sha256(title || chr(10) || chr(10) || cleaned_text) AS summary, published_at FROM m_sources WHERE source_id % 6 <> 0"))
def a06_video_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "m_sources")
    videos = s.select(F.when(F.col("source_id") % 6 != 0, F.concat(F.lit("v"), "source_id")).alias("id"), "title", F.col("cleaned_text").alias("description"), F.col("author").alias("channel"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("published"))
    return landing.video_rows(videos).select("source_url", "author", F.sha2("summary", 256).alias("summary"), "published_at")


@query(r"""WITH RECURSIVE r(section, id, depth) AS (SELECT 's' || i, i * 10, 0 FROM range(9) t(i) UNION ALL SELECT section, unnest([id * 2 + 1, id * 2 + 2]), depth + 1 FROM r WHERE depth < 5 AND id IN (SELECT doc_id FROM documents)),
    f AS (SELECT section, id, min(depth) AS depth FROM r GROUP BY section, id), k AS (SELECT f.*, len(regexp_extract_all(d.text, '\S+')) AS n, row_number() OVER (PARTITION BY section ORDER BY depth, 'https://site.org/p/' || id) AS rn FROM f JOIN documents d ON f.id = d.doc_id)
    SELECT section, 'https://site.org/p/' || id AS url, depth FROM k WHERE rn <= 12 AND n >= 90""")
def a07_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    page = lambda c: F.concat(F.lit("http://www.site.org/p/"), c.cast("string"))
    links = docs.select(page(F.col("doc_id")).alias("url"), F.explode(F.array(F.col("doc_id") * 2 + 1, F.col("doc_id") * 2 + 2)).alias("t")).select("url", F.concat(page(F.col("t")), F.lit("/#x")).alias("target"))
    seeds = spark.range(9).select(F.concat(F.lit("s"), "id").alias("section"), page(F.col("id") * 10).alias("url"))
    return landing.crawl(docs.select(page(F.col("doc_id")).alias("url"), "text"), links, seeds, ("site.org",)).select("section", "url", "depth")


@query(rf"""WITH c AS (SELECT doc_id, {_CLEAN.format('text')} AS c FROM documents WHERE doc_id % 13 <> 0), l AS (SELECT *, split_part(c, chr(10), 1) AS line FROM c)
    SELECT CASE WHEN doc_id % 2 = 0 THEN 'https://own.org/a/' || doc_id ELSE 'manual://manual_text/' || left(sha256({_PLAIN.format('c')}), 16) END AS source_url, CASE WHEN length(line) > 120 THEN left(line, 120) || '…' ELSE line END AS title, left(c, 400) AS summary FROM l""")
def a08_manual_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    entries = _docs(spark, sf_dir).select(F.lit("manual_text").alias("kind"), F.when(d % 13 != 0, F.col("text")).otherwise("  ").alias("text"), F.when(d % 2 == 0, F.concat(F.lit("own.org/a/"), d, F.lit("/?ref=x"))).alias("url"))
    return landing.manual_items(entries).select("source_url", "title", "summary")


@query("""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'skipped_bad_scheme' WHEN ends_with(h, '.example.net') OR h = 'example.net' THEN 'skipped_blocklist' WHEN page_id % 9 = 1 THEN 'skipped_robots' WHEN page_id % 9 = 2 THEN 'skipped_crawl_delay_deferred' WHEN page_id % 9 = 3 THEN 'skipped_access_restricted'
    WHEN page_id % 9 IN (4, 5) THEN 'error' WHEN page_id % 9 = 6 OR contains(lower(html), 'captcha') OR contains(lower(html), 'access denied') OR contains(lower(html), 'enable javascript') OR contains(lower(html), 'subscribe to continue') THEN 'skipped_access_restricted' ELSE 'fetched' END AS outcome FROM (SELECT page_id, html, lower(regexp_extract(url, '^https?://(?:www[.])?([^/:?#]+)', 1)) AS h FROM pages)""")
def a09_fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 9
    status = F.when(k == 3, 403).when(k == 4, 500).when(k == 5, F.lit(None)).otherwise(200)
    link = F.when(k == 0, F.lit("ftp://x.org/a")).otherwise(F.col("url"))
    body = F.when(k == 6, F.concat("html", F.lit(" Please solve the CAPTCHA"))).otherwise(F.col("html"))
    out = landing.fetch_outcome(status.cast("int"), link, body, F.when(k == 1, False), F.when(k == 2, 45.0).otherwise(5.0), blocked=("example.net",))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", out.alias("outcome"))


@query(oracle(rf"""SELECT source_id FROM (SELECT *, len(regexp_extract_all(cleaned_text, '\S+')) AS n, CASE WHEN contains(source_url, '/en/') THEN 0 WHEN contains(source_url, '/fr/') THEN 1 ELSE 2 END AS r FROM m_sources) WHERE (source_domain = 'example.com' OR ends_with(source_domain, '.example.com')) AND n >= 150 AND source_id % 4 <> 0 ORDER BY r, length(cleaned_text) DESC, source_id LIMIT 40"""))
def a18_voice_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "m_sources")
    return landing.voice_seeds(s, s.where("source_id % 4 = 0"), "example.com", 40, marks=("/en/", "/fr/")).select("source_id")


# F: phrases, names and themes


# each mark between words is doubled, so that neighbouring hits do not share one
_APART = r"' ' || regexp_replace(lower(text), '([^\pL\pM\pN_])', '\1\1', 'g') || ' '"


@query(rf"""SELECT doc_id, len(regexp_extract_all(t, '[^\pL\pM\pN_]thes?[^\pL\pM\pN_]'))::INTEGER AS one, len(regexp_extract_all(t, '[^\pL\pM\pN_]of\s+thes?[^\pL\pM\pN_]'))::INTEGER AS two, regexp_matches(t, '[^\pL\pM\pN_]und[^\pL\pM\pN_]') AS has_und FROM (SELECT doc_id, {_APART} AS t FROM documents)""")
def f02_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = taxonomy.Phrases(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", p.count("the").alias("one"), p.count("of  THE").alias("two"), p.has("und", plural=False).alias("has_und"))


@query(rf"""SELECT doc_id, list_filter([CASE WHEN list_contains(w, 'und') THEN 'Und Co' END, CASE WHEN list_has_any(w, ['les', 'des']) THEN 'Les' END, CASE WHEN list_contains(w, 'that') THEN 'That' END], lambda x: x IS NOT NULL) AS names FROM (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents)""")
def f04_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", taxonomy.match_entities(F.col("text"), {"und": "Und Co", "les": "Les", "des": "Les", "that": "That"}).alias("names"))


_TOPICS = tuple(Theme(f"t-{w}", w.title(), (w,), (v,), (n,)) for w, v, n in (("the", "of", "from"), ("and", "that", "was"), ("und", "der", "von"), ("les", "des", "pour"), ("que", "los", "para"), ("in", "die", "un")))


def _topic(t: Theme) -> str:
    n = lambda w: f"len(list_filter(w, lambda x: x IN ('{w}', '{w}s')))"
    return f"least({n(t.keywords[0])}, 4) + least({n(t.strong[0])}, 4) * 15e-1 - {n(t.negative[0])} * 3e0"


@query(rf"""WITH w AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents), s AS (SELECT doc_id, unnest([{', '.join(_topic(t) for t in _TOPICS)}]) AS score, unnest(range({len(_TOPICS)})) AS place, unnest({[t.name for t in _TOPICS]}) AS name FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS k FROM s WHERE score > 0), p AS (SELECT doc_id, max(name) FILTER (WHERE k = 1 AND score >= 4) AS first, coalesce(string_agg(name, ',' ORDER BY k) FILTER (WHERE k BETWEEN 2 AND 4 AND score >= 3), '') AS rest FROM r GROUP BY doc_id)
    SELECT d.doc_id, p.first AS primary_theme, CASE WHEN p.first IS NULL THEN '' ELSE p.rest END AS secondary_themes FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id""")
def f07_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _docs(spark, sf_dir).select("doc_id", taxonomy.match_themes(F.col("text"), _TOPICS).alias("m"))
    return m.select("doc_id", taxonomy.primary_theme(F.col("m")).alias("primary_theme"), F.array_join(taxonomy.secondary_themes(F.col("m")), ",").alias("secondary_themes"))


# G: sentences, coercion and targets


@query(f"""WITH {_PROSE}, c AS (SELECT doc_id, place, s, n, prose, contains(lower(s), 'the')::INTEGER + contains(lower(s), 'und')::INTEGER + contains(lower(s), 'les')::INTEGER AS found, contains(lower(s), 'ion')::INTEGER AS bonus FROM p),
    sc AS (SELECT *, found * 15e-1 + bonus * 5e-1 - n / 100e0 AS score FROM c), pick AS (SELECT doc_id, arg_max(s, struct_pack(a := score, b := -place)) AS picked FROM sc WHERE n BETWEEN 8 AND 70 AND found > 0 AND score > 0 AND prose GROUP BY doc_id), lead AS (SELECT doc_id, arg_min(s, place) AS first FROM c WHERE n BETWEEN 10 AND 60 AND prose GROUP BY doc_id)
    SELECT d.doc_id, pick.picked, lead.first FROM documents d LEFT JOIN pick ON d.doc_id = pick.doc_id LEFT JOIN lead ON d.doc_id = lead.doc_id""")
def g02_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    # cut and judged once for both
    said, docs = F.col("said"), _docs(spark, sf_dir).withColumn("said", prose_sentences(t))
    return docs.select("doc_id", extraction.pick_sentence(t, ("the", "und", "les"), ("ion",), prose=said).alias("picked"), extraction.first_substantive(t, prose=said).alias("first"))


@query("""SELECT doc_id, least(greatest((doc_id % 30 - 8)::DOUBLE, 0e0), 1e1) AS market_relevance, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Theme ' || (doc_id % 4) END AS primary_theme, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'missed calls' ELSE source END AS customer_problem,
    CASE WHEN doc_id % 5 = 0 THEN ['Cross-industry'] ELSE ['a', 'b', source] END AS industries FROM documents""")
def g16_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    raw = F.struct(
        (d % 30 - 8).alias("market_relevance"), F.concat(F.lit("Theme "), d % 4).alias("primary_theme"), F.when(d % 3 == 0, "N/A").when(d % 3 == 1, " missed calls ").otherwise(F.col("source")).alias("customer_problem"),
        F.when(d % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit(""), F.lit("b"), F.col("source"), F.lit("c"))).alias("industries"),
    )
    said = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(raw), F.lit("\n```"))
    out = _docs(spark, sf_dir).select("doc_id", extraction.coerce_model_output(said, ("Theme 1", "Theme 2", "Theme 3")).alias("o"))
    return out.select("doc_id", "o.market_relevance", "o.primary_theme", "o.customer_problem", "o.industries")


@query(oracle(r"""SELECT source_id, n >= CASE WHEN source_type = 'social_public' THEN 12 ELSE 25 END AS extractable FROM (SELECT source_id, source_type, len(regexp_extract_all(cleaned_text, '\S+')) AS n FROM m_sources)"""))
def g19_extractable(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "m_sources")
    return s.select("source_id", extraction.extractable(s).alias("extractable"))


@query(oracle("SELECT source_id, CASE WHEN source_id % 3 = 0 THEN 99e0 ELSE opportunity_score END AS opportunity_score FROM m_signals UNION ALL SELECT source_id, 99e0 FROM m_sources WHERE source_id % 3 = 0 AND source_id NOT IN (SELECT source_id FROM m_signals)"))
def g20_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = view(spark, sf_dir, "m_signals").select("source_id", "opportunity_score")
    new = view(spark, sf_dir, "m_sources").where("source_id % 3 = 0").select("source_id", F.lit(99.0).alias("opportunity_score"))
    return extraction.upsert_signals(old, new)


# I, J: themes kept, one opportunity, lists, runs


@query(oracle(f"WITH {TREND_SQL} SELECT slug, name, source_count FROM t UNION ALL SELECT 'gone-' || i, 'Gone ' || i, i FROM range(3) r(i)"))
def i10_upserted_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = trends.theme_trends(view(spark, sf_dir, "m_signals"), view(spark, sf_dir, "m_sources"), as_of()).select("slug", "name", "source_count")
    old = new.limit(5).withColumn("source_count", F.lit(-1)).unionByName(spark.range(3).select(F.concat(F.lit("gone-"), "id").alias("slug"), F.concat(F.lit("Gone "), "id").alias("name"), F.col("id").alias("source_count")))
    return trends.upsert_themes(old, new)


@query(oracle("""WITH o AS (SELECT * FROM m_opportunities WHERE opportunity_id = 53), c AS (SELECT string_agg(s.source_id || ':' || s.source_domain, ',' ORDER BY s.source_id) AS sources FROM m_sources s WHERE s.source_id IN (SELECT unnest(source_ids) FROM o)), d AS (SELECT string_agg(draft_id || ':' || approval_status, ',' ORDER BY draft_id) AS drafts FROM m_drafts WHERE opportunity_id = 53)
    SELECT o.opportunity_id, o.title, c.sources, coalesce(d.drafts, '') AS drafts FROM o, c, d"""))
def j10_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = analytics.opportunity_detail(view(spark, sf_dir, "m_opportunities"), view(spark, sf_dir, "m_sources"), view(spark, sf_dir, "m_drafts"), 53)
    line = lambda c, a, b: F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: F.concat(x[a].cast("string"), F.lit(":"), x[b])), ",")
    return one.select("opportunity_id", "title", line(F.col("sources"), "source_id", "source_domain").alias("sources"), F.coalesce(line(F.col("drafts"), "draft_id", "approval_status"), F.lit("")).alias("drafts"))


@query(oracle("SELECT draft_id, created_at FROM m_drafts ORDER BY created_at DESC, draft_id LIMIT 12"))
def j12_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest(view(spark, sf_dir, "m_drafts"), "created_at", 12, "draft_id").select("draft_id", "created_at")


@query(oracle("SELECT run_id, 30e0 AS seconds, 'ingest' AS stage, unnest(['rss', 'web']) AS connector, unnest([stored, 60 - stored]) AS candidates, unnest([0, 1])::BIGINT AS errors FROM m_runs"))
def j15_agent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n, e: F.struct(n.alias("candidates"), F.lit(e).alias("errors"))
    stages = F.to_json(F.struct(F.struct(F.struct(part(F.col("stored"), 0).alias("rss"), part(60 - F.col("stored"), 1).alias("web")).alias("connectors")).alias("ingest")))
    runs = view(spark, sf_dir, "m_runs").select("run_id", "started_at", (F.col("started_at") + F.expr("interval 30 seconds")).alias("finished_at"), stages.alias("stages"))
    return analytics.agent_activity(runs)


# K: evidence of themes

_DICTIONARY = tuple(Theme(f"theme-{i}", f"Theme {i}", ("the", "les"), ("und",), ("von",)) for i in range(12))
_EVIDENCE = rf"""m AS (SELECT s.*, d.text FROM m_signals s JOIN documents d ON s.source_id = d.doc_id), x AS (SELECT source_id, unnest(list_distinct(list_append(secondary_themes, primary_theme))) AS theme FROM m_signals),
    r AS (SELECT m.*, lower(replace(x.theme, ' ', '-')) AS slug, row_number() OVER (PARTITION BY x.theme ORDER BY m.opportunity_score DESC, m.source_id) AS rn FROM m JOIN x ON m.source_id = x.source_id WHERE regexp_full_match(x.theme, 'Theme [0-9]+') QUALIFY rn <= 25),
    e0 AS (SELECT slug, source_id, is_promotional, rn * 10 AS place, 'passage' AS kind, left(text, 120) AS text, NULL AS detail FROM r WHERE source_id % 5 <> 0 UNION ALL SELECT slug, source_id, is_promotional, rn * 10 + 1, 'passage', substr(text, 121, 90), NULL FROM r
        UNION ALL SELECT slug, source_id, is_promotional, rn * 10, 'quote', substr(text, 30, 90), CASE WHEN source_id % 3 <> 0 THEN 'Jo' END FROM r WHERE source_id % 4 <> 1 UNION ALL SELECT slug, source_id, is_promotional, rn * 10, 'number', substr(text, 10, (source_id % 80)::INTEGER), '4' || (source_id % 10) || '%' FROM r
        UNION ALL SELECT slug, source_id, is_promotional, rn * 10, 'problem', substr(text, 5, 60), NULL FROM r WHERE source_id % 4 <> 0 UNION ALL SELECT slug, source_id, is_promotional, rn * 10, 'claim', substr(text, 40, 70), NULL FROM r),
    e AS (SELECT * FROM e0 WHERE text <> '' OR kind = 'number'), w AS (SELECT *, {_TOKENS.format('text')} AS w, len(regexp_extract_all(text, '\S+')) AS n FROM e),
    q AS (SELECT *, list_has_any(w, {_once('the')})::INTEGER + list_has_any(w, {_once('les')})::INTEGER + list_has_any(w, {_once('und')})::INTEGER AS terms, list_has_any(w, {_once('von')}) AS wrong, list_bool_or(list_transform({_list(lists.MARKETING_TELLS)}, lambda f: contains(lower(text), f))) AS tell, regexp_matches(text, '[0-9]') AS digit FROM w),
    v AS (SELECT *, CASE WHEN kind = 'passage' THEN CASE WHEN wrong THEN -10e0 ELSE CASE WHEN terms = 0 THEN -8e0 ELSE least(terms, 3) * 4e0 END + CASE WHEN is_promotional THEN 0 ELSE 3 END - CASE WHEN tell THEN 4 ELSE 0 END + CASE WHEN digit THEN 15e-1 ELSE 0 END + CASE WHEN n BETWEEN 12 AND 45 THEN 1 ELSE 0 END END
        WHEN kind = 'quote' THEN CASE WHEN wrong THEN -10e0 ELSE CASE WHEN terms = 0 THEN -5e0 ELSE 0 END + CASE WHEN detail IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN digit THEN 2 ELSE 0 END - CASE WHEN tell THEN 5 ELSE 0 END + CASE WHEN n < 8 THEN -3e0 WHEN n BETWEEN 10 AND 45 THEN 15e-1 ELSE 0 END + CASE WHEN is_promotional THEN 0 ELSE 1 END END END AS quality FROM q),
    f AS (SELECT * FROM v WHERE CASE kind WHEN 'passage' THEN quality > 0 OR NOT EXISTS (SELECT 1 FROM v o WHERE o.slug = v.slug AND o.kind = 'passage' AND o.quality > 0) WHEN 'quote' THEN true ELSE terms > 0 AND NOT wrong END),
    k AS (SELECT *, row_number() OVER (PARTITION BY slug, kind ORDER BY quality DESC NULLS LAST, CASE WHEN quality IS NULL AND is_promotional THEN 1 ELSE 0 END, CASE WHEN kind = 'number' THEN -length(text) ELSE 0 END, place) AS rank FROM f)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, d = F.col("text"), F.col("source_id")
    cut = lambda a, n: F.substr(t, F.lit(a), n if isinstance(n, Column) else F.lit(n))
    true = F.lit(True).alias("verified_verbatim")
    signals = view(spark, sf_dir, "m_signals").join(_docs(spark, sf_dir).select(F.col("doc_id").alias("source_id"), "text"), "source_id").select(
        "source_id", "primary_theme", "secondary_themes", "opportunity_score", "is_promotional",
        F.array(F.struct(cut(1, 120).alias("passage"), (d % 5 != 0).alias("verified_verbatim")), F.struct(cut(121, 90).alias("passage"), true)).alias("supporting_evidence"),
        F.array(F.struct(cut(30, 90).alias("quote"), F.when(d % 3 != 0, "Jo").alias("speaker"), (d % 4 != 1).alias("verified_verbatim"))).alias("notable_quotes"),
        F.array(F.struct(F.concat(F.lit("4"), d % 10, F.lit("%")).alias("value"), cut(10, (d % 80).cast("int")).alias("context"))).alias("numerical_claims"), F.when(d % 4 != 0, cut(5, 60)).alias("customer_problem"), cut(40, 70).alias("primary_claim"),
    )
    names = spark.createDataFrame([(t.name, t.slug) for t in _DICTIONARY], "name string, slug string")
    found = briefs.theme_evidence(signals, view(spark, sf_dir, "m_sources"), names)
    return briefs.rank_evidence(found, *briefs.term_counts(F.col("text"), F.col("slug"), _DICTIONARY))


@query(oracle(f"WITH {_EVIDENCE} SELECT slug, kind, rank::INTEGER AS rank, source_id, text, detail, quality FROM k"))
def k08_ranked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("slug", "kind", "rank", "source_id", "text", "detail", "quality")


def _cut(n: int) -> str:
    return f"CASE WHEN length(text) <= {n} THEN text ELSE regexp_replace(left(text, {n}), ' [^ ]*$', '', 's') || ' …' END"


@query(oracle(f"""WITH {_EVIDENCE}, c AS (SELECT *, count(*) FILTER (WHERE kind = 'number') OVER (PARTITION BY slug) AS numbers FROM k), s AS (SELECT *, CASE WHEN kind = 'quote' AND rank = 1 AND quality >= 2 THEN 1 WHEN kind = 'number' AND rank = 1 AND (NOT is_promotional OR numbers = 1) THEN 2 WHEN kind = 'problem' AND NOT is_promotional THEN 3 WHEN kind = 'problem' AND rank = 1 THEN 4 END AS step FROM c)
    SELECT slug, step::INTEGER AS step, CASE step WHEN 1 THEN '“' || {_cut(180)} || '”' || coalesce(' — ' || detail, '') || ' (source #' || source_id || ')' WHEN 2 THEN detail || ' — from “' || {_cut(150)} || '” (source #' || source_id || '; verify before use).' ELSE {_cut(190)} END AS hook FROM s WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug ORDER BY step, rank) = 1"""))
def k10_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefs.hook(_evidence(spark, sf_dir))


@query(rf"""WITH c AS (SELECT doc_id, {_LOOSE.format('text')} AS c FROM documents), p AS (SELECT item_id, {_LOOSE.format('text')} AS p FROM benchmark) SELECT doc_id AS claim_id, min(item_id) AS passage_id FROM c JOIN p ON length(c) >= 40 AND length(p) >= 40 AND (contains(c, p) OR contains(p, c)) GROUP BY doc_id""")
def k13_stored_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _docs(spark, sf_dir).select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim"))
    return briefs.match_stored_passage(claims, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")))


@query(oracle("""WITH l AS (SELECT theme_slug, max(opportunity_id) AS old FROM m_opportunities GROUP BY theme_slug), h AS (SELECT l.*, o.status FROM l JOIN m_opportunities o ON o.opportunity_id = l.old), n AS (SELECT 'theme-' || i AS theme_slug, 100000 + i AS opportunity_id FROM range(15) r(i)),
    u AS (SELECT n.*, h.old FROM n LEFT JOIN h ON n.theme_slug = h.theme_slug WHERE h.status IS NULL OR h.status NOT IN ('approved', 'review', 'archived'))
    SELECT opportunity_id, theme_slug, status FROM m_opportunities WHERE opportunity_id NOT IN (SELECT old FROM u WHERE old IS NOT NULL) UNION ALL SELECT opportunity_id, theme_slug, 'ready_for_brief' FROM u"""))
def k16_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = view(spark, sf_dir, "m_opportunities").select("opportunity_id", "theme_slug", "status")
    new = spark.range(15).select((F.col("id") + 100000).alias("opportunity_id"), F.concat(F.lit("theme-"), "id").alias("theme_slug"), F.lit("ready_for_brief").alias("status"))
    return briefs.persist_opportunities(old, new).select("opportunity_id", "theme_slug", "status")


# figures of prose: a mark before each place where one may begin stands for a look back, which RE2 has not
_MARK = "chr(30)"
_UNITS = "(?:%|percent|x|bn|billion|million|k\\b|hours?|minutes?|days?|seconds?|customers?|businesses?|dealerships?|locations?|leads?|calls?)?"
_FIGURES = rf"""y0 AS (SELECT doc_id, place, s, unnest(regexp_extract_all(regexp_replace(s, '(^|[^\w.])(\$?[0-9])', '\1' || {_MARK} || '\2', 'g'), {_MARK} || '((?i)\$?[0-9][0-9,' || {_MARK} || ']*\.?[0-9]*\s?{_UNITS})', 1)) AS v FROM p WHERE prose AND regexp_matches(s, '[0-9]')),
    y1 AS (SELECT doc_id, place, s, regexp_replace(trim(replace(v, {_MARK}, '')), '[.,;:]+$', '') AS v, row_number() OVER () AS ord FROM y0),
    y2 AS (SELECT * FROM y1 WHERE regexp_matches(v, '[0-9]') AND NOT regexp_full_match(replace(replace(v, ',', ''), '$', ''), '(19|20)[0-9][0-9]') AND NOT regexp_full_match(v, '[0-9]{{1,2}}') AND (NOT contains(v, ',') OR regexp_matches(v, '^\$?[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]+)?\s?[^0-9]*$'))),
    y3 AS (SELECT doc_id, v, s, min(place) AS place, min(ord) AS ord FROM y2 GROUP BY doc_id, v, s), y4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, v, left(s, 60) ORDER BY place, ord) AS k FROM y3), y5 AS (SELECT doc_id, v AS value, s AS context, row_number() OVER (PARTITION BY doc_id ORDER BY place, ord) AS rank FROM y4 WHERE k = 1)"""


@query(f"WITH {_PROSE}, {_FIGURES} SELECT doc_id, rank::INTEGER AS rank, value, context FROM y5 WHERE rank <= 8")
def b16_numerical_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(extract_numerical_claims(F.col("text"))).alias("i", "c"))
    return rows.select("doc_id", (F.col("i") + 1).alias("rank"), "c.value", "c.context")


def _has(phrase: str) -> str:
    body = r"\s+".join(w.replace("-", "-+").replace("'", "''") for w in phrase.split())
    return rf"regexp_matches(t, '[^{_W}]{body}s?[^{_W}]')"


_W = r"\pL\pM\pN_"
_any_of = lambda phrases: "(" + " OR ".join(map(_has, phrases)) + ")"
_number_of = lambda phrases: "(" + " + ".join(f"{_has(x)}::INTEGER" for x in phrases) + ")"
_held = lambda low, phrases: f"len(list_filter({_list(phrases)}, lambda f: contains({low}, f)))"
_own_sql = " OR ".join(f"source_domain = '{d}' OR ends_with(source_domain, '.{d}')" for d in OWN_DOMAINS)


def _theme(t: Theme) -> str:
    n = lambda w: f"len(list_filter(w, lambda x: x IN ('{w}', '{w}s')))"
    return " + ".join(f"least({n(k)}, 4)" for k in t.keywords) + "".join(f" + least({n(k)}, 4) * 15e-1" for k in t.strong) + "".join(f" - {n(k)} * 3e0" for k in t.negative)


_KEYWORDS = ", ".join("list_filter([" + ", ".join(f"CASE WHEN list_has_any(w, {_once(k)}) THEN '{k}' END" for k in t.keywords) + "], lambda x: x IS NOT NULL)" for t in THEMES)
# half a cent goes up, as for decimals
_CLAMP = "round(greatest(0e0, least({0}, 1e1)) + 1e-9, 2)"
_AGE = f"(epoch_us({_NOW}) - epoch_us(published_at)) / 86400e6"
_EXTRACTED = rf"""{_PROSE}, {_FIGURES}, h0 AS (SELECT o.*, title || chr(10) || cleaned_text AS hay FROM m_sources o), h1 AS (SELECT *, {_TOKENS.format('hay')} AS w, ' ' || regexp_replace(lower(hay), '([^{_W}])', '\1\1', 'g') || ' ' AS t, len(regexp_extract_all(cleaned_text, '\S+')) AS words FROM h0),
    h2 AS (SELECT *, unnest([{', '.join(_theme(t) for t in THEMES)}]) AS score, unnest([{_KEYWORDS}]) AS kw, unnest({[t.name for t in THEMES]}) AS name, unnest(range({len(THEMES)})) AS place FROM h1), h3 AS (SELECT source_id, list(kw ORDER BY score DESC, place) AS kws, max(score) AS top, count(*) AS matches, list(name ORDER BY score DESC, place)[1] AS best FROM h2 WHERE score > 0 GROUP BY source_id),
    h AS (SELECT h1.*, coalesce(flatten(h3.kws), []) AS kws, coalesce(h3.top, 0e0) AS top, coalesce(h3.matches, 0) AS matches, CASE WHEN h3.top >= 4 THEN h3.best END AS primary_theme, len(list_filter(h1.w, lambda x: x IN ('the', 'thes'))) AS rn, len(list_filter(h1.w, lambda x: x IN ('und', 'unds', 'der', 'ders'))) AS an, list_contains(h1.w, 'that') AS competitor FROM h1 LEFT JOIN h3 ON h1.source_id = h3.source_id),
    i AS (SELECT p.doc_id, p.place, p.s, p.n, p.prose, {_held('lower(p.s)', lists.PROBLEM_MARKERS)} AS pm, {_held('lower(p.s)', lists.CLAIM_MARKERS)} AS cm, {_held('lower(p.s)', lists.EVIDENCE_WORDS)} AS ev, len(list_filter(h.kws, lambda k: contains(lower(p.s), k))) AS mine, len(h.kws) AS held FROM p JOIN h ON p.doc_id = h.source_id),
    j AS (SELECT *, pm * 15e-1 + mine * 5e-1 - n / 1e2 AS ps, cm * 15e-1 + mine * 5e-1 - n / 1e2 AS cs, mine * 4e0 + ev - n / 120e0 - CASE WHEN held > 0 AND mine = 0 THEN 2e0 ELSE 0e0 END + CASE WHEN regexp_matches(s, '(^|[^\w.])\$?[0-9]') THEN 15e-1 ELSE 0e0 END - CASE WHEN {_held('lower(s)', lists.PROMOTIONAL)} > 0 THEN 25e-1 ELSE 0e0 END AS es FROM i WHERE prose),
    pr AS (SELECT doc_id, arg_max(s, struct_pack(a := ps, b := -place)) AS problem FROM j WHERE n BETWEEN 8 AND 70 AND pm > 0 AND ps > 0 GROUP BY doc_id), cl AS (SELECT doc_id, arg_max(s, struct_pack(a := cs, b := -place)) AS claim FROM j WHERE n BETWEEN 8 AND 70 AND cm > 0 AND cs > 0 GROUP BY doc_id), fi AS (SELECT doc_id, arg_min(s, place) AS first FROM j WHERE n BETWEEN 10 AND 60 GROUP BY doc_id),
    ev AS (SELECT doc_id, least(count(DISTINCT left({_LOOSE.format('s')}, 80)), 5) AS passages FROM j WHERE n BETWEEN 10 AND 90 AND (mine > 0 OR ev > 0) AND es > 0 GROUP BY doc_id), nu AS (SELECT doc_id, least(count(*), 6) AS numbers FROM y5 GROUP BY doc_id),
    qu AS (SELECT doc_id, least(count(DISTINCT {_LOOSE.format('v')}), 5) AS quotes FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '["“]([^"”]{{25,400}})["”]', 1))) AS v FROM documents) WHERE len(regexp_extract_all(v, '\S+')) >= 6 GROUP BY doc_id),
    a0 AS (SELECT h.*, pr.problem AS customer_problem, coalesce(cl.claim, fi.first) AS primary_claim, coalesce(ev.passages, 0) AS passages, coalesce(nu.numbers, 0) AS numbers, coalesce(qu.quotes, 0) AS quotes, ({_own_sql}) OR source_type = 'first_party' AS promo, status = 'summary_only' AS brief,
        {_held('lower(hay)', lists.FAMILIAR)} > 0 OR (matches > 0 AND top < 3 AND matches >= 3) AS familiar, CASE WHEN published_at IS NULL THEN 4e0 WHEN {_AGE} <= 7 THEN 1e1 WHEN {_AGE} >= 120 THEN 0e0 ELSE round(greatest(1e1 * (1 - ({_AGE} - 7) / 113), 0), 2) END AS freshness
        FROM h LEFT JOIN pr ON source_id = pr.doc_id LEFT JOIN cl ON source_id = cl.doc_id LEFT JOIN fi ON source_id = fi.doc_id LEFT JOIN ev ON source_id = ev.doc_id LEFT JOIN nu ON source_id = nu.doc_id LEFT JOIN qu ON source_id = qu.doc_id),
    a1 AS (SELECT *, {_CLAMP.format(f"CASE WHEN {_any_of(lists.AGENT)} THEN 2e0 ELSE 0e0 END + CASE WHEN competitor THEN 8e-1 ELSE 0e0 END + CASE WHEN rn >= 2 OR an >= 2 THEN 2e0 ELSE 0e0 END + CASE WHEN {_any_of(lists.SMALL_BUSINESS)} THEN 15e-1 ELSE 0e0 END + least(top / 6e0, 2e0) + CASE WHEN {_any_of(lists.RESPONSE)} THEN 15e-1 ELSE 0e0 END")} AS market_relevance FROM a0),
    a2 AS (SELECT *, {_CLAMP.format(f"market_relevance * 5e-1 + CASE WHEN {_any_of(lists.FOUNDER)} THEN 1 ELSE 0 END + least({_number_of(lists.OPERATOR)} * 6e-1, 3e0) - CASE WHEN {_any_of(lists.DEEP_TECH)} THEN 2 ELSE 0 END")} AS speaker_relevance,
        {_CLAMP.format("2e0 + least(passages * 8e-1, 3e0) + least(quotes * 7e-1, 2e0) + least(numbers * 5e-1, 2e0) + CASE WHEN words > 800 THEN 1e0 WHEN words < 200 THEN -15e-1 ELSE 0e0 END - CASE WHEN promo THEN 25e-1 ELSE 0e0 END - CASE WHEN source_type = 'youtube' THEN 1 ELSE 0 END - CASE WHEN brief THEN 2 ELSE 0 END")} AS evidence_strength,
        {_CLAMP.format(f"3e0 + least({_number_of(lists.MONEY)} * 8e-1, 35e-1) + least(numbers * 4e-1, 15e-1) + least({_number_of(lists.SCALE)} * 6e-1, 12e-1) + CASE WHEN {_any_of(lists.MISSED)} THEN 1 ELSE 0 END")} AS business_impact,
        {_CLAMP.format("5e0 - CASE WHEN familiar THEN 25e-1 ELSE 0e0 END + least(numbers * 5e-1, 2e0) + CASE WHEN quotes > 0 THEN 1 ELSE 0 END - CASE WHEN promo THEN 15e-1 ELSE 0e0 END + CASE WHEN top >= 8 THEN 1 ELSE 0 END")} AS novelty FROM a1)"""


@query(oracle(f"""WITH {_EXTRACTED} SELECT source_id, primary_theme, coalesce(CASE WHEN competitor THEN 'That Co' END, source_domain) AS primary_entity, customer_problem, primary_claim, passages::INTEGER AS passages, quotes::INTEGER AS quotes, numbers::INTEGER AS numbers, promo AS is_promotional, familiar AS is_familiar, market_relevance, speaker_relevance, evidence_strength, business_impact, novelty, freshness,
    least(CASE WHEN evidence_strength < 4 THEN 18e0 ELSE 0e0 END + CASE WHEN numbers > 0 THEN 16 ELSE 0 END + CASE WHEN competitor THEN 14 ELSE 0 END + CASE WHEN promo THEN 10 ELSE 0 END + CASE WHEN familiar THEN 10 ELSE 0 END + CASE WHEN published_at IS NULL THEN 6 ELSE 0 END, 1e2) AS risk_score,
    CASE WHEN quotes > 0 AND evidence_strength >= 6 THEN 'linkedin_post' WHEN numbers > 0 AND business_impact >= 6 THEN 'short_form_video_outline' WHEN evidence_strength >= 7 THEN 'long_form_essay_outline' WHEN promo THEN 'internal_briefing_note' ELSE 'executive_talking_point' END AS recommended_format FROM a2"""))
def g01_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extraction.extract(view(spark, sf_dir, "m_sources"), KNOWN, as_of())
    size = lambda c, name: F.size(c).alias(name)
    return out.select(
        "source_id", "primary_theme", "primary_entity", "customer_problem", "primary_claim", size("supporting_evidence", "passages"), size("notable_quotes", "quotes"), size("numerical_claims", "numbers"), "is_promotional", "is_familiar",
        "market_relevance", "speaker_relevance", "evidence_strength", "business_impact", "novelty", "freshness", "risk_score", "recommended_format",
    )
