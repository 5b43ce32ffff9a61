"""Text, URL, taxonomy, HTML and extraction queries (B, C, D, F, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, labels, text, urls
from ..operators import extraction, taxonomy
from ..operators.taxonomy import Theme
from ..registry import query
from .ranking import as_of
from .views import AS_OF, OWN_DOMAINS, oracle, view

# A small dictionary of tokens of the synthetic texts.
THEMES = (
    Theme("theme-that", "That", ("that", "this"), ("with",), ("not",)), Theme("theme-the", "The", ("the", "and"), ("of",), ("from",)),
    Theme("theme-und", "Und", ("und", "der"), ("die",), ("von",)), Theme("theme-les", "Les", ("les", "des"), ("une",), ("pour",)),
)
KNOWN = extraction.Dictionaries(THEMES, competitors={"that": "That Co"}, industries={"Retail": ("the",), "Automotive": ("und", "der")}, segments={"small": ("and",), "large": ("les",)}, own_domains=OWN_DOMAINS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INTEGER AS words FROM documents")
def b03_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE regexp_replace(left(text, 100), ' [^ ]*$', '', 's') || ' …' END AS cut FROM documents")
def b04_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.truncate(F.col("text"), 100).alias("cut"))


@query(oracle(r"SELECT source_id, regexp_replace(lower(regexp_replace(search_query || ' ' || source_type || '!', '[^\w\s-]', '', 'g')), '[\s_-]+', '-', 'g') AS slug FROM m_sources"))
def b11_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "m_sources")
    return s.select("source_id", text.slugify(F.concat("search_query", F.lit(" "), "source_type", F.lit("!"))).alias("slug"))


@query(oracle(f"SELECT source_id, CASE WHEN published_at IS NULL THEN 'undated' WHEN a <= 14 THEN 'new' WHEN a <= 90 THEN 'recent' ELSE 'evergreen' END AS tier FROM (SELECT source_id, published_at, (epoch_us(make_timestamp({AS_OF}000000)) - epoch_us(published_at)) / 86400e6 AS a FROM m_sources)"))
def b24_recency_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "m_sources").select("source_id", labels.recency_tier(F.col("published_at"), as_of()).alias("tier"))


@query(oracle("SELECT source_id, CASE WHEN " + " OR ".join(f"source_domain = '{d}' OR ends_with(source_domain, '.{d}')" for d in OWN_DOMAINS) + " THEN 'own' WHEN is_promotional THEN 'vendor' ELSE 'independent' END AS origin FROM (SELECT o.source_id, o.source_domain, s.is_promotional FROM m_sources o JOIN m_signals s ON o.source_id = s.source_id)"))
def b27_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "m_sources").join(view(spark, sf_dir, "m_signals"), "source_id")
    return rows.select("source_id", labels.origin(F.col("source_domain"), F.col("is_promotional"), OWN_DOMAINS).alias("origin"))


# the driver's page URLs hold no user, port, index file or encoded character, so these pieces suffice for them
@query(r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://(www[.])?', '') AS r FROM pages), s AS (SELECT page_id, lower(regexp_extract(r, '^([^/?]*)', 1)) AS h, rtrim(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/') AS p, regexp_extract(r, '[?](.*)$', 1) AS q FROM u),
    k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'ref='))) AS l FROM s)
    SELECT page_id, 'https://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(l) = 0 THEN '' ELSE '?' || array_to_string(l, '&') END AS url FROM k""")
def c01_normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@query(r"SELECT page_id, d AS domain, CASE WHEN len(l) <= 2 THEN d WHEN array_to_string(l[-2:], '.') IN ('co.uk', 'com.au', 'co.nz', 'co.jp', 'com.br', 'co.za') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS registrable FROM (SELECT page_id, d, string_split(d, '.') AS l FROM (SELECT page_id, lower(regexp_extract(url, '^https?://(?:www[.])?([^/:?#]+)', 1)) AS d FROM pages))")
def c04_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.domain_of(u).alias("domain"), urls.registrable_domain(u).alias("registrable"))


@query(r"SELECT page_id, (d = 'example.com' OR ends_with(d, '.example.com')) AND NOT (d = 'blog.tionble.example.com') AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^https?://(?:www[.])?([^/:?#]+)', 1)) AS d FROM pages)")
def c06_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.is_allowed(F.col("url"), ("example.com",), ("blog.tionble.example.com",)).alias("allowed"))


@query()
def d01_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", html.parse_html(F.col("html"), F.col("url")).alias("a"))
    return pages.select("page_id", "a.title", "a.lang", "a.canonical", "a.author", "a.published", "a.site", "a.excerpt", "a.promotional", "a.body", html.page_links(F.col("a.links"), F.col("url"), absolute=True).alias("links"))


def _hit(words: tuple[str, ...], weight: str, cap: bool = True) -> str:
    one = lambda w: f"len(list_filter(w, lambda x: x IN ('{w}', '{w}s')))"
    return " + ".join(f"least({one(w)}, 4) * {weight}" if cap else f"{one(w)} * {weight}" for w in words)


_SCORES = ", ".join(f"{_hit(tuple(t.keywords), '1e0')} + {_hit(tuple(t.strong), '15e-1')} - ({_hit(tuple(t.negative), '3e0', cap=False)})" + f" AS s{i}" for i, t in enumerate(THEMES))


@query(rf"""WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^\pL\pM\pN_]+') AS w FROM documents), s AS (SELECT doc_id, {_SCORES} FROM w),
    l AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS place, unnest([s0, s1, s2, s3]) AS score, unnest({[t.name for t in THEMES]}) AS name FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS rn FROM l WHERE score > 0)
    SELECT d.doc_id, r.name, r.score FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r.rn = 1""")
def f03_theme_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(taxonomy.match_themes(F.col("text"), THEMES), F.lit(0))
    return _docs(spark, sf_dir).select("doc_id", first.alias("m")).select("doc_id", "m.name", "m.score")


@query(r"""WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^\pL\pM\pN_]+') AS w FROM documents), n AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'thes'))) AS r, len(list_filter(w, lambda x: x IN ('und', 'unds', 'der', 'ders'))) AS a, len(list_filter(w, lambda x: x IN ('and', 'ands'))) AS s, len(list_filter(w, lambda x: x IN ('les', 'less'))) AS l FROM w)
    SELECT doc_id, CASE WHEN r >= 2 AND a >= 2 THEN CASE WHEN r > a THEN 'Retail,Automotive' ELSE 'Automotive,Retail' END WHEN r >= 2 THEN 'Retail' WHEN a >= 2 THEN 'Automotive' ELSE 'Cross-industry' END AS industries,
    CASE WHEN s = 0 AND l = 0 THEN 'Not specified in source' WHEN s >= l THEN 'small' ELSE 'large' END AS segment FROM n""")
def f05_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(taxonomy.match_industries(t, KNOWN.industries), ",").alias("industries"), taxonomy.match_segment(t, KNOWN.segments).alias("segment"))


@query(oracle("SELECT source_id FROM m_sources WHERE status IN ('fetched', 'summary_only', 'needs_review', 'extracted') AND source_id NOT IN (SELECT source_id FROM m_signals) ORDER BY discovered_at DESC, source_id LIMIT 25"))
def g18_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.targets(view(spark, sf_dir, "m_sources"), view(spark, sf_dir, "m_signals"), 25).select("source_id")
