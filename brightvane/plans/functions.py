"""Text, URL and label functions by value, over whole tables (B, C, D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, labels, lists, text, urls
from ..registry import query
from .ranking import as_of
from .views import AS_OF, oracle, view

# SQL pieces. The tables hold composed text, which compatibility normalisation leaves as it is; what it changes is added by hand.
_WORD = r"\pL\pM\pN_"
_LOOSE = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_LINES = r"list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), lambda x: x = '' OR length(x) >= 3)"
_CLEAN = rf"trim(regexp_replace(array_to_string(list_transform({_LINES}, lambda x: regexp_replace(x, '[ \t]{{{{2,}}}}', ' ', 'g')), chr(10)), '\n{{{{3,}}}}', chr(10) || chr(10), 'g'), chr(9) || chr(10) || chr(13) || ' ')"
_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace(replace({_CLEAN}, chr(10), ' '), '([.!?])\s+([A-Z"''“(])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: trim(x)), lambda x: length(x) > 2)"""
_PLAIN = rf"trim(regexp_replace(regexp_replace(lower(regexp_replace({{0}}, '(?i)(cookie policy|accept all cookies|privacy policy|terms of service|all rights reserved|subscribe to our newsletter|skip to (main )?content)', ' ', 'g')), '[^{_WORD}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _shingles(w: str) -> str:
    return f"CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < 5 THEN [array_to_string({w}, ' ')] ELSE list_distinct(list_transform(range(1, len({w}) - 3), lambda i: array_to_string(list_slice({w}, i, i + 4), ' '))) END"


def _words(plain: str) -> str:
    return f"list_filter(string_split({plain}, ' '), lambda x: x <> '')"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _joined(items: Column) -> Column:
    return F.sha2(F.array_join(items, "\x1f"), 256)


@query("SELECT doc_id, sha256(replace(text, chr(10), chr(10) || chr(10)) || chr(10) || 'a b fi1A') AS value FROM documents")
def b01_normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n\r")), F.lit("\ra b ﬁ①Ａ"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.normalize_unicode(raw), 256).alias("value"))


_RAGGED = r"'  ab  ' || chr(10) || chr(10) || chr(10) || chr(10) || text || chr(10) || chr(9) || 'x  y   z ' || chr(10) || 'q'"


@query(f"SELECT doc_id, sha256({_CLEAN.format(_RAGGED)}) AS value FROM documents")
def b02_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ragged = F.concat(F.lit("  ab  \n\n\n\n"), F.col("text"), F.lit("\n\tx  y   z \nq"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.clean_text(ragged), 256).alias("value"))


@query(f"SELECT doc_id, len(s)::INTEGER AS sentences, sha256(array_to_string(s, chr(31))) AS value FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents)")
def b05_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("sentences"), _joined(F.col("s")).alias("value"))


@query(f"SELECT doc_id, p AS plain, sha256(p) AS content_hash, left(sha256(p), 12) AS short FROM (SELECT doc_id, {_PLAIN.format('text')} AS p FROM documents)")
def b07_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", text.normalize_for_hash(t).alias("plain"), text.content_hash(t).alias("content_hash"), text.short_hash(t).alias("short"))


@query(f"SELECT doc_id, len(s)::INTEGER AS shingles, sha256(array_to_string(list_sort(s), chr(31))) AS value FROM (SELECT doc_id, {_shingles('w')} AS s FROM (SELECT doc_id, {_words(_PLAIN.format('text'))} AS w FROM documents))")
def b08_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.shingles(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("shingles"), _joined(F.array_sort("s")).alias("value"))


@query(f"""WITH w AS (SELECT doc_id, {_words(_PLAIN.format('text'))} AS w, {_words(_PLAIN.format("left(text, 400) || ' tail'"))} AS v FROM documents), s AS (SELECT doc_id, {_shingles('w')} AS a, {_shingles('v')} AS b FROM w)
    SELECT doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0e0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 9) AS similarity FROM s""")
def b10_text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.round(text.text_similarity(t, F.concat(F.left(t, F.lit(400)), F.lit(" tail"))), 9).alias("similarity"))


@query(rf"""WITH p AS (SELECT doc_id, text, '"' || lower(substr(text, 15, 70)) || '.' AS passage FROM documents),
    l AS (SELECT *, {_LOOSE.format('text')} AS source, regexp_replace({_LOOSE.format('passage')}, '^["''.,;: ]+|["''.,;: ]+$', '', 'g') AS asked FROM p)
    SELECT doc_id, sha256(source) AS loose, length(asked) >= 12 AND contains(source, asked) AS own, length(asked) >= 12 AND contains({_LOOSE.format("left(text, 40)")}, asked) AS part FROM l""")
def b13_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    passage = F.concat(F.lit('"'), F.lower(F.substring(t, 15, 70)), F.lit("."))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.loose(t), 256).alias("loose"), text.is_verbatim(passage, t).alias("own"), text.is_verbatim(passage, F.left(t, F.lit(40))).alias("part"))


@query(rf"""WITH p AS (SELECT doc_id, text, substr(text, 25, 30) AS a, lower(substr(text, 25, 30)) AS b FROM documents), l AS (SELECT *, {_LOOSE.format('text')} AS source, {_LOOSE.format('b')} AS asked FROM p),
    n AS (SELECT *, strpos(source, asked) - 1 AS near, strpos(text, a) - 1 AS exact FROM l)
    SELECT doc_id, CASE WHEN a <> '' THEN exact END::INTEGER AS start_exact, CASE WHEN a <> '' THEN exact + length(a) END::INTEGER AS end_exact, CASE WHEN b = '' THEN NULL WHEN strpos(text, b) > 0 THEN strpos(text, b) - 1 WHEN near >= 0 THEN floor(near * (length(text) / greatest(length(source), 1)::DOUBLE)) END::INTEGER AS start_near FROM n""")
def b14_locate_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    part = F.substring(t, 25, 30)
    rows = _docs(spark, sf_dir).select("doc_id", text.locate_passage(part, t).alias("a"), text.locate_passage(F.lower(part), t).alias("b"))
    return rows.select("doc_id", F.col("a.start").alias("start_exact"), F.col("a.end").alias("end_exact"), F.col("b.start").alias("start_near"))


@query(rf"""WITH q AS (SELECT doc_id, text, trim(replace(left(text, 90 + doc_id % 300), chr(34), '')) AS said FROM documents), k AS (SELECT *, len(regexp_extract_all(said, '\S+')) >= 6 AND length(said) BETWEEN 25 AND 400 AS good FROM q)
    SELECT doc_id, CASE WHEN good THEN 1 ELSE 0 END AS quotes, CASE WHEN good THEN trim(said, ' ' || chr(10)) END AS quote, CASE WHEN good THEN 'Ada Lovelace' END AS speaker, CASE WHEN good THEN 8 END AS char_start, CASE WHEN good THEN 8 + length(said) END AS char_end, CASE WHEN good THEN true END AS verified_verbatim FROM k""")
def b15_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one quote a text, of 6 words or more or of fewer; then the text itself without its quotation marks
    t = F.replace(F.col("text"), F.lit('"'))
    said = F.trim(F.replace(F.left(F.col("text"), (F.lit(90) + F.col("doc_id") % 300).cast("int")), F.lit('"')))
    whole = F.concat(F.lit("Intro: “"), said, F.lit("” added Ada Lovelace, and "), F.translate(t, "“”", ""))
    rows = _docs(spark, sf_dir).select("doc_id", text.extract_quotes(whole).alias("q")).withColumn("f", F.get("q", F.lit(0)))
    return rows.select("doc_id", F.size("q").alias("quotes"), "f.quote", "f.speaker", "f.char_start", "f.char_end", "f.verified_verbatim")


# a sentence's words, and the tests of prose, in SQL over (doc_id, at, s)
_ALL = f"SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS place FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents)"
_BARE = r"""list_filter(list_transform(w, lambda x: lower(regexp_replace(x, '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g'))), lambda x: regexp_full_match(x, '\pL{2,}'))"""
_UPPER = "upper({0}) = {0} AND lower({0}) <> {0}"
_PROSE = rf"""x AS ({_ALL}), y AS (SELECT *, regexp_extract_all(s, '\S+') AS w FROM x), z AS (SELECT *, {_BARE} AS b, len(w) AS n FROM y),
    g AS (SELECT *, len(b) >= 8 AND (len(list_filter(b, lambda x: NOT regexp_matches(x, '[aeiouy]'))) / greatest(len(b), 1)::DOUBLE > 0.15e0 OR len(list_filter(b, lambda x: list_contains({_list(lists.FUNCTION_WORDS)}, x))) = 0) AS gibberish,
        len(list_filter(w, lambda x: length(x) > 2 AND {_UPPER.format('x')})) AS shouty, len(list_filter(w[2:], lambda x: upper(left(x, 1)) = left(x, 1) AND lower(left(x, 1)) <> left(x, 1))) AS capital,
        len(list_filter(w, lambda x: length(x) > 2 AND lower(x) = x AND upper(x) <> x)) AS small FROM z),
    p AS (SELECT *, n >= 6 AND regexp_matches(s, '[.!?]["''”’)]?\s*$') AND NOT list_bool_or(list_transform({_list(lists.FURNITURE)}, lambda f: contains(lower(s), f))) AND NOT regexp_full_match(s, '[A-Z0-9][A-Za-z0-9 &/,''’-]{{0,60}}')
        AND shouty < 3 AND shouty <= 0.3 * n AND capital <= 0.6 * greatest(n - 1, 1) AND small >= 3 AND NOT gibberish AS prose FROM g)"""


@query(f"WITH {_PROSE} SELECT doc_id, place::INTEGER AS place, gibberish, prose FROM p")
def b18_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("place", "s"))
    # words are cut once for both, and one is a part of the other
    s = s.withColumn("w", text.words(F.col("s")))
    s = s.withColumn("gibberish", text.looks_like_gibberish(F.col("s"), F.col("w")))
    return s.select("doc_id", "place", "gibberish", text.looks_like_prose(F.col("s"), F.col("w"), F.col("gibberish")).alias("prose"))


@query(f"""WITH {_PROSE}, c AS (SELECT doc_id, place, s, (contains(lower(s), 'with'))::INTEGER AS top, contains(lower(s), 'the')::INTEGER + contains(lower(s), 'that')::INTEGER AS wide, n, prose FROM p),
    e AS (SELECT *, top * 4e0 + wide - n / 120e0 - CASE WHEN top = 0 THEN 2e0 ELSE 0e0 END + CASE WHEN regexp_matches(s, '(?:^|[^{_WORD}.])\\$?[0-9]') THEN 15e-1 ELSE 0e0 END - CASE WHEN list_bool_or(list_transform({_list(lists.PROMOTIONAL)}, lambda f: contains(lower(s), f))) THEN 25e-1 ELSE 0e0 END AS score FROM c),
    k AS (SELECT *, left({_LOOSE.format('s')}, 80) AS key FROM e WHERE n BETWEEN 10 AND 90 AND (top > 0 OR wide > 0) AND score > 0 AND prose),
    o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY score DESC, place) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS rank FROM o)
    SELECT doc_id, rank::INTEGER AS rank, s AS passage FROM r WHERE rank <= 5""")
def b19_evidence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.select_evidence_passages(F.col("text"), ["the", "that"], priority=["with"])
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(found).alias("i", "p")).select("doc_id", (F.col("i") + 1).alias("rank"), "p.passage")


_SOLD = f"text || CASE doc_id % 4 WHEN 0 THEN ' Book a demo. See pricing.' WHEN 1 THEN ' Trusted by many.' ELSE '' END"


@query(rf"SELECT doc_id, n >= 2 OR (n = 1 AND len(regexp_extract_all(t, '\S+')) < 400) AS promotional FROM (SELECT doc_id, t, len(list_filter({_list(lists.PROMOTIONAL)}, lambda f: contains(lower(t), f))) AS n FROM (SELECT doc_id, {_SOLD} AS t FROM documents))")
def b20_promotional(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " Book a demo. See pricing.").when(F.col("doc_id") % 4 == 1, " Trusted by many.").otherwise(""))
    return _docs(spark, sf_dir).select("doc_id", text.looks_promotional(sold).alias("promotional"))


@query("SELECT event_id, ts + CASE WHEN (ts >= TIMESTAMP '2023-03-12 02:00:00' AND ts < TIMESTAMP '2023-11-05 02:00:00') OR (ts >= TIMESTAMP '2024-03-10 02:00:00' AND ts < TIMESTAMP '2024-11-03 02:00:00') THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS at FROM events WHERE ts >= TIMESTAMP '2023-01-01' AND ts < TIMESTAMP '2025-01-01'")
def b21_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts >= timestamp '2023-01-01' and ts < timestamp '2025-01-01'")
    return events.select("event_id", text.to_utc(F.col("ts").cast("timestamp"), "America/New_York").alias("at"))


@query(r"""SELECT doc_id, format('{:,}', doc_id * 37) || CASE WHEN doc_id * 37 = 1 THEN ' source' ELSE ' sources' END AS count_label, CASE WHEN doc_id % 3 = 1 THEN 'industry' ELSE 'industries' END AS plural,
    CASE WHEN doc_id % 2 = 0 THEN 'retail and home services' ELSE 'retail' END AS industries, CASE doc_id % 3 WHEN 0 THEN 'AI for ' || source WHEN 1 THEN 'Long form ' || source ELSE '—' END AS label,
    CASE WHEN len(w) <= 8 THEN array_to_string(w, ' ') ELSE regexp_replace(array_to_string(w[1:8], ' '), '[.,;:]+$', '') || '…' END AS short, trim(left(text, 30)) AS inferred FROM (SELECT *, regexp_extract_all(text, '\S+') AS w FROM documents)""")
def b22_formatters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    names = F.array(F.lit(" Retail"), F.lit("Cross-industry"), F.when(d % 2 == 0, "Home Services").otherwise("retail"))
    raw = F.when(d % 3 == 0, F.concat(F.lit("ai_for-"), F.col("source"))).when(d % 3 == 1, F.concat(F.lit("long_form-"), F.col("source"))).otherwise("")
    return _docs(spark, sf_dir).select(
        "doc_id", labels.count_label(d * 37, "source").alias("count_label"), labels.pluralize(d % 3, "industry", "industries").alias("plural"), labels.industry_phrase(names).alias("industries"), labels.humanize_label(raw).alias("label"),
        labels.truncate_words(F.col("text"), 8).alias("short"), labels.strip_inference_prefix(F.concat(F.lit(" [Inference: weak] "), F.left("text", F.lit(30)))).alias("inferred"),
    )


@query(oracle(f"""SELECT source_id, CASE WHEN published_at IS NULL THEN 'no date' WHEN s < 3600 THEN greatest(s // 60, 1) || ' min' || CASE WHEN greatest(s // 60, 1) = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 86400 THEN s // 3600 || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago'
    WHEN d < 31 THEN d || ' day' || CASE WHEN d = 1 THEN '' ELSE 's' END || ' ago' WHEN d // 30 < 12 THEN d // 30 || ' month' || CASE WHEN d // 30 = 1 THEN '' ELSE 's' END || ' ago' ELSE d // 365 || ' year' || CASE WHEN d // 365 = 1 THEN '' ELSE 's' END || ' ago' END AS ago
    FROM (SELECT source_id, published_at, s, s // 86400 AS d FROM (SELECT source_id, published_at, epoch_us(make_timestamp({AS_OF}000000) - (published_at - to_days((source_id % 9 * 60)::INTEGER))) // 1000000 AS s FROM m_sources))"""))
def b23_relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.col("published_at") - F.make_dt_interval((F.col("source_id") % 9 * 60).cast("int"))
    return view(spark, sf_dir, "m_sources").select("source_id", labels.relative_time(back, as_of()).alias("ago"))


@query("""SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN 'no activity in either period' WHEN b = 0 THEN 'new this period — ' || a || CASE WHEN a = 1 THEN ' source' ELSE ' sources' END || ', none previously' WHEN a = b THEN 'flat at ' || a || CASE WHEN a = 1 THEN ' source' ELSE ' sources' END
    ELSE CASE WHEN a > b THEN 'up ' ELSE 'down ' END || round(abs((a - b) / b::DOUBLE) * 100)::INTEGER || '% — ' || a || ' this period vs ' || b || ' last' END AS growth,
    CASE WHEN r <= 24 THEN 'Low' WHEN r <= 49 THEN 'Moderate' WHEN r <= 74 THEN 'Elevated' ELSE 'High' END AS risk, CASE WHEN r >= 80 THEN 'Strong' WHEN r >= 65 THEN 'Promising' WHEN r >= 50 THEN 'Moderate' ELSE 'Weak' END AS score FROM (SELECT doc_id, doc_id % 7 AS a, doc_id // 7 % 6 AS b, (doc_id * 13 % 201) / 2e0 AS r FROM documents)""")
def b25_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    r = (d * 13 % 201) / 2.0
    return _docs(spark, sf_dir).select("doc_id", labels.growth_phrase(d % 7, F.floor(d / 7) % 6).alias("growth"), labels.risk_band(r).alias("risk"), labels.score_band(r).alias("score"))


_HOST = "lower(regexp_extract(url, '^https?://(?:www[.])?([^/:?#]+)', 1))"


@query(f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://' || {_HOST} || '/canonical' WHEN 1 THEN 'https://' || {_HOST} || '/x?a=1&b=2' ELSE 'https://' || {_HOST} || '/own' END AS url FROM pages")
def c02_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.col("url"), F.col("page_id") % 3
    host = urls.domain_of(u)
    declared = F.when(k == 0, F.concat(F.lit("http://www."), host, F.lit("/canonical/#top"))).when(k == 1, F.concat(F.lit("//"), host, F.lit("/x?b=2&utm_source=q&a=1&c="))).otherwise("https://elsewhere.org/y")
    fetched = F.concat(F.lit("HTTP://"), host, F.lit(":80/own/index.html"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.canonicalize(fetched, declared).alias("url"))


@query(f"""SELECT page_id, page_id % 5 IN (0, 1, 4) AS is_http, {_HOST} <> '' AND array_to_string(string_split({_HOST}, '.')[-2:], '.') = CASE WHEN page_id % 2 = 0 THEN 'example.com' ELSE 'example.org' END AS same_site FROM pages""")
def c05_url_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.col("url"), F.col("page_id")
    form = F.when(k % 5 == 0, u).when(k % 5 == 1, F.regexp_replace(u, "^https?://", "")).when(k % 5 == 2, F.concat(F.lit("mailto:"), urls.domain_of(u))).when(k % 5 == 3, F.lit("/relative")).otherwise(F.regexp_replace(u, "^https?", "HTTPS"))
    other = F.when(k % 2 == 0, "http://sub.example.com/q").otherwise("https://www.example.org")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.is_http_url(form).alias("is_http"), urls.same_site(u, other).alias("same_site"))


@query("""SELECT page_id, CASE WHEN page_id % 6 < 4 THEN 'vid' || page_id END AS video, CASE page_id % 5 WHEN 0 THEN 'jane-doe' WHEN 1 THEN 'jd_' || page_id END AS handle,
    CASE page_id % 5 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'x' WHEN 2 THEN 'reddit' WHEN 3 THEN 'x' ELSE 'other' END AS platform, page_id % 3 = 0 AS aggregator, page_id % 4 = 0 AS own FROM pages""")
def c08_link_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    one = lambda lead, tail="": F.concat(F.lit(lead), n, F.lit(tail))
    video = F.when(k % 6 == 0, one("https://youtu.be/vid", "?t=3")).when(k % 6 == 1, one("https://www.youtube.com/watch?list=q&v=vid", "&t=1")).when(k % 6 == 2, one("youtube.com/shorts/vid", "/")).when(k % 6 == 3, one("https://m.youtube.com/embed/vid")).when(k % 6 == 4, F.lit("https://www.youtube.com/feed/library")).otherwise(F.col("url"))
    link = F.when(k % 5 == 0, one("https://www.linkedin.com/posts/jane-doe_topic-")).when(k % 5 == 1, one("https://x.com/jd_", "/status/1")).when(k % 5 == 2, F.lit("https://www.reddit.com/user/j-d/")).when(k % 5 == 3, F.lit("https://twitter.com/i/status/5")).otherwise(F.col("url"))
    domain = F.when(k % 3 == 0, "www.G2.com").when(k % 3 == 1, "notg2.com").otherwise("g2.com.example.org")
    host = F.when(k % 4 == 0, "blog.own.org").otherwise("disown.org")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.video_id(video).alias("video"), urls.social_handle(link).alias("handle"), urls.platform(link).alias("platform"), urls.is_aggregator(domain).alias("aggregator"), urls.is_first_party(host, ("own.org",)).alias("own"))


@query("""SELECT doc_id, CASE WHEN doc_id % 8 IN (6, 7) THEN NULL ELSE make_timestamp((1650000000 + (doc_id * 7919 % 500) * 86400 + CASE WHEN doc_id % 8 IN (2, 4) THEN 0 ELSE 3600 * (doc_id % 10) END) * 1000000) - CASE WHEN doc_id % 8 IN (2, 4) THEN to_seconds(1650000000 % 86400) ELSE to_seconds(0) END END AS at FROM documents""")
def d06_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    day = F.timestamp_seconds(F.lit(1650000000) + (d * 7919 % 500) * 86400 + F.when((d % 8).isin(2, 4), 0).otherwise(3600 * (d % 10)))
    form = lambda f: F.date_format(day, f)
    raw = (
        F.when(d % 8 == 0, form("yyyy-MM-dd'T'HH:mm:ssXXX")).when(d % 8 == 1, form("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).when(d % 8 == 2, form("yyyy-MM-dd")).when(d % 8 == 3, form("EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(d % 8 == 4, form("MMMM d, yyyy")).when(d % 8 == 5, form("yyyy-MM-dd HH:mm:ss")).when(d % 8 == 6, F.lit("1994-12-31")).otherwise("last week")
    )
    return _docs(spark, sf_dir).select("doc_id", html.parse_date(raw, 2025).alias("at"))
