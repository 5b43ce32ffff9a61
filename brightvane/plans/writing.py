"""Briefs in words, drafts, and what a model's answers may cite (K-03, K-11, K-12, K-23, K-24, K-26)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..operators import audit, briefs, drafts, extraction, voice, whitelist
from ..operators import templates as T
from ..operators.taxonomy import Theme
from ..registry import query
from .functions import _LOOSE, _SENTENCES, _list
from .views import oracle, view


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fill(text: str, **places: str) -> str:
    """A template as SQL."""
    return "(" + T.fill(text, places, _quote, lambda parts: " || ".join(p if p.startswith("'") else f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)) + ")"


def _cut(text: str, n: int) -> str:
    return f"(CASE WHEN length({text}) <= {n} THEN {text} ELSE regexp_replace(left({text}, {n}), ' [^ ]*$', '', 's') || ' …' END)"


def _count(n: str, noun: str) -> str:
    return f"({n} || CASE WHEN {n} = 1 THEN ' {noun}' ELSE ' {noun}s' END)"


def _bare(text: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({text}, ''), '^\s+|\s+$', '', 'g'), '[.]+$', '')"


def _phrase(n: int) -> str:
    return f"array_to_string(list_distinct_in_order(list_filter(list_transform(industries, lambda x: lower(trim(x))), lambda x: x NOT IN ('', 'cross-industry')))[1:{n}], ' and ')".replace("list_distinct_in_order(", "(")


_WITHIN3, _WITHIN2 = (f"CASE WHEN {_phrase(n)} <> '' THEN ' in ' || {_phrase(n)} ELSE '' END" for n in (3, 2))
_GIVEN = {"domains": _count("domains", "domain"), "sources": _count("sources", "public source"), "promotional": "promotional", "promotional_label": _count("promotional", "marketing source")}
_PASSAGES = _count("passages", "passage")


def _pairs(kind: tuple[str, str], texts: tuple[str, str], **places: str) -> str:
    return f"{{'{kind[0]}': {_fill(texts[0], **places)}, '{kind[1]}': {_fill(texts[1], **places)}}}"


_OBJECTION, _CHECK = ("objection", "response"), ("item", "why")
_FIELDS = {
    "title": "CASE WHEN cut <> '' THEN upper(left(cut, 1)) || substr(cut, 2) ELSE name END",
    "core_insight": _fill(T.INSIGHT, about=f"CASE WHEN trim(description) <> '' THEN {_bare('description')} || '. ' ELSE '' END", sources=_GIVEN["sources"], domains=_GIVEN["domains"], scope=_WITHIN3, passages=_PASSAGES, independent="sources - promotional")
    + f" || CASE WHEN len(problems) > 0 THEN {_fill(T.INSIGHT_PROBLEM, problem=_cut('problems[1].problem', 260), problem_source='problems[1].source_id')} ELSE '' END",
    "why_now": _fill(T.WHY_NOW, status="coalesce(trend_status, 'unknown')", current=_count("current_period_count", "source"), previous="previous_period_count")
    + " || CASE WHEN previous_period_count > 0 THEN ' (' || CASE WHEN growth_rate >= 0 THEN '+' ELSE '-' END || round(abs(growth_rate) * 100)::INTEGER || '%).' ELSE '.' END"
    + f" || CASE WHEN newest IS NOT NULL THEN {_fill(T.WHY_NOW_NEWEST, newest_title=_cut('newest.title', 90), newest_domain='newest.domain', newest_date='newest.day')} ELSE {_quote(T.WHY_NOW_UNDATED)} END || CASE WHEN domains < 2 THEN {_quote(T.WHY_NOW_ALONE)} ELSE '' END",
    "why_company": _fill(T.WHY_COMPANY, name="lower(name)", relevance="average_market_relevance") + f" || CASE WHEN {_phrase(3)} <> '' THEN {_fill(T.WHY_COMPANY_INDUSTRIES, three_industries=_phrase(3))} ELSE '' END || CASE WHEN own > 0 THEN {_fill(T.WHY_COMPANY_OWN, own=_count('own', 'source'))} ELSE '' END",
    "why_speaker": _fill(T.WHY_SPEAKER, in_two=_WITHIN2), "target_audience": _fill(T.AUDIENCE, in_three=_WITHIN3), "founder_point_of_view": _fill(T.VIEW, description="trim(description)", domains=_GIVEN["domains"], sources=_GIVEN["sources"]),
    "potential_objections": f"to_json(list_concat([{_pairs(_OBJECTION, T.OBJECTION_VENDOR, **_GIVEN)}, CASE WHEN domains < 3 THEN {_pairs(_OBJECTION, T.OBJECTION_THIN, **_GIVEN)} ELSE {_pairs(_OBJECTION, T.OBJECTION_WIDE, **_GIVEN)} END], CASE WHEN len(numbers) > 0 THEN [{_pairs(_OBJECTION, T.OBJECTION_NUMBERS)}] ELSE [] END))::VARCHAR",
    "recommended_format": "CASE WHEN len(quotes) > 0 AND domains >= 3 THEN 'linkedin_post' WHEN len(numbers) > 0 THEN 'short_form_video_outline' WHEN sources >= 6 THEN 'long_form_essay_outline' ELSE 'executive_talking_point' END",
    "suggested_call_to_action": _fill(T.CALL, name="lower(name)"),
    "verification_checklist": f"to_json(list_concat(list_concat(list_concat([{_pairs(_CHECK, T.CHECK_PAGES)}, {_pairs(_CHECK, T.CHECK_DATES)}], list_transform(numbers, lambda x: {_pairs(_CHECK, T.CHECK_NUMBER, value='x.value', source='x.source_id')})), list_transform(quotes, lambda x: {_pairs(_CHECK, T.CHECK_QUOTE, quote=_cut('x.quote', 90))})),"
    f" list_concat(CASE WHEN promotional > 0 THEN [{_pairs(_CHECK, T.CHECK_SOLD, **_GIVEN)}] ELSE [] END, [{_pairs(_CHECK, T.CHECK_VOICE)}])))::VARCHAR",
    "confidence_note": f"CASE WHEN domains <= 1 THEN {_quote(T.CONFIDENCE_WEAK)} WHEN passages < 3 THEN {_fill(T.CONFIDENCE_THIN, passages=_PASSAGES)} ELSE {_fill(T.CONFIDENCE_FAIR, passages=_PASSAGES, domains=_GIVEN['domains'], sources=_GIVEN['sources'])} END",
}


@query(oracle(rf"""WITH c AS (SELECT *, regexp_replace(split_part({_bare("CASE WHEN trim(description) <> '' THEN trim(description) ELSE name END")}, '. ', 1), '[.]+$', '') AS claim FROM m_facts), w AS (SELECT *, regexp_extract_all(claim, '\S+') AS w FROM c),
    k AS (SELECT *, CASE WHEN len(w) <= 14 THEN array_to_string(w, ' ') ELSE regexp_replace(array_to_string(w[1:14], ' '), '[.,;:]+$', '') || '…' END AS cut FROM w)
    SELECT doc_id, {', '.join(f'{sql} AS {name}' for name, sql in _FIELDS.items())} FROM k"""))
def k11_brief_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = drafts.brief_fields(view(spark, sf_dir, "m_facts"))
    return fields.select("doc_id", *[F.to_json(c).alias(c) if c in ("potential_objections", "verification_checklist") else c for c in _FIELDS])


@query(oracle(f"""SELECT draft_id, place, CASE WHEN len(regexp_extract_all(said, '\\S+')) >= 4 AND NOT regexp_full_match(said, '[a-z0-9_]+') AND replace(lower(said), ' ', '_') NOT IN ('primary_claim', 'customer_problem', 'supporting_evidence', 'notable_quotes', 'numerical_claims', 'content_opportunity') THEN said ELSE {_cut('passage', 200)} END AS text
    FROM (SELECT draft_id, place, trim(coalesce(p.point, '')) AS said, p.evidence_passage AS passage FROM (SELECT draft_id, unnest(points) AS p, unnest(range(len(points)))::INTEGER AS place FROM m_briefs))"""))
def k12_point_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "m_briefs").select("draft_id", F.posexplode("points").alias("place", "p"))
    return points.select("draft_id", "place", drafts.point_text(F.col("p.point"), F.col("p.evidence_passage")).alias("text"))


def _plain(text: str) -> str:
    return rf"regexp_replace(coalesce({text}, ''), '\[Inference[^\]]*\]\s*', '', 'g')"


def _body(n: int) -> str:
    own = "CASE WHEN trim(coalesce(p.point, '')) <> '' THEN p.point ELSE p.evidence_passage END"
    return _bare(_cut(f"({_bare(own)} || '.')", n))


_VERBATIM = f"{_bare('p.point')} <> '' AND {_bare('p.evidence_passage')} <> '' AND contains(lower({_bare('p.evidence_passage')}), lower(left({_bare('p.point')}, 60)))"
_IDS = "array_to_string(list_transform(p.evidence_source_ids, lambda i: '#' || i), ', ')"
_DOMAIN = "coalesce(p.evidence_domain, 'source')"
_FIRST = "coalesce(CAST(p.evidence_source_ids[1] AS VARCHAR), '?')"


def _each(most: int, text: str, sep: str = "chr(10)") -> str:
    """A text of each of the first points, `p` at place `n`."""
    return f"array_to_string(list_transform(points[1:{most}], lambda p, n: {text}), {sep})"


def _passage(n: int) -> str:
    return _cut("p.evidence_passage", n)


_ASK, _HOOK = "suggested_call_to_action", "coalesce(hook, title)"
_INSIGHT, _VIEW = _plain("core_insight"), _plain("founder_point_of_view")
_SAID = lambda text, n: f"CASE WHEN {_VERBATIM} THEN {_fill(text, domain=_DOMAIN, body=_body(n))} ELSE {_body(n)} END"
_CALL = "regexp_replace(suggested_call_to_action, '^Ask the reader to ', '')"
_DRAFTS = {
    "linkedin_post": f"trim({_fill(T.POST, hook=_HOOK, insight=_cut(f'trim(split_part({_INSIGHT}, {_quote(T.INSIGHT_PROBLEM.split(chr(8220))[0])}, 1))', 320), points=_each(3, f'CASE WHEN {_VERBATIM} THEN {_fill(T.POINT_SAID, body=_body(190), domain=_DOMAIN, ids=_IDS)} ELSE {_fill(T.POINT_SUMMARY, body=_body(190), ids=_IDS)} END'), view='CASE WHEN mine <> chr(0) THEN mine ELSE chr(0) END', ask=_cut(f'(upper(left({_CALL}, 1)) || substr({_CALL}, 2))', 200), links='links')})".replace("CASE WHEN mine <> chr(0) THEN mine ELSE chr(0) END", f"CASE WHEN mine <> '' THEN 'My view: ' || {_cut('mine', 300)} || chr(10) || chr(10) ELSE '' END"),
    "short_form_video_outline": _fill(T.VIDEO, title="title", hook=_HOOK, beats=f"CASE WHEN len(points) > 0 THEN {_each(3, _fill(T.VIDEO_BEAT, number='n', said=f'CASE WHEN {_VERBATIM} THEN {_fill(T.VIDEO_SAID, domain=_DOMAIN, body=_body(160))} ELSE {_body(160)} || chr(46) END', passage=_passage(90), ids=_IDS, url='p.evidence_url'))} ELSE {_quote(T.NO_POINTS)} END", ask=_cut(_ASK, 180), spoken=r"40 + coalesce(list_sum(list_transform(points[1:3], lambda p: len(regexp_extract_all(coalesce(p.point, p.evidence_passage), '\S+')))), 0)::BIGINT"),
    "long_form_essay_outline": _fill(T.ESSAY, title="title", view=_cut(_VIEW, 400), why_now=_cut("why_now", 300), sections=_each(5, _fill(T.ESSAY_SECTION, number="n + 1", said=_SAID(T.ESSAY_SAID, 120), ids=_IDS, passage=_passage(220), url="p.evidence_url"), "''"), objections_number="len(points[1:5]) + 2", close_number="len(points[1:5]) + 3", ask=_cut(_ASK, 220),
        objections=f"array_to_string(list_transform(potential_objections[1:3], lambda o: {_fill(T.ESSAY_OBJECTION, objection='o.objection', response='o.response')}), chr(10))", missing=f"CASE WHEN len(points[1:5]) < 4 THEN {_quote(T.ESSAY_THIN)} ELSE {_quote(T.ESSAY_FULL)} END"),
    "executive_talking_point": _fill(T.TALK, title="title", insight=_cut(_INSIGHT, 480), facts=_each(3, _fill(T.TALK_FACT, ids=_IDS, passage=_passage(200))), objection="coalesce(potential_objections[1].objection, 'None recorded.')", response="potential_objections[1].response", figure=f"CASE WHEN figure IS NOT NULL THEN {_fill(T.TALK_FIGURE, passage=_cut('figure.passage', 160), source='figure.source_id')} ELSE {_quote(T.TALK_NO_FIGURE)} END"),
    "podcast_discussion_point": _fill(T.PODCAST, title="title", question=_bare("title"), view=_cut(_VIEW, 700), facts=_each(2, _fill(T.PODCAST_FACT, passage=_passage(220), domain="p.evidence_domain", source=_FIRST))),
    "customer_story_angle": _fill(T.STORY, title="title", insight=_cut("core_insight", 300)),
    "engagement_comment": _fill(T.COMMENT, title="title", insight=_cut(_INSIGHT, 240), passage=f"CASE WHEN len(points) > 0 THEN {_cut('points[1].evidence_passage', 160)} ELSE {_quote(T.NO_POINTS)} END", source="coalesce(CAST(points[1].evidence_source_ids[1] AS VARCHAR), '?')", url="points[1].evidence_url"),
    "internal_briefing_note": _fill(T.NOTE, title="title", facts=_each(5, _fill(T.NOTE_FACT, ids=_IDS, passage=_passage(220))), why_now=_cut("why_now", 500), checks=f"array_to_string(list_transform(verification_checklist[1:6], lambda c: {_fill(T.NOTE_CHECK, item='c.item', why='c.why')}), chr(10))", ask=_cut(_ASK, 300), confidence="coalesce(confidence_note, 'Not stated.')"),
}
_PREPARED = f"""b AS (SELECT *, array_to_string(({_SENTENCES.format(_VIEW)})[1:2], ' ') AS mine, list_filter(evidence, lambda e: regexp_matches(e.passage, '[0-9]'))[1] AS figure,
    CASE len(points) WHEN 0 THEN '' WHEN 1 THEN l1 || chr(10) || l2 WHEN 2 THEN l1 || chr(10) || l2 ELSE l1 || chr(10) || l2 END AS links FROM (SELECT *, '#' || draft_id || ' https://e.org/1' AS l1, '#' || (draft_id + 1) || ' https://e.org/1' AS l2 FROM m_briefs))"""


@query(oracle(f"WITH {_PREPARED} " + " UNION ALL ".join(f"SELECT draft_id, '{kind}' AS content_type, sha256({sql}) AS draft_sha256 FROM b" for kind, sql in _DRAFTS.items())))
def k23_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "m_briefs")
    out = [drafts.write(rows, kind).select("draft_id", "content_type", F.sha2("draft_text", 256).alias("draft_sha256")) for kind in drafts.TYPES]
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return every


@query(oracle(f"""SELECT source_id, CASE WHEN len(served) > 0 THEN 'Within the served industries: ' || array_to_string(served, ', ') || '.' WHEN market_relevance >= 7 THEN {_quote(T.CONNECTION_CATEGORY)} ELSE {_quote(T.CONNECTION_THEME)} END AS connection,
    CASE WHEN said <> '' THEN {_fill(T.ANGLE_CLAIM, claim=_cut('said', 160))} ELSE {_quote(T.ANGLE_NONE)} END AS angle FROM (SELECT s.source_id, s.market_relevance, list_sort(list_filter({_list(lists.CORE_INDUSTRIES)}, lambda x: (x = 'Retail' AND s.source_id % 3 = 0) OR (x = 'Healthcare' AND s.source_id % 4 = 0))) AS served,
    CASE WHEN s.source_id % 5 = 0 THEN '' WHEN s.source_id % 5 = 1 THEN 'a claim of ' || o.source_domain ELSE trim(o.cleaned_text) END AS said FROM m_signals s JOIN m_sources o ON o.source_id = s.source_id)"""))
def k03_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("source_id")
    rows = view(spark, sf_dir, "m_signals").join(view(spark, sf_dir, "m_sources").select("source_id", "cleaned_text", "source_domain"), "source_id")
    industries = F.filter(F.array(F.lit("Cross-industry"), F.when(i % 3 == 0, "Retail"), F.when(i % 4 == 0, "Healthcare")), lambda x: x.isNotNull())
    problem, claim = F.when(i % 5 > 1, F.col("cleaned_text")).otherwise(" "), F.when(i % 5 == 1, F.concat(F.lit("a claim of "), "source_domain"))
    return rows.select("source_id", briefs.connection(industries, F.col("market_relevance")).alias("connection"), briefs.angle(problem, claim).alias("angle"))


@query(f"""WITH d AS (SELECT doc_id, 'theme-' || (doc_id % 40) AS slug, text FROM documents), m AS (SELECT item_id, 'theme-' || (item_id % 40) AS slug, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS loose FROM benchmark),
    p AS (SELECT d.doc_id, d.slug, k AS spot, CASE k WHEN 0 THEN m.text WHEN 1 THEN translate(substr(m.text, 4, 60), 'abcdefghij ', 'ABCDEFGHIJ' || chr(10)) WHEN 2 THEN d.text ELSE left(m.text, 20) END AS asked, m.item_id AS own FROM d JOIN (SELECT slug, min(item_id) AS item_id FROM m GROUP BY slug) f ON f.slug = d.slug JOIN m ON m.item_id = f.item_id CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k)),
    c AS (SELECT p.*, m.item_id, m.text AS passage, p.asked = m.text AS same, lower(trim(regexp_replace(p.asked, '\\s+', ' ', 'g'))) AS needle, m.loose FROM p JOIN m ON m.slug = p.slug),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, spot ORDER BY CASE WHEN same THEN 0 ELSE 1 END, CASE WHEN same THEN -item_id ELSE item_id END) AS rn FROM c WHERE same OR (length(needle) >= 40 AND (contains(loose, needle) OR (length(loose) >= 40 AND contains(needle, loose)))))
    SELECT doc_id AS brief_id, spot::INTEGER AS "at", 'point ' || spot AS point, own || CASE WHEN spot = 1 THEN '' ELSE ',' || own END AS evidence_source_ids, sha256(passage) AS evidence_passage, 'https://e.org/' || item_id AS evidence_url FROM r WHERE rn = 1""")
def k26_whitelisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer for each document: four points that cite, among other numbers and texts, the first benchmark item of its theme, with that item's passage as it is, in part with capitals and other white space, the document's text, or too little of it."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("slug", F.concat(F.lit("theme-"), F.col("item_id") % 40))
    first = items.groupBy("slug").agg(F.min_by(F.struct("item_id", F.col("text").alias("passage")), "item_id").alias("f")).select("slug", "f.*")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("theme-"), F.col("doc_id") % 40).alias("slug"), "text").join(first, "slug")
    asked = (F.col("passage"), F.translate(F.substring("passage", 4, 60), "abcdefghij ", "ABCDEFGHIJ\n"), F.col("text"), F.left("passage", F.lit(20)))
    number = F.col("item_id").cast("string")
    # ids as they come: other sources', texts, fractions, and once or twice the one that counts
    ids = [F.concat(F.lit("[999999, "), number, F.lit(', "'), number, F.lit('", 1.5, null, true'), F.lit("" if k == 1 else ", ") if k == 1 else F.concat(F.lit(", "), number, F.lit(".0")), F.lit("]")) for k in range(4)]
    points = [F.concat(F.lit(f'{{"point": " point {k} ", "evidence_source_ids": '), ids[k], F.lit(', "evidence_passage": '), F.get_json_object(F.to_json(F.struct(asked[k].alias("a"))), "$").substr(F.lit(6), F.length(F.to_json(F.struct(asked[k].alias("a")))) - 6), F.lit("}")) for k in range(4)]
    answer = F.concat(F.lit('Here it is: {"title": "t", "supporting_points": ['), F.concat_ws(", ", *points), F.lit(', "no point", 7, {"point": "without sources"}]} — done'))
    members = items.select("slug", F.col("item_id").alias("source_id"))
    passages = items.select("slug", F.col("item_id").alias("place"), F.col("item_id").alias("source_id"), F.col("text").alias("passage"), F.concat(F.lit("https://e.org/"), "item_id").alias("url"), F.lit("e.org").alias("domain"))
    out = whitelist.whitelist_points(docs.select(F.col("doc_id").alias("brief_id"), "slug", answer.alias("response")), members, passages)
    return out.select("brief_id", "at", "point", F.array_join("evidence_source_ids", ",").alias("evidence_source_ids"), F.sha2("evidence_passage", 256).alias("evidence_passage"), "evidence_url")


_COMPONENTS = tuple(lists.WEIGHTS)


@query(oracle(f"""WITH m AS (SELECT s.primary_theme AS slug, o.source_domain, o.published_at, s.* FROM m_signals s JOIN m_sources o ON o.source_id = s.source_id WHERE s.primary_theme IS NOT NULL), a AS (SELECT slug, {', '.join(f'avg({c}) AS {c}' for c in _COMPONENTS)}, count(DISTINCT source_domain) AS domains, count(DISTINCT source_id) AS sources, sum(passages)::BIGINT AS passages, count(published_at) AS dated FROM m GROUP BY slug)
    SELECT slug, round({' + '.join(f'least({c}, 1e1) * {w} * 1e1' for c, w in lists.WEIGHTS.items())}, 1) AS opportunity_score, round(least((least(domains / 3e0, 1e0) * 30 + least(passages / 4e0, 1e0) * 25 + evidence_strength / 1e1 * 30 + least(sources / 5e0, 1e0) * 15) * CASE WHEN domains <= 1 THEN 0.65e0 ELSE 1e0 END * CASE WHEN dated > 0 THEN 1e0 ELSE 0.9e0 END, 1e2), 1) AS confidence_score FROM a"""))
def k14_brief_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "m_signals").where("primary_theme is not null").withColumnRenamed("primary_theme", "slug")
    return briefs.score_brief(rows.join(view(spark, sf_dir, "m_sources").select("source_id", "source_domain", "published_at"), "source_id"))


_GUIDE = {"approved_example_count": 4, "median_sentence_words": 10, "median_paragraph_sentences": 3, "number_share": 60, "recurring_themes": ["That other thing", "Und so"], "coverage_warning": "few examples"}
_MEDIAN = "list_sort({0})[len({0}) // 2 + 1]"


@query(f"""WITH s AS (SELECT doc_id, text, lower(text) AS low, list_transform({_SENTENCES.format('text')}, lambda s: len(regexp_extract_all(s, '\\S+'))) AS lengths, list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda p: trim(p) <> '') AS blocks FROM documents),
    d AS (SELECT doc_id, {_MEDIAN.format('list(d)')} AS depth FROM (SELECT doc_id, greatest(len({_SENTENCES.format('b')}), 1) AS d FROM (SELECT doc_id, unnest(blocks) AS b FROM s)) GROUP BY doc_id),
    g AS (SELECT s.*, abs({_MEDIAN.format('lengths')} - 10) AS gap, abs(depth - 3) AS deep FROM s LEFT JOIN d ON d.doc_id = s.doc_id)
    SELECT doc_id, round(greatest(0e0, 1e2 - CASE WHEN gap > 8 THEN 20 WHEN gap > 4 THEN 8 ELSE 0 END - CASE WHEN deep > 2 THEN 12 ELSE 0 END - CASE WHEN list_bool_or(list_transform({_list(lists.BANNED)}, lambda b: contains(low, b))) THEN 25 ELSE 0 END
        - CASE WHEN regexp_matches(regexp_replace(text, '[^\\x00-\\x7f]', 'x', 'g'), '\\b[0-9]') THEN 0 ELSE 10 END - CASE WHEN contains(low, 'that') OR contains(low, 'und') THEN 0 ELSE 5 END) * 0.8e0, 1) AS score FROM g""")
def k22_voice_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", audit.voice_alignment(F.col("text"), _GUIDE).alias("score"))


_ASKED = f"regexp_replace({_LOOSE.format('quote')}, '^[\"''.,;: ]+|[\"''.,;: ]+$', '', 'g')"


@query(f"""WITH t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id), q AS (SELECT conv_id, CASE turn % 3 WHEN 0 THEN substr(text, 5, 40) WHEN 1 THEN 'nobody ever said ' || text ELSE left(text, 6) END AS quote FROM conversations)
    SELECT q.conv_id, count(*) FILTER (WHERE NOT (length({_ASKED}) >= 12 AND contains({_LOOSE.format('t')}, {_ASKED}))) AS dropped FROM q JOIN t ON t.conv_id = q.conv_id GROUP BY q.conv_id""")
def m10_dropped_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    whole = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    turn = F.col("turn") % 3
    quotes = lines.select("conv_id", F.when(turn == 0, F.substring("text", 5, 40)).when(turn == 1, F.concat(F.lit("nobody ever said "), "text")).otherwise(F.left("text", F.lit(6))).alias("quote"))
    return voice.drop_unverifiable(quotes, whole)


@query(oracle("""SELECT source_id, CASE WHEN primary_theme = 'Theme 1' THEN '[Inference] The first. Seen in ' || array_to_string(industries, ', ') || '.' WHEN primary_theme = 'Theme 2' THEN '[Inference] The second. Seen in ' || array_to_string(industries, ', ') || '.' ELSE '[Inference] No strong theme; review by hand.' END AS angle,
    '[Inference] Evidence for a point of view on ' || lower(coalesce(primary_theme, 'this topic')) || CASE WHEN industries[1] <> 'Cross-industry' THEN ' in ' || lower(industries[1]) ELSE '' END || '.' AS opportunity FROM m_signals"""))
def g13_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    themes = (Theme("t1", "Theme 1", (), description="The first."), Theme("t2", "Theme 2", (), description="The second."))
    rows = view(spark, sf_dir, "m_signals").withColumn("matches", F.array(F.struct(F.col("primary_theme").alias("name"))))
    return rows.select("source_id", extraction.angle(themes).alias("angle"), extraction.content_opportunity().alias("opportunity"))
