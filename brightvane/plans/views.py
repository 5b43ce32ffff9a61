"""The model's tables, derived from the driver's by integer arithmetic, alike in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

#: 2024-01-31 00:00:00 UTC: the moment all queries look back from.
AS_OF = 1706659200
OWN_DOMAINS = ("tionble.example.com", "src3.example.com")


class _Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def ts(self, seconds: str) -> str:
        return f"timestamp_seconds({seconds})" if self.spark else f"make_timestamp(CAST(({seconds}) * 1000000 AS BIGINT))"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def struct(self, **fields: str) -> str:
        return f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())})" if self.spark else "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def first(self, items: str, n: str) -> str:
        return f"slice({items}, 1, CAST({n} AS INT))" if self.spark else f"({items})[1:{n}]"


def _views(d: _Dialect) -> dict[str, str]:
    score = lambda k: f"CAST(doc_id * {k} % 101 AS DOUBLE) / 10e0"
    url = "coalesce(p.url, 'https://' || d.source || '.example.com/' || d.doc_id)"
    # Spark cuts titles before it joins, so that queries without the text do not move it
    title, documents = ("d.title", "(SELECT *, left(text, 60) AS title FROM documents)") if d.spark else ("left(d.text, 60)", "documents")
    return {
        "m_sources": f"""SELECT d.doc_id AS source_id,
            CASE d.doc_id % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'web_search' WHEN 2 THEN 'first_party' WHEN 3 THEN 'social_public' ELSE 'youtube' END AS source_type,
            {url} AS source_url, lower(regexp_extract({url}, '^https?://(?:www[.])?([^/:?#]+)', 1)) AS source_domain,
            {title} AS title, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 'author ' || (d.doc_id % 11) END AS author,
            CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE {d.ts(f"{AS_OF} - (d.doc_id % 150) * 86400 - (d.doc_id % 24) * 3600")} END AS published_at,
            {d.ts(f"{AS_OF} - (d.doc_id % 20) * 86400 - (d.doc_id % 13) * 3600")} AS discovered_at,
            CASE d.doc_id % 10 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped_robots' WHEN 3 THEN 'summary_only' WHEN 4 THEN 'fetched' ELSE 'extracted' END AS status,
            'query ' || (d.doc_id % 17) AS search_query, d.text AS cleaned_text, d.n_chars AS n_chars
            FROM {documents} d LEFT JOIN pages p ON d.doc_id = p.page_id""",
        "m_signals": f"""SELECT doc_id AS source_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 'Theme ' || (doc_id % 12) END AS primary_theme,
            {d.array("'Theme ' || (doc_id * 5 % 12)", "'Extra Theme ' || (doc_id % 4)")} AS secondary_themes,
            {d.array("'industry ' || (doc_id % 4)", "'industry ' || (doc_id % 6)")} AS industries,
            {score(7)} AS market_relevance, {score(11)} AS speaker_relevance, {score(17)} AS evidence_strength, {score(23)} AS freshness, {score(13)} AS novelty, {score(19)} AS business_impact,
            CAST(doc_id * 29 % 1001 AS DOUBLE) / 10e0 AS opportunity_score, CAST(doc_id * 31 % 101 AS DOUBLE) AS risk_score,
            n_chars % 4 = 0 AS is_promotional, {d.array("'note ' || (doc_id % 5)", "'check ' || source", "'third'")} AS verification_notes, doc_id % 6 AS passages, doc_id % 4 AS quotes
            FROM documents WHERE n_chars >= 200""",
        "m_opportunities": f"""SELECT doc_id AS opportunity_id, 'theme-' || (doc_id % 12) AS theme_slug, 'Opportunity ' || doc_id AS title,
            CASE doc_id % 7 WHEN 0 THEN 'archived' WHEN 1 THEN 'drafting' WHEN 2 THEN 'approved' WHEN 3 THEN 'review' ELSE 'ready_for_brief' END AS status,
            CAST(doc_id * 37 % 1001 AS DOUBLE) / 10e0 AS opportunity_score, CAST(doc_id * 41 % 1001 AS DOUBLE) / 10e0 AS confidence_score, CAST(doc_id * 43 % 101 AS DOUBLE) AS risk_score,
            doc_id % 6 AS points, {d.array("doc_id", "doc_id + 3", "doc_id + 7", "doc_id + 11")} AS source_ids
            FROM documents""",
        "m_drafts": f"""SELECT doc_id AS draft_id, doc_id - doc_id % 25 + 3 AS opportunity_id, CASE doc_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending_review' END AS approval_status, text AS draft_text, doc_id % 5 AS unsupported, {d.ts(f"{AS_OF} - (doc_id % 30) * 3600")} AS created_at
            FROM documents""",
        "m_watchlist": f"""SELECT doc_id AS item_id, doc_id AS source_id, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority,
            CASE doc_id % 4 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'dismissed' ELSE 'unreviewed' END AS review_status, {d.ts(f"{AS_OF} - (doc_id % 50) * 3600")} AS discovered_at
            FROM documents""",
        # each document as a theme's facts, and as a brief
        "m_facts": f"""SELECT doc_id, 'Theme ' || (doc_id % 12) AS name, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'local shops lose calls. And more.' ELSE text END AS description, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'rising' ELSE 'stable' END AS trend_status,
            doc_id % 9 AS current_period_count, doc_id % 4 AS previous_period_count, CAST(doc_id % 7 AS DOUBLE) / 4e0 - 1e0 AS growth_rate, CAST(doc_id % 100 AS DOUBLE) / 10e0 AS average_market_relevance, doc_id % 8 + 1 AS sources, doc_id % 5 AS domains, doc_id % 3 AS promotional, doc_id % 2 AS own,
            CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {d.struct(title="text", domain="source || '.org'", day="'2024-01-' || (doc_id % 18 + 10)")} END AS newest, doc_id % 6 AS passages,
            {d.first(d.array(*[d.struct(rank=f"{k}", value=f"'{k}' || (doc_id % 90) || '%'", source_id=f"doc_id + {k}") for k in range(1, 5)]), "doc_id % 5")} AS numbers, {d.first(d.array(*[d.struct(rank=f"{k}", quote="text", source_id=f"doc_id + {k}") for k in range(1, 4)]), "doc_id % 4")} AS quotes,
            {d.first(d.array(d.struct(rank="1", problem="text", source_id="doc_id")), "doc_id % 2")} AS problems, {d.first(d.array("'Home services'", "'Cross-industry'", "'Retail'", "source"), "doc_id % 5")} AS industries FROM documents""",
        "m_briefs": f"""SELECT doc_id AS draft_id, doc_id % 50 AS opportunity_id, 'Title ' || left(text, 50) || '.' AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Hook ' || doc_id END AS hook, '[Inference — x] ' || text || ' Said most concretely: “y”' AS core_insight, '[Inference — z] ' || text AS founder_point_of_view, text AS why_now,
            'Ask the reader to ' || text AS suggested_call_to_action, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Fair.' END AS confidence_note, {d.first(d.array(*[d.struct(objection=f"'Objection {k} ' || source", response="left(text, 90)") for k in range(1, 5)]), "doc_id % 5")} AS potential_objections,
            {d.first(d.array(*[d.struct(item=f"'Item {k}'", why="left(text, 70)") for k in range(1, 9)]), "doc_id % 9")} AS verification_checklist, {d.array(d.struct(source_id="doc_id", passage="text"), d.struct(source_id="doc_id + 1", passage="'about 7 of them'"))} AS evidence,
            {d.first(d.array(
                d.struct(point="left(text, 120)", evidence_source_ids=d.array("doc_id", "doc_id + 1"), evidence_passage="left(text, 300)", evidence_url="'https://e.org/1'", evidence_domain="'e.org'"),
                d.struct(point="'A summary of what they say..'", evidence_source_ids=d.array("doc_id + 2"), evidence_passage="text", evidence_url="''", evidence_domain="NULL"),
                d.struct(point="''", evidence_source_ids=d.array("doc_id"), evidence_passage="left(text, 80)", evidence_url="'https://e.org/1'", evidence_domain="source"),
                d.struct(point="text", evidence_source_ids=d.array("doc_id", "doc_id"), evidence_passage="'another passage'", evidence_url="'https://e.org/2'", evidence_domain="'e.org'"),
                d.struct(point="text", evidence_source_ids=d.array("doc_id + 5"), evidence_passage="text", evidence_url="'https://e.org/3'", evidence_domain="'f.org'"),
            ), "doc_id % 6")} AS points FROM documents""",
        "m_voice": "SELECT conv_id AS example_id, turn, text, conv_id % 3 = 0 AS approved_for_voice_library FROM conversations",
        "m_runs": f"""SELECT event_id AS run_id, ts AS started_at, event_id % 60 AS stored, {d.array("event_type", "'late'")} AS errors FROM events""",
        "m_items": """SELECT event_id AS arrival, CASE event_type WHEN 'purchase' THEN 'manual' WHEN 'error' THEN 'first_party' WHEN 'click' THEN 'rss' WHEN 'view' THEN 'web_search' ELSE 'zine' END AS source_type,
            CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS published_at, 'https://host' || (user_id % 50) || '.example.com/a' || (event_id % 700) AS source_url, 'query ' || (user_id % 23) AS search_query
            FROM events""",
    }


def view(spark: SparkSession, sf_dir: str, name: str, **early: Column) -> DataFrame:
    """A model table on Spark. m_sources takes `early` columns of documents too, which are computed before these meet their pages, so that the text need not move."""
    text = _views(_Dialect(spark=True))[name].replace("d.n_chars AS n_chars", ", ".join(["d.n_chars AS n_chars", *(f"d.{c} AS {c}" for c in early)]))
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages", "events", "conversations") if t in text}
    if early:
        frames["documents"] = frames["documents"].withColumns(early)
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **frames)


def oracle(sql: str) -> str:
    """DuckDB SQL over the model tables it names."""
    views = _views(_Dialect(spark=False))
    used = [f"{name} AS ({text})" for name, text in views.items() if name in sql]
    lead = ", ".join(used)
    sql = sql.strip()
    return f"WITH {lead}, {sql[5:].lstrip()}" if sql.upper().startswith("WITH ") else f"WITH {lead} {sql}"
