"""Briefs and drafts by rule, and what of a model's answer stands."""

import json

import pytest
from pyspark.sql import functions as F

from brightvane.functions import text
from brightvane.operators import briefs, drafts, templates, whitelist

PASSAGE = "a passage that is long enough to be recognised in another text by its words"
ANSWER = {
    "title": "", "supporting_points": [
        {"point": " p1 ", "evidence_source_ids": [2, "1", 1.0, 9, True, 1.5, None], "evidence_passage": PASSAGE}, {"point": "p2", "evidence_source_ids": [1], "evidence_passage": "A  passage that is long enough\nto be RECOGNISED in"},
        "x", {"point": "p3", "evidence_source_ids": [9], "evidence_passage": PASSAGE}, {"point": "p4", "evidence_source_ids": 5, "evidence_passage": PASSAGE}, {"evidence_source_ids": [1], "evidence_passage": "short"}, {"point": "p6", "evidence_source_ids": [2], "evidence_passage": None},
    ],
    "potential_objections": [{"objection": "o"}, "no"], "risk_notes": ["a", 5, None], "verification_checklist": {"a": 1},
}


@pytest.fixture
def evidence(spark):
    members = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2), ("t", 9)], "slug string, source_id long")
    passages = spark.createDataFrame([("s", 1, 1, PASSAGE, "u1", "d1"), ("s", 2, 7, PASSAGE + " and more", "u2", "d2"), ("s", 3, 2, "", "u", "d"), ("t", 1, 9, "nothing like it", "u", "d")], "slug string, place int, source_id long, passage string, url string, domain string")
    return members, passages


def test_points_need_a_member_and_a_stored_passage(spark, evidence):
    responses = spark.createDataFrame([(1, "s", "Sure: " + json.dumps(ANSWER) + " done"), (2, "s", "no json"), (3, "t", json.dumps(ANSWER)), (4, "s", json.dumps({"supporting_points": {"a": {}}})), (5, "s", None)], "brief_id long, slug string, response string")
    got = sorted(map(tuple, whitelist.whitelist_points(responses, *evidence).collect()))
    assert got == [(1, 0, "p1", [2, 1], PASSAGE, "u1", "d1"), (1, 1, "p2", [1], PASSAGE, "u1", "d1")]
    # the second passage holds the second point as well, but its source is not cited
    assert whitelist.whitelist_points(responses, evidence[0].where("source_id = 2"), evidence[1], cited_only=True).count() == 0
    (brief,) = whitelist.whitelist_briefs(responses, *evidence, spark.createDataFrame([("s", "Name")], "slug string, name string")).collect()
    assert (brief.brief_id, brief.title, brief.recommended_format, brief.risk_notes) == (1, "Name", "linkedin_post", ["a", "5"])
    assert [p.point for p in brief.supporting_points] == ["p1", "p2"] and [o.objection for o in brief.potential_objections] == ["o"] and brief.verification_checklist == []
    assert whitelist.whitelist_points(responses.limit(0), *evidence).count() == 0


def test_drafts_and_items_of_a_model(spark):
    said = [(1, json.dumps({"draft_text": "w " * 30, "claims_used": [{"source_id": 3}, {"source_id": 1}, {"source_id": 3}, {"source_id": "2"}, 7], "unsupported_claims": ["q"]})), (2, json.dumps({"draft_text": "w " * 29})), (3, json.dumps({"draft_text": "w " * 31, "claims_used": "none"}))]
    got = {r.draft_id: (r.cited_source_ids, r.unsupported_claims) for r in whitelist.whitelist_drafts(spark.createDataFrame(said, "draft_id long, response string")).collect()}
    assert got == {1: ([1, 3], ["q"]), 3: ([], [])}
    answer = spark.createDataFrame([(1, json.dumps({"watchlist": [{"source_id": 1, "angle": "a"}, {"source_id": 1, "angle": "b"}, {"source_id": 4}, 3]}))], "run_id long, response string")
    assert [tuple(r) for r in whitelist.whitelist_items(answer, spark.createDataFrame([(1, 1), (2, 4)], "run_id long, source_id long")).collect()] == [(1, 1, None, "b", None)]


def test_a_capital_is_one_character(spark):
    """As in SQL: ß becomes ẞ, not SS, which has one letter too many."""
    facts = facts_of(spark).withColumn("description", F.lit("ßheit fehlt. Mehr."))
    assert drafts.brief_fields(facts).first().title == "ẞheit fehlt"
    got = spark.createDataFrame([("ßa",), ("éa",), ("1a",), ("ŉa",), ("",)], "t string").select(text.capital(F.col("t"))).collect()
    assert [r[0] for r in got] == ["ẞ", "É", "1", "ŉ", ""]


def facts_of(spark):
    evidence = [("s", 1, "e.org", False, "passage", "Calls go unanswered at 40 shops.", None, 1), ("s", 2, "f.org", True, "passage", "More text.", None, 2), ("s", 1, "e.org", False, "number", "context", "41%", 1), ("s", 2, "f.org", True, "quote", "We lost calls", "Ann", 1), ("s", 1, "e.org", False, "problem", "nobody answers", None, 1)]
    ranked = spark.createDataFrame(evidence, "slug string, source_id long, source_domain string, is_promotional boolean, kind string, text string, detail string, rank int")
    members = spark.createDataFrame([("s", 1, "e.org", "Older", "2024-01-02 00:00:00", False), ("s", 2, "f.org", "Newer", "2024-01-09 00:00:00", True), ("s", 3, "own.org", "Undated", None, None)], "slug string, source_id long, source_domain string, title string, at string, is_promotional boolean").withColumn("published_at", F.col("at").cast("timestamp"))
    themes = spark.createDataFrame([("s", "Missed calls", "shops lose calls. Second sentence.", "rising", 3, 1, 2.0, 7.25)], "slug string, name string, description string, trend_status string, current_period_count long, previous_period_count long, growth_rate double, average_market_relevance double")
    industries = spark.createDataFrame([("s", "Retail", 2), ("s", "Home services", 1)], "slug string, industry string, rank int")
    return drafts.brief_facts(ranked, members, themes, industries, "own.org")


def test_a_brief_from_evidence(spark):
    (b,) = drafts.brief_fields(facts_of(spark)).collect()
    assert (b.sources, b.domains, b.promotional, b.own, b.passages, b.newest.title, b.newest.day) == (3, 3, 1, 1, 2, "Newer", "2024-01-09")
    assert b.title == "Shops lose calls" and b.recommended_format == "linkedin_post"
    assert b.core_insight == "shops lose calls. Second sentence. The theme appears in 3 public sources on 3 domains in home services and retail. 2 passages of it could be checked word for word, and 2 of the sources have nothing to sell. Said most concretely: “nobody answers” (source #1)."
    assert b.why_now == "The trend is **rising**: 3 sources this period, 1 in the one before (+200%). Latest dated source: “Newer” (f.org, 2024-01-09)."
    assert len(b.potential_objections) == 3 and [c.item for c in b.verification_checklist][2:5] == ["Find a primary source for “41%” (now from source #1).", "Check who said “We lost calls”.", "Decide whether 1 marketing source may be cited."]
    assert b.confidence_note == templates.CONFIDENCE_THIN.format(passages="2 passages")


def test_drafts_with_their_scores(spark):
    points = [("Calls go unanswered at 40 shops.", [1], "Calls go unanswered at 40 shops. And more.", "https://e.org/1", "e.org"), ("A summary in own words here.", [2, 1], "More text.", None, None)]
    base = drafts.brief_fields(facts_of(spark)).crossJoin(spark.createDataFrame([(7, 70, None, points, [(1, "Calls go unanswered at 40 shops. And more.")])], f"draft_id long, opportunity_id long, hook string, points array<{drafts.POINT}>, evidence array<struct<source_id:long,passage:string>>"))
    for kind in drafts.TYPES:
        (row,) = drafts.write(base, kind).collect()
        assert row.content_type == kind and "{" not in row.draft_text and row.cited_source_ids == [1, 2]
    post = drafts.write(base, "linkedin_post").first().draft_text
    assert '— "Calls go unanswered at 40 shops" — e.org [#1]' in post and "— A summary in own words here. [#2, #1]" in post and post.endswith("#1 https://e.org/1") and "[Inference" not in post
    assert drafts.write(base, "no such type").first().content_type == "executive_talking_point"
    statuses = spark.createDataFrame([(70, "ready_for_brief"), (71, "ready_for_brief"), (72, "approved")], "opportunity_id long, status string")
    rows, moved = drafts.generate(base, "linkedin_post", {}, statuses)
    (row,) = rows.collect()
    assert 0 < row.evidence_score <= 100 and row.voice_score == 0.0 and row.approval_status == "pending_review"
    assert {r.opportunity_id: r.status for r in moved.collect()} == {70: "drafting", 71: "ready_for_brief", 72: "approved"}


def test_point_texts(spark):
    rows = [("primary claim", "p"), ("a summary of four", "p"), ("three words only", "long " * 60), ("customer_problem_statement_text", "p"), ("Supporting Evidence", "p"), (None, "p")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, p string").select(drafts.point_text(F.col("s"), F.col("p"))).collect()]
    assert got[0] == got[3] == got[4] == got[5] == "p" and got[1] == "a summary of four" and got[2].endswith(" …") and len(got[2]) <= 202


def test_connection_and_angle(spark):
    rows = spark.createDataFrame([(["Retail", "Automotive", "x"], 1.0, " ", "c"), (["x"], 7.0, None, None), (None, None, "p", "c")], "i array<string>, r double, p string, c string")
    got = [tuple(r) for r in rows.select(briefs.connection(F.col("i"), F.col("r")), briefs.angle(F.col("p"), F.col("c"))).collect()]
    assert got[0] == ("Within the served industries: Automotive, Retail.", templates.ANGLE_CLAIM.format(claim="c")) and got[1] == (templates.CONNECTION_CATEGORY, templates.ANGLE_NONE) and got[2] == (templates.CONNECTION_THEME, templates.ANGLE_CLAIM.format(claim="p"))
