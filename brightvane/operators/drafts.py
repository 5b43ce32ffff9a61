"""Briefs in words, and drafts from them (K-11, K-12, K-23, K-24). Texts are in `templates`; here are the rules that choose and fill them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import count_label, industry_phrase, truncate_words
from ..functions.text import capital, sentences, truncate, word_count
from . import audit
from . import templates as T

TYPES = (
    "linkedin_post", "short_form_video_outline", "long_form_essay_outline", "executive_talking_point",
    "podcast_discussion_point", "customer_story_angle", "engagement_comment", "internal_briefing_note",
)
#: A summary that only repeats the name of a field says nothing.
_FIELD_NAMES = ("primary_claim", "customer_problem", "supporting_evidence", "notable_quotes", "numerical_claims", "content_opportunity")
POINT = "struct<point:string,evidence_source_ids:array<bigint>,evidence_passage:string,evidence_url:string,evidence_domain:string>"


def _fill(text: str, **places: Column) -> Column:
    return T.fill(text, places, F.lit, lambda parts: F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _bare(c: Column) -> Column:
    """Without white space around, and without full stops at the end."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+\z", ""), r"\.+\z", "")


def brief_facts(evidence: DataFrame, members: DataFrame, themes: DataFrame, industries: DataFrame, own_domain: str = "") -> DataFrame:
    """What a brief of each theme says, a row a theme, from ranked evidence (`briefs.rank_evidence`) and members(slug, source_id, source_domain, title, published_at, is_promotional).

    A theme's members and evidence are bounded by `briefs.theme_evidence`, and of both
    only the first few are gathered.
    """
    ranked = lambda kind, most, *cols: F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("rank") <= most), F.struct("rank", *cols))))
    shown = evidence.groupBy("slug").agg(
        F.count_if(F.col("kind") == "passage").alias("passages"), ranked("number", 4, F.col("detail").alias("value"), "source_id").alias("numbers"),
        ranked("quote", 3, F.col("text").alias("quote"), "source_id").alias("quotes"), ranked("problem", 1, F.col("text").alias("problem"), "source_id").alias("problems"),
    )
    sold = F.coalesce("is_promotional", F.lit(False))
    dated = F.struct(F.unix_micros("published_at").alias("at"), -F.col("source_id"))
    who = members.groupBy("slug").agg(
        F.countDistinct("source_id").alias("sources"), F.countDistinct("source_domain").alias("domains"), F.count_if(sold).alias("promotional"), F.count_if(F.col("source_domain") == own_domain).alias("own"),
        F.max_by(F.struct("title", F.col("source_domain").alias("domain"), F.to_date("published_at").cast("string").alias("day")), F.when(F.col("published_at").isNotNull(), dated)).alias("newest"),
    )
    named = industries.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "industry"))), lambda x: x["industry"]).alias("industries"))
    base = themes.select("slug", "name", "description", "trend_status", "current_period_count", "previous_period_count", "growth_rate", "average_market_relevance")
    return base.join(who, "slug").join(shown, "slug", "left").join(named, "slug", "left")


def brief_fields(facts: DataFrame) -> DataFrame:
    """K-11: the twelve fields of each brief, added to rows of the columns of `brief_facts`."""
    n = lambda c: F.coalesce(c, F.lit(0))
    name, description = F.col("name"), F.coalesce(F.trim("description"), F.lit(""))
    sources, domains, passages = count_label(n("sources"), "public source"), count_label(n("domains"), "domain"), count_label(n("passages"), "passage")
    low = F.lower(name)
    three, two = industry_phrase(F.col("industries"), 3), industry_phrase(F.col("industries"), 2)
    within = lambda phrase: F.when(phrase != "", F.concat(F.lit(" in "), phrase)).otherwise("")
    claim = F.regexp_replace(F.substring_index(_bare(F.when(description != "", description).otherwise(name)), ". ", 1), r"\.+\z", "")
    cut = truncate_words(claim, 14)
    problem = F.get("problems", F.lit(0))
    newest = F.col("newest")
    growth = F.concat(F.lit(" ("), F.when(F.col("growth_rate") >= 0, "+").otherwise("-"), F.round(F.abs(F.col("growth_rate")) * 100).cast("int").cast("string"), F.lit("%)."))
    pair = lambda kind, texts, **places: F.struct(_fill(texts[0], **places).alias(kind[0]), _fill(texts[1], **places).alias(kind[1]))
    objection, check = ("objection", "response"), ("item", "why")
    none = lambda kind: F.array().cast(f"array<struct<{kind[0]}:string,{kind[1]}:string>>")
    given = {"domains": domains, "sources": sources, "promotional": n("promotional").cast("string"), "promotional_label": count_label(n("promotional"), "marketing source")}
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return facts.withColumns({
        "title": F.when(cut != "", F.concat(capital(cut), F.substr(cut, F.lit(2)))).otherwise(name),
        "core_insight": F.concat(
            _fill(T.INSIGHT, about=F.when(description != "", F.concat(_bare(description), F.lit(". "))).otherwise(""), sources=sources, domains=domains, scope=within(three), passages=passages, independent=n("sources") - n("promotional")),
            F.when(problem.isNotNull(), _fill(T.INSIGHT_PROBLEM, problem=truncate(problem["problem"], 260), problem_source=problem["source_id"])).otherwise(""),
        ),
        "why_now": F.concat(
            _fill(T.WHY_NOW, status=F.coalesce("trend_status", F.lit("unknown")), current=count_label(n("current_period_count"), "source"), previous=n("previous_period_count")), F.when(n("previous_period_count") > 0, growth).otherwise("."),
            F.when(newest.isNotNull(), _fill(T.WHY_NOW_NEWEST, newest_title=truncate(newest["title"], 90), newest_domain=newest["domain"], newest_date=newest["day"])).otherwise(T.WHY_NOW_UNDATED), F.when(n("domains") < 2, T.WHY_NOW_ALONE).otherwise(""),
        ),
        "why_company": F.concat(
            _fill(T.WHY_COMPANY, name=low, relevance=F.round(n("average_market_relevance"), 1)), F.when(three != "", _fill(T.WHY_COMPANY_INDUSTRIES, three_industries=three)).otherwise(""), F.when(n("own") > 0, _fill(T.WHY_COMPANY_OWN, own=count_label(n("own"), "source"))).otherwise(""),
        ),
        "why_speaker": _fill(T.WHY_SPEAKER, in_two=within(two)), "target_audience": _fill(T.AUDIENCE, in_three=within(three)),
        "founder_point_of_view": _fill(T.VIEW, description=description, domains=domains, sources=sources),
        "potential_objections": F.concat(
            F.array(pair(objection, T.OBJECTION_VENDOR, **given)), F.when(n("domains") < 3, F.array(pair(objection, T.OBJECTION_THIN, **given))).otherwise(F.array(pair(objection, T.OBJECTION_WIDE, **given))),
            F.when(some("numbers"), F.array(pair(objection, T.OBJECTION_NUMBERS))).otherwise(none(objection)),
        ),
        "recommended_format": F.when(some("quotes") & (n("domains") >= 3), "linkedin_post").when(some("numbers"), "short_form_video_outline").when(n("sources") >= 6, "long_form_essay_outline").otherwise("executive_talking_point"),
        "suggested_call_to_action": _fill(T.CALL, name=low),
        "verification_checklist": F.concat(
            F.array(pair(check, T.CHECK_PAGES), pair(check, T.CHECK_DATES)), F.coalesce(F.transform("numbers", lambda x: pair(check, T.CHECK_NUMBER, value=x["value"], source=x["source_id"])), none(check)),
            F.coalesce(F.transform("quotes", lambda x: pair(check, T.CHECK_QUOTE, quote=truncate(x["quote"], 90))), none(check)), F.when(n("promotional") > 0, F.array(pair(check, T.CHECK_SOLD, **given))).otherwise(none(check)), F.array(pair(check, T.CHECK_VOICE)),
        ),
        "confidence_note": F.when(n("domains") <= 1, T.CONFIDENCE_WEAK).when(n("passages") < 3, _fill(T.CONFIDENCE_THIN, passages=passages)).otherwise(_fill(T.CONFIDENCE_FAIR, passages=passages, domains=domains, sources=sources)),
    })


def point_text(supports: Column, passage: Column) -> Column:
    """K-12: a model's summary of a point if it is one, of four words or more and no name of a field; else its passage, cut."""
    said = F.trim(F.coalesce(supports, F.lit("")))
    usable = (word_count(said) >= 4) & ~said.rlike(r"^[a-z0-9_]+$") & ~F.replace(F.lower(said), F.lit(" "), F.lit("_")).isin(*_FIELD_NAMES)
    return F.when(usable, said).otherwise(truncate(passage, 200))


def _verbatim(p: Column) -> Column:
    """Whether a point only repeats its passage: then it is quoted, not told."""
    point, passage = _bare(p["point"]), _bare(p["evidence_passage"])
    return (point != "") & (passage != "") & F.contains(F.lower(passage), F.lower(F.left(point, F.lit(60))))


def _body(p: Column, n: int) -> Column:
    own = F.when(F.trim(F.coalesce(p["point"], F.lit(""))) != "", p["point"]).otherwise(p["evidence_passage"])
    return _bare(truncate(F.concat(_bare(own), F.lit(".")), n))


def _ids(p: Column) -> Column:
    return F.array_join(F.transform(p["evidence_source_ids"], lambda i: F.concat(F.lit("#"), i.cast("string"))), ", ")


def _plain(c: Column) -> Column:
    """Without marks of inference."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\[Inference[^\]]*\]\s*", "")


def draft_text(kind: str) -> Column:
    """K-23: the draft of a type from a brief's columns: its fields, `hook`, `points` and `evidence`, an array of (source_id, passage)."""
    if kind not in TYPES:
        raise ValueError(kind)
    points = lambda most: F.slice(F.coalesce("points", F.array().cast(f"array<{POINT}>")), 1, most)
    lines = lambda items, sep="\n": F.array_join(items, sep)
    title, hook, ask = F.coalesce("title", F.lit("")), F.coalesce("hook", "title", F.lit("")), F.coalesce("suggested_call_to_action", F.lit(""))
    insight, view = _plain(F.col("core_insight")), _plain(F.col("founder_point_of_view"))
    domain = lambda p: F.coalesce(p["evidence_domain"], F.lit("source"))
    passage = lambda p, n: truncate(p["evidence_passage"], n)
    first = lambda p: F.coalesce(F.get(p["evidence_source_ids"], F.lit(0)).cast("string"), F.lit("?"))
    if kind == "linkedin_post":
        told = F.transform(points(3), lambda p: F.when(_verbatim(p), _fill(T.POINT_SAID, body=_body(p, 190), domain=domain(p), ids=_ids(p))).otherwise(_fill(T.POINT_SUMMARY, body=_body(p, 190), ids=_ids(p))))
        links = F.array_distinct(F.flatten(F.transform(F.filter(points(3), lambda p: F.coalesce(p["evidence_url"], F.lit("")) != ""), lambda p: F.transform(p["evidence_source_ids"], lambda i: F.concat(F.lit("#"), i.cast("string"), F.lit(" "), p["evidence_url"])))))
        mine = F.array_join(F.slice(sentences(view, False), 1, 2), " ")
        own = F.when(mine != "", F.concat(F.lit("My view: "), truncate(mine, 300), F.lit("\n\n"))).otherwise("")
        bare = F.regexp_replace(ask, "^Ask the reader to ", "")
        call = truncate(F.concat(capital(bare), F.substr(bare, F.lit(2))), 200)
        return F.trim(_fill(T.POST, hook=hook, insight=truncate(F.trim(F.substring_index(insight, T.INSIGHT_PROBLEM.split("“")[0], 1)), 320), points=lines(told), view=own, ask=call, links=lines(links)))
    if kind == "short_form_video_outline":
        said = lambda p: F.when(_verbatim(p), _fill(T.VIDEO_SAID, domain=domain(p), body=_body(p, 160))).otherwise(F.concat(_body(p, 160), F.lit(".")))
        beats = F.transform(points(3), lambda p, i: _fill(T.VIDEO_BEAT, number=i + 1, said=said(p), passage=passage(p, 90), ids=_ids(p), url=p["evidence_url"]))
        spoken = F.aggregate(points(3), F.lit(40), lambda a, p: a + word_count(F.coalesce(p["point"], p["evidence_passage"])))
        return _fill(T.VIDEO, title=title, hook=hook, beats=F.when(F.size(points(3)) > 0, lines(beats)).otherwise(T.NO_POINTS), ask=truncate(ask, 180), spoken=spoken)
    if kind == "long_form_essay_outline":
        said = lambda p: F.when(_verbatim(p), _fill(T.ESSAY_SAID, domain=domain(p), body=_body(p, 120))).otherwise(_body(p, 120))
        parts = F.transform(points(5), lambda p, i: _fill(T.ESSAY_SECTION, number=i + 2, said=said(p), ids=_ids(p), passage=passage(p, 220), url=p["evidence_url"]))
        n = F.size(points(5))
        against = lines(F.transform(F.slice("potential_objections", 1, 3), lambda o: _fill(T.ESSAY_OBJECTION, objection=o["objection"], response=o["response"])))
        return _fill(T.ESSAY, title=title, view=truncate(view, 400), why_now=truncate(F.col("why_now"), 300), sections=lines(parts, ""), objections_number=n + 2, objections=against, close_number=n + 3, ask=truncate(ask, 220), missing=F.when(n < 4, T.ESSAY_THIN).otherwise(T.ESSAY_FULL))
    if kind == "executive_talking_point":
        facts = F.transform(points(3), lambda p: _fill(T.TALK_FACT, ids=_ids(p), passage=passage(p, 200)))
        o = F.get("potential_objections", F.lit(0))
        number = F.get(F.filter("evidence", lambda e: e["passage"].rlike(r"\d")), F.lit(0))
        figure = F.when(number.isNotNull(), _fill(T.TALK_FIGURE, passage=truncate(number["passage"], 160), source=number["source_id"])).otherwise(T.TALK_NO_FIGURE)
        return _fill(T.TALK, title=title, insight=truncate(insight, 480), facts=lines(facts), objection=F.coalesce(o["objection"], F.lit("None recorded.")), response=o["response"], figure=figure)
    if kind == "podcast_discussion_point":
        facts = F.transform(points(2), lambda p: _fill(T.PODCAST_FACT, passage=passage(p, 220), domain=p["evidence_domain"], source=first(p)))
        return _fill(T.PODCAST, title=title, question=_bare(title), view=truncate(view, 700), facts=lines(facts))
    if kind == "customer_story_angle":
        return _fill(T.STORY, title=title, insight=truncate(F.col("core_insight"), 300))
    if kind == "engagement_comment":
        p = F.get(points(1), F.lit(0))
        return _fill(T.COMMENT, title=title, insight=truncate(insight, 240), passage=F.when(p.isNotNull(), passage(p, 160)).otherwise(T.NO_POINTS), source=first(p), url=p["evidence_url"])
    facts = F.transform(points(5), lambda p: _fill(T.NOTE_FACT, ids=_ids(p), passage=passage(p, 220)))
    checks = F.transform(F.slice("verification_checklist", 1, 6), lambda c: _fill(T.NOTE_CHECK, item=c["item"], why=c["why"]))
    return _fill(T.NOTE, title=title, facts=lines(facts), why_now=truncate(F.col("why_now"), 500), checks=lines(checks), ask=truncate(ask, 300), confidence=F.coalesce("confidence_note", F.lit("Not stated.")))


def write(briefs: DataFrame, kind: str) -> DataFrame:
    """K-23: briefs with content_type, draft_text and the sources cited; an unknown type is written as a talking point."""
    kind = kind if kind in TYPES else "executive_talking_point"
    cited = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("points", F.array().cast(f"array<{POINT}>")), lambda p: F.coalesce(p["evidence_source_ids"], F.array().cast("array<bigint>"))))))
    return briefs.withColumns({"content_type": F.lit(kind), "draft_text": draft_text(kind), "cited_source_ids": cited})


def generate(briefs: DataFrame, kind: str, guide: dict, statuses: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """K-24: drafts of briefs(draft_id, opportunity_id, fields, points, evidence) with the scores of their audit against their own evidence and of their voice, pending review; and the opportunities' statuses, those just briefed now `drafting`."""
    drafts = write(briefs, kind)
    own = drafts.select("draft_id", F.posexplode("evidence").alias("passage_id", "e")).select("draft_id", "passage_id", "e.passage")
    scores = audit.audit_scores(audit.audit_sentences(drafts, own)).select("draft_id", "evidence_score")
    rows = drafts.join(scores, "draft_id", "left").withColumns({"evidence_score": F.coalesce("evidence_score", F.lit(0.0)), "voice_score": audit.voice_alignment(F.col("draft_text"), guide), "approval_status": F.lit("pending_review")})
    if statuses is None:
        return rows, None
    begun = briefs.select("opportunity_id").distinct().withColumn("_begun", F.lit(True))
    moved = statuses.join(begun, "opportunity_id", "left").withColumn("status", F.when(F.col("_begun") & F.col("status").isin("new", "ready_for_brief", "research_needed"), "drafting").otherwise(F.col("status"))).drop("_begun")
    return rows, moved

