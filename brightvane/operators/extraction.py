"""Rule-based extraction of signals from sources (G-01 to G-20)."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import any_of, extract_numerical_claims, extract_quotes, hits, hits_in, holds, let, looks_like_prose, loose, normalize_unicode, prose_sentences, rounded, select_evidence_passages, sentences, word_count
from ..functions.urls import under
from . import scoring
from .taxonomy import Phrases, Theme, match_entities, match_industries, match_segment, match_themes, primary_theme, secondary_themes


@dataclass(frozen=True)
class Dictionaries:
    """What the extraction looks for: all of it data."""

    themes: Sequence[Theme]
    own: Mapping[str, str] = field(default_factory=dict)
    competitors: Mapping[str, str] = field(default_factory=dict)
    vendors: Mapping[str, str] = field(default_factory=dict)
    industries: Mapping[str, Sequence[str]] = field(default_factory=dict)
    segments: Mapping[str, Sequence[str]] = field(default_factory=dict)
    own_domains: Sequence[str] = ()
    speaker: Sequence[str] = ()


def pick_sentence(text: Column, markers: Sequence[str], bonus: Sequence[str] | Column = (), compose: bool = True, prose: Column | None = None) -> Column:
    """G-02: the sentence of 8 to 70 words with the most markers, the first of equals; null if none has any. The bonus words may be an array column; `prose` may bring the text's `prose_sentences`."""

    own = bonus if isinstance(bonus, Column) else F.array(*[F.lit(b) for b in bonus]).cast("array<string>")

    def scored(s: Column, i: Column, words_: Column) -> Column:
        def rated(x: Column) -> Column:
            score = x["found"] * 1.5 + hits_in(x["low"], words_) * 0.5 - x["n"] / 100.0
            return F.when(x["found"] > 0, let(score, lambda v: F.when((v > 0) & (looks_like_prose(s) if prose is None else F.lit(True)), F.struct(v.alias("score"), (-i).alias("at"), s.alias("s")))))

        # each is computed once, and only for a sentence of the right length
        with_low = lambda n: let(F.lower(s), lambda low: let(F.struct(low.alias("low"), hits(low, markers).alias("found"), n.alias("n")), rated))
        return let(word_count(s), lambda n: F.when((n >= 8) & (n <= 70), with_low(n)))

    # sentences and words are computed once, not for each sentence
    best = lambda v: F.array_max(F.filter(F.transform(v["s"], lambda s, i: scored(s, i, v["w"])), lambda x: x.isNotNull()))["s"]
    return let(F.struct((sentences(text, compose) if prose is None else prose).alias("s"), own.alias("w")), best)


def first_substantive(text: Column, compose: bool = True, prose: Column | None = None) -> Column:
    """G-03"""
    found = F.filter(sentences(text, compose), lambda s: word_count(s).between(10, 60) & looks_like_prose(s)) if prose is None else F.filter(prose, lambda s: word_count(s).between(10, 60))
    return F.get(found, F.lit(0))


def _score(c: Column) -> Column:
    # half a cent goes up, as for decimals, also where a sum comes out a little less
    return rounded(F.greatest(F.lit(0.0), F.least(c, F.lit(10.0))) + 1e-9, 2)


def _layer(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """df with more columns, each computed once: the optimizer may copy a column of a plain projection into every place that uses it, but not one that comes out of a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def extract(sources: DataFrame, known: Dictionaries, as_of: Column, compose: bool = True) -> DataFrame:
    """G-01: sources (source_id, title, cleaned_text, source_type, source_domain, published_at) to signals.

    Where sources have them, `is_promotional` and `first_party` mark vendors' own
    texts beside the own domains, and `status` or `summary_only` mark summaries.

    In four layers of columns - features, facts, components, scores - so that each
    is computed once. No shuffle: a row depends on itself only.
    """
    mark = lambda *names: functools.reduce(lambda a, b: a | b, [F.coalesce(F.col(n).cast("boolean"), F.lit(False)) for n in names if n in sources.columns], F.lit(False))
    own = under(F.coalesce("source_domain", F.lit("")), known.own_domains) | (F.col("source_type") == "first_party") | mark("is_promotional", "first_party")
    brief = mark("summary_only") | (F.coalesce("status", F.lit("")) == "summary_only" if "status" in sources.columns else F.lit(False))
    f = sources.select(own.alias("is_promotional"), brief.alias("is_summary_only"), "source_id", "source_type", "source_domain", "published_at", F.coalesce("title", F.lit("")).alias("title"), normalize_unicode(F.col("cleaned_text"), compose).alias("text"))
    compose = False  # texts are composed from here on
    f = f.withColumn("hay", F.concat("title", F.lit("\n"), "text")).drop("title")
    hay = F.col("hay")
    # the keywords of the themes that match a text, not of all: they are what makes a sentence one about it
    every = F.flatten(F.transform("matches", lambda m: m["keywords"]))
    f = _layer(f, {
        "matches": match_themes(hay, known.themes), "own": match_entities(hay, known.own) if known.own else F.array().cast("array<string>"),
        "competitors": match_entities(hay, known.competitors) if known.competitors else F.array().cast("array<string>"), "vendors": match_entities(hay, known.vendors) if known.vendors else F.array().cast("array<string>"),
        "industries": match_industries(hay, known.industries) if known.industries else F.array(F.lit("Cross-industry")),
        "customer_segment": match_segment(hay, known.segments) if known.segments else F.lit("Not specified in source"),
    })
    text, said = F.col("text"), F.col("said")
    facts = _layer(f.withColumn("notable_quotes", extract_quotes(text, 5)), {"said": prose_sentences(text, compose), "every": every, "plain": loose(text, compose)})
    every = F.col("every")
    facts = _layer(facts, {
        "primary_theme": primary_theme(F.col("matches")), "secondary_themes": secondary_themes(F.col("matches")),
        "customer_problem": pick_sentence(text, lists.PROBLEM_MARKERS, every, compose, said), "primary_claim": F.coalesce(pick_sentence(text, lists.CLAIM_MARKERS, every, compose, said), first_substantive(text, compose, said)),
        "supporting_evidence": select_evidence_passages(text, list(lists.EVIDENCE_WORDS), 5, priority=every, compose=compose, prose=said), "numerical_claims": extract_numerical_claims(text, 6, compose, said),
    })
    facts = enforce_verbatim(facts, compose)
    top = F.coalesce(F.get("matches", F.lit(0))["score"], F.lit(0.0))
    some = F.size("matches") > 0
    familiar = any_of(F.lower(hay), lists.FAMILIAR) | (some & (top < 3.0) & (F.size("matches") >= 3))
    p = Phrases(hay)
    yes = lambda c, v: F.when(c, F.lit(float(v))).otherwise(0.0)
    passages, quotes, numbers = F.size("supporting_evidence"), F.size("notable_quotes"), F.size("numerical_claims")
    core = F.arrays_overlap("industries", F.array(*map(F.lit, lists.CORE_INDUSTRIES)))
    market = (
        yes(F.size("own") > 0, 5) + yes(p.any(lists.AGENT), 2) + F.least(F.size("competitors") * 0.8, F.lit(2.0)) + yes(core, 2) + yes(p.any(lists.SMALL_BUSINESS), 1.5)
        + F.least(top / 6.0, F.lit(2.0)) + yes(p.any(lists.RESPONSE), 1.5)
    )
    n = word_count(text)
    comp = facts.withColumns({"is_familiar": familiar, "market_relevance": _score(market)})
    comp = comp.withColumns({
        "speaker_relevance": _score(F.col("market_relevance") * 0.5 + yes(p.any(known.speaker) if known.speaker else F.lit(False), 3.5) + yes(p.any(lists.FOUNDER), 1) + F.least(p.number(lists.OPERATOR) * 0.6, F.lit(3.0)) - yes(p.any(lists.DEEP_TECH), 2)),
        "evidence_strength": _score(
            2.0 + F.least(passages * 0.8, F.lit(3.0)) + F.least(quotes * 0.7, F.lit(2.0)) + F.least(numbers * 0.5, F.lit(2.0)) + F.when(n > 800, 1.0).when(n < 200, -1.5).otherwise(0.0)
            - yes(F.col("is_promotional"), 2.5) - yes(F.col("source_type") == "youtube", 1) - yes(F.col("source_type").startswith("manual"), 0.5) - yes(F.col("is_summary_only"), 2)
        ),
        "business_impact": _score(3.0 + F.least(p.number(lists.MONEY) * 0.8, F.lit(3.5)) + F.least(numbers * 0.4, F.lit(1.5)) + F.least(p.number(lists.SCALE) * 0.6, F.lit(1.2)) + yes(p.any(lists.MISSED), 1)),
        "novelty": _score(5.0 - yes(F.col("is_familiar"), 2.5) + F.least(numbers * 0.5, F.lit(2.0)) + yes(quotes > 0, 1) - yes(F.col("is_promotional"), 1.5) + yes(top >= 8, 1)),
        "freshness": scoring.freshness(F.col("published_at"), as_of),
    })
    score, breakdown = scoring.opportunity({k: F.col(k) for k in lists.WEIGHTS})
    risk, band, factors = scoring.risk(risk_factors())
    entities = F.concat("own", "competitors", "vendors")
    first = F.coalesce(F.get(entities, F.lit(0)), F.col("source_domain"))
    out = comp.withColumns({
        "opportunity_score": score, "score_breakdown": breakdown, "risk_score": risk, "risk_band": band, "risk_factors": factors, "recommended_format": recommended_format(),
        "primary_entity": first, "secondary_entities": F.slice(F.filter(entities, lambda x: x != first), 1, 8), "potential_angle": angle(known.themes), "content_opportunity": content_opportunity(), "verification_notes": F.concat("verification_notes", notes()),
    })
    return out.drop("text", "hay", "said", "every", "plain")


def enforce_verbatim(facts: DataFrame, compose: bool = True) -> DataFrame:
    """G-14: drops quotes, passages and figures that are not in the text, and notes how many."""
    text = F.col("text")
    told = []
    for column, part, what in (("notable_quotes", "quote", "quote(s)"), ("supporting_evidence", "passage", "evidence passage(s)"), ("numerical_claims", "context", "numerical claim(s)")):
        kept = _holding(column, part)(F.col("plain")) if "plain" in facts.columns else let(loose(text, compose), _holding(column, part))
        lost = F.size(F.col(column)) - F.size(kept)
        told.append(F.when(lost > 0, F.concat(lost.cast("string"), F.lit(f" proposed {what} discarded: not in the source."))))
        facts = facts.withColumn(f"_{column}", kept)
    facts = facts.withColumn("verification_notes", F.filter(F.array(*told), lambda x: x.isNotNull()))
    for column in ("notable_quotes", "supporting_evidence", "numerical_claims"):
        facts = facts.withColumn(column, F.col(f"_{column}")).drop(f"_{column}")
    return facts


def _holding(column: str, part: str):
    return lambda plain: F.filter(F.col(column), lambda x: holds(plain, x[part]))


def risk_factors() -> dict[str, Column]:
    """G-11: the factors that a signal's columns show, each with its reason."""
    text = lambda cond, *parts: F.when(cond, F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts]))
    return {
        "weak_sourcing": text(F.col("evidence_strength") < 4, "Evidence strength ", F.col("evidence_strength").cast("string"), "/10."),
        "unverified_numbers": text(F.size("numerical_claims") > 0, F.size("numerical_claims").cast("string"), " figure(s) from the source, none verified."),
        "competitor_claims": text(F.size("competitors") > 0, "Named competitors: ", F.array_join(F.slice("competitors", 1, 4), ", ")),
        "promotional_source": text(F.col("is_promotional"), F.coalesce("source_domain", F.lit("")), " content is vendor marketing."),
        "overused_narrative": text(F.col("is_familiar"), "A widely published storyline."),
        "missing_publication_date": text(F.col("published_at").isNull(), "No publication date in the source."),
    }


def recommended_format() -> Column:
    """G-10"""
    return (
        F.when((F.size("notable_quotes") > 0) & (F.col("evidence_strength") >= 6), "linkedin_post").when((F.size("numerical_claims") > 0) & (F.col("business_impact") >= 6), "short_form_video_outline")
        .when(F.col("evidence_strength") >= 7, "long_form_essay_outline").when(F.col("is_promotional"), "internal_briefing_note").otherwise("executive_talking_point")
    )


def angle(themes: Sequence[Theme]) -> Column:
    """G-13"""
    text = F.lit(None).cast("string")
    for t in reversed(themes):
        text = F.when(F.get("matches", F.lit(0))["name"] == t.name, F.lit(t.description)).otherwise(text)
    return F.coalesce(F.concat(F.lit("[Inference] "), text, F.lit(" Seen in "), F.array_join("industries", ", "), F.lit(".")), F.lit("[Inference] No strong theme; review by hand."))


def content_opportunity() -> Column:
    """G-13"""
    first = F.get("industries", F.lit(0))
    return F.concat(F.lit("[Inference] Evidence for a point of view on "), F.lower(F.coalesce("primary_theme", F.lit("this topic"))), F.when(first != "Cross-industry", F.concat(F.lit(" in "), F.lower(first))).otherwise(""), F.lit("."))


def notes() -> Column:
    """G-12"""
    figures = F.transform(F.slice("numerical_claims", 1, 4), lambda x: F.concat(F.lit("Verify the figure “"), x["value"], F.lit("” at a primary source.")))
    more = F.array(
        F.when(F.col("published_at").isNull(), F.lit("No publication date was found; confirm it before citing.")), F.when(F.col("is_promotional"), F.lit("A vendor page: evidence of positioning, not of the market.")),
        F.when(F.col("is_summary_only"), F.lit("Rests on the publisher's summary only; read the original.")), F.when(F.size("supporting_evidence") == 0, F.lit("No passage is verbatim; build no claim on this source alone.")),
        F.when(F.size("notable_quotes") > 0, F.lit("Confirm who said the quotes on the original page.")),
    )
    return F.concat(figures, F.filter(more, lambda x: x.isNotNull()))


def targets(sources: DataFrame, signals: DataFrame, limit: int | None = None, ids: Sequence[int] = ()) -> DataFrame:
    """G-18: sources to extract: of a usable status and without a signal, newest first; or those named."""
    if ids:
        return sources.where(F.col("source_id").isin(*ids))
    rows = sources.where(F.col("status").isin("fetched", "summary_only", "needs_review", "extracted")).join(signals.select("source_id"), "source_id", "left_anti")
    rows = rows.orderBy(F.desc_nulls_last("discovered_at"), "source_id")
    return rows.limit(limit) if limit else rows


def extractable(sources: DataFrame, least: int = 25, least_social: int = 12) -> Column:
    """G-19"""
    return word_count(sources["cleaned_text"]) >= F.when(sources["source_type"] == "social_public", least_social).otherwise(least)


def upsert_signals(old: DataFrame, new: DataFrame) -> DataFrame:
    """G-20: a source's new signal replaces its old one."""
    return old.join(new.select("source_id"), "source_id", "left_anti").unionByName(new, allowMissingColumns=True)


FORMATS = ("linkedin_post", "short_form_video_outline", "long_form_essay_outline", "executive_talking_point", "podcast_talking_points", "customer_email", "engagement_comment", "internal_briefing_note")
SCORES = ("market_relevance", "speaker_relevance", "novelty", "evidence_strength", "business_impact")
RAW_SIGNAL = (
    f"struct<{','.join(f'{k}:string' for k in SCORES)},primary_entity:string,secondary_entities:array<string>,industries:array<string>,customer_segment:string,primary_theme:string,secondary_themes:array<string>,customer_problem:string,primary_claim:string,"
    "supporting_evidence:array<struct<passage:string,supports:string>>,notable_quotes:array<struct<quote:string,speaker:string>>,numerical_claims:array<struct<value:string,context:string>>,is_familiar:boolean,is_promotional:boolean,"
    "content_opportunity:string,potential_angle:string,recommended_format:string,verification_notes:array<string>>"
)


def coerce_model_output(raw: Column, themes: Sequence[str], domain: Column | None = None) -> Column:
    """G-16: a language model's JSON made safe: fences stripped, scores clamped to 0..10, placeholders to null, unknown themes and formats dropped, lists cut.

    Nothing counts as verbatim yet: `enforce_verbatim` proves it. JSON that cannot be
    read gives the empty signal.
    """
    body = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), RAW_SIGNAL)
    text = lambda c: F.when(~c.isin("", "N/A", "n/a", "unknown", "TBD"), F.trim(c))
    some = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != "")
    known = lambda c: F.filter(some(c), lambda x: x.isin(*themes))
    # a note on what a passage supports is a sentence; names of fields are none
    note = lambda c: F.when((word_count(text(c)) >= 4) & ~text(c).rlike("^[a-z0-9_]+$"), text(c))
    items = lambda c, need, make: F.transform(F.filter(F.coalesce(c, F.array()), lambda x: x[need] != ""), make)
    industries, unproven = F.slice(some(body["industries"]), 1, 3), F.lit(False).alias("verified_verbatim")
    return F.struct(
        *[scoring.clamp10(body[k].try_cast("double")).alias(k) for k in SCORES], F.coalesce(text(body["primary_entity"]), domain if domain is not None else F.lit(None)).alias("primary_entity"), F.slice(some(body["secondary_entities"]), 1, 10).alias("secondary_entities"),
        F.when(F.size(industries) > 0, industries).otherwise(F.array(F.lit("Cross-industry"))).alias("industries"), text(body["customer_segment"]).alias("customer_segment"), F.when(text(body["primary_theme"]).isin(*themes), text(body["primary_theme"])).alias("primary_theme"),
        F.slice(known(body["secondary_themes"]), 1, 3).alias("secondary_themes"), text(body["customer_problem"]).alias("customer_problem"), text(body["primary_claim"]).alias("primary_claim"),
        items(body["supporting_evidence"], "passage", lambda x: F.struct(x["passage"].alias("passage"), note(x["supports"]).alias("supports"), unproven)).alias("supporting_evidence"),
        items(body["notable_quotes"], "quote", lambda x: F.struct(x["quote"].alias("quote"), text(x["speaker"]).alias("speaker"), unproven)).alias("notable_quotes"),
        items(body["numerical_claims"], "value", lambda x: F.struct(x["value"].alias("value"), F.coalesce(x["context"], F.lit("")).alias("context"), F.lit(True).alias("needs_verification"), unproven)).alias("numerical_claims"),
        F.coalesce(body["is_familiar"], F.lit(False)).alias("is_familiar"), F.coalesce(body["is_promotional"], F.lit(False)).alias("is_promotional"), text(body["content_opportunity"]).alias("content_opportunity"), text(body["potential_angle"]).alias("potential_angle"),
        F.when(text(body["recommended_format"]).isin(*FORMATS), text(body["recommended_format"])).otherwise("executive_talking_point").alias("recommended_format"), some(body["verification_notes"]).alias("verification_notes"),
    )
