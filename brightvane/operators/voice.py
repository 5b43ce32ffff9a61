"""Stylometry of voice examples (M-01 to M-06) and meeting notes (M-07 to M-10)."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import _BLANKS, any_of, cut_sentences, is_verbatim, let, normalize_unicode, one_line, rounded, sentences, word_count, words
from ..shared import settle
from .taxonomy import Theme, match_themes


def split_paragraphs(c: Column) -> Column:
    """M-02: blocks between blank lines, or lines where there is one block only."""
    full = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    blocks = full(F.split(c, r"\n\s*\n"))
    return F.when(F.size(blocks) > 1, blocks).otherwise(full(F.split(c, "\n")))


def median(values: Column) -> Column:
    """The middle of an array of numbers, or the mean of the two middle ones."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(ordered, i.cast("int")).cast("double")
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def _begun(pattern: str, first: str) -> str:
    """A pattern that begins with a border, begun with what is behind it: that is found faster than borders."""
    return f"{first}(?<=\\b{first})" + pattern.removeprefix("\\b" + first)


def _spelled(pattern: str) -> list[str]:
    """The phrases that a pattern of alternatives stands for."""
    parts = re.split(r"\((.*?)\)", pattern.replace("\\?", "?"))
    return ["".join(x) for x in itertools.product(*[p.split("|") if i % 2 else [p] for i, p in enumerate(parts)])]


_FIGURE, _PERSON = _begun(lists.FIGURE, r"\d"), "(?U)" + _begun(r"\b[imow](?:(?<=i)|(?<=w)e|(?<=o)ur|(?<=m)y)\b", "[imow]")
_CALLS = tuple(phrase for p in lists.CALLS for phrase in _spelled(p))
#: Each of them holds one of these.
_CALL_WORDS = ("you", "know", "curious", "agree?", "tell", "drop", "reply", "thoughts")
#: Each contrast, and the letters of the two words that it is made of.
_CONTRAST = tuple(zip([_begun(p, p[2]) for p in lists.CONTRAST], (("isn", "it"), ("not", "but"), ("less", "more"), ("don", "do")), strict=True))
#: A word of nine characters or more between the signs at its ends.
_LONG_WORD = r"(?U)[^\s.,!?;:]\S{7,}[^\s.,!?;:]"


def _contrasts(low: Column, patterns: bool = True) -> Column:
    """Whether lower-cased text argues by contrast; the words are looked for before the patterns, or alone."""
    out = F.lit(False)
    for pattern, (first, second) in _CONTRAST:
        both = F.contains(low, F.lit(first)) & F.contains(low, F.lit(second))
        out = out | (both & low.rlike("(?U)" + pattern) if patterns else both)
    return out


def _paragraph_sentences(p: Column) -> Column:
    """How many sentences a paragraph has; of one that is a single line they are its parts of three characters or more."""
    parts = F.filter(F.split(p, lists.SENTENCE_BREAK), lambda x: (F.length(x) > 20) | (F.length(F.btrim(x, F.lit(_BLANKS))) > 2))
    return F.when(F.contains(p, F.lit("\n")), F.size(sentences(p, False))).otherwise(F.size(parts))


def analyse(examples: DataFrame, themes: Sequence[Theme] = (), compose: bool = True) -> DataFrame:
    """M-01: 28 measures of each example(example_id, text)."""
    text = F.trim(normalize_unicode(F.col("text"), compose))
    # asked of the text as it came: a condition on the composed one would compose it twice
    some = F.col("text").rlike("[^ \\u00a0\\u2000-\\u200a\\u202f\\u205f\\u3000]" if compose else "[^ \\u00a0]")
    rows = examples.where(some).withColumn("text", text)
    rows = rows.withColumns({"_line": one_line(F.col("text"), False), "_p": split_paragraphs(F.col("text")), "_w": words(F.col("text")), "_low": F.lower("text")})
    rows = rows.withColumns({"_s": cut_sentences(F.col("_line")), "_contrast": _contrasts(F.col("_low"), False), "_call": any_of(F.col("_low"), _CALL_WORDS), "_figures": F.regexp_count("text", F.lit(_FIGURE))})
    rows = rows.withColumns({"_n": F.when(F.size("_s") > 0, F.transform("_s", word_count)).otherwise(F.array(F.lit(0))), "_d": F.when(F.size("_p") == 1, F.array(F.greatest(F.size("_s"), F.lit(1)))).otherwise(F.transform("_p", lambda p: F.greatest(_paragraph_sentences(p), F.lit(1))))})
    line = F.substring_index(F.coalesce(F.get("_p", F.lit(0)), F.lit("")), "\n", 1)
    rows = rows.withColumn("hook", F.when(word_count(line) <= 30, line).otherwise(F.coalesce(F.get("_s", F.lit(0)), F.lit(""))))
    share = lambda a, cond: F.size(F.filter(a, cond)) / F.greatest(F.size(a), F.lit(1))
    # sentences are looked through only where their text holds what is looked for
    picked = lambda some, cond: F.slice(F.when(some, F.filter("_s", cond)).otherwise(F.array().cast("array<string>")), 1, 2)
    return rows.select(
        "example_id", F.size("_w").alias("word_count"), F.size("_s").alias("sentence_count"), F.size("_p").alias("paragraph_count"),
        rounded(median(F.col("_n")), 1).alias("median_sentence_words"), rounded(F.aggregate("_n", F.lit(0), lambda a, x: a + x) / F.size("_n"), 1).alias("mean_sentence_words"), F.array_max("_n").alias("max_sentence_words"),
        rounded(median(F.col("_d")), 1).alias("median_paragraph_sentences"), rounded(share(F.col("_n"), lambda n: n <= 12), 2).alias("short_sentence_share"), F.exists("_n", lambda n: n <= 5).alias("uses_fragments"),
        "hook", word_count(F.col("hook")).alias("hook_words"), F.trim("hook").endswith("?").alias("hook_is_question"), F.col("hook").rlike(_FIGURE).alias("hook_has_number"),
        F.col("_figures").alias("number_count"), rounded(F.col("_figures") / F.greatest(F.size("_w"), F.lit(1)) * 100, 2).alias("numbers_per_100_words"), (F.col("_contrast") & _contrasts(F.col("_low"))).alias("uses_contrast"),
        picked(F.col("_contrast"), lambda s: let(F.lower(s), lambda low: _contrasts(low))).alias("contrast_examples"), any_of(F.col("_low"), lists.STORIES).alias("uses_customer_story"), F.col("_low").rlike(_PERSON).alias("uses_first_person"),
        F.filter(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in lists.HYPE]), lambda x: x.isNotNull()).alias("hype_terms"), (F.col("_call") & any_of(F.col("_low"), _CALLS)).alias("cta_present"),
        picked(F.col("_call"), lambda s: let(F.lower(s), lambda low: any_of(low, _CALLS))).alias("cta_sentences"), F.when(F.contains("_line", F.lit("?")), F.size(F.filter("_s", lambda s: s.endswith("?")))).otherwise(0).alias("question_count"),
        rounded(share(F.col("_w"), lambda w: (F.length(w) >= 9) & w.rlike(_LONG_WORD)), 3).alias("long_word_share"),
        (F.transform(match_themes(F.col("text"), themes, 5), lambda m: m["name"]) if themes else F.array().cast("array<string>")).alias("themes"), F.coalesce(F.try_element_at("_s", F.lit(-1)), F.lit("")).alias("closing_sentence"),
    )


def provenance(content_type: Column) -> Column:
    """M-03"""
    return F.when(content_type.isin(*lists.PERSONAL_TYPES), "verified_founder").otherwise("company_editorial")


def _percent(share: Column, digits: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.bround(share * 100, digits)), F.lit("%"))


#: The measures that a guide is made of.
_GUIDING = (
    "median_sentence_words", "median_paragraph_sentences", "word_count", "short_sentence_share", "hook", "hook_words", "hook_is_question", "hook_has_number", "uses_fragments", "numbers_per_100_words", "long_word_share", "number_count",
    "uses_contrast", "uses_first_person", "uses_customer_story", "cta_present", "cta_sentences", "hype_terms", "themes",
)


def voice_guide(analysed: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """M-04: one row over all analysed examples, and what it may claim; kinds(example_id, content_type) tells where they come from.

    Medians, shares, themes of two examples or more (most frequent first, then by
    name), which usual assumptions the examples bear out and which they do not, and
    warnings of few examples, of a single type and of provenance.
    """
    rows = analysed.withColumn("content_type", F.lit(None).cast("string")) if kinds is None else analysed.join(kinds.select("example_id", "content_type"), "example_id", "left")
    # measured once, as four passes read the measures: without it each pass cuts the texts again
    rows = settle(rows.select("example_id", "content_type", *_GUIDING))
    share = lambda cond, name: F.avg(cond.cast("int")).alias(name)
    middle = lambda c, name=None: rounded(F.percentile(c, 0.5), 1).alias(name or c)
    first = lambda c, n: F.slice(F.transform(F.array_sort(F.collect_list(F.struct("example_id", F.col(c).alias("v")))), lambda x: x["v"]), 1, n)
    totals = rows.agg(
        F.count(F.lit(1)).alias("approved_example_count"), middle("median_sentence_words"), middle("median_paragraph_sentences"), middle("word_count", "median_word_count"), middle("short_sentence_share"), middle("hook_words", "median_hook_words"),
        F.max("uses_fragments").alias("uses_fragments"), middle("numbers_per_100_words", "median_numbers"), middle("long_word_share", "median_long_words"), F.avg("long_word_share").alias("mean_long_words"), share(F.col("number_count") > 0, "numbers"), share(F.col("uses_contrast"), "contrast"),
        share(F.col("uses_first_person"), "person"), share(F.col("uses_customer_story"), "stories"), share(F.col("cta_present"), "calls"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hype_terms")))).alias("hype_terms_found"), F.percentile("median_sentence_words", 0.5).alias("rhythm"),
        F.count_if("hook_is_question").alias("q"), F.count_if("hook_has_number").alias("f"), F.count_if(F.col("hook_words") <= 10).alias("b"), F.count_if(provenance(F.col("content_type")) == "verified_founder").alias("founder_example_count"), F.array_sort(F.collect_set(F.when(F.col("content_type") != "", F.col("content_type")))).alias("content_types"),
    )
    # the first few of each, not all of them: cut before they are gathered
    hooks = rows.where("hook <> ''").orderBy("example_id").limit(5).agg(first("hook", 5).alias("example_hooks"))
    calls = rows.where(F.size("cta_sentences") > 0).orderBy("example_id").limit(5).agg(F.slice(F.flatten(first("cta_sentences", 5)), 1, 5).alias("typical_calls_to_action"))
    themes = rows.select("example_id", F.explode("themes").alias("theme")).groupBy("theme").agg(F.countDistinct("example_id").alias("n")).where("n >= 2")
    named = themes.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "theme"))), lambda x: x["theme"]).alias("recurring_themes"))
    one = totals.crossJoin(F.broadcast(hooks)).crossJoin(F.broadcast(calls)).crossJoin(F.broadcast(named))  # single rows
    n, found, themes_ = F.col("approved_example_count"), F.size("hype_terms_found") > 0, F.col("recurring_themes")
    held = {
        "Direct": F.col("median_sentence_words") <= 20, "Clear": F.col("median_long_words") <= 0.22, "Commercially focused": F.arrays_overlap(themes_, F.array(*map(F.lit, lists.COMMERCIAL_THEMES))), "Grounded in business outcomes": F.size(themes_) > 0,
        "Focused on local-business problems": F.exists(themes_, lambda t: F.lower(t).rlike("local|business")), "Uses short paragraphs": F.col("median_paragraph_sentences") <= 3, "Avoids generic AI hype": ~found, "Prefers measurable impact": F.col("numbers") >= 0.5,
    }
    judged = lambda want: F.filter(F.array(*[F.when(F.coalesce(held.get(x, F.lit(False)), F.lit(False)) == want, F.lit(x)) for x in lists.ASSUMPTIONS]), lambda x: x.isNotNull())
    of = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit("/"), n.cast("string"), F.lit(f" open with {what}")))
    patterns = F.filter(F.array(of("q", "a question"), of("f", "a figure"), of("b", "a line of 10 words or fewer")), lambda x: x.isNotNull())
    tone = F.concat_ws(", ", F.when(F.col("rhythm") <= 16, "concise").otherwise("measured"), F.when(F.col("person") >= 0.6, "first-person").otherwise("third-person"), F.when(found, "occasionally promotional").otherwise("hype-free"), F.when(F.col("contrast") >= 0.4, "argues by contrast"))
    level = F.when(F.col("mean_long_words") < 0.12, "none").when(F.col("mean_long_words") < 0.18, "light").when(F.col("mean_long_words") < 0.25, "moderate").otherwise("heavy")
    few = F.concat(F.lit("Only "), n.cast("string"), F.lit(" approved example(s). Below five examples these patterns are indicative, not reliable."))
    alike = F.concat(F.lit("All examples are of one type ("), F.coalesce(F.get("content_types", F.lit(0)), F.lit("unknown")), F.lit("). The guide may not transfer to other formats."))
    personal = F.col("founder_example_count")
    return one.select(
        "approved_example_count", "founder_example_count", (n - personal).alias("company_example_count"), F.when(n == 0, "empty").otherwise("derived").alias("status"), "content_types", "median_sentence_words", "median_paragraph_sentences", "median_word_count", "short_sentence_share", "uses_fragments",
        "median_hook_words", "example_hooks", F.when(F.size(patterns) > 0, patterns).otherwise(F.array(F.lit("No single dominant hook pattern across the approved examples"))).alias("hook_patterns"), "recurring_themes", "typical_calls_to_action", "hype_terms_found",
        rounded(F.col("numbers") * 100, 0).alias("number_share"), F.concat(_percent(F.col("numbers")), F.lit(" of examples contain at least one figure (median "), F.col("median_numbers").cast("string"), F.lit(" per 100 words).")).alias("use_of_numbers"),
        F.concat(_percent(F.col("stories")), F.lit(" of examples reference a customer situation.")).alias("use_of_customer_stories"), F.concat(_percent(F.col("contrast")), F.lit(" of examples use an explicit contrast construction.")).alias("use_of_contrast"),
        F.concat(_percent(F.col("person")), F.lit(" of examples are written in the first person.")).alias("use_of_founder_experience"), F.concat(_percent(F.col("calls")), F.lit(" of examples end with an invitation to respond.")).alias("cta_share"),
        F.concat(tone, F.lit(" (derived from "), n.cast("string"), F.lit(" example(s))")).alias("tone"), F.concat(level, F.lit(" (mean long-word share "), _percent(F.col("mean_long_words"), 1), F.lit(" across the approved examples)")).alias("technical_detail_level"),
        judged(True).alias("confirmed_assumptions"), judged(False).alias("unsupported_assumptions"),
        F.when(n == 0, "Zero examples: no voice conclusion can be drawn.").when(n < 5, few).when(F.size("content_types") <= 1, alike).alias("coverage_warning"),
        F.when(personal == 0, "Every example is company-published; nothing here is evidence of how the founder writes.").when(personal < 5, F.concat(F.lit("Only "), personal.cast("string"), F.lit(" verified founder example(s): treat the patterns as a baseline."))).alias("provenance_warning"),
    )


def describe(analysed: DataFrame) -> DataFrame:
    """M-05, M-06: an example's measures in words."""
    text = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    n = lambda c: F.col(c).cast("string")
    return analysed.select(
        "example_id", F.concat_ws("; ", text(n("hook_words"), "-word opening"), F.when(F.col("hook_is_question"), "question hook"), F.when(F.col("hook_has_number"), "leads with a figure"), F.when(F.col("hook_words") <= 10, "short declarative")).alias("hook_style"),
        text("Median ", n("median_sentence_words"), " words per sentence; ", _percent(F.col("short_sentence_share")), " of sentences are 12 words or fewer; median ", n("median_paragraph_sentences"), " sentence(s) per paragraph.").alias("sentence_style"),
        text(n("number_count"), " figure(s) (", n("numbers_per_100_words"), " per 100 words); ", F.when(F.col("uses_customer_story"), "includes a customer example.").otherwise("no customer example present.")).alias("evidence_style"),
        F.concat_ws("; ", F.when(F.col("uses_first_person"), "first person").otherwise("impersonal"), F.when(F.col("uses_contrast"), "uses contrast framing"), F.when(F.size("hype_terms") > 0, text("contains hype vocabulary: ", F.array_join("hype_terms", ", "))).otherwise("no hype vocabulary detected"),
                    F.when(F.col("cta_present"), "ends with an invitation to respond"), F.when(F.col("question_count") > 0, text(n("question_count"), " question(s)"))).alias("tone_notes"),
    )


def speaker_lines(transcripts: DataFrame) -> DataFrame:
    """M-07: (conv_id, turn, at, speaker, text) of the lines of transcripts(conv_id, turn, text); a line without a name has no speaker."""
    lines = transcripts.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "_line")).withColumn("_line", F.trim("_line")).where("_line <> ''")
    pattern = "(?U)" + lists.SPEAKER
    name = F.regexp_extract("_line", pattern, 1)
    return lines.select("conv_id", "turn", "at", F.when(name != "", F.trim(name)).alias("speaker"), F.when(name != "", F.trim(F.regexp_extract("_line", pattern, 2))).otherwise(F.col("_line")).alias("text"))


def meeting_notes(lines: DataFrame, decisions: Sequence[str] = lists.DECISIONS, actions: Sequence[str] = lists.ACTIONS) -> DataFrame:
    """M-08: tall notes (conv_id, kind, rank, speaker, text): 6 decisions, 8 actions, 6 questions, the 4 longest quotable lines, and a summary of the first 3 sentences.

    A line that decides is no action; a question may be either.
    """
    low, n = F.lower("text"), word_count(F.col("text"))
    decided, acted = any_of(low, decisions) & (n >= 5), any_of(low, actions) & (n >= 5)
    kinds = F.array(F.when(decided, "decision").when(acted, "action"), F.when(F.col("text").endswith("?") & (n >= 5), "question"), F.when(n.between(12, 45), "quote"))
    rows = lines.select("*", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    size = F.when(F.col("kind") == "quote", -F.length("text")).otherwise(0)
    w = Window.partitionBy("conv_id", "kind").orderBy(size, "turn", "at")
    most = F.when(F.col("kind") == "action", 8).when(F.col("kind") == "quote", 4).otherwise(6)
    notes = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("conv_id", "kind", "rank", "speaker", "text")
    # a transcript is read as a whole: what one meeting says
    whole = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "at", "text"))), lambda x: x["text"]), " ").alias("_t"))
    said = F.array_join(F.slice(sentences(F.col("_t")), 1, 3), " ")
    summary = whole.select("conv_id", F.lit("summary").alias("kind"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("speaker"), F.when(said != "", said).otherwise("(transcript too short to summarise)").alias("text"))
    return notes.unionByName(summary)


def meeting_gate(lines: DataFrame, least: int = 60) -> DataFrame:
    """M-09: (conv_id, words, accepted): under `least` words a transcript is refused."""
    return lines.groupBy("conv_id").agg(F.sum(word_count(F.col("text"))).alias("words")).withColumn("accepted", F.col("words") >= least)


def drop_unverifiable(quotes: DataFrame, transcripts: DataFrame, compose: bool = True) -> DataFrame:
    """M-10: per conversation how many of its quotes do not occur in it."""
    return quotes.join(transcripts.select("conv_id", F.col("text").alias("_t")), "conv_id").groupBy("conv_id").agg(F.count_if(~is_verbatim(F.col("quote"), F.col("_t"), compose)).alias("dropped"))
