"""Keyword classification (F-01 to F-07). Dictionaries are data that the caller gives."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

PRIMARY_LEAST, SECONDARY_LEAST = 4.0, 3.0


@dataclass(frozen=True)
class Theme:
    slug: str
    name: str
    keywords: Sequence[str]
    strong: Sequence[str] = ()
    negative: Sequence[str] = ()
    description: str = ""


def phrase_pattern(phrase: str, plural: bool = True) -> str:
    """F-01: the phrase between non-word characters, in any case and spacing, with an optional plural s. Unicode-aware."""
    body = r"\s+".join(re.escape(w) for w in phrase.split())
    return rf"(?iU)(?<!\w){body}{'s?' if plural else ''}(?!\w)"


@dataclass
class Phrases:
    """Counts of phrases in one text column. A phrase is only searched for by pattern where its first word occurs at all."""

    text: Column
    _low: Column = field(init=False)

    def __post_init__(self) -> None:
        self.text = F.coalesce(self.text, F.lit(""))
        self._low = F.lower(self.text)

    def count(self, phrase: str, plural: bool = True) -> Column:
        """F-02"""
        return F.when(F.contains(self._low, F.lit(phrase.split()[0].lower())), F.regexp_count(self.text, F.lit(phrase_pattern(phrase, plural)))).otherwise(0)

    def has(self, phrase: str, plural: bool = True) -> Column:
        """F-02"""
        return F.contains(self._low, F.lit(phrase.split()[0].lower())) & self.text.rlike(phrase_pattern(phrase, plural))

    def any(self, phrases: Sequence[str]) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | self.has(p)
        return out

    def number(self, phrases: Sequence[str]) -> Column:
        out = F.lit(0)
        for p in phrases:
            out = out + self.has(p).cast("int")
        return out

    def total(self, phrases: Sequence[str]) -> Column:
        out = F.lit(0)
        for p in phrases:
            out = out + self.count(p)
        return out


def match_themes(text: Column, themes: Sequence[Theme], top: int = 4) -> Column:
    """F-03: array of struct(name, score, keywords), best first. A keyword counts up to 4 times 1, a strong one 4 times 1.5 more, a negative one -3 each time.

    Each phrase is counted once, whatever the number of themes and lists that hold it.
    """
    p = Phrases(text)
    place = {k: i for i, k in enumerate(dict.fromkeys(k for t in themes for k in (*t.keywords, *t.strong, *t.negative)))}

    def judge(counts: Column) -> Column:
        n = lambda k: F.get(counts, F.lit(place[k]))
        rows = []
        for at, theme in enumerate(themes):
            score = F.lit(0.0)
            for k in theme.keywords:
                score = score + F.least(n(k), F.lit(4)) * 1.0
            for k in theme.strong:
                score = score + F.least(n(k), F.lit(4)) * 1.5
            for k in theme.negative:
                score = score - n(k) * 3.0
            found = F.filter(F.array(*[F.when(n(k) > 0, F.lit(k)) for k in theme.keywords]), lambda x: x.isNotNull())
            rows.append(F.struct((-score).alias("rank"), F.lit(at).alias("at"), F.lit(theme.name).alias("name"), score.alias("score"), found.alias("keywords")))
        good = F.array_sort(F.filter(F.array(*rows), lambda x: x["score"] > 0))
        return F.transform(F.slice(good, 1, top), lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score"), x["keywords"].alias("keywords")))

    return let(F.array(*[p.count(k) for k in place]), judge)


def primary_theme(matches: Column) -> Column:
    """F-07"""
    first = F.get(matches, F.lit(0))
    return F.when(first["score"] >= PRIMARY_LEAST, first["name"])


def secondary_themes(matches: Column) -> Column:
    """F-07: ranks 2 to 4, only beside a primary theme."""
    rest = F.transform(F.filter(F.slice(matches, 2, 3), lambda x: x["score"] >= SECONDARY_LEAST), lambda x: x["name"])
    return F.when(primary_theme(matches).isNotNull(), rest).otherwise(F.array().cast("array<string>"))


def match_entities(text: Column, names: Mapping[str, str]) -> Column:
    """F-04: labels of the names that occur, in the dictionary's order, each once; no plurals."""
    p = Phrases(text)
    return F.array_distinct(F.filter(F.array(*[F.when(p.has(k, plural=False), F.lit(v)) for k, v in names.items()]), lambda x: x.isNotNull()))


def match_industries(text: Column, industries: Mapping[str, Sequence[str]], least: int = 2, top: int = 3) -> Column:
    """F-05: industries with `least` hits or more, most hits first, else `Cross-industry`."""
    p = Phrases(text)
    rows = F.array(*[F.struct((-p.total(k)).alias("rank"), F.lit(name).alias("name")) for name, k in industries.items()])
    found = F.transform(F.slice(F.array_sort(F.filter(rows, lambda x: x["rank"] <= -least)), 1, top), lambda x: x["name"])
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Cross-industry")))


def match_segment(text: Column, segments: Mapping[str, Sequence[str]], default: str = "Not specified in source") -> Column:
    """F-06: the segment with the most hits, the first of equals."""
    p = Phrases(text)
    best = F.array_min(F.array(*[F.struct((-p.total(k)).alias("rank"), F.lit(i).alias("at"), F.lit(name).alias("name")) for i, (name, k) in enumerate(segments.items())]))
    return F.when(best["rank"] < 0, best["name"]).otherwise(default)
