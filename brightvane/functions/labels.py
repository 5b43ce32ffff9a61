"""Labels and bands (B-22 to B-27). Times are compared with an explicit `as_of`."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import capital, words
from .urls import is_first_party


def pluralize(n: Column, singular: str, plural: str | None = None) -> Column:
    return F.when(n == 1, F.lit(singular)).otherwise(F.lit(plural or singular + "s"))


def count_label(n: Column, singular: str, plural: str | None = None) -> Column:
    """`1,200 sources`"""
    return F.concat(F.format_number(n, 0), F.lit(" "), pluralize(n, singular, plural))


def industry_phrase(industries: Column, limit: int = 2) -> Column:
    """The first names in lower case joined by `and`, without the catch-all."""
    names = F.transform(F.coalesce(industries, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_join(F.slice(F.array_distinct(F.filter(names, lambda x: ~x.isin("", "cross-industry"))), 1, limit), " and ")


def humanize_label(c: Column) -> Column:
    """`long_form` as `Long form`; usual abbreviations in capitals."""
    text = F.trim(F.translate(F.coalesce(c, F.lit("")), "_-", "  "))
    text = F.concat(capital(text), F.substr(text, F.lit(2)))
    for low, proper in (("ai", "AI"), ("saas", "SaaS"), ("roi", "ROI"), ("hvac", "HVAC"), ("smb", "SMB"), ("cx", "CX")):
        text = F.regexp_replace(text, rf"(?i)(?<=^|\s){low}(?=\s|$)", proper)
    return F.when(text == "", "—").otherwise(text)


def truncate_words(c: Column, n: int) -> Column:
    w = words(c)
    return F.when(F.size(w) <= n, F.array_join(w, " ")).otherwise(F.concat(F.regexp_replace(F.array_join(F.slice(w, 1, n), " "), "[.,;:]+$", ""), F.lit("…")))


def strip_inference_prefix(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*\[Inference[^\]]*\]\s*", ""))


def age_days(at: Column, as_of: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(86400e6)


def relative_time(at: Column, as_of: Column) -> Column:
    """B-23"""
    s = (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(1e6)
    ago = lambda n, unit: F.concat(count_label(n.cast("long"), unit), F.lit(" ago"))
    days = F.floor(s / 86400)
    months = F.floor(days / 30)
    return (
        F.when(at.isNull(), "no date").when(s < 0, "just now").when(s < 3600, ago(F.greatest(F.floor(s / 60), F.lit(1)), "min")).when(s < 86400, ago(F.floor(s / 3600), "hour"))
        .when(days < 31, ago(days, "day")).when(months < 12, ago(months, "month")).otherwise(ago(F.floor(days / 365), "year"))
    )


def recency_tier(at: Column, as_of: Column) -> Column:
    """B-24"""
    age = age_days(at, as_of)
    return F.when(at.isNull(), "undated").when(age <= 14, "new").when(age <= 90, "recent").otherwise("evergreen")


def growth_phrase(now: Column, before: Column) -> Column:
    """B-25: no percentage without a base."""
    now, before = F.coalesce(now, F.lit(0)), F.coalesce(before, F.lit(0))
    change = F.abs((now - before) / before.cast("double"))
    return (
        F.when((before == 0) & (now == 0), "no activity in either period")
        .when(before == 0, F.concat(F.lit("new this period — "), count_label(now, "source"), F.lit(", none previously")))
        .when(now == before, F.concat(F.lit("flat at "), count_label(now, "source")))
        .otherwise(F.concat(F.when(now > before, "up ").otherwise("down "), F.round(change * 100).cast("int").cast("string"), F.lit("% — "), now.cast("string"), F.lit(" this period vs "), before.cast("string"), F.lit(" last")))
    )


def risk_band(score: Column) -> Column:
    """B-26"""
    return F.when(score <= 24, "Low").when(score <= 49, "Moderate").when(score <= 74, "Elevated").otherwise("High")


def score_band(score: Column) -> Column:
    """B-26"""
    return F.when(score >= 80, "Strong").when(score >= 65, "Promising").when(score >= 50, "Moderate").otherwise("Weak")


def origin(domain: Column, promotional: Column, own: Iterable[str]) -> Column:
    """B-27"""
    return F.when(is_first_party(domain, own), "own").when(promotional, "vendor").otherwise("independent")
