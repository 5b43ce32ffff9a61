"""Scores (H-01 to H-05): freshness, opportunity, risk and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.labels import age_days, risk_band, score_band
from ..functions.text import rounded

FULL_DAYS, ZERO_DAYS, UNKNOWN_DATE = 7, 120, 4.0


def clamp10(c: Column) -> Column:
    # least and greatest pass over nulls, so a missing score is made 0 first
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(c.cast("double"), F.lit(0.0))))


def freshness(published: Column, as_of: Column, full: int = FULL_DAYS, zero: int = ZERO_DAYS, unknown: float = UNKNOWN_DATE) -> Column:
    """H-01: 10 up to `full` days, 0 from `zero` days, linear between; undated gets `unknown`, the future 10."""
    age = age_days(published, as_of)
    between = rounded(F.greatest(10.0 * (1.0 - (age - full) / max(zero - full, 1)), F.lit(0.0)), 2)
    return F.when(published.isNull(), F.lit(float(unknown))).when(age <= full, F.lit(10.0)).when(age >= zero, F.lit(0.0)).otherwise(between)


def freshness_reason(published: Column, as_of: Column, full: int = FULL_DAYS, zero: int = ZERO_DAYS) -> Column:
    age = age_days(published, as_of)
    days = F.bround(age).cast("long").cast("string")
    return (
        F.when(published.isNull(), "No publication date in the source — default score applied and flagged.").when(age < 0, "Publication date is in the future — treated as brand new and flagged.")
        .when(age <= full, F.concat(F.lit("Published "), days, F.lit(" day(s) ago."))).when(age >= zero, F.concat(F.lit("Published "), days, F.lit(f" days ago — outside the {zero}-day freshness window.")))
        .otherwise(F.concat(F.lit("Published "), days, F.lit(" days ago — linear decay.")))
    )


def opportunity(components: dict[str, Column], weights: dict[str, float] | None = None) -> tuple[Column, Column]:
    """H-02: the weighted score out of 100, and its breakdown by component. Weights are normalised over known names."""
    used = {k: float(v) for k, v in (weights or lists.WEIGHTS).items() if k in lists.WEIGHTS} or dict(lists.WEIGHTS)
    total = sum(used.values()) or 1.0
    rows, score = [], F.lit(0.0)
    for name in lists.WEIGHTS:
        share = used.get(name, 0.0) / total
        raw = clamp10(components.get(name, F.lit(0.0)))
        points = raw * share * 10.0
        score = score + points
        rows.append(F.struct(F.lit(name).alias("component"), F.round(raw, 2).alias("raw_0_10"), F.lit(round(share, 4)).alias("weight"), F.round(points, 2).alias("points"), F.lit(round(share * 100, 2)).alias("max_points")))
    return rounded(F.least(score, F.lit(100.0)), 1), F.array(*rows)


def risk(factors: dict[str, Column], points: dict[str, float] | None = None) -> tuple[Column, Column, Column]:
    """H-03: points of the factors present (unknown ones count 8), at most 100; the band; the factors, heaviest first.

    A factor is present where its column is a non-empty string or true.
    """
    table = points or lists.RISK_POINTS
    rows = []
    for at, (name, column) in enumerate(factors.items()):
        text = column.cast("string")
        present = column.isNotNull() & ~text.isin("", "false")
        value = float(table.get(name, lists.UNKNOWN_RISK_POINTS))
        reason = F.when(text == "true", F.lit("detected")).otherwise(text)
        rows.append(F.when(present, F.struct(F.lit(-value).alias("rank"), F.lit(at).alias("at"), F.lit(name).alias("factor"), F.lit(value).alias("points"), reason.alias("reason"))))
    found = F.array_sort(F.filter(F.array(*rows), lambda x: x.isNotNull()))
    total = F.round(F.least(F.aggregate(found, F.lit(0.0), lambda a, x: a + x["points"]), F.lit(100.0)), 1)
    return total, risk_band(total), F.transform(found, lambda x: F.struct(x["factor"].alias("factor"), x["points"].alias("points"), x["reason"].alias("reason")))


def confidence(domains: Column, passages: Column, strength: Column, sources: Column, dated: Column, domain_target: int = 3, passage_target: int = 4) -> Column:
    """H-04: how well a brief is supported, out of 100."""
    parts = (
        F.least(domains / F.lit(float(max(domain_target, 1))), F.lit(1.0)) * 30 + F.least(passages / F.lit(float(max(passage_target, 1))), F.lit(1.0)) * 25
        + clamp10(strength) / 10.0 * 30 + F.least(sources / F.lit(5.0), F.lit(1.0)) * 15
    )
    parts = parts * F.when(domains <= 1, 0.65).otherwise(1.0) * F.when(dated, 1.0).otherwise(0.9)
    return rounded(F.least(parts, F.lit(100.0)), 1)


__all__ = ["clamp10", "confidence", "freshness", "freshness_reason", "opportunity", "risk", "risk_band", "score_band"]
