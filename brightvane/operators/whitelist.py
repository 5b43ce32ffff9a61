"""What a model wrote, held against the evidence (K-26): only points, claims and items whose sources are the theme's and whose passages are stored stay.

A model's answer is nested JSON of any shape. It is taken apart into rows as variants,
which keep each value's own type, semi-joined with what may be cited, and put
together again in the order in which it was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

#: A passage is recognised in another by at least so many characters.
OVERLAP = 40
_TEXTS = ("core_insight", "why_now", "why_company", "why_speaker", "target_audience", "founder_point_of_view", "hook", "suggested_call_to_action", "confidence_note")


def _json(response: Column) -> Column:
    """The outermost object of a text, whatever stands around it; null if there is none."""
    return F.try_parse_json(F.regexp_extract(response, r"(?s)(\{.*\})", 1))


def _parts(rows: DataFrame, path: str, place: str, value: str) -> DataFrame:
    """A row for each element of the array at a path of the variant `data`, with its place; other values than arrays have none."""
    found = rows.sparkSession.sql(f"SELECT r.*, x.pos AS {place}, x.value AS {value}, x.key AS _key FROM {{rows}} r, LATERAL variant_explode(try_variant_get(r.data, '{path}', 'variant')) x", rows=rows)
    return found.where("_key is null").drop("_key")


def _whole(value: str) -> Column:
    """A number of JSON as a long, if it is whole; texts and truth values are no numbers."""
    number = F.expr(f"case when schema_of_variant({value}) rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' then try_variant_get({value}, '$', 'double') end")
    return F.when(number == F.floor(number), number.cast("long"))


def _field(value: str, name: str) -> Column:
    return F.expr(f"try_variant_get({value}, '$.{name}', 'string')")


def _is_object(value: str) -> Column:
    return F.expr(f"schema_of_variant({value}) like 'OBJECT<%'")


def _loose(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def whitelist_points(responses: DataFrame, members: DataFrame, passages: DataFrame, cited_only: bool = False) -> DataFrame:
    """The supporting points that stand, of responses(brief_id, slug, response): brief_id, at, point, evidence_source_ids, evidence_passage, evidence_url, evidence_domain.

    A point stays if it cites a member(slug, source_id) of its theme, and if its passage
    is one of the theme's passages(slug, place, source_id, passage, url, domain), or the
    first that contains it or lies in it over 40 characters or more. What is given back is
    the stored passage, never the model's. With `cited_only` it must be of a cited source.
    Ids keep the model's order; those of other sources are left out.
    """
    said = responses.select("brief_id", "slug", _json(F.col("response")).alias("data"))
    points = _parts(said, "$.supporting_points", "at", "p").where(_is_object("p"))
    points = points.select("brief_id", "slug", "at", _field("p", "point").alias("point"), F.coalesce(_field("p", "evidence_passage"), F.lit("")).alias("asked"), F.expr("try_variant_get(p, '$.evidence_source_ids', 'variant')").alias("data"))
    ids = _parts(points.select("brief_id", "slug", "at", "data"), "$", "spot", "i").select("brief_id", "slug", "at", "spot", _whole("i").alias("source_id"))
    ids = ids.join(members.select("slug", "source_id").distinct(), ["slug", "source_id"], "left_semi")
    cited = ids.groupBy("brief_id", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("spot", "source_id"))), lambda x: x["source_id"]).alias("evidence_source_ids"))
    # a theme's passages are bounded by its members, so a point meets few
    held = passages.select("slug", "place", F.col("source_id").alias("_source"), "passage", "url", "domain", _loose(F.col("passage")).alias("_stored")).where("passage <> ''")
    # both sides are brought into form before they meet, not once a pair
    met = points.join(cited, ["brief_id", "at"]).withColumn("_needle", _loose(F.col("asked"))).join(held, "slug")
    if cited_only:
        met = met.where(F.array_contains("evidence_source_ids", F.col("_source")))
    needle, stored = F.col("_needle"), F.col("_stored")
    close = (F.length(needle) >= OVERLAP) & (F.contains(stored, needle) | ((F.length(stored) >= OVERLAP) & F.contains(needle, stored)))
    # of equal passages the last is the one that an exact text names, as in an index by text
    rank = F.when(F.col("asked") == F.col("passage"), F.struct(F.lit(0).alias("k"), (-F.col("place")).alias("v"))).when(close, F.struct(F.lit(1).alias("k"), F.col("place").alias("v")))
    best = met.withColumn("_rank", rank).where("_rank is not null").groupBy("brief_id", "at").agg(F.min_by(F.struct(F.trim(F.coalesce("point", F.lit(""))).alias("point"), "evidence_source_ids", F.col("passage").alias("evidence_passage"), F.col("url").alias("evidence_url"), F.col("domain").alias("evidence_domain")), F.col("_rank")).alias("b"))
    return best.select("brief_id", "at", "b.*")


def whitelist_briefs(responses: DataFrame, members: DataFrame, passages: DataFrame, names: DataFrame, cited_only: bool = False) -> DataFrame:
    """The briefs of responses(brief_id, slug, response) that have at least one point that stands; names(slug, name) give a missing title. Lists keep only elements of the right form, in their order."""
    points = whitelist_points(responses, members, passages, cited_only)
    kept = points.groupBy("brief_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct("point", "evidence_source_ids", "evidence_passage", "evidence_url", "evidence_domain").alias("p")))), lambda x: x["p"]).alias("supporting_points"))
    said = responses.select("brief_id", "slug", _json(F.col("response")).alias("data"))
    objects = lambda path, *names: F.transform(F.filter(F.coalesce(F.expr(f"try_variant_get(data, '$.{path}', 'array<variant>')"), F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v).startswith("OBJECT<")), lambda v: F.struct(*[F.try_variant_get(v, f"$.{n}", "string").alias(n) for n in names]))
    notes = F.expr("filter(transform(coalesce(try_variant_get(data, '$.risk_notes', 'array<variant>'), array()), v -> try_variant_get(v, '$', 'string')), x -> x is not null)")
    out = said.join(kept, "brief_id").join(names.select("slug", "name"), "slug", "left")
    return out.select(
        "brief_id", "slug", F.trim(F.coalesce(F.nullif(_field("data", "title"), F.lit("")), "name")).alias("title"), *[_field("data", t).alias(t) for t in _TEXTS], "supporting_points", objects("potential_objections", "objection", "response").alias("potential_objections"),
        F.coalesce(F.nullif(_field("data", "recommended_format"), F.lit("")), F.lit("linkedin_post")).alias("recommended_format"), objects("verification_checklist", "item", "why").alias("verification_checklist"), notes.alias("risk_notes"),
    )


def whitelist_drafts(responses: DataFrame, least_words: int = 30) -> DataFrame:
    """The drafts of responses(draft_id, response) with `least_words` words or more: draft_text, unsupported_claims, and the ids of the sources their claims name, ascending."""
    said = responses.select("draft_id", _json(F.col("response")).alias("data")).withColumn("draft_text", F.trim(F.coalesce(_field("data", "draft_text"), F.lit("")))).where(word_count(F.col("draft_text")) >= least_words)
    claims = _parts(said.select("draft_id", "data"), "$.claims_used", "at", "c").where(_is_object("c")).select("draft_id", F.expr("try_variant_get(c, '$.source_id', 'variant')").alias("i"))
    cited = claims.select("draft_id", F.when(F.expr("schema_of_variant(i) = 'BIGINT'"), _whole("i")).alias("source_id")).where("source_id is not null").groupBy("draft_id").agg(F.array_sort(F.collect_set("source_id")).alias("cited_source_ids"))
    unsupported = F.expr("filter(transform(coalesce(try_variant_get(data, '$.unsupported_claims', 'array<variant>'), array()), v -> try_variant_get(v, '$', 'string')), x -> x is not null)")
    return said.join(cited, "draft_id", "left").select("draft_id", "draft_text", unsupported.alias("unsupported_claims"), F.coalesce("cited_source_ids", F.array().cast("array<bigint>")).alias("cited_source_ids"))


def whitelist_items(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """The watchlist items of responses(run_id, response) about sources that were candidates(run_id, source_id), the last of each: run_id, source_id, connection, angle, priority."""
    said = responses.select("run_id", _json(F.col("response")).alias("data"))
    items = _parts(said, "$.watchlist", "at", "w").where(_is_object("w")).withColumn("i", F.expr("try_variant_get(w, '$.source_id', 'variant')")).withColumn("source_id", _whole("i"))
    items = items.join(candidates.select("run_id", "source_id").distinct(), ["run_id", "source_id"], "left_semi")
    fields = F.struct(*[_field("w", n).alias(n) for n in ("connection", "angle", "priority")])
    return items.groupBy("run_id", "source_id").agg(F.max_by(fields, "at").alias("f")).select("run_id", "source_id", "f.*")
