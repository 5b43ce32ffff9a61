"""The five-stage batch run (O-01 to O-06): ingest, extract, trends, briefs, watchlist."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import briefs, dedupe, extraction, trends
from .shared import settle
from .sources import landing

STAGES = ("ingest", "extract", "trends", "opportunities", "engagement")


@dataclass
class Run:
    """What a run made, by table name, and what each stage reports."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    stages: dict[str, dict] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


#: What each stage counts besides its rows, while its table is computed: a column and the values that are told apart.
COUNTED = {
    "ingest": ("result", ("stored", "duplicate", "left")), "extract": ("is_promotional", (True, False)), "trends": ("trend_status", ("rising", "emerging", "stable", "saturated", "declining", "low_confidence")),
    "opportunities": ("skip_reason", ("status", "no evidence", "score", "cap")), "engagement": ("priority", ("high", "medium", "low")),
}
_ERROR, _ERRORS, _NOTES = 300, 50, 5


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """O-04: df whose rows, and rows by the value that the stage counts, are gathered while it is computed: no second pass reads it."""
    watch = Observation(f"stage {stage}")
    column, values = COUNTED[stage]
    counts = [F.count_if(F.col(column) == v).alias(str(v).lower() if isinstance(v, str) else f"{column} {str(v).lower()}") for v in values] if column in df.columns else []
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *counts), watch


def may_write() -> bool:
    """O-05: writes need ENGINE_ADMIN; the default is read-only."""
    return os.environ.get("ENGINE_ADMIN", "").strip().lower() in ("1", "true", "yes", "on")


def run(found: DataFrame, known: extraction.Dictionaries, as_of: Column, stages: Sequence[str] = STAGES, compose: bool = True, limit: int = 60, stored: DataFrame | None = None, notes: Sequence[str] = ()) -> Run:
    """O-01, O-02: runs the stages over found sources; one that fails is reported and the later ones still run.

    Each stage's table is computed once and kept in the checkpoint folder. At most
    `limit` sources are stored; those `stored` before are what they may duplicate.
    `notes` are what connectors said about their settings.
    """
    out = Run(notes=list(notes))

    def ingest() -> DataFrame:
        return dedupe.store(found, limit, stored, compose)

    def extract() -> DataFrame:
        return extraction.extract(out.tables.get("ingest", found), known, as_of, compose)

    def theme() -> DataFrame:
        return trends.theme_trends(out.tables["extract"], out.tables.get("ingest", found), as_of)

    def opportunities() -> DataFrame:
        members = trends.theme_rows(out.tables["extract"].withColumn("passages", F.size("supporting_evidence")), out.tables.get("ingest", found))
        detail = members.join(out.tables["extract"].select("source_id", "freshness", F.size("supporting_evidence").alias("passages"), "published_at"), "source_id")
        return briefs.promote(out.tables["trends"], briefs.score_brief(detail), members.groupBy("slug").agg(F.count(F.lit(1)).alias("evidence")))

    def engagement() -> DataFrame:
        rising = out.tables["trends"].where(F.col("trend_status").isin("rising", "emerging"))
        return briefs.watchlist(out.tables.get("ingest", found), out.tables["extract"], rising, found.select("source_url").limit(0), as_of)

    work: dict[str, Callable[[], DataFrame]] = {"ingest": ingest, "extract": extract, "trends": theme, "opportunities": opportunities, "engagement": engagement}
    for name in stages:
        began = time.time()
        try:
            table, watch = observed(work[name](), name)
            table = settle(table)
            out.stages[name] = {**watch.get, "seconds": round(time.time() - began, 3)}
            out.tables[name] = table.where("result = 'stored'").select(*found.columns) if name == "ingest" else table
        except Exception as error:  # noqa: BLE001  a stage that fails must not stop the others
            out.errors.append(f"{name}: {type(error).__name__}: {str(error)[:_ERROR]}")
            out.stages[name] = {"rows": 0, "error": type(error).__name__}
    return out


LOG = "at timestamp, trigger string, stages string, discovered long, stored long, duplicates long, signals long, themes long, opportunities long, errors array<string>, notes string"


def run_log(spark: SparkSession, done: Run, trigger: str = "manual") -> DataFrame:
    """O-03, O-04: one row for the log: counts, stages as JSON, at most 50 errors, the first 5 notes."""
    of = lambda stage, name="rows": int(done.stages.get(stage, {}).get(name) or 0)
    written = of("opportunities") - sum(of("opportunities", r) for r in COUNTED["opportunities"][1])
    row = (trigger, json.dumps(done.stages, sort_keys=True), of("ingest"), of("ingest", "stored"), of("ingest", "duplicate"), of("extract"), of("trends"), written, done.errors[:_ERRORS], "; ".join(done.notes[:_NOTES]))
    return spark.createDataFrame([row], LOG.partition(", ")[2]).select(F.current_timestamp().alias("at"), "*")


def save(done: Run, folder: str, trigger: str = "manual") -> bool:
    """O-03, O-05: each table of a run replaced as a whole and a row appended to the log, where writing is allowed; says whether it is."""
    if not may_write():
        return False
    for name, table in done.tables.items():
        landing.replace_table(table, f"{folder}/{name}")
    spark = SparkSession.active()
    run_log(spark, done, trigger).write.mode("append").parquet(f"{folder}/run_log")
    return True


def integrations(spark: SparkSession, configured: dict[str, bool]) -> DataFrame:
    """O-06: which integrations are set up."""
    rows = [(k, v, "ready" if v else "not configured") for k, v in sorted(configured.items())]
    return spark.createDataFrame(rows, "name string, configured boolean, message string")
