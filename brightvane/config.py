"""Settings and dictionaries as JSON files (A-15, O-10), and the tables a run keeps (A-14)."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .operators.extraction import Dictionaries
from .operators.taxonomy import Theme
from .pipeline import LOG, may_write
from .sources.landing import replace_table
from .sources.snapshots import read_snapshot


@dataclass(frozen=True)
class Settings:
    """What a run may be told; a file need name only what differs."""

    max_sources: int = 60
    rss_items_per_feed: int = 15
    lookback_days: int = 45
    blocked_domains: tuple[str, ...] = ()
    user_agent: str = "brightvane"
    default_delay: float = 1.0
    max_wait: float = 30.0
    feeds: tuple[dict, ...] = ()
    dictionaries: Dictionaries = field(default_factory=lambda: Dictionaries(()))


def _dictionaries(given: dict) -> Dictionaries:
    themes = tuple(Theme(**{k: tuple(v) if isinstance(v, list) else v for k, v in t.items()}) for t in given.get("themes", ()))
    names = {f.name for f in dataclasses.fields(Dictionaries)} - {"themes"}
    unknown = set(given) - names - {"themes"}
    if unknown:
        raise ValueError(f"unknown dictionaries: {sorted(unknown)}")
    return Dictionaries(themes, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names})


def load(path: str | None = None) -> Settings:
    """The settings of a JSON file, defaults for what it leaves out; without a file all defaults. An unknown name is an error, not a setting that does nothing."""
    if path is None or not os.path.exists(path):
        return Settings()
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    unknown = set(given) - {f.name for f in dataclasses.fields(Settings)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return Settings(**{k: _dictionaries(v) if k == "dictionaries" else tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def save(settings: Settings, path: str) -> bool:
    """Writes settings back, whole or not at all; says whether writing is allowed."""
    if not may_write():
        return False
    beside = f"{path}.new"
    with open(beside, "w", encoding="utf-8") as file:
        json.dump(dataclasses.asdict(settings), file, indent=2, ensure_ascii=False, default=list)
    os.replace(beside, path)
    return True


#: The tables of `pipeline.save` that exist before the first run.
TABLES = {
    "ingest": "source_id long, source_type string, source_url string, source_domain string, title string, author string, published_at timestamp, discovered_at timestamp, status string, search_query string, cleaned_text string, n_chars long",
    "opportunities": "slug string, opportunity_score double, skip_reason string",
}


def create_tables(spark: SparkSession, folder: str, reset: bool = False) -> list[str]:
    """A-14: makes the tables and the log that are not there yet, or all of them anew with `reset`, empty; gives the names of those made."""
    if not may_write():
        return []
    made = [name for name in TABLES if reset or read_snapshot(spark, f"{folder}/{name}") is None]
    for name in made:
        replace_table(spark.createDataFrame([], TABLES[name]), f"{folder}/{name}")
    log = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/run_log")
    if reset or not log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(log):
        spark.createDataFrame([], LOG).write.mode("overwrite").parquet(f"{folder}/run_log")
        made.append("run_log")
    return made
