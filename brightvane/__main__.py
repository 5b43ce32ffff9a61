"""O-02: the batch run from a shell: `python -m brightvane SOURCES FOLDER`, or by spark-submit."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config, pipeline
from .sources.landing import read_table

#: Sources of a run with --quick.
QUICK = 25


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="brightvane", description="Runs the stages over found sources; tables are written if ENGINE_ADMIN is set.")
    parser.add_argument("sources", help="table of found sources")
    parser.add_argument("folder", help="where the tables and the log are kept")
    parser.add_argument("--stage", action="append", choices=pipeline.STAGES, help="run only these stages (repeatable)")
    parser.add_argument("--no-engagement", action="store_true", help="leave out the watchlist")
    parser.add_argument("--max-sources", type=int, help="store so many sources at most")
    parser.add_argument("--quick", action="store_true", help=f"store {QUICK} sources at most")
    parser.add_argument("--as-of", help="the moment to look back from (default: now)")
    parser.add_argument("--settings", help="JSON file of settings and dictionaries")
    parser.add_argument("--json", action="store_true", help="print the stages as JSON")
    parser.add_argument("--quiet", action="store_true")
    out = parser.parse_args(given)
    if out.max_sources is None and out.quick:
        out.max_sources = QUICK
    out.stage = tuple(s for s in pipeline.STAGES if (not out.stage or s in out.stage) and not (out.no_engagement and s == "engagement"))
    return out


def main(given: list[str] | None = None) -> int:
    """0 if every stage ran."""
    asked = arguments(given)
    spark = SparkSession.builder.appName("brightvane").getOrCreate()
    at = F.lit(asked.as_of).cast("timestamp") if asked.as_of else F.current_timestamp()
    settings = config.load(asked.settings)
    notes = [] if settings.dictionaries.themes else ["no themes are set: name them in the settings' dictionaries"]
    done = pipeline.run(read_table(spark, asked.sources), settings.dictionaries, at, asked.stage, limit=asked.max_sources or settings.max_sources, notes=notes)
    saved = pipeline.save(done, asked.folder, "command line")
    if asked.json:
        print(json.dumps({"stages": done.stages, "errors": done.errors, "saved": saved}, sort_keys=True))
    elif not asked.quiet:
        for name, counts in done.stages.items():
            print(f"{name:14} " + ", ".join(f"{k} {v}" for k, v in counts.items()))
        print("saved" if saved else "not saved: set ENGINE_ADMIN to write")
        for error in done.errors:
            print(error, file=sys.stderr)
    return 1 if done.errors else 0


if __name__ == "__main__":
    sys.exit(main())
