"""The batch run: counts of stages, the log, settings, tables and the command line."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from brightvane import __main__ as shell
from brightvane import config, pipeline
from brightvane.plans import textual
from brightvane.plans.views import view
from brightvane.sources.landing import read_table

NOW = F.lit("2024-01-31 00:00:00").cast("timestamp")


@pytest.fixture
def sources(spark, sf_dir):
    return view(spark, sf_dir, "m_sources").where("source_id < 40")


def test_counts_come_with_the_tables(spark, sources, monkeypatch, tmp_path):
    done = pipeline.run(sources, textual.KNOWN, NOW, limit=10, notes=[f"note {i}" for i in range(7)])
    assert not done.errors
    for name, table in done.tables.items():
        if name != "ingest":
            assert done.stages[name]["rows"] == table.count()
    ingest = done.stages["ingest"]
    assert ingest["stored"] == done.tables["ingest"].count() == 10 and ingest["rows"] == ingest["stored"] + ingest["duplicate"] + ingest["left"]
    promotional = done.tables["extract"].where("is_promotional").count()
    assert done.stages["extract"]["is_promotional true"] == promotional and done.stages["extract"]["is_promotional false"] == 10 - promotional
    row = pipeline.run_log(spark, done).first()
    assert (row.discovered, row.stored, row.duplicates, row.signals) == (ingest["rows"], 10, ingest["duplicate"], 10) and row.notes == "note 0; note 1; note 2; note 3; note 4"
    monkeypatch.delenv("ENGINE_ADMIN", raising=False)
    assert not pipeline.save(done, str(tmp_path)) and not list(tmp_path.iterdir())
    monkeypatch.setenv("ENGINE_ADMIN", "yes")
    assert pipeline.save(done, str(tmp_path)) and pipeline.save(done, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "run_log")).count() == 2 and read_table(spark, str(tmp_path / "ingest")).count() == 10


def test_a_stage_that_fails_is_reported(spark):
    done = pipeline.run(spark.range(3), textual.KNOWN, NOW, ("ingest", "extract"))
    assert [e.partition(":")[0] for e in done.errors] == ["ingest", "extract"] and all(len(e) < 400 for e in done.errors) and done.stages["ingest"]["rows"] == 0


def test_settings_round_trip(monkeypatch, tmp_path):
    path = str(tmp_path / "s.json")
    assert config.load(path) == config.Settings()
    mine = dataclasses.replace(config.Settings(), max_sources=7, blocked_domains=("a.com",), dictionaries=textual.KNOWN)
    monkeypatch.delenv("ENGINE_ADMIN", raising=False)
    assert not config.save(mine, path)
    monkeypatch.setenv("ENGINE_ADMIN", "1")
    assert config.save(mine, path)
    back = config.load(path)
    assert back.max_sources == 7 and back.blocked_domains == ("a.com",) and tuple(back.dictionaries.themes) == textual.THEMES and back.dictionaries.competitors == {"that": "That Co"}
    (tmp_path / "bad.json").write_text('{"max_source": 7}')
    with pytest.raises(ValueError, match="max_source"):
        config.load(str(tmp_path / "bad.json"))


def test_tables_are_made_once(spark, monkeypatch, tmp_path):
    monkeypatch.delenv("ENGINE_ADMIN", raising=False)
    assert config.create_tables(spark, str(tmp_path)) == []
    monkeypatch.setenv("ENGINE_ADMIN", "on")
    assert config.create_tables(spark, str(tmp_path)) == ["ingest", "opportunities", "run_log"] and config.create_tables(spark, str(tmp_path)) == []
    assert "cleaned_text" in read_table(spark, str(tmp_path / "ingest")).columns and config.create_tables(spark, str(tmp_path), reset=True)


def test_command_line(spark, sources, monkeypatch, tmp_path, capsys):
    monkeypatch.setenv("ENGINE_ADMIN", "1")
    sources.write.parquet(str(tmp_path / "found"))
    given = [str(tmp_path / "found"), str(tmp_path / "out")]
    asked = shell.arguments([*given, "--quick", "--no-engagement", "--stage", "engagement", "--stage", "extract", "--stage", "ingest"])
    assert asked.max_sources == 25 and asked.stage == ("ingest", "extract")
    config.save(dataclasses.replace(config.Settings(), dictionaries=textual.KNOWN), str(tmp_path / "s.json"))
    code = shell.main([*given, "--max-sources", "5", "--stage", "ingest", "--stage", "extract", "--as-of", "2024-01-31", "--json", "--settings", str(tmp_path / "s.json")])
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert code == 0 and said["saved"] and said["stages"]["ingest"]["stored"] == 5 and set(said["stages"]) == {"ingest", "extract"}
    assert read_table(spark, str(tmp_path / "out" / "extract")).count() == 5
    with pytest.raises(SystemExit):
        shell.arguments([*given, "--stage", "nothing"])
