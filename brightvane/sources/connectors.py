"""The connector contract (A-01) as a Spark data source: a connector lists its parts, each is read in a task of its own, and what goes wrong is a row.

    register(spark)
    spark.read.format("brightvane").option("connector", "parquet").option("path", folder).load()

A connector without its settings gives one row of outcome `not_configured` with the
message what to set; a part that fails gives a row of outcome `error`; neither stops
the others. Own connectors are classes in a module named by the option `module`.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "connector string, outcome string, message string, source_type string, source_url string, title string, summary string, place long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_ARROW = pa.schema([(n, pa.int64() if n == "place" else pa.string()) for n in _NAMES])
_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


@dataclass
class Part(InputPartition):
    """What one task reads."""

    value: object


class Connector:
    """What a source of items has to say: whether it is set up, its parts, and the items of a part as dicts of the schema's columns.

    `pushable` names columns by which parts can be left out or items dropped early;
    `parts` and `items` get the filters on them as (column, operation, value).
    """

    name = "base"
    pushable: frozenset[str] = frozenset()

    def __init__(self, options: dict[str, str]):
        self.options = options

    def setup_message(self) -> str | None:
        """What is missing, or None."""
        return None

    def parts(self, filters: list[tuple]) -> Iterable[object]:
        raise NotImplementedError

    def items(self, part: object, filters: list[tuple]) -> Iterator[pa.RecordBatch | dict]:
        raise NotImplementedError


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


class ParquetConnector(Connector):
    """Items of landed Parquet files: `url`, `title`, `summary`, `key` name their columns (the first by default of the same name). A part is a row group; those whose statistics exclude a filter are never opened."""

    name = "parquet"
    pushable = frozenset({"source_url", "title", "place"})

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self._columns = {"source_url": options.get("url", "url"), "title": options.get("title", "title"), "summary": options.get("summary", "summary"), "place": options.get("key", "id")}

    def setup_message(self) -> str | None:
        return None if self.options.get("path") else "set the option path to a Parquet file or folder"

    def parts(self, filters: list[tuple]) -> Iterator[tuple[str, int]]:
        store, path = _open(self.options["path"])
        scheme = self.options["path"].rpartition("://")[0]
        found = store.get_file_info(path)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(path))
        for file in sorted((f.path for f in files if f.is_file and f.path.endswith(".parquet"))):
            with store.open_input_file(file) as opened:
                meta = pq.ParquetFile(opened).metadata
            for group in range(meta.num_row_groups):
                if self._may_hold(meta.row_group(group), filters):
                    yield (f"{scheme}://{file}" if scheme else file), group

    def _may_hold(self, group, filters: list[tuple]) -> bool:
        held = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        for column, operation, value in filters:
            known = held.get(self._columns[column])
            if known is None or not known.has_min_max:
                continue
            values = value if operation is In else (value,)
            least, most = known.min, known.max
            if operation in (EqualTo, In) and not any(least <= v <= most for v in values) or operation is GreaterThan and most <= value or operation is GreaterThanOrEqual and most < value or operation is LessThan and least >= value or operation is LessThanOrEqual and least > value:
                return False
        return True

    def items(self, part: tuple[str, int], filters: list[tuple]) -> Iterator[pa.RecordBatch]:
        uri, group = part
        store, path = _open(uri)
        with store.open_input_file(path) as opened:
            file = pq.ParquetFile(opened)
            present = {k: c for k, c in self._columns.items() if c in file.schema_arrow.names}
            for batch in file.iter_batches(row_groups=[group], columns=list(present.values())):
                table = pa.table({k: batch.column(batch.schema.get_field_index(c)) for k, c in present.items()})
                for column, operation, value in filters:
                    values = table.column(column)
                    table = table.filter(pc.is_in(values, pa.array(value, values.type)) if operation is In else _COMPARE[operation](values, value))
                columns = {k: table.column(k).cast(_ARROW.field(k).type) if k in present else pa.nulls(table.num_rows, _ARROW.field(k).type) for k in _NAMES}
                columns |= {"connector": pa.array([self.name] * table.num_rows, pa.string()), "outcome": pa.array(["item"] * table.num_rows, pa.string()), "source_type": pa.array([self.options.get("source_type", self.name)] * table.num_rows, pa.string())}
                yield from pa.table([columns[n] for n in _NAMES], schema=_ARROW).to_batches()


class FeedConnector(Connector):
    """Landed feed documents: `feeds` is a JSON list of {name, url, path}; a part is a feed, whose body is the summary for `feeds.feed_items` to take apart."""

    name = "feeds"
    pushable = frozenset({"title"})

    def setup_message(self) -> str | None:
        return None if json.loads(self.options.get("feeds") or "[]") else "set the option feeds to a list of {name, url, path}"

    def parts(self, filters: list[tuple]) -> list[dict]:
        names = [value if operation is In else (value,) for _, operation, value in filters if operation in (EqualTo, In)]
        return [f for f in json.loads(self.options["feeds"]) if all(f.get("name") in n for n in names)]

    def items(self, part: dict, filters: list[tuple]) -> Iterator[dict]:
        store, path = _open(part["path"])
        with store.open_input_file(path) as opened:
            yield {"source_type": "rss", "source_url": part.get("url"), "title": part.get("name"), "summary": opened.read().decode("utf-8", "replace")}


class ConnectorReader(DataSourceReader):
    def __init__(self, connector: Connector):
        self._connector, self._filters = connector, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a pushable column with a value go to the connector; the rest is left to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self._connector.pushable and type(f) in (*_COMPARE, In):
                self._filters.append((column, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        if self._connector.setup_message() is not None:
            return [Part(None)]
        return [Part(p) for p in self._connector.parts(self._filters)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch | tuple]:
        row = lambda **given: pa.RecordBatch.from_pylist([{n: given.get(n) for n in _NAMES}], schema=_ARROW)
        name, message = self._connector.name, self._connector.setup_message()
        if message is not None:
            yield row(connector=name, outcome="not_configured", message=message)
            return
        try:
            for item in self._connector.items(partition.value, self._filters):
                yield item if isinstance(item, pa.RecordBatch) else row(**{"connector": name, "outcome": "item"} | item)
        except Exception as error:  # noqa: BLE001  a part that fails is reported and the others are still read
            yield row(connector=name, outcome="error", message=f"{partition.value}: {type(error).__name__}: {str(error)[:300]}")


class ConnectorSource(DataSource):
    """spark.read.format("brightvane"): see the module's text."""

    @classmethod
    def name(cls) -> str:
        return "brightvane"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ConnectorReader:
        module = importlib.import_module(self.options["module"]) if self.options.get("module") else None
        known = {c.name: c for c in (ParquetConnector, FeedConnector, *(vars(module).values() if module else ())) if isinstance(c, type) and issubclass(c, Connector)}
        asked = self.options.get("connector", "")
        if asked not in known:
            raise ValueError(f"no connector {asked!r}; there are {sorted(set(known) - {Connector.name})}")
        return ConnectorReader(known[asked](dict(self.options)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it push filters to connectors."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ConnectorSource)
