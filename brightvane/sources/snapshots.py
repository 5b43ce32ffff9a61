"""Tables replaced as a whole (A-13) by snapshots: data first, then a numbered manifest that names it. A reader takes the last whole manifest, so there is a table at every moment, on stores without atomic renames too."""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession

#: Snapshots kept, so that a reader that began before a commit can finish.
KEPT = 3
_MANIFESTS = "_manifests"


def _store(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def _numbers(spark: SparkSession, path: str) -> list[int]:
    store, at = _store(spark, path)
    folder = at(f"{path}/{_MANIFESTS}")
    if not store.exists(folder):
        return []
    names = (f.getPath().getName() for f in store.listStatus(folder))
    return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def _manifest(spark: SparkSession, path: str, number: int) -> dict | None:
    """A manifest, or None if it is not whole: its first line is the checksum of the second."""
    text = "\n".join(r.value for r in spark.read.text(f"{path}/{_MANIFESTS}/{number:012d}.json").collect())
    check, _, body = text.partition("\n")
    return json.loads(body) if body and check == f"{zlib.crc32(body.encode()):08x}" else None


def versions(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """Whole manifests of a table, the latest first."""
    found = ((n, _manifest(spark, path, n)) for n in _numbers(spark, path))
    return [(n, m) for n, m in found if m is not None]


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as of its last commit (or a kept version); None if it was never committed. What is read does not change when the table is replaced."""
    for number in _numbers(spark, path):
        if version is None or number == version:
            manifest = _manifest(spark, path, number)
            if manifest is not None:
                return spark.read.schema(manifest["schema"]).parquet(f"{path}/{manifest['data']}")
    return None


def commit_snapshot(df: DataFrame, path: str, kept: int = KEPT) -> int:
    """Replaces the table at `path` by df, which may read it; gives the version.

    Two writers cannot both make a version: the later one fails with an error and
    leaves the table as the other made it. Data that no kept manifest names is
    removed only after the commit.
    """
    spark = df.sparkSession
    store, at = _store(spark, path)
    number = max(_numbers(spark, path), default=0) + 1
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    body = json.dumps({"data": data, "schema": _ddl(df), "version": number})
    out = store.create(at(f"{path}/{_MANIFESTS}/{number:012d}.json"), False)  # fails if another writer was first
    try:
        out.write(bytearray(f"{zlib.crc32(body.encode()):08x}\n{body}\n".encode()))
    finally:
        out.close()
    whole = versions(spark, path)
    for old, manifest in whole[kept:]:
        store.delete(at(f"{path}/{_MANIFESTS}/{old:012d}.json"), False)
        store.delete(at(f"{path}/{manifest['data']}"), True)
    return number


def _ddl(df: DataFrame) -> str:
    return df.sparkSession.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromJson(df.schema.json()).toDDL()
