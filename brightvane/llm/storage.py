"""Shared-folder materialisation, numbering by ranges, and components of link tables."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a local session gets one of its own; a cluster, whose executors would not see it, gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
            folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: a cut lineage that outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path within it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        path = rest if scheme == "file" else uri
        return fs.LocalFileSystem(), "/" + path.lstrip("/") if path.startswith("/") else path
    return fs.FileSystem.from_uri(uri)


def task_file(folder: str, number: int, kind: str) -> str:
    """A file name no other task or attempt uses. List it in a table that Spark commits: files of lost attempts are then never read."""
    task = TaskContext.get()
    return f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}-{number:04d}.{kind}"


def write_file(uri: str, data: bytes) -> None:
    where, path = store(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path) as out:
        out.write(data)


def read_file(uri: str) -> bytes:
    where, path = store(uri)
    with where.open_input_file(path) as file:
        return file.read()


def dealt(files: DataFrame, path: str) -> DataFrame:
    """A table of a row a file, dealt over all tasks, or a few of them would read all the files."""
    return files.repartition(max(1, min(files.count(), 4 * files.sparkSession.sparkContext.defaultParallelism)), path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def without(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose keys (an id and a digest of the text, say) are not those of a row of gone. Nulls equal nulls."""
    marks = [f"key to drop {k}" for k in range(len(keys))]
    found = gone.toDF(*marks).distinct().hint("shuffle_hash")
    same = [key.eqNullSafe(F.col(f"`{mark}`")) for key, mark in zip(keys, marks, strict=True)]
    return docs.join(found, functools.reduce(lambda x, y: x & y, same), "left_anti")


#: Of a row's number by monotonically_increasing_id: the bits that count within a partition.
_WITHIN = 33


def running(df: DataFrame, order: list[str], out: str, weight: str | None = None) -> DataFrame:
    """Adds `out`: how many rows (or how much `weight`) come before each row in `order`, nulls first, without one task.

    Rows are dealt by sampled ranges of `order` and sorted inside each; the totals of
    the ranges before, one row a range, are broadcast. Rows equal in all of `order`
    share a range, so end `order` with a column that tells rows apart.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    cut = cut.withColumn("_range", F.shiftright("_at", _WITHIN))
    inside = F.col("_at").bitwiseAND((1 << _WITHIN) - 1)
    if weight is not None:
        inside = F.coalesce(F.sum(weight).over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = cut.groupBy("_range").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    placed = cut.withColumn("_inside", inside).join(F.broadcast(offsets), F.col("_range") == F.col("_of"))
    return placed.select(*df.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(out))


#: A key with more rows than this, and than HUB_SHARE of all, is joined by broadcast: there are at most 1 / HUB_SHARE of those.
HUB, HUB_SHARE = 20_000, 0.002


def attach(df: DataFrame, lookup: DataFrame, key: str, rows: int, least: int | None = None) -> DataFrame:
    """Inner join of df with lookup(key, columns, `_count`), one row for each key with its rows in df, without one task for a hot key.

    `rows` is an upper bound of df's rows. Keys of more than HUB_SHARE of them (and
    than `least`), 500 at most, are broadcast; all others are shuffled. `_count` is
    dropped, null keys go.
    """
    plain = [c for c in lookup.columns if c not in (key, "_count")]
    bound = max(HUB if least is None else least, int(rows * HUB_SHARE))
    if rows <= bound:
        return df.join(lookup.drop("_count"), key)
    hot = lookup.where(F.col("_count") > bound).drop("_count")
    mark = hot.select(F.col(key).alias("_hot"))
    marked = df.join(F.broadcast(mark), df[key] == mark["_hot"], "left")
    cold = marked.where("_hot is null").drop("_hot").join(lookup.where(F.col("_count") <= bound).drop("_count"), key)
    return df.join(F.broadcast(hot), key).select(key, *[c for c in df.columns if c != key], *plain).union(cold.select(key, *[c for c in df.columns if c != key], *plain))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links(a, b): (node, component) with the smallest node reachable.

    Alternates large-star and small-star steps until the table no longer changes;
    each step is a grouped minimum (combined on the map side) and an equi-join in
    which hubs are broadcast (`attach`), so a node with very many neighbours is never
    gathered. Each step that changes the table lowers some end, so the steps end. Only
    a count and a checksum reach the driver. Null ends and self-links are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = materialise(edges, "links")
    state = _summary(edges)
    while state[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_count"))
        large = attach(both, low, "u", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_count"))
        small = attach(large, low, "u", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialise(small, "links")
        new = _summary(after)
        discard(edges)
        edges = after
        if new == state:
            break
        state = new
    top = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().join(top, F.col("node") == top["u"], "left_anti").select("node", F.col("node").alias("component"))
    return top.select(F.col("u").alias("node"), "component").union(roots)


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
