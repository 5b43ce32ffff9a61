"""Shards of equal row counts whose source mixture matches the corpus.

Rows are shuffled by a seeded hash and ranked within their source; a row of rank r
of n gets the fractional rank (r + u) / n, where u in [0, 1) is the source's own
phase, a seeded hash of it, so that small sources do not all fall on one place.
Sorting all rows by that interleaves the sources in proportion, and cutting the order
into equal parts gives shards that each hold the same mixture, to within one row a
source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import attach, discard, running

OVERHEAD = 16
_UNIT = float(1 << 53)
_TIES = ("doc_id", "text_crc32", "size", "tie")


def _key(source_col: str) -> Column:
    """The source as a key that is never null: `-` for a null one, else `=` and its text."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))


def stratified_shards(docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law `rows`: shard sizes differ by one row at most. A null text has no bytes; a
    null source is a source of its own; equal texts are separate rows. Rows alike in
    id, source and text have places next to each other in an arbitrary order, and are
    still dealt over many tasks. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(source_col), text)
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), _key(source_col).alias("source"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        (F.shiftrightunsigned(key, 11).cast("double") / _UNIT).alias("spot"), F.monotonically_increasing_id().alias("tie"),
    )
    ranked = running(base, ["source", "spot", *_TIES], "at")
    rows = ranked.count()
    sources = ranked.groupBy("source").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("of")).withColumn("_count", F.col("of"))
    phase = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("source")), 11).cast("double") / _UNIT
    whole = attach(ranked, sources, "source", rows).withColumn("part", (F.col("at") - F.col("start") + phase) / F.col("of"))
    placed = running(whole.drop("at", "start", "of"), ["part", "spot", *_TIES], "place")
    discard(ranked)
    exact = F.expr(f"cast(place * {shards} div {max(rows, 1)} as long)")
    start = F.expr(f"cast((cast(place * {shards} div {max(rows, 1)} as long) * {max(rows, 1)} + {shards - 1}) div {shards} as long)")
    return placed.select("doc_id", F.expr("if(source = '-', null, substr(source, 2))").alias("source"), "size", "text_crc32", F.lit("rows").alias("law"), exact.cast("int").alias("shard"), (F.col("place") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
