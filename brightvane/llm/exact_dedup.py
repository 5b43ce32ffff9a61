"""Exact duplicates by a heavy-hitter split, in DataFrame operations only.

A frequent-items summary of bounded size (Misra-Gries counters, merged from all
tasks) names digests that may be frequent. Their true counts and smallest ids are
then computed, and those that really are frequent become the broadcast *winners*:
their rows are decided on the map side. All other digests are rare, so ordinary
shuffling by digest is even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, without

#: Counters of the summary, and so the most winners that are ever broadcast.
COUNTERS = 4096
WINNERS = 1024
#: A digest with at least so many rows is frequent.
FREQUENT = 64


def normalised(text) -> F.Column:
    """The text in which each run of [\\x20\\x09-\\x0D] is one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, counters: int = COUNTERS, winners: int = WINNERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts have one SHA-256. The smallest id of
    a group stays. A null text equals the empty text. Rows with a null id form
    groups too: null sorts after all ids, so such a row stays (with null keep_id)
    only when no row of its group has an id, and then all of them do. If ids are
    repeated, each row that bears the group's smallest id is kept. An empty table
    gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
    base = materialise(base, "digests")
    summary = base.agg(F.expr(f"approx_top_k(hex(digest), {winners}, {counters})").alias("top"))
    suspects = summary.select(F.explode("top").alias("x")).where(F.col("x.count") >= frequent).select(F.unhex("x.item").alias("digest"))
    # at most `winners` rows of 32 bytes each: the bound of the summary
    verified = base.join(F.broadcast(suspects), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where(F.col("n") >= frequent)
    verified = materialise(verified, "winners")
    split = base.join(F.broadcast(verified), "digest", "left")
    hot = split.where(F.col("n").isNotNull()).select("doc_id", "digest", "first_id", "n")
    rare = base.join(F.broadcast(verified), "digest", "left_anti")
    same = Window.partitionBy("digest")
    rest = rare.select("doc_id", "digest", F.min("doc_id").over(same).alias("first_id"), F.count(F.lit(1)).over(same).alias("n"))
    return hot.unionByName(rest).select("doc_id", F.col("first_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("first_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; texts are moved at most once.

    Rows go by id and digest together: where an id is repeated with another text, that
    text is judged for itself, and a row without an id goes if its text has one
    elsewhere. Rows alike in both stay together. Columns may bear any name.
    """
    gone = exact_groups(docs, id_col, text_col).where(~F.col("kept")).select("doc_id", "text_sha256")
    return without(docs, [docs[id_col].cast("long"), F.sha2(normalised(docs[text_col]), 256)], gone)
