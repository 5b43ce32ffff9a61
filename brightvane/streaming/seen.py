"""Duplicates of a stream against everything seen (L-02, L-06): all four layers over an incremental index, first writer wins, rediscoveries merged.

Each micro-batch is looked up in an inverted index of the sources kept so far, in
buckets of its keys' hash, so that only the buckets a batch has keys for are read:

* URLs and content hashes under themselves;
* titles under the keys of `dedupe.title_keys`, by domain;
* bodies of n shingles under their first n - ceil(n * 0.72) + 1 in the order of
  their hashes, by domain: two bodies as similar as that share one of those.

The order of keys is fixed, not by frequency, so what was indexed stays right as the
index grows. A batch's files are named by its number and written once more if it
is run again, and a batch reads those of smaller numbers only: each counts once.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalize_for_hash, shingles, word_count, words
from ..functions.urls import domain_of, normalize_url
from ..operators import dedupe
from ..shared import settle

BUCKETS = 64
KEYS = "kind string, source_id long, block string, key long, n int, _b0 long, _b1 long, _b2 long, _b3 long, at timestamp, bucket int, batch long"
SETS = "source_id long, title string, set array<long>, at timestamp, bucket int, batch long"
VERDICTS = "source_id long, kept boolean, matched_id long, method string, score double, search_query string, source_type string, source_url string, at timestamp, batch long"


class SeenStore:
    """An index in `folder`, which all executors see. Call it with each micro-batch, as foreachBatch does.

    Rows: source_id long (rising as items arrive), source_url, title, cleaned_text,
    search_query, source_type and `at`, a timestamp. Sources seen longer than `days`
    before a batch's newest item no longer count; null keeps them for ever.
    """

    def __init__(self, spark: SparkSession, folder: str, days: int | None = None, compose: bool = True):
        self.spark, self.folder, self.days, self.compose = spark, folder, days, compose

    def _read(self, table: str, schema: str, batch_id: int | None = None) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        return rows if batch_id is None else rows.where(F.col("batch") < batch_id)

    def _write(self, rows: DataFrame, table: str, batch_id: int) -> None:
        by = ["bucket"] if "bucket" in rows.columns else []
        (rows.repartition(*by) if by else rows).write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{table}/batch={batch_id}")

    def _features(self, rows: DataFrame) -> DataFrame:
        text, domain = F.coalesce("cleaned_text", F.lit("")), domain_of(F.col("source_url"))
        title = F.array_sort(F.array_distinct(words(F.translate(dedupe.normalize_title(F.col("title")), "\x1c\x1d\x1e\x1f", "    "))))
        long = word_count(dedupe.normalize_title(F.col("title"))) >= 4
        body = F.array_sort(F.array_distinct(F.transform(shingles(normalize_for_hash(text, self.compose), compose=False), lambda s: F.xxhash64(s))))
        return rows.select(
            "source_id", "at", domain.alias("block"), normalize_url(F.col("source_url")).alias("url"), F.when(text != "", content_hash(text, self.compose)).alias("hash"),
            F.when(long, title).alias("title"), F.when(word_count(text) >= dedupe.BODY_WORDS, body).alias("set"),
        )

    def _keys(self, made: DataFrame) -> DataFrame:
        """(kind, source_id, block, key, n, bits, at, bucket) of features."""
        none = [F.lit(0).cast("long").alias(b) for b in dedupe._BITS]
        plain = lambda kind, key, n, block: made.where(key.isNotNull() & (key != "")).select(F.lit(kind).alias("kind"), "source_id", block.alias("block"), F.xxhash64(key).alias("key"), n.alias("n"), *none, "at")
        out = plain("url", F.col("url"), F.lit(0), F.lit("")).union(plain("hash", F.col("hash"), F.lit(0), F.lit("")))
        n = F.size("set")
        prefix = F.slice("set", F.lit(1), (n - F.ceil(n * F.lit(dedupe.BODY_LEAST)) + 1).cast("int"))
        out = out.union(made.where("set is not null").select(F.lit("body").alias("kind"), "source_id", "block", F.explode(prefix).alias("key"), n.alias("n"), *none, "at"))
        titled = made.where("title is not null and block is not null").select(F.col("source_id").alias("_id"), F.col("block").alias("_block"), F.col("title").alias("_words"))
        for kind in ("words", "heads", "rare"):
            found = titled.mapInPandas(dedupe._title_keys(kind, dedupe.TITLE_LEAST, Counter(), Counter()), dedupe._KEY_SCHEMA)
            found = found.join(made.select(F.col("source_id").alias("_id"), "at"), "_id")
            out = out.union(found.select(F.lit(kind), "_id", "_block", F.xxhash64("_f"), "_n", *dedupe._BITS, "at"))
        return out.withColumn("bucket", F.pmod(F.xxhash64("kind", "block", "key"), F.lit(BUCKETS)).cast("int"))

    def _pairs(self, mine: DataFrame, made: DataFrame, keys: DataFrame, sets: DataFrame) -> DataFrame:
        """(source_id, matched_id, method, score) of a batch's rows with earlier ones, of the index or the batch."""
        near = {"url": ("url",), "hash": ("hash",), "body": ("body",), "heads": ("words",), "words": ("heads",), "rare": ("rare",)}
        kinds = F.create_map(*[F.lit(x) for k, (other,) in near.items() for x in (k, other)])
        left = mine.withColumn("other", kinds[F.col("kind")])
        right = keys.select(F.col("kind").alias("other"), "block", "key", F.col("source_id").alias("matched_id"), F.col("n").alias("m"), *[F.col(b).alias(f"o{b}") for b in dedupe._BITS])
        met = left.join(right, ["other", "block", "key"]).where("matched_id < source_id")
        body = F.least("n", "m") >= F.greatest("n", "m") * dedupe.BODY_LEAST
        # of the many that share a word of a title only those whose lengths and letters allow the score are compared
        t = dedupe.TITLE_LEAST / 100
        both, slack = F.col("n") + F.col("m"), 1e-6
        lacks = lambda a, b, n: dedupe._bits(lambda c: F.col(a(c)).bitwiseAND(F.bitwise_not(b(c)))) <= n * (1 - t / (2 - t)) + slack
        own, others = (lambda c: c), (lambda c: f"o{c}")
        alike = (F.abs(F.col("n") - F.col("m")) <= both * (1 - t) + slack) & (dedupe._bits(lambda c: F.col(c).bitwiseXOR(F.col(f"o{c}"))) <= both * (3 - 3 * t) + slack)
        fits = F.when(F.col("kind") == "body", body).when(F.col("kind") == "heads", lacks(own, others, F.col("n"))).when(F.col("kind") == "words", lacks(others, own, F.col("m"))).when(F.col("kind") == "rare", alike).otherwise(True)
        layer = F.when(F.col("kind").isin("heads", "words", "rare"), "title").otherwise(F.col("kind"))
        met = met.where(fits).select("source_id", "matched_id", layer.alias("layer")).distinct()
        exact = met.where(F.col("layer").isin("url", "hash")).select("source_id", "matched_id", F.when(F.col("layer") == "url", "canonical_url").otherwise("content_hash").alias("method"), F.lit(1.0).alias("score"))
        far = sets.select(F.col("source_id").alias("matched_id"), F.col("title").alias("_title"), F.col("set").alias("_set"))
        joined = F.array_join("title", " ")
        some = met.where(F.col("layer").isin("title", "body")).join(made.select("source_id", joined.alias("title"), "set"), "source_id").join(far, "matched_id")
        titles = some.where("layer = 'title'").select("source_id", "matched_id", F.lit("title").alias("method"), (dedupe.title_ratio("title", "_title") / 100).alias("score")).where(F.col("score") >= dedupe.TITLE_LEAST / 100)
        shared = F.size(F.array_intersect("set", "_set"))
        bodies = some.where("layer = 'body'").select("source_id", "matched_id", F.lit("body").alias("method"), (shared / (F.size("set") + F.size("_set") - shared)).alias("score")).where(F.col("score") >= dedupe.BODY_LEAST)
        return exact.unionByName(titles).unionByName(bodies)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.spark = batch.sparkSession
        batch = settle(batch)
        if batch.isEmpty():
            return
        made = settle(self._features(batch))
        mine = settle(self._keys(made))
        buckets = [r[0] for r in mine.select("bucket").distinct().collect()]  # BUCKETS at most
        live = F.lit(True)
        if self.days is not None:
            live = F.col("at") >= F.lit(batch.agg(F.max("at")).first()[0]) - F.make_dt_interval(F.lit(self.days))
        keys = self._read("keys", KEYS, batch_id).where(F.col("bucket").isin(buckets) & live).drop("batch").unionByName(mine)
        held = F.pmod(F.xxhash64("source_id"), F.lit(BUCKETS)).cast("int")
        own = made.select("source_id", F.array_join("title", " ").alias("title"), "set", "at", held.alias("bucket"))
        sets = self._read("sets", SETS, batch_id).where(live).drop("batch").unionByName(own)
        pairs = settle(self._pairs(mine, made, keys, sets))
        # what an earlier batch has kept stays kept
        ids = made.select("source_id").union(pairs.select("matched_id")).distinct()
        kept = dedupe.keep_greedily(pairs, ids)
        against = pairs.join(kept.where("kept").select(F.col("source_id").alias("matched_id")), "matched_id", "left_semi")
        verdict = dedupe.verdicts(against).select("source_id", "matched_id", "method", "score")
        out = settle(batch.select("source_id", "search_query", "source_type", "source_url", "at").join(kept, "source_id").join(verdict, "source_id", "left"))
        stays = out.where("kept").select("source_id")
        self._write(mine.join(stays, "source_id", "left_semi"), "keys", batch_id)
        self._write(own.join(stays, "source_id", "left_semi"), "sets", batch_id)
        self._write(out, "verdicts", batch_id)

    def verdicts(self) -> DataFrame:
        """What became of each item: kept, or the kept source it repeats, by which layer and how closely."""
        return self._read("verdicts", VERDICTS).drop("batch")

    def rediscoveries(self) -> DataFrame:
        """E-07 over the stream: per kept source its queries, channels and URLs in order of arrival, how often and when it was last found again."""
        rows = self.verdicts().withColumn("keep_id", F.when(F.col("kept"), F.col("source_id")).otherwise(F.col("matched_id")))
        return dedupe.merged(rows).join(rows.groupBy("keep_id").agg(F.max(F.when(~F.col("kept"), F.col("at"))).alias("last_rediscovered_at")), "keep_id")
