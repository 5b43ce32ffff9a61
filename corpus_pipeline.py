"""From raw documents to packed training sequences: five stages, each an operator of brightvane.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brightvane.llm import exact_dedup, language_id, ngram_join, packing, quality_fm
from brightvane.llm.storage import materialise


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null and empty ones too) and those of no clear language. Rows that repeat an id, or have none, are judged each for itself; where no text has a language, all with a letter stay."""
    return language_id.keep_identified(docs, language_id.train_language_model(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the quality classifier predicts as label 0, null and empty ones judged as empty; where the labels are not of both kinds, none is dropped."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_fm.keep_good(docs, quality_fm.train_quality(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of equal texts, of which null and empty ones are one. Rows without an id stay, as do all rows of the id kept."""
    return exact_dedup.drop_exact_duplicates(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates. Texts without words are in no group; rows without an id stay."""
    return ngram_join.keep_representatives(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into sequences of 2048 tokens; a null text is empty, and so a piece of its end token alone. An empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", identified), ("quality classifier", good), ("exact dedup", distinct), ("n-gram Jaccard join", dissimilar), ("best-fit packing", packed)]

#: Two stages are trained models, so no SQL gives these rows; the tests rebuild them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
