"""Auditing drafts against evidence (K-19 to K-22, K-25)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import any_of, hits, let, normalize_unicode, rounded, sentences, words
from ..shared import settle


_WORD = re.compile(r"[a-z']{4,}")


def auditable_units(text: Column, compose: bool = True) -> Column:
    """K-19: claims of a draft: per line, without meta lines and list marks, then by sentence."""
    lines = F.filter(F.transform(F.split(normalize_unicode(text, compose), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(lists.META_LINE))
    bare = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*(?:[-—•*]|\d+\.)\s*", ""), r"^\*+|\*+$", ""))), lambda x: x != "")
    parts = lambda x: let(sentences(x, False), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(x)))
    return F.flatten(F.transform(bare, parts))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({_WORD.pattern})"), 1))


def _units(drafts: DataFrame, compose: bool) -> DataFrame:
    units = drafts.select("draft_id", F.posexplode(auditable_units(F.col("draft_text"), compose)).alias("at", "sentence"))
    low = F.lower(F.trim("sentence"))
    units = units.withColumn("low", low).where(F.size(words(F.col("low"))) >= 4)
    units = units.withColumn("head", F.left(F.regexp_replace("low", "^[\"“”' ]+|[\"“”' ]+$", ""), F.lit(60)))
    stop = F.array(*map(F.lit, lists.AUDIT_STOPWORDS))
    return units.withColumn("tokens", F.array_except(_tokens(F.col("low")), stop))


def _judged(rows: DataFrame, found: Column, joint: Column) -> DataFrame:
    future = F.lit(False)
    for m in lists.FUTURE:
        future = future | F.col("low").startswith(m) | F.contains("low", F.lit(" " + m))
    status = (
        F.when((F.col("head") != "") & found, "supported").when(any_of(F.col("low"), lists.OPINION), "opinion").when(future & ~F.contains("low", F.lit("?")), "unverifiable")
        .when(F.size("tokens") == 0, F.lit(None)).when(F.col("overlap") >= 0.6, "supported").when(F.col("overlap") >= 0.35, "partially_supported").when(joint >= 0.75, "partially_supported").otherwise("unsupported")
    )
    return rows.select("draft_id", "at", "sentence", status.alias("status"), rounded(F.col("overlap"), 2).alias("overlap"), "best_passage").where("status is not null")


def audit_sentences(drafts: DataFrame, passages: DataFrame, compose: bool = True) -> DataFrame:
    """K-20: a row per claim of drafts(draft_id, draft_text) with its status against passages(draft_id, passage_id, passage).

    Statuses in order: supported where its first 60 characters occur in the
    evidence, opinion, unverifiable, then by the share of its content words in the
    best passage (0.6 supported, 0.35 partly), or 0.75 in all of them (partly). A
    draft's claims meet only its own passages.
    """
    units = _units(drafts, compose)
    proof = passages.select("draft_id", "passage_id", F.lower("passage").alias("p"), _tokens(F.col("passage")).alias("pt"))
    corpus = proof.groupBy("draft_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage_id", "p"))), lambda x: x["p"]), " ").alias("corpus"), F.array_distinct(F.flatten(F.collect_set("pt"))).alias("ct"))
    share = F.size(F.array_intersect("tokens", "pt")) / F.greatest(F.size("tokens"), F.lit(1))
    best = units.select("draft_id", "at", "tokens").join(proof.select("draft_id", "passage_id", "pt"), "draft_id").withColumn("share", share)
    best = best.groupBy("draft_id", "at").agg(F.max("share").alias("overlap"), F.max_by("passage_id", F.struct("share", -F.col("passage_id"))).alias("best_passage"))
    rows = units.join(corpus, "draft_id", "left").join(best, ["draft_id", "at"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    joint = F.size(F.array_intersect("tokens", F.coalesce("ct", F.array().cast("array<string>")))) / F.greatest(F.size("tokens"), F.lit(1))
    return _judged(rows, F.contains(F.coalesce("corpus", F.lit("")), F.col("head")), joint)


#: Characters of evidence in a block, bytes of it in a range, and claims held against a block at once.
BLOCK_CHARS, RANGE_BYTES, CLAIMS = 1_000_000, 64_000_000, 20_000
#: What a claim is looked up by; no more of a text beyond a block's end is needed.
HEAD = 60


def evidence_blocks(items: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, ids, texts, beyond) of items(passage_id, passage): runs of passages in order of about `chars` characters, and how the text goes on after each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, texts, size, number = [], [], 0, 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text or "")
                if size >= chars:
                    yield pa.RecordBatch.from_pydict({"block": [part << 32 | number], "ids": [ids], "texts": [texts]}, schema=_BLOCK)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_pydict({"block": [part << 32 | number], "ids": [ids], "texts": [texts]}, schema=_BLOCK)

    low = items.select(F.col("passage_id").cast("long").alias("passage_id"), F.lower("passage").alias("p"))
    ranges = 1 + (low.agg(F.sum(F.octet_length("p"))).first()[0] or 0) // RANGE_BYTES
    blocks = settle(low.repartitionByRange(ranges, "passage_id").sortWithinPartitions("passage_id").mapInArrow(cut, "block long, ids array<long>, texts array<string>"))
    begins = blocks.select("block", F.left(F.array_join("texts", " "), F.lit(HEAD)).alias("begin"))
    # a narrow row a block: only the last of a range can be short, so the next few always suffice
    after = Window.orderBy("block").rowsBetween(1, 3)
    return blocks.join(begins.select("block", F.left(F.array_join(F.collect_list("begin").over(after), " "), F.lit(HEAD)).alias("beyond")), "block")


_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])


def _held_against(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """claims(draft_id, at, head, tokens) with `found`, the best `overlap` and its `best_passage`, and the tokens found anywhere (`hits`), over all blocks.

    Claims are dealt into groups, and each group meets each block in a task, which makes
    the block's index from word to passages.
    """
    names = blocks.select("block").collect()  # a number a block
    groups = max(1, -(-claims.count() // CLAIMS))
    asked = claims.withColumn("block", F.explode(F.array(*[F.lit(r["block"]).cast("long") for r in names]))).withColumn("group", F.pmod(F.xxhash64("draft_id", "at"), F.lit(groups)).cast("int"))
    dealt = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def against(rows: pd.DataFrame, evidence: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=["draft_id", "at", "found", "overlap", "best_passage", "hits"])
        ids, texts, beyond = evidence.iloc[0][["ids", "texts", "beyond"]]
        corpus = " ".join([*(t for t in texts if t is not None), beyond])
        index: dict[str, list[int]] = {}
        for i, text in enumerate(texts):
            for w in dict.fromkeys(_WORD.findall(text or "")):
                index.setdefault(w, []).append(i)
        places = {w: np.array(x) for w, x in index.items()}
        out = []
        for draft, at, head, tokens in zip(rows["draft_id"], rows["at"], rows["head"], rows["tokens"], strict=True):
            n, hits = np.zeros(len(ids), dtype=np.int32), []
            for k, w in enumerate(tokens):
                where = places.get(w)
                if where is not None:
                    n[where] += 1
                    hits.append(k)
            best = int(n.argmax())
            out.append((draft, at, head in corpus, n[best] / max(len(tokens), 1), int(ids[best]), hits))
        return pd.DataFrame(out, columns=["draft_id", "at", "found", "overlap", "best_passage", "hits"])

    met = asked.groupBy("block", "group").cogroup(dealt.groupBy("block", "group")).applyInPandas(against, "draft_id long, at int, found boolean, overlap double, best_passage long, hits array<int>")
    best = F.max(F.struct("overlap", (-F.col("best_passage")).alias("other")))
    whole = met.groupBy("draft_id", "at").agg(F.max("found").alias("found"), best.alias("best"), F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    return whole.select("draft_id", "at", "found", F.col("best.overlap").alias("overlap"), (-F.col("best.other")).alias("best_passage"), "hits")


def audit_shared(drafts: DataFrame, items: DataFrame, compose: bool = True, chars: int = BLOCK_CHARS) -> DataFrame:
    """K-20 where every draft has all passages of items(passage_id, passage) as evidence: the rows of audit_sentences with each passage given to each draft. Neither side is held as a whole anywhere."""
    units = settle(_units(drafts, compose))
    found = _held_against(units.select("draft_id", "at", "head", "tokens"), evidence_blocks(items, chars))
    rows = units.join(found, ["draft_id", "at"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    return _judged(rows, F.coalesce("found", F.lit(False)), F.coalesce("hits", F.lit(0)) / F.greatest(F.size("tokens"), F.lit(1)))


def audit_scores(audited: DataFrame) -> DataFrame:
    """K-20: per draft its counts and evidence score."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = audited.groupBy("draft_id").agg(*[n(s) for s in ("supported", "partially_supported", "unsupported", "opinion", "unverifiable")])
    facts = F.col("supported") + F.col("partially_supported") + F.col("unsupported")
    return out.withColumn("evidence_score", F.when(facts > 0, rounded((F.col("supported") + 0.5 * F.col("partially_supported")) / facts * 100, 1)).otherwise(0.0))


def _numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(lists.AUDIT_NUMBER))


def _claimed(drafts: DataFrame) -> DataFrame:
    """(draft_id, numbers, quotes, banned_phrases): what a draft states that evidence should hold; years and single digits need none."""
    numbers = F.filter(F.array_distinct(_numbers(F.col("draft_text"))), lambda x: ~F.replace(x, F.lit(",")).rlike(r"^(19|20)\d{2}$") & (F.length(F.replace(x, F.lit("%"))) > 1))
    banned = F.filter(F.array(*[F.when(F.contains(F.lower("draft_text"), F.lit(p)), F.lit(p)) for p in lists.BANNED]), lambda x: x.isNotNull())
    return drafts.select("draft_id", numbers.alias("numbers"), F.regexp_extract_all("draft_text", F.lit(lists.AUDIT_QUOTE)).alias("quotes"), banned.alias("banned_phrases"))


def fabrications(drafts: DataFrame, passages: DataFrame) -> DataFrame:
    """K-21: per draft the numbers and quotes that its evidence lacks, and banned phrases."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage_id", F.lower("passage").alias("p")))), lambda x: x["p"]), " ")
    rows = _claimed(drafts).join(passages.groupBy("draft_id").agg(joined.alias("corpus")), "draft_id", "left").withColumn("corpus", F.coalesce("corpus", F.lit("")))
    new = F.array_except("numbers", _numbers(F.col("corpus")))
    quotes = F.filter("quotes", lambda q: ~F.contains(F.col("corpus"), F.left(F.lower(q), F.lit(HEAD))))
    return rows.select("draft_id", F.array_sort(new).alias("invented_numbers"), quotes.alias("invented_quotes"), "banned_phrases")


def fabrications_shared(drafts: DataFrame, items: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """K-21 where every draft has all passages of items(passage_id, passage) as evidence: numbers are joined with those of the passages, quotes are held against blocks of them."""
    claimed = settle(_claimed(drafts))
    known = items.select(F.explode(F.array_distinct(_numbers(F.lower("passage")))).alias("number")).distinct()
    new = claimed.select("draft_id", F.explode("numbers").alias("number")).join(known, "number", "left_anti").groupBy("draft_id").agg(F.array_sort(F.collect_list("number")).alias("invented_numbers"))
    said = claimed.select("draft_id", F.posexplode("quotes").alias("at", "quote"))
    found = _held_against(said.select("draft_id", "at", F.left(F.lower("quote"), F.lit(HEAD)).alias("head"), F.array().cast("array<string>").alias("tokens")), evidence_blocks(items, chars)).where("found")
    made = said.join(found.select("draft_id", "at"), ["draft_id", "at"], "left_anti").groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "quote"))), lambda x: x["quote"]).alias("invented_quotes"))
    none = F.array().cast("array<string>")
    rows = claimed.select("draft_id", "banned_phrases").join(new, "draft_id", "left").join(made, "draft_id", "left")
    return rows.select("draft_id", F.coalesce("invented_numbers", none).alias("invented_numbers"), F.coalesce("invented_quotes", none).alias("invented_quotes"), "banned_phrases")


def upper_median(values: Column) -> Column:
    """The middle value, the upper of two."""
    return let(values, lambda v: F.get(F.array_sort(v), F.floor(F.size(v) / 2).cast("int")))


def voice_alignment(text: Column, guide: dict, compose: bool = True) -> Column:
    """K-22: 100 less deductions against the guide of approved examples; 0 without examples."""
    if not guide.get("approved_example_count"):
        return F.lit(0.0)
    low = F.lower(text)
    lengths = F.transform(sentences(text, compose), lambda s: F.size(words(s)))
    gap = F.abs(upper_median(lengths) - F.lit(float(guide.get("median_sentence_words") or 16)))
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")
    depth = upper_median(F.transform(blocks, lambda p: F.greatest(F.size(sentences(p, False)), F.lit(1))))
    hype = any_of(low, lists.BANNED)
    score = F.lit(100.0) - let(gap, lambda g: F.when(g > 8, 20.0).when(g > 4, 8.0).otherwise(0.0)) - F.when(F.abs(depth - F.lit(float(guide.get("median_paragraph_sentences") or 2))) > 2, 12.0).otherwise(0.0)
    score = score - F.when(hype, 10.0 if guide.get("hype_terms_found") else 25.0).otherwise(0.0)
    if (guide.get("number_share") or 0) >= 50:
        score = score - F.when(text.rlike(r"\b\d"), 0.0).otherwise(10.0)
    if guide.get("recurring_themes"):
        score = score - F.when(any_of(low, [t.lower().split()[0] for t in guide["recurring_themes"]]), 0.0).otherwise(5.0)
    if guide.get("coverage_warning"):
        score = score * 0.8
    return rounded(F.greatest(F.lit(0.0), F.least(score, F.lit(100.0))), 1)


def source_links(drafts: DataFrame, opportunities: DataFrame, sources: DataFrame) -> DataFrame:
    """K-25: a draft's sources: those it cites, else its opportunity's."""
    rows = drafts.join(opportunities.select("opportunity_id", F.col("source_ids").alias("_ids")), "opportunity_id", "left")
    cited = F.when(F.size("cited_source_ids") > 0, F.col("cited_source_ids")).otherwise(F.col("_ids")) if "cited_source_ids" in drafts.columns else F.col("_ids")
    return rows.select("draft_id", F.explode(F.array_distinct(cited)).alias("source_id")).join(sources.select("source_id", "title", "source_url"), "source_id")


def latest_draft(drafts: DataFrame) -> DataFrame:
    w = Window.partitionBy("opportunity_id").orderBy(F.desc("draft_id"))
    return drafts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
