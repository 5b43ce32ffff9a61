"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's features are its lower-cased words hashed to buckets, each occurrence
with weight 1/words; standardised statistics of its structure; and its recorded
length. The score is sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum
(v_if x_i)^2)): all pairwise interactions in time linear in the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .sampling import capped, fold, stratified
from .textkernel import _SYMBOL, blocks, span_hashes, word_hashes, word_spans

BUCKET_BITS, RANK = 16, 8
#: Bound of the training sample: labelled texts of each label.
TEXTS_PER_LABEL = 2500
THRESHOLD = 0.7
#: Small samples are gone through again until the training has so many steps.
LEAST_STEPS = 300
#: Interaction and word weights meet means, which are small; this scales them up.
_WORD_SCALE = 8.0


def _kinds() -> np.ndarray:
    """Byte kinds: 0 white, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 exclamation or question, 6 quote or bracket, 7 other symbol, 8 non-ASCII lead, 9 continuation, 10 control, 11 pipe or angle."""
    out = np.full(256, 7, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            out[b] = 8
        elif b >= 0x80:
            out[b] = 9
        elif b == 0x20 or 9 <= b <= 13:
            out[b] = 0
        elif b < 0x20 or b == 0x7F:
            out[b] = 10
        elif c.islower():
            out[b] = 1
        elif c.isupper():
            out[b] = 2
        elif c.isdigit():
            out[b] = 3
        elif c in ".,;:":
            out[b] = 4
        elif c in "!?":
            out[b] = 5
        elif c in "'\"()[]{}-":
            out[b] = 6
        elif c in "|<>/\\":
            out[b] = 11
    return out


_KIND = _kinds()
STATISTICS = 21


def statistics(raw: np.ndarray, at: np.ndarray, n_chars: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """(texts, STATISTICS) structure and metadata of each text."""
    n = len(at) - 1
    length = np.diff(at).astype(np.float64)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    kinds = np.bincount(doc * 12 + _KIND[raw], minlength=n * 12).reshape(n, 12).astype(np.float64) if n else np.zeros((0, 12))
    starts, ends, before = word_spans(raw, at)
    words = np.diff(before).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(before))
    sizes = (ends - starts).astype(np.float64)
    final = _KIND[raw[ends - 1]] if len(ends) else np.zeros(0, dtype=np.int64)
    again = np.zeros(len(owner), dtype=bool)
    again[1:] = (buckets[1:] == buckets[:-1]) & (owner[1:] == owner[:-1])
    tally = lambda flag: np.bincount(owner, weights=flag.astype(np.float64), minlength=n)
    cut = np.flatnonzero(raw == 10)
    line_starts = np.unique(np.concatenate([at[:-1][length > 0], cut + 1])) if len(raw) else np.zeros(0, dtype=np.int64)
    line_starts = line_starts[line_starts < len(raw)]
    line_doc = np.searchsorted(at, line_starts, side="right") - 1
    line_ends = np.append(line_starts[1:], len(raw))
    hashes = span_hashes(_SYMBOL[raw], line_starts, line_ends) if len(line_starts) else np.zeros(0, dtype=np.uint64)
    by = np.lexsort((hashes, line_doc))
    same = np.zeros(len(by), dtype=bool)
    same[1:] = (hashes[by][1:] == hashes[by][:-1]) & (line_doc[by][1:] == line_doc[by][:-1])
    lines = np.bincount(line_doc, minlength=n).astype(np.float64)
    repeats = np.bincount(line_doc[by][same], minlength=n)
    some, chars = np.maximum(words, 1), np.maximum(length, 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 8], 1)
    return np.column_stack([
        kinds[:, [0, 3, 4, 5, 6, 7, 8, 10, 11]] / chars[:, None], kinds[:, 2] / letters, np.log1p(words), np.bincount(owner, weights=sizes, minlength=n) / some,
        tally(sizes > 16) / some, tally(final == 4) / some, tally(final == 5) / some, tally(final == 7) / some, np.log1p(chars / np.maximum(lines, 1)), repeats / np.maximum(lines, 1), np.log1p(lines),
        tally(again) / some, np.log1p(np.maximum(n_chars, 0)),
    ])


def word_buckets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, before = word_hashes(raw, at)
    return (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), before


class FactorisationMachine:
    """Row i of `table` is a bucket's (weight, factors, squared norm); the last STATISTICS rows of `dense` are the statistics'."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.word = np.concatenate([np.zeros((1 << BUCKET_BITS, 1)), rng.normal(0, 0.05, (1 << BUCKET_BITS, RANK))], axis=1).astype(np.float32)
        self.dense = np.concatenate([np.zeros((STATISTICS, 1)), rng.normal(0, 0.05, (STATISTICS, RANK))], axis=1).astype(np.float32)
        self.mean, self.spread = np.zeros(STATISTICS), np.ones(STATISTICS)
        self._table: np.ndarray | None = None

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4)

    def train(self, buckets: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.05, decay: float = 1e-4, seed: int = 9) -> None:
        """Adagrad on the log loss; buckets: the distinct hashed words of each text and their counts."""
        self.mean, self.spread = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        x = self.standard(stats)
        rng = np.random.default_rng(seed)
        word_sum, dense_sum, bias_sum = np.full(len(self.word), 1e-3, dtype=np.float32), np.full(self.dense.shape, 1e-3), 1e-3
        sizes = np.array([b[1].sum() for b in buckets])
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // max(1, len(labels))))):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                ids = np.concatenate([buckets[i][0] for i in pick]) if len(pick) else np.zeros(0, dtype=np.int64)
                count = np.concatenate([buckets[i][1] for i in pick]).astype(np.float64)
                row = np.repeat(np.arange(len(pick)), [len(buckets[i][0]) for i in pick])
                unit = _WORD_SCALE / np.maximum(1, sizes[pick])
                rows = self.word[ids].astype(np.float64)
                first, square = np.zeros((len(pick), RANK + 1)), np.zeros(len(pick))
                np.add.at(first, row, rows * (count * unit[row])[:, None])
                np.add.at(square, row, (rows[:, 1:] ** 2).sum(axis=1) * count * unit[row] ** 2)
                d = x[pick]
                first += d @ self.dense
                square += d**2 @ (self.dense[:, 1:] ** 2).sum(axis=1)
                logit = self.bias + first[:, 0] + 0.5 * ((first[:, 1:] ** 2).sum(axis=1) - square)
                g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]) / len(pick)
                bias_sum += g.sum() ** 2
                self.bias -= rate * g.sum() / bias_sum**0.5
                up = np.concatenate([g[:, None], g[:, None] * first[:, 1:]], axis=1)
                g_dense = d.T @ up
                g_dense[:, 1:] -= (d**2).T @ g[:, None] * self.dense[:, 1:]
                g_dense += decay * self.dense
                dense_sum += g_dense**2
                self.dense -= (rate * g_dense / np.sqrt(dense_sum)).astype(np.float32)
                weight = (count * unit[row])[:, None]
                g_word = up[row] * weight
                g_word[:, 1:] -= (g[row] * count * unit[row] ** 2)[:, None] * rows[:, 1:]
                uniq, back = np.unique(ids, return_inverse=True)
                total = np.zeros((len(uniq), RANK + 1))
                np.add.at(total, back, g_word)
                total += decay * self.word[uniq]
                word_sum[uniq] += (total**2).mean(axis=1)
                self.word[uniq] -= (rate * total / np.sqrt(word_sum[uniq])[:, None]).astype(np.float32)
        self._table = None

    def score(self, buckets: np.ndarray, before: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, by the sum-of-squares identity."""
        if self._table is None:
            self._table = np.concatenate([self.word, (self.word[:, 1:] ** 2).sum(axis=1, keepdims=True)], axis=1)
        n = len(before) - 1
        counts = np.diff(before)
        sums = np.zeros((n, RANK + 2))
        some = np.flatnonzero(counts > 0)
        if len(some):
            sums[some] = np.add.reduceat(self._table[buckets], before[:-1][some], axis=0, dtype=np.float64)
        unit = _WORD_SCALE / np.maximum(1, counts)
        first, square = sums[:, : RANK + 1] * unit[:, None], sums[:, RANK + 1] * unit**2
        d = self.standard(stats)
        first += d @ self.dense
        square += d**2 @ (self.dense[:, 1:] ** 2).sum(axis=1)
        logit = self.bias + first[:, 0] + 0.5 * ((first[:, 1:] ** 2).sum(axis=1) - square)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _lengths(column: pa.Array) -> np.ndarray:
    return np.array([0 if x is None else x for x in column.to_pylist()], dtype=np.float64)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the sampled texts: a text of any length gives at most 2**BUCKET_BITS buckets with counts."""
    for block, raw, at in blocks(batches, "_text"):
        buckets, before = word_buckets(raw, at)
        stats = statistics(raw, at, _lengths(block.column(2)), buckets)
        distinct = [np.unique(buckets[a:b], return_counts=True) for a, b in zip(before[:-1], before[1:], strict=True)]
        words, counts = (pa.array([x[k].astype("<i4").tobytes() for x in distinct], pa.binary()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), words, counts, pa.array(list(stats), pa.list_(pa.float64()))], ["id", "label", "words", "counts", "stats"])


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_col: str = "quality", held_out: int = 2, per_label: int = TEXTS_PER_LABEL) -> FactorisationMachine | None:
    """Learns from labelled texts outside the held-out fold; the intercept is set back to the labels' own shares.

    Several labels of one id count as their mean, over or under one half. None
    unless both labels occur.
    """
    seen = labels.where(F.col(label_col).isNotNull() & F.coalesce(fold(id_col, 4) != held_out, F.lit(False)))
    seen = seen.groupBy(F.col(id_col).alias("_lid")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    picked, sizes = stratified(seen, "_label", "_lid", per_label, 13)
    if set(sizes) != {0, 1}:
        return None
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (F.col(length_col) if length_col in docs.columns else F.length(text_col)).cast("double").alias("_len"))
    picked = capped(picked, "_label", ["_lid"], per_label)
    sample = texts.join(F.broadcast(picked), texts["_id"] == picked["_lid"]).select("_id", "_label", "_len", "_text")
    sample = capped(sample, "_label", ["_id", "_text"], per_label)
    rows = sorted(sample.mapInArrow(_sample_rows, "id long, label int, words binary, counts binary, stats array<double>").collect(), key=lambda r: (r["id"], r["words"], r["counts"]))
    target = np.array([r["label"] for r in rows])
    if len(set(target.tolist())) < 2:
        return None
    machine = FactorisationMachine()
    machine.train([(np.frombuffer(r["words"], dtype="<i4").astype(np.int64), np.frombuffer(r["counts"], dtype="<i4")) for r in rows], np.array([r["stats"] for r in rows]), target)
    there = target.mean()
    machine.bias += float(np.log(sizes[1] / sizes[0]) - np.log(there / (1 - there)))
    return machine


def score_quality(docs: DataFrame, machine: FactorisationMachine | None, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    A null text is scored as an empty one, from its statistics; a null length counts
    as 0. Without a model every score is 0.5. Repeated rows are scored alike; null
    ids are scored (held_out false); other columns are ignored.
    """
    length = F.col(length_col) if length_col in docs.columns else F.length(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col, 4) == 2, F.lit(False)).alias("held_out"), length.cast("double").alias("_len"), F.col(text_col).alias("_text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, raw, at in blocks(batches, "_text"):
            if machine is None:
                score = np.full(block.num_rows, 0.5)
            else:
                buckets, before = word_buckets(raw, at)
                score = machine.score(buckets, before, statistics(raw, at, _lengths(block.column(2)), buckets))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, machine: FactorisationMachine | None, text_col: str = "text", length_col: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score `threshold` or more. Without a model none can be judged, and all stay."""
    if machine is None:
        return docs
    length = docs[length_col] if length_col in docs.columns else F.length(docs[text_col])
    rows = docs.select(F.struct("*").alias("row"), length.cast("double").alias("length"))
    at_text = docs.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, raw, at in blocks(batches, lambda b: b.column(0).field(at_text)):
            buckets, before = word_buckets(raw, at)
            score = machine.score(buckets, before, statistics(raw, at, _lengths(block.column(1)), buckets))
            yield pa.RecordBatch.from_arrays([block.column(0).filter(pa.array(score >= threshold))], ["row"])

    return rows.mapInArrow(choose, StructType([StructField("row", docs.schema)])).select("row.*")
