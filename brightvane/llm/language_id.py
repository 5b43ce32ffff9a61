"""Language identification by a byte convolutional network.

The network reads fixed windows of 256 bytes: byte classes are embedded, filters
of widths 2, 3 and 4 slide over them, each is max-pooled over the window, and a
softmax layer gives languages. It is trained in numpy on labelled windows. Since
inputs are symbols, embedding and filters fold into tables of byte-class pairs, so
scoring a window is two table look-ups a byte. A text's score is the mean of its
windows' probabilities, weighted by the letters in them; all windows count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .sampling import capped, fold, stratified
from .textkernel import blocks

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 12, (2, 3, 4)
#: Bound of the training sample: windows of each language.
WINDOWS_PER_LANGUAGE = 2400
CLASSES = 128
#: Small samples are gone through again until the training has so many steps.
LEAST_STEPS = 300


def _byte_classes() -> np.ndarray:
    """ASCII letters fold case; other ASCII is white, digit or one of a few marks; continuation and lead bytes keep their values in part."""
    out = np.zeros(256, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            out[b] = 96 + ((b - 0xC0) >> 1)
        elif b >= 0x80:
            out[b] = 32 + (b - 0x80)
        elif c.isalpha():
            out[b] = 6 + ord(c.lower()) - ord("a")
        elif c.isdigit():
            out[b] = 1
        elif c in ".,;:!?":
            out[b] = 2
        elif c in "'\"`":
            out[b] = 3
        elif c == "-":
            out[b] = 4
        elif c > " ":
            out[b] = 5
    return out


_CLASS = _byte_classes()


class ByteConvNet:
    """Parameters, training and scoring of the network."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (CLASSES, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), dtype=np.float32)
        self._tables: tuple[np.ndarray, np.ndarray] | None = None

    def _params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the cross entropy; windows: (n, WINDOW) byte classes. Max pooling sends gradients to one place a filter only."""
        rng = np.random.default_rng(seed)
        params = self._params()
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // max(1, len(windows))))):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                grads = self._gradients(windows[pick], labels[pick])
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        self._tables = None

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        pooled, places = [], []
        for w, filt in zip(WIDTHS, self.filters, strict=True):
            span = WINDOW - w + 1
            act = np.zeros((n, span, FILTERS), dtype=np.float32)
            for k in range(w):
                act += (self.embed @ filt[k])[x[:, k : k + span]]
            place = act.argmax(axis=1)
            places.append(place)
            pooled.append(np.take_along_axis(act, place[:, None, :], axis=1)[:, 0, :])
        raw = np.concatenate(pooled, axis=1) + self.bias
        hidden = np.maximum(raw, 0)
        logits = hidden @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (raw > 0)
        g_embed, g_filters = np.zeros_like(self.embed), []
        for j, (w, filt, place) in enumerate(zip(WIDTHS, self.filters, places, strict=True)):
            g = back[:, j * FILTERS : (j + 1) * FILTERS]
            g_filt = np.zeros_like(filt)
            for k in range(w):
                symbols = np.take_along_axis(x, place + k, axis=1)
                g_filt[k] = np.einsum("nf,nfe->ef", g, self.embed[symbols])
                np.add.at(g_embed, symbols, g[:, :, None] * filt[k].T[None])
            g_filters.append(g_filt)
        return [g_embed, *g_filters, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]

    def _fold(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables by byte-class pair: what its place starts in every filter, and what a pair two places on adds to widths 3 and 4."""
        if self._tables is None:
            part = [[self.embed @ filt[k] for k in range(w)] for w, filt in zip(WIDTHS, self.filters, strict=True)]
            a, b = np.divmod(np.arange(CLASSES * CLASSES), CLASSES)
            start = np.concatenate([part[2][0][a] + part[2][1][b], part[1][0][a] + part[1][1][b], part[0][0][a] + part[0][1][b]], axis=1)
            later = np.concatenate([part[2][2][a] + part[2][3][b], part[1][2][a]], axis=1)
            self._tables = np.ascontiguousarray(start), np.ascontiguousarray(later)
        return self._tables

    def probabilities(self, windows: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Softmax for each window of byte classes."""
        start, later = self._fold()
        order = np.concatenate([np.arange(FILTERS) + j * FILTERS for j in (2, 1, 0)])
        wide = later.shape[1]
        out = np.empty((len(windows), len(self.languages)), dtype=np.float32)
        act = np.empty((chunk, WINDOW - 1, start.shape[1]), dtype=np.float32)
        add = np.empty((chunk, WINDOW - 3, wide), dtype=np.float32)
        for at in range(0, len(windows), chunk):
            x = windows[at : at + chunk]
            n = len(x)
            pair = x[:, :-1] * CLASSES + x[:, 1:]
            np.take(start, pair, axis=0, out=act[:n], mode="clip")
            np.take(later, pair[:, 2:], axis=0, out=add[:n], mode="clip")
            act[:n, : WINDOW - 3, :wide] += add[:n]
            # the last place has no pair after it: width 3 ends two places before the end, width 4 three
            act[:n, WINDOW - 3 :, :FILTERS] = -1e9
            tail = self._tail(x)
            act[:n, WINDOW - 3, FILTERS:wide] = tail
            act[:n, WINDOW - 2, FILTERS:wide] = -1e9
            top = act[:n].max(axis=1)
            hidden = np.maximum(top + self.bias[order], 0)
            logits = hidden @ self.out[order] + self.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[at : at + n] = p / p.sum(axis=1, keepdims=True)
        return out

    def _tail(self, x: np.ndarray) -> np.ndarray:
        filt = self.filters[1]
        return sum((self.embed @ filt[k])[x[:, WINDOW - 3 + k]] for k in range(3))

    def score(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language of each text and its probability."""
        lengths = np.diff(at)
        each = -(-lengths // WINDOW)
        each[lengths == 0] = 1
        starts = np.zeros(len(each) + 1, dtype=np.int64)
        np.cumsum(each, out=starts[1:])
        windows = np.zeros(starts[-1] * WINDOW, dtype=np.int64)
        place = np.arange(len(raw)) + np.repeat(starts[:-1] * WINDOW - at[:-1], lengths)
        windows[place] = _CLASS[raw]
        windows = windows.reshape(-1, WINDOW)
        weight = (windows >= 6).sum(axis=1).astype(np.float64) + 1e-9
        total = np.add.reduceat(self.probabilities(windows) * weight[:, None], starts[:-1], axis=0)
        mean = total / np.add.reduceat(weight, starts[:-1])[:, None]
        best = mean.argmax(axis=1)
        return best, np.clip(mean[np.arange(len(best)), best], 0.0, 1.0)


def _windows(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), WINDOW), dtype=np.int64)
    for row, text in zip(out, texts, strict=True):
        data = np.frombuffer(text.encode()[:WINDOW], dtype=np.uint8)
        row[: len(data)] = _CLASS[data]
    return out


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, per_language: int = WINDOWS_PER_LANGUAGE) -> ByteConvNet | None:
    """Learns from labelled texts outside the held-out fold; a window is cut at a hashed place of the whole text.

    None if nothing is labelled.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & F.coalesce(fold(id_col, 4) != held_out, F.lit(False)))
    known = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    picked, sizes = stratified(known, "_lang", "_id", per_language, 11)
    room = F.greatest(F.length("_text") - WINDOW * 3 // 4, F.lit(1))
    window = F.substring(F.col("_text"), (F.pmod(F.xxhash64(F.lit(3), "_id"), room) + 1).cast("int"), F.lit(WINDOW))
    rows = capped(picked.select("_id", "_lang", window.alias("_w")), "_lang", ["_id", "_w"], per_language).orderBy("_id", "_w").collect()
    languages = sorted(sizes)
    if not rows or not languages:
        return None
    net = ByteConvNet(languages)
    number = {x: i for i, x in enumerate(languages)}
    net.train(_windows([r["_w"] for r in rows]), np.array([number[r["_lang"]] for r in rows]))
    return net


def identify(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    A null text, or one without a letter, is `und` with score 0, as is every text
    when nothing could be learnt. Repeated rows and null ids are scored like others
    (held_out false for a null id); other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col, 4) == 2, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"), F.col(text_col).alias("_text"),
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, raw, at in blocks(batches, "_text"):
            n = block.num_rows
            letters = np.asarray(block.column(2).to_numpy(zero_copy_only=False), dtype=bool)
            if net is None:
                best, score = np.zeros(n, dtype=np.int64), np.zeros(n)
                letters[:] = False
            else:
                best, score = net.score(raw, at)
            names = [net.languages[i] if ok else "und" for i, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteConvNet | None, minimum: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language is known: not `und`, and of a probability of `minimum` or more.

    Without a model no language can be judged, and all texts with a letter stay.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    at_text = docs.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, raw, at in blocks(batches, lambda b: b.column(0).field(at_text)):
            keep = np.asarray(block.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            keep = keep & (net.score(raw, at)[1] >= minimum) if net is not None else keep
            yield pa.RecordBatch.from_arrays([block.column(0).filter(pa.array(keep))], ["row"])

    return rows.mapInArrow(choose, StructType([StructField("row", docs.schema)])).select("row.*")
