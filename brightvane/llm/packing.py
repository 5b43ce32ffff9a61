"""Best-fit packing by exact complements.

Texts are tokenised, cut into pieces of at most one sequence, and only the counts
of piece lengths (at most `capacity` numbers) reach the driver. There a plan is
made on the counts: for each length, from the longest, single lengths, pairs and
triples that fill its gap exactly are consumed as far as they last; what remains is
placed best-fit, longest first. The plan lists ranges of ranks within a length, so
pieces find their places by their rank, whatever their number.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise, running
from .textkernel import _SYMBOL, SpanCache, blocks, mix, span_hashes, word_spans

CAPACITY = 2048
#: Entries kept by a worker's segment cache before it starts afresh.
CACHE_SEGMENTS = 1_500_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
def _alphabet() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_ALPHABET = _alphabet()
# Fixed value: the split of the vocabulary for which segments are cut.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class SegmentTokenizer:
    """Token ids of whole texts from a cache of segments.

    The tokenizer drops white space, so ids of a text are those of its words in
    turn. A word of plain letters (ASCII or Latin-1) with trailing marks is cut
    before the marks, where the tokenizer's own split falls; any other word is one
    segment. Unseen segments go through the tokenizers library: plain letters to its
    model, as the one word they are, others to the whole tokenizer.
    """

    def __init__(self, path: str, most: int = CACHE_SEGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._check(path)
        self.library, self._cache = Tokenizer.from_file(path), SpanCache(most, np.uint16)

    @staticmethod
    def _check(path: str) -> None:
        """Refuses vocabularies to which the cutting into segments does not apply."""
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = [s.get("type") for s in (rules["normalizer"] or {}).get("normalizers", [])]
        split = ((rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        known = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": _SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
        if not known or any(not t["content"].startswith("<|") for t in rules["added_tokens"]) or max([t["id"] for t in rules["added_tokens"]] + list(rules["model"]["vocab"].values())) > 0xFFFF:
            raise ValueError(f"{path}: only vocabularies that drop white space, lower-case, split off marks and have ids under 65536 can be packed")

    @staticmethod
    def _segments(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and keys of segments, segments before each text, which are plain letters, and the bytes in lower case."""
        starts, ends, before = word_spans(raw, at)
        n = len(raw)
        folded = _FOLD[raw]
        if len(starts) == 0:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64), none.astype(bool), folded
        letter = _LETTER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        follow = raw[lead + 1]
        lead = lead[(follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7)]
        letter[lead] = letter[lead + 1] = True
        folded[lead + 1] += np.where(raw[lead + 1] <= 0x9E, 0x20, 0).astype(np.uint8)
        odd = np.zeros(n + 1, dtype=np.int32 if n < 1 << 31 else np.int64)
        np.cumsum(~letter, out=odd[1:])
        tail = _without_marks(raw, starts, ends)
        cut = (tail > starts) & (tail < ends) & (odd[tail] == odd[starts])
        extra = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(cut, out=extra[1:])
        where = np.arange(len(starts)) + extra[:-1]
        first, last = np.empty(len(starts) + extra[-1], dtype=np.int64), np.empty(len(starts) + extra[-1], dtype=np.int64)
        first[where], last[where] = starts, np.where(cut, tail, ends)
        first[where[cut] + 1], last[where[cut] + 1] = tail[cut], ends[cut]
        keys = span_hashes(_SYMBOL[folded], first, last)
        # special tokens are matched before letters are lower-cased
        signs = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        if len(signs):
            special = np.searchsorted(signs, last) > np.searchsorted(signs, first)
            keys[special] = mix(span_hashes(_SYMBOL[raw], first[special], last[special]))
        return first, last, keys, before + extra[before], odd[first] == odd[last], folded

    def _ids(self, raw: bytes, folded: bytes, spans: Iterator[tuple[int, int, bool]]) -> list[list[int]]:
        """Ids of segments: one of plain letters is one word of the model, the others go through the whole tokenizer."""
        model, out, other = self.library.model, [], []
        for a, b, plain in spans:
            if plain:
                word = folded[a:b].decode("latin-1")
                out.append([x.id for x in model.tokenize(word if word.isascii() else word.translate(_ALPHABET))])
            else:
                other.append((len(out), raw[a:b].decode()))
                out.append([])
        for (at, _), x in zip(other, self.library.encode_batch_fast([w for _, w in other], add_special_tokens=False), strict=True):
            out[at] = x.ids
        return out

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and ids before each text."""
        first, last, keys, before, plain, folded = self._segments(raw, at)
        if len(keys) == 0:
            return np.zeros(0, dtype=np.uint16), np.zeros(len(at), dtype=np.int64)
        data, low = raw.tobytes(), folded.tobytes()
        fetch = lambda spans: self._ids(data, low, zip(first[spans].tolist(), last[spans].tolist(), plain[spans].tolist(), strict=True))
        ids, total = self._cache.lookup(keys, fetch)
        return ids, total[before]


def _without_marks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ends of words without the marks at their end: step by step, and for long runs of marks at once."""
    tail = ends.copy()
    open_ = np.flatnonzero(_MARK[raw[tail - 1]])
    for _ in range(8):
        tail[open_] -= 1
        open_ = open_[tail[open_] > starts[open_]]
        open_ = open_[_MARK[raw[tail[open_] - 1]]]
        if len(open_) == 0:
            return tail
    solid = np.where(_MARK[raw], -1, np.arange(len(raw)))
    np.maximum.accumulate(solid, out=solid)
    tail[open_] = np.maximum(solid[tail[open_] - 1] + 1, starts[open_])
    return tail


_tokenizers: dict[str, SegmentTokenizer] = {}


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the tokens of each text and the end id, cut only beyond `capacity`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.setdefault(vocabulary, None) or SegmentTokenizer(vocabulary)
        _tokenizers[vocabulary] = tokenizer
        for block, raw, at in blocks(batches, "_text"):
            ids, before = tokenizer.encode(raw, at)
            docs_ = block.column(0).to_pylist()
            rows: list[tuple] = []
            for doc_id, a, b in zip(docs_, before[:-1].tolist(), before[1:].tolist(), strict=True):
                whole = np.full(b - a + 1, end_id, dtype="<u4")
                whole[:-1] = ids[a:b]
                for piece, start in enumerate(range(0, len(whole), capacity)):
                    part = whole[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(f"make_valid_utf8(cast(`{text_col}` as string))").alias("_text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (times, lengths), lengths from the start of a sequence, that use every piece of `counts` once."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length}")
        left[length] = n
    out: list[tuple[int, tuple[int, ...]]] = []

    def take(lengths: tuple[int, ...]) -> int:
        times = min(left[x] // k for x, k in Counter(lengths).items())
        if times:
            out.append((times, lengths))
            for x in lengths:
                left[x] -= times
        return times

    take((capacity,))
    there = pairs = 0
    stale = True
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        if left[length]:
            take((length, gap))
        a = gap - 1
        while left[length] and a >= (gap + 1) // 2:
            if left[a] and left[gap - a]:
                stale |= bool(take((length, a, gap - a)))
            a -= 1
        # a set of lengths is a number whose bits are the lengths; pair sums are an index of the same form
        a = gap - 2
        while left[length] and a >= -(-gap // 3):
            if stale:
                there = sum(1 << x for x in range(1, capacity) if left[x])
                pairs = 0
                for x in range(1, capacity):
                    if left[x]:
                        pairs |= there << x
                stale = False
            if left[a] and pairs >> (gap - a) & 1:
                rest = gap - a
                for b in range(min(a, rest - 1), (rest - 1) // 2, -1):
                    if left[b] and left[rest - b] and take((length, a, b, rest - b)):
                        stale = True
                    if not (left[length] and left[a]):
                        break
            a -= 1
        stale = True
    bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    gaps = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        while left[length]:
            fit = np.flatnonzero(gaps[length:])
            if len(fit):
                gap = int(fit[0]) + length
                n, held = bins[gap].pop()
                if not bins[gap]:
                    gaps[gap] = False
                k = min(n, left[length])
                if n > k:
                    bins[gap].append((n - k, held))
                    gaps[gap] = True
                bins.setdefault(gap - length, []).append((k, (*held, length)))
                gaps[gap - length] = True
                left[length] -= k
            else:
                each = capacity // length
                whole, some = divmod(left[length], each)
                for n, k in ((whole, each), (1 if some else 0, some)):
                    if n:
                        bins.setdefault(capacity - k * length, []).append((n, (length,) * k))
                        gaps[capacity - k * length] = True
                left[length] = 0
    return out + [x for gap in sorted(bins) for x in bins[gap]]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ascending: from that rank on, pieces of the length go to successive sequences at the offset."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    A null or empty text is the end token alone. Texts of any length are cut into
    pieces of `capacity`. Repeated rows are packed each for itself; null ids are
    kept. Bytes that are not UTF-8 count as U+FFFD. An empty table gives no rows;
    other columns are ignored. Pieces of a length take their places in the order of id
    and piece, and many alike ones are still dealt over many tasks.
    """
    cut = materialise(pieces(docs, vocabulary, id_col, text_col, capacity).withColumn("tie", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table = places(plan(counts, capacity))
    placed = running(cut, ["length", "doc_id", "piece", "ids_crc32", "tie"], "at")
    discard(cut)
    longest, n_shorter = max(counts, default=0), 0
    shorter = np.zeros(longest + 1, dtype=np.int64)  # pieces of any smaller length
    for length in range(longest + 1):
        shorter[length] = n_shorter
        n_shorter += counts.get(length, 0)
    keys = table[:, 0] << 44 | table[:, 1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "at"))
            rank = at - shorter[length]
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1] if len(table) else np.zeros((0, 4), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], [*batch.schema.names[:5], "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at").mapInArrow(put, schema)
