"""A bigram language model in Elias-Fano tries, for corpora of any size.

Texts are tokenised once into blocks, files of the shared folder. Counts are gathered and answers given in two columnar shuffles: blocks send their distinct words
and word pairs, with training counts, to buckets; hot first words are spread over all
buckets. A bucket builds its part of the model: an n-gram trie whose levels (words
with their counts, monotone pointers, successors within a context) are Elias-Fano
coded and whose smoothed probabilities are quantised to a byte, laid out in a file
that is memory-mapped. It answers each block's words and pairs by successor search,
for pairs within their context. Blocks then add up their texts' scores.

The mapped file is a scratch file of the task that builds it, without a name; a task
that is run again builds its own.

The model is P(w|h) = (c(hw) + M P(w)) / (c(h) + M), with P(w) = (c(w) + a) / (N +
a (V + 1)), a = 0.1: proper distributions over the vocabulary and one unknown word.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import _press, _unpress
from .sampling import fold
from .storage import dealt, materialise, read_file, shared_folder, task_file, write_file
from .textkernel import blocks, mix, word_hashes

ADD, STRENGTH = 0.1, 24.0
BLOCK_TOKENS, BUCKET_TOKENS = 1_500_000, 2_000_000
#: Words of a smaller share than this are never spread over buckets.
LEAST_SHARE = 2.0**-16
END = np.uint64(0x9D39247E33776D41)
#: Successors are told apart within their context by so many bits.
SUCCESSOR_BITS = 40
LEVELS, LOWEST = 255, -10.0

_POP = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)
_SELECT = np.zeros((256, 8), dtype=np.int64)
for _b in range(256):
    for _k, _bit in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_b, _k] = _bit


class EliasFano:
    """A monotone sequence of 64-bit integers: low bits packed, high bits in unary, with vectorised access and successor search."""

    def __init__(self, arrays: list[np.ndarray]):
        self._head, self._low, self._high, self._ones = arrays
        self.n, self._bits, self._buckets = (int(x) for x in self._head)

    @staticmethod
    def build(values: np.ndarray) -> list[np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64)
        buckets = int(high[-1]) + 1 if n else 1
        marks = np.zeros(-(-(n + buckets + 1) // 64) * 64, dtype=np.uint8)
        marks[high + np.arange(n)] = 1
        unary = np.packbits(marks, bitorder="little").view("<u8")
        low = np.zeros(-(-(n * bits) // 64) + 2, dtype="<u8")
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = np.zeros(len(unary) + 1, dtype="<i8")
        np.cumsum(_POP[unary.view(np.uint8)].reshape(-1, 8).sum(axis=1), out=ones[1:])
        return [np.array([n, bits, buckets], dtype="<i8"), low, unary, ones]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if self._bits == 0:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self._bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        got = self._low[word] >> shift
        over = shift > 0
        got[over] |= self._low[word[over] + 1] << (np.uint64(64) - shift[over])
        return got & np.uint64((1 << self._bits) - 1)

    @staticmethod
    def _within(words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one (from 0) in each word."""
        each = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
        total = np.cumsum(_POP[each], axis=1)
        byte = (total <= k[:, None]).sum(axis=1)
        before = np.where(byte > 0, total[np.arange(len(k)), np.maximum(byte - 1, 0)], 0)
        return byte * 8 + _SELECT[each[np.arange(len(k)), byte], k - before]

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self._ones, i, side="right") - 1
        place = word * 64 + self._within(self._high[word], i - self._ones[word])
        return (place - i).astype(np.uint64) << np.uint64(self._bits) | self._lows(i)

    def _before(self, bucket: np.ndarray) -> np.ndarray:
        """How many values lie in high buckets below each."""
        zeros = np.arange(len(self._ones), dtype=np.int64) * 64 - self._ones
        k = np.maximum(bucket - 1, 0)
        word = np.searchsorted(zeros, k, side="right") - 1
        place = word * 64 + self._within(~self._high[word], k - zeros[word])
        return np.where(bucket > 0, place - k, 0)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first position whose value is not below each of `values`, and whether it equals it."""
        if self.n == 0 or len(values) == 0:
            return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
        values = values.astype(np.uint64)
        high = np.minimum(values >> np.uint64(self._bits), np.uint64(self._buckets)).astype(np.int64)
        at = self._before(np.minimum(high, self._buckets))
        stop = np.where(high < self._buckets, self._before(np.minimum(high + 1, self._buckets)), at)
        want = values & np.uint64((1 << self._bits) - 1)
        # within a high bucket low bits ascend: halve the range until it is empty
        end = stop.copy()
        open_ = np.flatnonzero(at < end)
        while len(open_):
            middle = (at[open_] + end[open_]) >> 1
            below = self._lows(middle) < want[open_]
            at[open_[below]] = middle[below] + 1
            end[open_[~below]] = middle[~below]
            open_ = open_[at[open_] < end[open_]]
        found = at < stop
        found[found] = self._lows(at[found]) == want[found]
        return at, found


class NgramTrie:
    """Words with counts, pointers and successors in Elias-Fano levels, and a byte of quantised log probability for each pair."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, context: np.ndarray, successor: np.ndarray, log10: np.ndarray):
        """Words ascending with their counts; pairs ascending by (context hash, successor code) with their log10 probabilities within the context. Contexts need not be among the words: a hot one has pairs in buckets other than its own."""
        names = np.union1d(words, context)
        total = np.zeros(len(names) + 1, dtype=np.uint64)
        total[np.searchsorted(names, words) + 1] = counts
        pointers = np.searchsorted(context, names)
        rank = np.searchsorted(names, context).astype(np.uint64)
        levels = [*EliasFano.build(names), *EliasFano.build(np.cumsum(total, dtype=np.uint64)), *EliasFano.build(np.append(pointers, len(context))), *EliasFano.build(rank << np.uint64(SUCCESSOR_BITS) | successor), quantise(log10)]
        with tempfile.TemporaryFile() as file:
            marks = []
            for array in levels:
                file.write(b"\0" * (-file.tell() % 8))
                marks.append((file.tell(), array.dtype, len(array)))
                file.write(array.tobytes())
            file.flush()
            self.size = file.tell()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        back = [np.frombuffer(self._map, dtype=d, count=n, offset=at) for at, d, n in marks]
        self.contexts, self.totals, self.pointers, self.successors, self.codes = EliasFano(back[0:4]), EliasFano(back[4:8]), EliasFano(back[8:12]), EliasFano(back[12:16]), back[16]

    def counts(self, words: np.ndarray) -> np.ndarray:
        """The count of each word; 0 for words not in the trie."""
        out = np.zeros(len(words), dtype="<u8")
        at, known = self.contexts.successor(words)
        out[known] = self.totals.access(at[known] + 1) - self.totals.access(at[known])
        return out

    def lookup(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The codes of pairs; 0 where the pair is not in the trie."""
        out = np.zeros(len(context), dtype=np.uint8)
        if self.contexts.n == 0 or len(context) == 0:
            return out
        names, back = np.unique(context, return_inverse=True)
        rank, known = self.contexts.successor(names)
        start = np.zeros(len(names), dtype=np.int64)
        stop = np.zeros(len(names), dtype=np.int64)
        start[known], stop[known] = self.pointers.access(rank[known]).astype(np.int64), self.pointers.access(rank[known] + 1).astype(np.int64)
        ask = np.flatnonzero(known[back])
        at, equal = self.successors.successor(rank[back[ask]].astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | successor[ask])
        inside = equal & (at >= start[back[ask]]) & (at < stop[back[ask]])
        out[ask[inside]] = self.codes[at[inside]]
        return out


def quantise(log10: np.ndarray) -> np.ndarray:
    """Codes 1..LEVELS over [LOWEST, 0]."""
    return np.clip(np.rint((log10 - LOWEST) / -LOWEST * (LEVELS - 1)) + 1, 1, LEVELS).astype(np.uint8)


def _probabilities() -> np.ndarray:
    """The probability of each code; none for code 0."""
    out = 10.0 ** (LOWEST + np.arange(-1, LEVELS) / (LEVELS - 1) * -LOWEST)
    out[0] = 0.0
    return out


def _tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, END after each, and the number of tokens of each text."""
    words, before = word_hashes(raw, at)
    counts = np.diff(before)
    out = np.full(len(words) + len(counts), END, dtype=np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
    return out, counts + 1


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, whether each text trains, tokens of each, and all tokens: of about BLOCK_TOKENS at a time."""
    held: list[tuple] = []
    amount = 0
    for block, raw, at in blocks(batches, "_text"):
        tokens, sizes = _tokens(raw, at)
        ids = block.column(0)
        held.append((np.array([-1 if x is None else x for x in ids.to_pylist()], dtype=np.int64), ids.is_null().to_numpy(zero_copy_only=False), np.asarray(block.column(1).to_numpy(zero_copy_only=False), dtype=bool), sizes, tokens))
        amount += len(tokens)
        if amount >= BLOCK_TOKENS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, amount = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _pairs(place: np.ndarray, sizes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of tokens that follow another in their text, and the distinct (first, second) of those pairs with each position's pair."""
    start = np.zeros(len(place), dtype=bool)
    start[np.cumsum(sizes) - sizes] = True
    second = np.flatnonzero(~start)
    key = place[second - 1].astype(np.int64) * words + place[second]
    uniq, back = np.unique(key, return_inverse=True)
    first, follow = np.divmod(uniq, words)
    return second, first, follow, back


def _homes(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(words ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(buckets)).astype(np.int64)


def _dest(first: np.ndarray, follow: np.ndarray, home: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """A pair's bucket: its first word's, or for a hot first word one that depends on both."""
    return np.where(hot[first], (home[first] + home[follow]) % buckets, home[first])


_ROW = "dest long, block string, kind int, data binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], ["dest", "block", "kind", "data"])


def _blocks_to(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to files of blocks: ids, which are null, which are held out, tokens of each, distinct words, and each token's word."""
        for number, (ids, missing, held_out, sizes, tokens) in enumerate(_text_blocks(batches)):
            words, place = np.unique(tokens, return_inverse=True)
            name = task_file(folder, number, "block")
            write_file(name, _press(ids, missing.astype("u1"), held_out.astype("u1"), sizes.astype("<i8"), np.diff(words, prepend=np.uint64(0)), place.astype("<u4")))
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["block"])

    return run


def _open(block: str) -> tuple[np.ndarray, ...]:
    """ids, missing, held_out, sizes, words, place of a block."""
    ids, missing, held_out, sizes, words, place = _unpress(read_file(block), "<i8", "u1", "u1", "<i8", "<u8", "<u4")
    return ids, missing.astype(bool), held_out.astype(bool), sizes, np.cumsum(words, dtype=np.uint64), place


def _word_counts(held_out: np.ndarray, sizes: np.ndarray, words: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.bincount(place, weights=np.repeat(~held_out, sizes), minlength=len(words)).astype(np.int64)


def _counted(hot_words: np.ndarray | None):
    """Training counts of words by block: of those frequent in the block, with all tokens as word 0; or of `hot_words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                _, _, held_out, sizes, words, place = _open(name)
                count = _word_counts(held_out, sizes, words, place)
                if hot_words is None:
                    keep = count >= max(2.0, LEAST_SHARE * count.sum() / 16)
                    word, n = np.append(words[keep], np.uint64(0)), np.append(count[keep], count.sum())
                else:
                    keep = np.isin(words, hot_words)
                    word, n = words[keep], count[keep]
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    return run


def _ask(buckets: int, hot_words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks to rows for buckets: kind 0 words and training counts, kind 1 pairs and training counts."""
        for batch in batches:
            for name in batch.column(0).to_pylist():
                _, _, held_out, sizes, words, place = _open(name)
                home, hot = _homes(words, buckets), np.isin(words, hot_words)
                count = _word_counts(held_out, sizes, words, place).astype("<u4")
                second, first, follow, back = _pairs(place, sizes, len(words))
                times = np.bincount(back, weights=np.repeat(~held_out, sizes)[second], minlength=len(first)).astype("<u4")
                dest = _dest(first, follow, home, hot, buckets)
                for b, w in _dealt(home):
                    yield _batch([(b, name, 0, _press(np.diff(words[w], prepend=np.uint64(0)), count[w]))])
                code = words >> np.uint64(64 - SUCCESSOR_BITS)
                for b, p in _dealt(dest):
                    narrow = np.ascontiguousarray(code[follow[p]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SUCCESSOR_BITS // 8]).ravel()
                    yield _batch([(b, name, 1, _press(np.diff(words[first[p]], prepend=np.uint64(0)), narrow, times[p]))])

    return run


def _dealt(dest: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that gets any, with the positions it gets, ascending."""
    if len(dest) == 0:
        return
    order = np.argsort(dest, kind="stable")
    cut = np.flatnonzero(np.append(True, dest[order][1:] != dest[order][:-1]))
    for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(dest)).tolist(), strict=True):
        yield int(dest[order[lo]]), order[lo:hi]


def _answer(hot: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        """A bucket's rows to answers in the rows' own order: kind 2 word counts, kind 3 pair codes; in place of the bucket, kind 4 has its distinct words and kind 5 its tokens."""
        names, kinds, dests, data = table.column("block").to_pylist(), table.column("kind").to_pylist(), table.column("dest").to_pylist(), table.column("data")
        none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        asked: dict[int, tuple] = {}
        for i, kind in enumerate(kinds):
            if kind == 0:
                delta, count = _unpress(data[i].as_py(), "<u8", "<u4")
                asked[i] = np.cumsum(delta, dtype=np.uint64), count
            else:
                delta, narrow, count = _unpress(data[i].as_py(), "<u8", "u1", "<u4")
                wide = np.zeros((len(count), 8), dtype=np.uint8)
                wide[:, : SUCCESSOR_BITS // 8] = narrow.reshape(-1, SUCCESSOR_BITS // 8)
                asked[i] = np.cumsum(delta, dtype=np.uint64), wide.ravel().view("<u8"), count
        words, back = np.unique(np.concatenate([none[0], *(x[0] for i, x in asked.items() if kinds[i] == 0)]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([none[2], *(x[1] for i, x in asked.items() if kinds[i] == 0)]), minlength=len(words)).astype(np.int64)
        words, counts = words[counts > 0], counts[counts > 0]
        context, follow, count = (np.concatenate([none[k], *(x[k] for i, x in asked.items() if kinds[i] == 1)]) for k in range(3))
        keep = count > 0
        context, follow, count = context[keep], follow[keep], count[keep].astype(np.float64)
        order = np.lexsort((follow, context))
        context, follow, count = context[order], follow[order], count[order]
        if len(context):
            first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (follow[1:] != follow[:-1])))
            count = np.add.reduceat(count, first)
            context, follow = context[first], follow[first]
        names_, start, which = np.unique(context, return_index=True, return_inverse=True)
        total = np.add.reduceat(count, start) if len(start) else np.zeros(0)
        spread = np.array([hot.get(int(x), 0) for x in names_], dtype=np.float64)
        within = np.where(spread > 0, spread, total)[which]
        trie = NgramTrie(words, counts, context, follow, np.log10(count / (within + STRENGTH)))
        rows = [(dests[i], names[i], 2, _press(trie.counts(x[0]))) if kinds[i] == 0 else (dests[i], names[i], 3, _press(trie.lookup(x[0], x[1]))) for i, x in asked.items()]
        rows += [(len(words), "", 4, b""), (int(counts.sum()), "", 5, b"")]
        return pa.Table.from_batches([_batch(rows)])

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(buckets: int, hot_words: np.ndarray, distinct: int, training: int):
    def run(table: pa.Table) -> pa.Table:
        """A block's answers to the scores of its texts."""
        answers: dict[tuple[int, int], bytes] = {}
        for dest, kind, data in zip(table.column("dest").to_pylist(), table.column("kind").to_pylist(), table.column("data"), strict=True):
            answers[kind, dest] = data.as_py()
        out = []
        for name in set(table.column("block").to_pylist()):
            ids, missing, held_out, sizes, words, place = _open(name)
            home, hot = _homes(words, buckets), np.isin(words, hot_words)
            count = np.zeros(len(words))
            for b, w in _dealt(home):
                (count[w],) = _unpress(answers[2, b], "<u8")
            second, first, follow, back = _pairs(place, sizes, len(words))
            codes = np.zeros(len(first), dtype=np.uint8)
            for b, p in _dealt(_dest(first, follow, home, hot, buckets)):
                (codes[p],) = _unpress(answers[3, b], "u1")
            single = (count + ADD) / (training + ADD * (distinct + 1))
            base = np.log10(single)[place]
            own = base.copy()
            pair = np.log10(_probabilities()[codes] + STRENGTH / (count[first] + STRENGTH) * single[follow])
            own[second] = pair[back]
            start = np.cumsum(sizes) - sizes
            out.append((ids, missing, held_out, sizes, np.add.reduceat((count > 0)[place].astype(np.int64), start), np.add.reduceat(base, start), np.add.reduceat(own, start)))
        ids, missing, held_out, sizes, known, base, own = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([np.zeros(0)] * 7)
        return pa.table([pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(held_out.astype(bool)), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(ids), training, dtype=np.int64)), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from the rows whose fold of `parts` is not 0 (those with a null id
    included) and scores all. A null or empty text is the end token alone. Repeated
    rows are scored, and train, each for itself. If nothing trains, every token is
    unknown. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(fold(id_col, parts) == 0, F.lit(False)).alias("_held"), F.col(text_col).alias("_text"))
    folder = f"{shared_folder(docs.sparkSession)}/blocks-{uuid.uuid4().hex}"
    texts = dealt(materialise(rows.mapInArrow(_blocks_to(folder), "block string"), "blocks"), "block")
    counted = materialise(texts.mapInArrow(_counted(None), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    tokens = counted.where("word = 0").select(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    # at most 8 * buckets words, and at most 1 / LEAST_SHARE
    often = max(tokens / (8 * buckets), tokens * LEAST_SHARE)
    hot_words = np.array(sorted(r["word"] % (1 << 64) for r in counted.where((F.col("word") != 0) & (F.col("n") >= often)).collect()), dtype=np.uint64)
    hot = {}
    if len(hot_words):
        # blocks name only words frequent in them; the few that are hot are counted in all
        exact = texts.mapInArrow(_counted(hot_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        hot = {r["word"] % (1 << 64): r["n"] for r in exact.collect()}
    asked = texts.mapInArrow(_ask(buckets, hot_words), _ROW)
    answers = materialise(asked.groupBy("dest").applyInArrow(_answer(hot), _ROW), "answers")
    sums = {r["kind"]: int(r["n"]) for r in answers.where("kind in (4, 5)").groupBy("kind").agg(F.sum("dest").alias("n")).collect()}
    return answers.where("kind < 4").groupBy("block").applyInArrow(_score(buckets, hot_words, sums.get(4, 0), sums.get(5, 0)), _SCORED)
