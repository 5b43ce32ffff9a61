"""Vectorised text primitives shared by the corpus operators.

All functions take the bytes of a *block*: the concatenated UTF-8 texts of some
rows and the offsets between them. A block holds whole texts only, so results
never depend on how rows were batched. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
#: Texts of a block at most, however short: their numbers within a few blocks fit in 16 bits.
BLOCK_ROWS = 16_384


def _return_memory() -> None:
    """Makes freed arrays go back to the system at once, so that a worker's memory does not grow from stage to stage.

    Sets glibc's M_MMAP_THRESHOLD (-3), which else rises with use; nothing is done elsewhere.
    """
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-3, 1 << 19)
    pa.set_memory_pool(pa.system_memory_pool())


_return_memory()

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SYMBOL_LOWER = _SYMBOL[_LOWER]


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to a few blocks."""
    have = _powers.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    size = max(n, 1 << 16)
    out = np.empty(size, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < size:
        step = min(done, size - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    if size <= 4 * BLOCK_BYTES:
        _powers[base] = out
    return out[:n]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of `symbols` (64-bit codes), equal for equal spans anywhere."""
    n = len(symbols)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(symbols * _power(_BASE, n), out=total[1:])
    raw = (total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str | Callable[[pa.RecordBatch], pa.Array] = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of whole rows of about `most` bytes; a longer text is a block of its own. `text` names the column, or takes it from a batch."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        raw, at = text_arrays(text(batch) if callable(text) else batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
            stop = min(stop, batch.num_rows, row + BLOCK_ROWS)
            yield batch.slice(row, stop - row), raw[at[row] : at[stop]], at[row : stop + 1] - at[row]
            row = stop


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of every text, and words before each text (one more than rows)."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(at), dtype=np.int64)
    black = ~_WHITE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    first = black.copy()
    first[1:] &= ~black[:-1] | edge[1:-1]
    last = black.copy()
    last[:-1] &= ~black[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z lower-cased if asked), and words before each text."""
    starts, ends, before = word_spans(raw, at)
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64), before
    return span_hashes((_SYMBOL_LOWER if lower else _SYMBOL)[raw], starts, ends), before


def shingle_hashes(words: np.ndarray, before: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every text, ascending within it, and shingles before each text.

    A text with fewer than `size` words but at least one has its whole sequence
    as one shingle; a text without words has none.
    """
    counts = np.diff(before)
    n = len(words)
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    got, owner = [], []
    if n >= size:
        acc = words[: n - size + 1].copy()
        for k in range(1, size):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + words[k : n - size + 1 + k]
        whole = doc[: n - size + 1] == doc[size - 1 :]
        got.append(mix(acc[whole]))
        owner.append(doc[: n - size + 1][whole])
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        acc = np.zeros(1, dtype=np.uint64)
        for w in words[before[row] : before[row + 1]]:
            acc = acc * np.uint64(0x9FB21C651E98DF25) + w
        got.append(mix(acc + np.uint64(counts[row])))
        owner.append(np.array([row], dtype=np.int64))
    if not got:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(before), dtype=np.int64)
    value, owner_ = np.concatenate(got), np.concatenate(owner)
    if np.any(owner_[1:] < owner_[:-1]):
        by = np.argsort(owner_, kind="stable")
        value, owner_ = value[by], owner_[by]
    cut = np.searchsorted(owner_, np.arange(len(before)))
    keep = np.ones(len(value), dtype=bool)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        part = value[a:b]
        part.sort()
        keep[a + 1 : b] = part[1:] != part[:-1]
    total = np.zeros(len(value) + 1, dtype=np.int64)
    np.cumsum(keep, out=total[1:])
    return value[keep], total[cut]


class SpanCache:
    """Integer ids of spans by their hash, kept between blocks of a worker up to `most` spans, then begun afresh."""

    def __init__(self, most: int, dtype: type):
        self._most, self._dtype = most, dtype
        self._reset()

    def _reset(self) -> None:
        self._key = np.zeros(0, dtype=np.uint64)
        self._start, self._size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self._ids = np.zeros(0, dtype=self._dtype)

    def lookup(self, keys: np.ndarray, fetch) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans end to end, and ids before each span; fetch(positions) gives the id lists of unseen ones."""
        uniq, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self._key) + len(uniq) > self._most:
            self._reset()
        spot = np.searchsorted(self._key, uniq)
        known = np.zeros(len(uniq), dtype=bool)
        inside = spot < len(self._key)
        known[inside] = self._key[spot[inside]] == uniq[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            found = fetch(where[fresh])
            size = np.array([len(x) for x in found], dtype=np.int32)
            start = np.cumsum(size, dtype=np.int64) - size + len(self._ids)
            self._ids = np.concatenate([self._ids, np.array([i for x in found for i in x], dtype=self._dtype)])
            into = spot[fresh]
            self._key, self._start, self._size = np.insert(self._key, into, uniq[fresh]), np.insert(self._start, into, start), np.insert(self._size, into, size)
            spot = np.searchsorted(self._key, uniq)
        place = spot[back]
        size = self._size[place].astype(np.int64)
        total = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        return self._ids[np.arange(total[-1]) + np.repeat(self._start[place] - total[:-1], size)], total
