"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The encoding of every prefix of a piece ends in one last token, and a token can
follow another only if the pair encodes to itself. A transducer state is therefore
the bytes read since the last token that was emitted; positions from which some
token may still extend are live, and what is common to the encodings of all live
positions is emitted. Lookahead is bounded by the longest token. States and moves
are made when first met and kept up to a limit, then made anew.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import SpanCache, blocks, mix, span_hashes

#: Moves, pair checks, and pieces kept by a worker before it starts afresh.
MOVES, PAIRS, PIECES = 1_000_000, 500_000, 2_500_000

_BYTE = [bytes((b,)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], but: int = -1) -> list[int]:
    """The definition: merge the leftmost pair of lowest rank until no pair is a token (other than `but`). For short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, best = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60 or rank == but:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[x] for x in parts]


class Transducer:
    """Encodes pieces byte by byte.

    A state is known by its pending bytes, those read since the last token emitted,
    and by that token where another may still extend from its end: every other live
    place is reached by the encoding of the pending bytes before it, whatever came
    earlier. States are numbered in steps of 256, so that state + byte names a move.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # the two tokens whose merge makes each token; tokens that no merge of two makes are only ever whole pieces
        made = {r: merge(t, ranks, but=r) for t, r in ranks.items() if len(t) > 1}
        self._halves = {r: (x[0], x[1]) for r, x in made.items() if len(x) == 2}
        self._bytes = {r: t for t, r in ranks.items()}
        self._child: dict[int, int] = {}
        self._token, self._inner = [-1], [True]
        for token, rank in ranks.items():
            if len(token) == 1 or rank in self._halves:
                self._add(token, rank)
        self._pairs: dict[int, bool] = {}
        # by state: pending bytes, and live places as (bytes before, trie node, last token, pending tokens up to it)
        self._states: list[tuple[bytes, tuple[tuple[int, int, int, tuple[int, ...]], ...]]] = []
        self._final: list[tuple[int, ...]] = []
        self._number: dict[tuple[bytes, int], int] = {}
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._reset()

    def _add(self, token: bytes, rank: int) -> None:
        """Puts a token in the trie: children by (node, byte), and which nodes have any."""
        node = 0
        for byte in token:
            self._inner[node] = True
            key = node << 8 | byte
            child = self._child.get(key)
            if child is None:
                child = self._child[key] = len(self._token)
                self._token.append(-1)
                self._inner.append(False)
            node = child
        self._token[node] = rank

    def _reset(self) -> None:
        for kept in (self._states, self._final, self._number, self._moves):
            kept.clear()
        self._state(b"", -1, ((0, 0, -1, ()),))

    def _state(self, pending: bytes, last: int, live: tuple[tuple[int, int, int, tuple[int, ...]], ...]) -> int:
        """The number of a state, made if new. The last live place is the end of what was read."""
        found = self._number.get((pending, last))
        if found is None:
            found = self._number[pending, last] = len(self._states) << 8
            self._states.append((pending, live))
            self._final.append(live[-1][3])
        return found

    def _follows(self, left: int, right: int) -> bool:
        got = self._pairs.get(left << 24 | right)
        if got is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            got = self._pairs[left << 24 | right] = self._stable(left, right)
        return got

    def _stable(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes encode to just them.

        Undoes the merges next to the border, latest first (of equal ranks the
        right one, since merging goes left to right), and sees whether a merge over
        the border would have come before the one undone.
        """
        limit = 1 << 60
        while True:
            joined = self.ranks.get(self._bytes[left] + self._bytes[right])
            if joined is not None and joined < limit:
                return False
            one, two = self._halves.get(left), self._halves.get(right)
            if one is None and two is None:
                return True
            if two is None or one is not None and left > right:
                limit, left = left, one[1]
            else:
                limit, right = right + 1, two[0]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        child_of, token_of, inner = self._child, self._token, self._inner
        pending, places = self._states[state >> 8]
        if len(self._moves) >= MOVES:
            self._reset()
            state = self._state(pending, places[0][2] if places[0][0] == 0 else -2, places)
        token, path = -1, ()
        live = []
        # only from live places can a token reach here, or one reach on
        for place in places:
            child = child_of.get(place[1] << 8 | byte)
            if child is not None:
                if token < 0:
                    own = token_of[child]
                    if own >= 0 and (place[2] < 0 or self._follows(place[2], own)):
                        token, path = own, (*place[3], own)
                if inner[child]:
                    live.append((place[0], child, place[2], place[3]))
        if not live:
            step = self._state(b"", token, ((0, 0, token, ()),)), path
        else:
            pending += _BYTE[byte]
            live.append((len(pending), 0, token, path))
            first = live[0]
            if first[0] == 0:
                step = self._state(pending, first[2], tuple(live)), ()
            else:
                step = self._emit(pending, live)
        self._moves[state | byte] = step
        return step

    def _emit(self, pending: bytes, live: list[tuple[int, int, int, tuple[int, ...]]]) -> tuple[int, tuple[int, ...]]:
        """The state after the tokens that the encodings up to all live places begin with, and those tokens."""
        paths = [place[3] for place in live]
        least = min(paths, key=len)
        common = len(least)
        for path in paths:
            while path[:common] != least[:common]:
                common -= 1
        if common == 0:
            return self._state(pending, -2, tuple(live)), ()
        emitted = least[:common]
        cut = sum([len(self._bytes[t]) for t in emitted])
        live = [(j - cut, node, last, path[common:]) for j, node, last, path in live]
        return self._state(pending[cut:], live[0][2] if live[0][0] == 0 else -2, tuple(live)), emitted

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, get = 0, self._moves.get
        for byte in piece:
            state, emitted = get(state | byte) or self._move(state, byte)
            if emitted:
                out += emitted
        out += self._final[state >> 8]
        return out


def _utf8_machine() -> list[list[int]]:
    """Next state by state and byte: 0 between characters, 1 to 3 that many bytes short, 4 to 7 after E0, ED, F0, F4 (whose second byte has a narrower range), 8 after a byte that cannot stand there."""
    start = [8] * 256
    start[:0x80] = [0] * 0x80
    start[0xC2:0xE0], start[0xE0:0xF0], start[0xF0:0xF5] = [1] * 30, [2] * 16, [3] * 5
    start[0xE0], start[0xED], start[0xF0], start[0xF4] = 4, 5, 6, 7
    table = [start]
    for low, high, after in ((0x80, 0xC0, 0), (0x80, 0xC0, 1), (0x80, 0xC0, 2), (0xA0, 0xC0, 1), (0x80, 0xA0, 1), (0x90, 0xC0, 2), (0x80, 0x90, 2)):
        table.append([after if low <= byte < high else 8 for byte in range(256)])
    # what cannot go on stands for itself, and the byte that broke it is read as if it came first
    for row in table[1:]:
        row[:0x80], row[0xC0:] = start[:0x80], start[0xC0:]
    return [*table, start]


_UTF8 = _utf8_machine()
#: More bytes than can be held.
_SYNC = 4


class StreamingDecoder:
    """Decodes ids chunk by chunk; a character whose bytes are split over tokens is held until complete.

    Carries the state of the UTF-8 machine and the bytes held. Any byte that is not
    a continuation byte sets the state alone, so only the bytes from the last of
    those on need to be stepped through.
    """

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for token, rank in ranks.items():
            pieces[rank] = token
        self._length = np.array([len(p) for p in pieces], dtype=np.int64)
        self._start = np.cumsum(self._length) - self._length
        self._flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self._held, self._state = b"", 0

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes of all characters that are complete now."""
        length = self._length[ids]
        at = np.cumsum(length) - length
        data = self._flat[np.arange(int(length.sum())) + np.repeat(self._start[ids] - at, length)].tobytes()
        state, held = self._state, len(self._held)
        first = max(0, len(data) - _SYNC)
        while first < len(data) and 0x80 <= data[first] < 0xC0:
            first += 1
        if len(data) > _SYNC:
            state, held = (0, 0) if first < len(data) else (8, 0)
        else:
            first = 0
        for byte in data[first:]:
            lead = byte < 0x80 or byte >= 0xC0
            state = _UTF8[state][byte]
            held = 0 if state in (0, 8) else 1 if lead else held + 1
        data = self._held + data
        cut = len(data) - held
        self._held, self._state = data[cut:], state
        return data[:cut]

    def finish(self) -> bytes:
        """What was held; raises UnicodeDecodeError in text use, gives the bytes here."""
        held, self._held, self._state = self._held, b"", 0
        return held


# Fixed value: the split that `split_pieces` makes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_class: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of each code point: 0 other, 1 letter, 2 number, 3 white space."""
    global _class
    if _class is None:
        table = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LN":
                table[c] = 1 if kind == "L" else 2
        table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
        _class = table
    return _class


def split_pieces(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends and hash of each piece, and pieces before each text, by PATTERN."""
    if len(raw) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    text = np.searchsorted(byte, at)
    n = len(code)
    kind = _classes()[code]
    begins = np.zeros(n + 1, dtype=bool)
    begins[text] = True
    turn = np.ones(n, dtype=bool)
    turn[1:] = (kind[1:] != kind[:-1]) | begins[1:-1]
    start = turn.copy()
    # a space before other than white space goes with it
    start[1:] &= ~((kind[1:] != 3) & (code[:-1] == 0x20) & ~begins[1:-1])
    # the last of several white spaces before something else stands apart
    final = np.zeros(n, dtype=bool)
    final[:-1] = (kind[:-1] == 3) & (kind[1:] != 3) & ~begins[1:-1]
    start |= final
    marks = np.flatnonzero((code == 0x27) & start)
    if len(marks):
        end_of = text[np.searchsorted(text, marks, side="right")]
        one = np.where(marks + 1 < end_of, code[np.minimum(marks + 1, n - 1)], 0)
        two = np.where(marks + 2 < end_of, code[np.minimum(marks + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((short, 2), (long, 3)):
            start[marks[hit] + 1] = False
            after = marks[hit] + size
            start[after[after < end_of[hit]]] = True
    first = np.flatnonzero(start)
    last = np.append(first[1:], n)
    return byte[first], byte[last], span_hashes(mix(code.astype(np.uint64) + np.uint64(1)), first, last), np.searchsorted(first, text)


class _Codec:
    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.transducer, self.cache = Transducer(self.ranks), SpanCache(PIECES, np.int32)
        self.decoder = StreamingDecoder(self.ranks)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and ids before each text."""
        first, last, keys, before = split_pieces(raw, at)
        data = raw.tobytes()
        fetch = lambda spans: [self.transducer.encode(data[a:b]) for a, b in zip(first[spans].tolist(), last[spans].tolist(), strict=True)]
        ids, total = self.cache.lookup(keys, fetch)
        return ids, total[before]


_codecs: dict[str, _Codec] = {}


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 65536, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row: its whole text encoded, then decoded in chunks.

    A null text is empty: no tokens, digests of no bytes. Strings of special tokens
    are ordinary text. Bytes that are not UTF-8 count as U+FFFD. A text longer than a
    block is a block of its own. Repeated rows and null ids are rows like others;
    other columns are ignored. `pattern` must be the split that is built in.
    """
    if pattern != PATTERN:
        raise ValueError(f"only the split {PATTERN} is built in")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get(vocabulary)
        if codec is None:
            codec = _codecs[vocabulary] = _Codec(vocabulary)
        for block, raw, at in blocks(batches, "_text"):
            ids, before = codec.encode(raw, at)
            counts, coded, decoded = np.diff(before), [], []
            for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
                own = ids[a:b]
                coded.append(hashlib.sha256(own.astype("<u4")).hexdigest())
                digest = hashlib.sha256()
                for c in range(0, len(own), chunk):
                    digest.update(codec.decoder.feed(own[c : c + chunk]))
                digest.update(codec.decoder.finish())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(f"make_valid_utf8(cast(`{text_col}` as string))").alias("_text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
