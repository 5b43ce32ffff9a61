"""Encoding and decoding with content-defined chunks that documents share.

1. A rolling (gear) hash over the last 32 bytes cuts each text where its high bits
   are zero, so passages that documents share are cut alike. Chunks, each once a
   block of texts, go to the bucket of their digest.
2. A bucket encodes each distinct chunk once and answers every block that sent it.
3. Where two chunks join, words and marks may run over the cut. A window from white
   space in the left chunk to white space in the right one is encoded as a whole and
   as its two sides. It repairs the join if the whole agrees with the left side from
   the start on, and with the right side to the end, over complete words; otherwise
   both chunks become part of the window and it is encoded again, up to the whole
   text. A chunk with hardly any white space is part of a window from the start.
4. Blocks put their texts together: the reused ids of chunks without what windows
   cover, which must be the windows' sides by length and checksum, and the windows' own.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import SegmentTokenizer
from .textkernel import _WHITE, blocks, mix

#: Bytes of a chunk: at least, on average beyond that, and at most.
LEAST, USUAL_BITS, MOST = 256, 10, 8192
#: White space to each side that a window reaches over; a chunk with less than twice as much and two is part of a window.
REACH = 3
#: Text of a block, and of the chunks of a bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
#: Blocks that share a bucket's answers: a chunk that very many blocks hold is encoded once for each so many, in different tasks.
REGION = 4096

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def rolling(raw: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the 32 latest bytes' codes, each shifted by its age."""
    out = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        out[step:] = out[step:] + (out[:-step] << np.uint32(step))
    return out


def cut_points(raw: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """For each text of a block the ends of its chunks. They depend on the text only: the first bytes, whose hash knows what came before, are never cut at."""
    found = (np.flatnonzero(rolling(raw) >> np.uint32(32 - USUAL_BITS) == 0) + 1).tolist()
    out = []
    for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        mine: list[int] = []
        while end - start > LEAST:
            k = bisect_left(found, start + LEAST)
            cut = min(found[k] if k < len(found) else end, start + MOST)
            while cut < end and raw[cut] & 0xC0 == 0x80:
                cut += 1
            if cut >= end:
                break
            mine.append(cut)
            start = cut
        out.append([*mine, end] if end > start else mine)
    return out


class Repairer:
    """Windows over the joins of chunks, encoded until they agree with the chunks."""

    def __init__(self, tokenizer: SegmentTokenizer):
        self._library = tokenizer.library
        self._ends_word = [t.endswith("</w>") or t.startswith("<|") for t in tokens_of(self._library)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def agrees(self, whole: list[int], left: list[int] | None, right: list[int] | None) -> bool:
        """Whether the whole begins like the left side over at least a word, and ends like the right side likewise; a missing side is the text's own end."""
        head = tail = 0
        if left is not None:
            same = next((i for i, (a, b) in enumerate(zip(whole, left, strict=False)) if a != b), min(len(whole), len(left)))
            head = next((i for i in range(same, 0, -1) if self._ends_word[whole[i - 1]]), 0)
        if right is not None:
            same = next((i for i, (a, b) in enumerate(zip(reversed(whole), reversed(right), strict=False)) if a != b), min(len(whole), len(right)))
            starts = lambda ids, n: n == len(ids) or self._ends_word[ids[-n - 1]]
            tail = next((i for i in range(same, 0, -1) if starts(whole, i) and starts(right, i)), 0)
        return (left is None or head > 0) and (right is None or tail > 0) and head + tail <= len(whole)

    def repair(self, raw: bytes, white: np.ndarray, bounds: list[tuple[int, list[int]]]) -> list[tuple[list[tuple[int, int]], list[tuple[list[int], list[int], list[int]]]]]:
        """For each text (start, chunk ends): its chunks to reuse, and the windows before, between and after them as (whole, left side, right side)."""
        done: list = [None] * len(bounds)
        solid: list[set[int]] = []
        for start, ends in bounds:
            inside = np.diff(np.searchsorted(white, [start, *ends]))
            solid.append(set(np.flatnonzero(inside < 2 * REACH + 2).tolist()))
        todo = range(len(bounds))
        while todo:
            asked: list[str] = []
            plans = []
            for t in todo:
                start, ends = bounds[t]
                chunks = [(a, b) for k, (a, b) in enumerate(zip([start, *ends], ends, strict=False)) if k not in solid[t]]
                windows = []
                for (_, left), (right, _) in zip([(None, None), *chunks], [*chunks, (None, None)], strict=True):
                    a = start if left is None else int(white[np.searchsorted(white, left) - REACH])
                    b = (ends[-1] if ends else start) if right is None else int(white[np.searchsorted(white, right) + REACH - 1]) + 1
                    if left is None and right == start or right is None and left == b or b <= a:
                        windows.append(None)
                        continue
                    windows.append((len(asked), left is not None, right is not None))
                    asked += [raw[a:b].decode(), raw[a:left].decode() if left is not None else "", raw[right:b].decode() if right is not None else ""]
                plans.append((t, chunks, windows))
            ids = self.encode(asked)
            again = []
            for t, chunks, windows in plans:
                wrong = set()
                for k, w in enumerate(windows):
                    if w and not self.agrees(ids[w[0]], ids[w[0] + 1] if w[1] else None, ids[w[0] + 2] if w[2] else None):
                        wrong |= {chunks[i] for i in (k - 1, k) if 0 <= i < len(chunks)}
                if wrong:
                    start, ends = bounds[t]
                    solid[t] |= {k for k, x in enumerate(zip([start, *ends], ends, strict=False)) if x in wrong}
                    again.append(t)
                else:
                    done[t] = chunks, [tuple(ids[w[0] : w[0] + 3]) if w else ([], [], []) for w in windows]
            todo = again
        return done


def tokens_of(library) -> list[str]:
    return [library.id_to_token(i) or "" for i in range(library.get_vocab_size(with_added_tokens=True))]


_tokenizers: dict[str, SegmentTokenizer] = {}


def _tokenizer(path: str) -> SegmentTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = SegmentTokenizer(path)
    return _tokenizers[path]


def _packed(*parts, level: int = 3) -> bytes:
    return zstandard.compress(pickle.dumps(parts, protocol=5), level)


def _unpacked(data: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(data))


def pack_ids(ids: np.ndarray) -> tuple[bytes, int, bytes, bytes]:
    """Ids by their rank of frequency among these: one byte for frequent ones, and a second, kept apart, for the others. The first bytes then compress to about their entropy."""
    times = np.bincount(ids, minlength=1)
    by = np.argsort(-times, kind="stable")[: np.count_nonzero(times)].astype(np.uint16)
    rank = np.zeros(len(times), dtype=np.int64)
    rank[by] = np.arange(len(by))
    frequent = 255 - (max(len(by) - 1, 0) >> 8)
    mine = rank[ids]
    far = mine >= frequent
    first = np.where(far, frequent + (mine - frequent >> 8), mine)
    return by.tobytes(), frequent, first.astype(np.uint8).tobytes(), (mine[far] - frequent & 255).astype(np.uint8).tobytes()


def unpack_ids(by: bytes, frequent: int, first: bytes, second: bytes) -> np.ndarray:
    mine = np.frombuffer(first, dtype=np.uint8).astype(np.int64)
    far = mine >= frequent
    mine[far] = frequent + (mine[far] - frequent << 8) + np.frombuffer(second, dtype=np.uint8)
    return np.frombuffer(by, dtype=np.uint16)[mine] if len(mine) else np.zeros(0, dtype=np.uint16)


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.array([i for x in lists for i in x], dtype=np.uint16)


def _sizes(lists: list) -> np.ndarray:
    return np.array([len(x) for x in lists], dtype=np.int32)


def _mark(ids) -> int:
    return zlib.crc32(np.asarray(ids, dtype=np.uint16).tobytes())


_SENT = "block binary, bucket int, data binary"


def _rows(rows: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
    block, bucket, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.binary()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], ["block", "bucket", "data"])


#: Rows that hold the outline of a block, not chunks, have this bit in their bucket, so that they are dealt like the others.
_OUTLINE = 1 << 30


def _cut(vocabulary: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(_tokenizer(vocabulary))
        for block, raw, at in blocks(batches, "_text", BLOCK_BYTES):
            data = raw.tobytes()
            doc_ids = block.column(0).to_pylist()
            # a block is named by what it holds: a task that is run again sends the same blocks
            name = hashlib.blake2b(data + repr((doc_ids, at.tolist(), block.column(2)[0].as_py())).encode(), digest_size=16).digest()
            region = int.from_bytes(name[:4], "little") % max(1, -(-buckets * BUCKET_BYTES // (BLOCK_BYTES * REGION)))
            outline = repairer.repair(data, np.flatnonzero(_WHITE[raw]), list(zip(at[:-1].tolist(), cut_points(raw, at), strict=True)))
            place: dict[bytes, tuple[int, int]] = {}
            sent: dict[int, list[bytes]] = {}
            used = []
            for chunks, _ in outline:
                for a, b in chunks:
                    chunk = data[a:b]
                    key = hashlib.blake2b(chunk, digest_size=16).digest()
                    if key not in place:
                        bucket = (int.from_bytes(key[:8], "little") + region) % buckets
                        mine = sent.setdefault(bucket, [])
                        place[key] = bucket, len(mine)
                        mine.append(chunk)
                    used.append(place[key])
            whole, left, right = ([w[k] for _, ws in outline for w in ws] for k in range(3))
            # of the windows' sides only lengths and checksums go on
            sides = [(_sizes(x), np.array([_mark(i) if i else 0 for i in x], dtype=np.uint32)) for x in (left, right)]
            own = _packed(doc_ids, _sizes([chunks for chunks, _ in outline]), np.array(used, dtype=np.int32).reshape(-1, 2), _sizes(whole), pack_ids(_flat(whole)), *sides)
            rows = [(name, bucket, _packed(_sizes(mine), b"".join(mine), level=5)) for bucket, mine in sent.items()]
            yield _rows([*rows, (name, int.from_bytes(name[4:8], "little") % buckets | _OUTLINE, own)])

    return run


def _encode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of a bucket to their ids, each distinct one encoded when first met."""
        tokenizer = _tokenizer(vocabulary)
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            out = []
            for block, bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket & _OUTLINE:
                    out.append((block, bucket, data))
                    continue
                sizes, content = _unpacked(data)
                end = np.cumsum(sizes).tolist()
                chunks = [content[b - n : b] for b, n in zip(end, sizes.tolist(), strict=True)]
                keys = [hashlib.blake2b(c, digest_size=16).digest() for c in chunks]
                fresh = [(k, c) for k, c in zip(keys, chunks, strict=True) if k not in known]
                if fresh:
                    at = np.concatenate([[0], np.cumsum([len(c) for _, c in fresh])])
                    ids, before = tokenizer.encode(np.frombuffer(b"".join(c for _, c in fresh), dtype=np.uint8), at)
                    for (k, _), a, b in zip(fresh, before[:-1].tolist(), before[1:].tolist(), strict=True):
                        known[k] = ids[a:b].copy()
                mine = [known[k] for k in keys]
                out.append((block, bucket, _packed(_sizes(mine), pack_ids(np.concatenate(mine)), level=1)))
            if out:
                yield _rows(out)

    return run


def _assemble(vocabulary: str):
    words: list[bytes] = []
    decimal: list[bytes] = []

    def run(table: pa.Table) -> pa.Table:
        """The outline and the encoded chunks of a block to its texts' rows."""
        if not words:
            words.extend(t.encode() for t in tokens_of(_tokenizer(vocabulary).library))
            decimal.extend(b"%d" % i for i in range(len(words)))
        outline, chunks = None, {}
        for bucket, data in zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True):
            if bucket & _OUTLINE:
                outline = _unpacked(data)
            else:
                sizes, ids = _unpacked(data)
                chunks[bucket] = unpack_ids(*ids), np.concatenate([[0], np.cumsum(sizes)])
        if outline is None:
            raise ValueError("chunks of a block without its outline: the input changed while it was read again")
        doc_ids, counts, used, sizes, ids, left, right = outline
        ids = unpack_ids(*ids)
        whole = [ids[b - n : b] for b, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
        left, right = ([x.tolist() for x in side] for side in (left, right))
        w = c = 0
        rows = []
        for doc_id, n in zip(doc_ids, counts.tolist(), strict=True):
            parts = [whole[w]]
            for k in range(n):
                ids, at = chunks[used[c + k][0]]
                mine = ids[at[used[c + k][1]] : at[used[c + k][1] + 1]]
                begin, end = right[0][w + k], len(mine) - left[0][w + k + 1]
                if end < begin or begin and _mark(mine[:begin]) != right[1][w + k] or end < len(mine) and _mark(mine[end:]) != left[1][w + k + 1]:
                    raise ValueError(f"a chunk of document {doc_id} does not agree with the windows at its ends")
                parts += [mine[begin:end], whole[w + k + 1]]
            w, c = w + n + 1, c + n
            ids = np.concatenate(parts).tolist()
            rows.append((doc_id, len(ids), hashlib.sha256(b" ".join([decimal[i] for i in ids])).hexdigest(), hashlib.sha256(b" ".join([words[i] for i in ids])).hexdigest()))
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row.

    Ids are those of the tokenizers library without added special tokens; decoded is
    their tokens joined by spaces, which is how it decodes a vocabulary without a
    decoder. A null text is empty and has no ids. Bytes that are not UTF-8 count as
    U+FFFD. Texts of any length are cut into chunks, and one longer than a block is a
    block of its own. Rows that repeat or lack an id are encoded each for itself. An
    empty table gives no rows; other columns are ignored. A task that is run again
    must see its rows in the same order, as from files; else the run ends with an
    error.
    """
    text = F.expr(f"make_valid_utf8(cast(`{text_col}` as string))")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), F.monotonically_increasing_id().alias("_row"))
    sent = rows.mapInArrow(_cut(vocabulary, buckets), _SENT).repartition(buckets, "bucket")
    answered = sent.mapInArrow(_encode(vocabulary), _SENT)
    return answered.groupBy("block").applyInArrow(_assemble(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
