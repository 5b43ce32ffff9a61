"""Exact Jaccard join of word-shingle sets by a size-aware heavy-light scheme.

1. Signatures: each text's set size and an order-free fingerprint of its set.
   Texts with equal sets are one *set* from here on.
2. Document frequencies of all shingles are counted exactly in a columnar shuffle:
   tasks send sorted, compressed blocks of shingle codes by hash range, and get back
   only the codes that occur more than once. A pair with Jaccard >= t shares at
   least t*n shingles, so a set with fewer repeated shingles than that is done.
3. Candidates, with shingles ordered by (frequency, code). Two sets that share o
   shingles share one of their first n-o+1 and a pair out of their first n-o+2.
   Sets up to a boundary size (*light*) are keyed by the 2-subsets of the latter;
   larger ones (*heavy*) by the single shingles of the former, whose inverted lists
   are scanned; light sets near the boundary enter those lists too. The boundary
   is the size at which the sum of both costs is least.
4. Sets connected by keys are verified together by counting along inverted lists.
   A connected group too large for one task is verified list by list, or in pairs of
   blocks, whichever moves fewer codes; a list too large is cut into blocks as well.
   Only links that join components are written, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import attach, components, materialise, without
from .textkernel import blocks, mix, shingle_hashes, word_hashes

SHINGLE = 5
#: Similarity at least PERCENT / 100.
PERCENT = 80
#: Shingles of a bucket of the frequency count, and of a block of texts.
BUCKET_SHINGLES, BLOCK_SHINGLES, BLOCK_TEXTS = 1_500_000, 2_000_000, 60_000
#: A code in more texts of a block than this is counted there and listed beside the count.
LOCAL = 4
#: Codes verified together; larger candidate groups are taken apart, or compared block by block.
TASK_CODES = 150_000
#: Cost of a shuffled key in entries of a scanned list (a row moves in about 1 us, an entry in about 10 ns).
KEY_COST = 100
_AGGREGATED = 0xFFFF


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_a, text_b, n, fp): keys of the text, the number of distinct shingles and the fingerprint of the set, for every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, raw, at in blocks(batches, "_text"):
            values, before = shingle_hashes(*word_hashes(raw, at), size)
            yield pa.RecordBatch.from_arrays([*block.columns[:3], pa.array(np.diff(before), pa.int64()), pa.array(_fingerprints(values, before).view(np.int64))], ["doc_id", "text_a", "text_b", "n", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *_text_keys(F.col(text_col)), F.col(text_col).alias("_text")).mapInArrow(sign, "doc_id long, text_a long, text_b long, n long, fp long")


def _text_keys(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(F.lit(seed), text).alias(name) for seed, name in ((1, "text_a"), (2, "text_b"))]


def _fingerprints(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return mix((total[before[1:]] - total[before[:-1]]) + np.diff(before).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _press(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a.tobytes()) for a in arrays)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpress(data: bytes, *kinds: str) -> list[np.ndarray]:
    plain = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(plain, dtype="<i8", count=len(kinds) + 1)[1:]
    at, out = 8 * (len(kinds) + 1), []
    for kind, n in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(plain, dtype=kind, count=n // np.dtype(kind).itemsize, offset=at))
        at += n
    return out


def _send_codes(buckets: int, bits: int, size: int):
    """Texts to rows (dest, block, kind, data): codes by range to buckets 0.., and what stays with the block to dests below 0.

    kind 0: codes with text and count; kind 1: fingerprints and sizes of the block's
    texts; kind 2: (code, text) of codes common within the block.
    """
    shift = np.uint64(64 - bits)

    def flush(block: str, held: list[tuple[np.ndarray, np.ndarray]], sets: list[tuple[int, int]], home: int) -> Iterator[tuple]:
        code, text = np.concatenate([c for c, _ in held]), np.concatenate([t for _, t in held])
        order = np.lexsort((text, code))
        code, text = code[order], text[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        times = np.diff(np.append(first, len(code)))
        common = np.repeat(times > LOCAL, times)
        yield home, block, 1, _press(np.array([f for f, _ in sets], dtype="<i8"), np.array([n for _, n in sets], dtype="<i8"))
        if common.any():
            yield home, block, 2, _press(code[common], text[common].astype("<u2"))
        keep = ~common
        keep[first] = True
        count = np.where(common, np.repeat(times, times), 1)[keep].astype("<u4")
        text = np.where(common, _AGGREGATED, text)[keep].astype("<u2")
        code = code[keep]
        dest = (code >> np.uint64(max(0, bits - 20))).astype(np.int64) * buckets >> min(bits, 20)
        cut = np.searchsorted(dest, np.arange(buckets + 1))
        for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            part = slice(cut[b], cut[b + 1])
            yield b, block, 0, _press(np.diff(code[part], prepend=np.uint64(0)), text[part], count[part])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        sets: list[tuple[int, int]] = []
        amount = number = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, sets, amount, number
            if held:
                for row in flush(f"{task}-{number}", held, sets, -1 - (task * 31 + number) % buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]]), pa.array([row[2]], pa.int32()), pa.array([row[3]], pa.binary())], ["dest", "block", "kind", "data"])
            held, sets, amount, number = [], [], 0, number + 1

        for _, raw, at in blocks(batches, "_text"):
            values, before = shingle_hashes(*word_hashes(raw, at), size)
            prints = _fingerprints(values, before).view(np.int64).tolist()
            counts = np.diff(before)
            fresh = np.zeros(len(prints), dtype=bool)
            for i, p in enumerate(prints):
                if counts[i] > 0 and p not in seen:
                    seen.add(p)
                    fresh[i] = True
            own = np.cumsum(fresh) - 1 + len(sets)
            use = np.repeat(fresh, counts)
            if use.any():
                held.append((values[use] >> shift, np.repeat(own, counts)[use]))
                amount += int(use.sum())
            sets += [(p, int(n)) for p, n, f in zip(prints, counts, fresh, strict=True) if f]
            if amount >= BLOCK_SHINGLES or len(sets) >= BLOCK_TEXTS // 2:
                yield from out()
        yield from out()

    return send


_ROW = "dest int, block string, kind int, data binary"


def _count_codes(table: pa.Table) -> pa.Table:
    """A bucket's rows to answers: for each block, its codes that occur in two or more texts, with text and frequency (kind 3)."""
    if table.num_rows == 0 or table.column("dest")[0].as_py() < 0:
        return table.select(["dest", "block", "kind", "data"])
    codes, texts, counts, rows = [], [], [], []
    for i, data in enumerate(table.column("data")):
        delta, text, count = _unpress(data.as_py(), "<u8", "<u2", "<u4")
        codes.append(np.cumsum(delta))
        texts.append(text)
        counts.append(count)
        rows.append(np.full(len(text), i, dtype=np.int32))
    code, text, count, row = (np.concatenate(x) for x in (codes, texts, counts, rows))
    order = np.argsort(code, kind="stable")
    code, text, count, row = code[order], text[order], count[order], row[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    total = np.repeat(np.add.reduceat(count.astype(np.int64), first), np.diff(np.append(first, len(code))))
    again = total > 1
    code, text, total, row = code[again], text[again], np.minimum(total[again], 0xFFFFFFFF).astype("<u4"), row[again]
    order = np.argsort(row, kind="stable")
    code, text, total, row = code[order], text[order], total[order], row[order]
    names = table.column("block").to_pylist()
    cut = np.searchsorted(row, np.arange(len(names) + 1))
    kept = [i for i in range(len(names)) if cut[i + 1] > cut[i]]
    data = [_press(code[cut[i] : cut[i + 1]], text[cut[i] : cut[i + 1]], total[cut[i] : cut[i + 1]]) for i in kept]
    return pa.table([pa.array([0] * len(kept), pa.int32()), pa.array([names[i] for i in kept], pa.string()), pa.array([3] * len(kept), pa.int32()), pa.array(data, pa.binary())], names=["dest", "block", "kind", "data"])


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def _survivors(percent: int):
    def settle(table: pa.Table) -> pa.Table:
        """A block's rows to its sets that may link: fp, n, alone (shingles in no other text), codes by (frequency, code)."""
        prints = sizes = np.zeros(0, dtype=np.int64)
        common_code, common_text = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint16)
        codes, texts, totals = [], [], []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
            if kind == 1:
                prints, sizes = _unpress(data.as_py(), "<i8", "<i8")
            elif kind == 2:
                common_code, common_text = _unpress(data.as_py(), "<u8", "<u2")
            else:
                code, text, total = _unpress(data.as_py(), "<u8", "<u2", "<u4")
                codes.append(code)
                texts.append(text)
                totals.append(total)
        rows: list[tuple] = []
        if codes:
            code, text, total = np.concatenate(codes), np.concatenate(texts), np.concatenate(totals)
            spread = text == _AGGREGATED
            if spread.any():
                order = np.argsort(code[spread])
                frequency = total[spread][order][np.searchsorted(code[spread][order], common_code)]
                code = np.concatenate([code[~spread], common_code])
                text = np.concatenate([text[~spread], common_text])
                total = np.concatenate([total[~spread], frequency])
            order = np.lexsort((code, total, text))
            code, text = code[order], text[order]
            cut = np.searchsorted(text, np.arange(len(prints) + 1))
            held = np.diff(cut)
            for i in np.flatnonzero(held >= np.maximum(_need(sizes, percent), 1)).tolist():
                rows.append((int(prints[i]), int(sizes[i]), int(sizes[i] - held[i]), code[cut[i] : cut[i + 1]].astype("<u8").tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["fp", "n", "alone", "codes"])

    return settle


def _keys(percent: int, light_to: int, all_lists: bool = False):
    """Sets to rows (key, fp, n): a prefix shingle of a heavy set, or a 2-subset of a light one."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, size = [], [], []
            for f, n, alone, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("fp", "n", "alone", "codes")), strict=True):
                code = np.frombuffer(data, dtype="<u8")
                free = n - int(_need(np.int64(n), percent)) + 1 - alone
                light = n <= light_to
                if all_lists or not light or n * 100 >= percent * (light_to + 1):
                    key.append(mix(code[: max(free, 0)]))
                    fp.append(np.full(len(key[-1]), f))
                    size.append(np.full(len(key[-1]), n))
                if light and not all_lists:
                    few = code[: max(free + 1, 0)]
                    a, b = np.triu_indices(len(few), 1)
                    key.append(mix(few[a] * np.uint64(0x9FB21C651E98DF25) + few[b]))
                    fp.append(np.full(len(a), f))
                    size.append(np.full(len(a), n))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(fp), pa.int64()), pa.array(np.concatenate(size), pa.int64())], ["key", "fp", "n"])

    return make


_KEY = "key long, fp long, n long"


def _boundary(sets: DataFrame, percent: int) -> int:
    """The size up to which keying by 2-subsets costs less than scanning lists, over all sets.

    Sizes are gathered in bins of a few per cent, so a few hundred rows reach the driver.
    """
    lists = sets.mapInArrow(_keys(percent, 0, all_lists=True), _KEY)
    lengths = lists.groupBy("key").agg(F.count(F.lit(1)).alias("len"))
    # every list is scanned once for each set in it: len entries for each of its len members, shared among their size bins
    per_list = lists.groupBy("key", F.floor(F.log("n") * 12).alias("bin")).agg(F.count(F.lit(1)).alias("own"))
    scan = per_list.join(lengths, "key").groupBy("bin").agg(F.sum(F.col("own") * (F.col("len") + KEY_COST)).alias("scan"))
    room = F.greatest(F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 2 - F.col("alone"), F.lit(0))
    subsets = sets.groupBy(F.floor(F.log("n") * 12).alias("bin")).agg(F.sum(room * (room - 1) / 2 * KEY_COST).alias("subsets"), F.max("n").alias("top"))
    rows = sorted(subsets.join(scan, "bin", "left").select("bin", "subsets", "scan", "top").collect())
    best, at = None, 0
    for k in range(len(rows) + 1):
        cost = sum(float(r["subsets"] or 0) for r in rows[:k]) + sum(float(r["scan"] or 0) for r in rows[k:])
        if best is None or cost < best:
            best, at = cost, rows[k - 1]["top"] if k else 0
    return int(at)


def _verify(percent: int):
    def check(table: pa.Table) -> pa.Table:
        """Rows (fp, n, codes, unit) to links (a, b) that span the true components within each unit."""
        a_out: list[int] = []
        b_out: list[int] = []
        _, team = np.unique(np.array(table.column("unit").to_pylist(), dtype=object), return_inverse=True)
        order = np.argsort(team, kind="stable")
        prints, sizes, data = table.column("fp").to_numpy(), table.column("n").to_numpy(), table.column("codes")
        cut = np.flatnonzero(np.append(True, team[order][1:] != team[order][:-1]))
        for lo, hi in zip(cut, np.append(cut[1:], len(order)), strict=True):
            rows = order[lo:hi]
            _, keep = np.unique(prints[rows], return_index=True)
            rows = rows[keep]
            if len(rows) > 1:
                for i, j in _spanning([np.frombuffer(data[int(r)].as_py(), dtype="<u8") for r in rows], sizes[rows], percent):
                    a_out.append(int(prints[rows[i]]))
                    b_out.append(int(prints[rows[j]]))
        return pa.table([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return check


def _spanning(codes: list[np.ndarray], sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of {(i, j): Jaccard >= percent/100}, overlaps counted along inverted lists."""
    length = np.array([len(c) for c in codes])
    owner = np.repeat(np.arange(len(codes)), length)
    _, word = np.unique(np.concatenate(codes), return_inverse=True)
    by = np.argsort(word, kind="stable")
    listed, start = owner[by], np.searchsorted(word[by], np.arange(word.max() + 2 if len(word) else 1))
    at = np.concatenate([[0], np.cumsum(length)])
    root = np.arange(len(codes))
    links: list[tuple[int, int]] = []
    for i in range(len(codes) - 1):
        rest = root[i + 1 :] != root[i]
        if not rest.any():
            continue
        own = word[at[i] : at[i + 1]]
        n = start[own + 1] - start[own]
        entries = listed[np.arange(int(n.sum())) + np.repeat(start[own] - (np.cumsum(n) - n), n)]
        both = np.bincount(entries, minlength=len(codes))[i + 1 :]
        hit = np.flatnonzero(rest & ((100 + percent) * both >= percent * (sizes[i] + sizes[i + 1 :]))) + i + 1
        for j in hit.tolist():
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs, and text_a, text_b, which tell apart the texts of a repeated id.

    A null or empty text, or one of white space only, has no shingles and links with
    nothing. A text with fewer words than `size` is one shingle. Equal sets are
    linked; rows that repeat an id share its component. A row with a null id has a
    null component unless a text with an id is linked to it. An empty table gives
    no rows; other columns are ignored.
    """
    signed = materialise(signatures(docs, id_col, text_col, size), "signatures")
    total = signed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    links = _links(docs, text_col, total, size, percent)
    sets = signed.where("n > 0").groupBy("fp", "n").agg(F.min("doc_id").alias("first_id"))
    if links is not None:
        joined = components(links)
        sets = sets.join(joined, sets["fp"] == joined["node"], "left").select("fp", "n", "first_id", F.coalesce("component", "fp").alias("team"))
        sets = materialise(sets, "members")
        lowest = sets.groupBy("team").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_count"))
        sets = attach(sets, lowest, "team", sets.count()).select("fp", "n", "component_id")
    else:
        sets = sets.withColumnRenamed("first_id", "component_id")
    sets = sets.withColumnRenamed("fp", "_fp").withColumnRenamed("n", "_n")
    # texts without words share one fingerprint, and need no partner
    some = signed.where("n > 0").join(sets, (F.col("fp") == F.col("_fp")) & (F.col("n") == F.col("_n"))).select("doc_id", "n", "component_id", "text_a", "text_b")
    none = signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "text_a", "text_b")
    return some.union(none).withColumnRenamed("n", "n_shingles")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that represent their near-duplicate group: those of its smallest id.

    Rows go by id and text together, so another text of a repeated id is judged for
    itself; a row without an id goes if its group has one. Texts without words stay.
    """
    gone = jaccard_components(docs, id_col, text_col).where("n_shingles > 0 and not doc_id <=> component_id").select("doc_id", "text_a", "text_b")
    return without(docs, [docs[id_col].cast("long"), *_text_keys(docs[text_col])], gone)


def _links(docs: DataFrame, text_col: str, total: int, size: int, percent: int) -> DataFrame | None:
    """Links between fingerprints that span the components of different sets; None if there are none."""
    if total == 0:
        return None
    buckets = max(1, -(-total // BUCKET_SHINGLES))
    # codes are long enough that a chance match of two shingles in a pair of sets is rarer than one in 10**9 pairs
    bits = min(64, max(48, total.bit_length() + 21))
    sent = docs.select(F.col(text_col).alias("_text")).mapInArrow(_send_codes(buckets, bits, size), _ROW)
    answers = sent.groupBy("dest").applyInArrow(_count_codes, _ROW)
    sets = answers.groupBy("block").applyInArrow(_survivors(percent), "fp long, n long, alone long, codes binary")
    sets = materialise(sets, "sets")
    sets = materialise(sets.dropDuplicates(["fp", "n"]), "sets")
    count = sets.count()
    if count < 2:
        return None
    light_to = _boundary(sets, percent)
    keys = materialise(sets.mapInArrow(_keys(percent, light_to), _KEY), "keys")
    leaders = keys.groupBy("key").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("_count")).where("_count > 1")
    stars = attach(keys, leaders, "key", keys.count(), least=1000).where("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b")).distinct()
    joined = components(stars)
    narrow = sets.select("fp", (F.octet_length("codes") / 8).cast("long").alias("w")).join(joined, F.col("fp") == joined["node"]).select("fp", "w", F.col("component").alias("team"))
    narrow = materialise(narrow, "teams")
    weights = narrow.groupBy("team").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("_count"))
    held = narrow.agg(F.coalesce(F.sum("w"), F.lit(0)), F.count(F.lit(1))).first()
    member = attach(narrow, weights, "team", held[1])
    work = _in_bins(member.where(F.col("total") <= TASK_CODES), held[0])
    if weights.where(F.col("total") > TASK_CODES).limit(1).count():
        work = work.union(_large_teams(member.where(F.col("total") > TASK_CODES), keys, held[0]))
    return work.join(sets, "fp").select("bin", "unit", "fp", "n", "codes").groupBy("bin").applyInArrow(_verify(percent), "a long, b long")


def _in_bins(member: DataFrame, codes: int) -> DataFrame:
    """(bin, unit, fp) of (team, fp): teams that fit in one task, dealt to bins by hash."""
    bins = max(1, 2 * codes // TASK_CODES)
    return member.select(F.pmod(F.xxhash64("team"), F.lit(bins)).cast("string").alias("bin"), F.col("team").cast("string").alias("unit"), "fp")


def _in_blocks(member: DataFrame) -> DataFrame:
    """(bin, unit, fp) of (team, fp, total): every two blocks of a team meet in a bin."""
    parts = F.ceil(F.col("total") * 2 / TASK_CODES).cast("int")
    cut = member.withColumn("_parts", parts).withColumn("_part", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("_parts")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("unit", F.col("team").cast("string"))
    return cut.select(F.concat_ws("/", "unit", F.least("_part", "_other").cast("string"), F.greatest("_part", "_other").cast("string")).alias("bin"), "unit", "fp")


def _large_teams(member: DataFrame, keys: DataFrame, codes: int) -> DataFrame:
    """(bin, unit, fp) of teams too large for a task, each the cheaper way.

    A team of true near copies has many different lists that all hold most of it: it
    is compared in pairs of blocks. A team that many small lists hold together is
    taken apart again into its different lists, whose members alone are candidates.
    """
    member = materialise(member.select("fp", "w", "team", "total"), "large")
    listed = keys.join(member, "fp").select("key", "fp", "w", "team", "total")
    lists = listed.groupBy("team", "key").agg(F.count(F.lit(1)).alias("len"), F.bit_xor(F.xxhash64("fp")).alias("sign"), F.sum("w").alias("list"), F.max("total").alias("total")).where("len > 1")
    # lists of the same members are one
    lists = materialise(lists.groupBy("team", "len", "sign").agg(F.min("key").alias("key"), F.max("list").alias("list"), F.max("total").alias("total")), "lists")
    cost = lists.groupBy("team").agg(F.sum("list").alias("lists"), F.max("total").alias("_total"), F.count(F.lit(1)).alias("_count"))
    cost = cost.withColumn("by_list", F.col("lists") < F.col("_total") * F.ceil(F.col("_total") * 2 / TASK_CODES)).select("team", "by_list", "_count")
    rows = member.count()
    whole = attach(member, cost, "team", rows).where("not by_list")
    apart = attach(lists, cost, "team", lists.count()).where("by_list").select("key", F.col("list").alias("_list"), F.col("len").alias("_count"))
    parts = attach(listed.select("key", "fp"), apart, "key", keys.count()).select(F.col("key").alias("team"), "fp", F.col("_list").alias("total"))
    return _in_blocks(whole).union(_in_bins(parts.where(F.col("total") <= TASK_CODES), codes)).union(_in_blocks(parts.where(F.col("total") > TASK_CODES)))
