"""Near-duplicate vectors by hashing to the E8 lattice.

Unit vectors are projected to eight dimensions by a random matrix in each of
several tables, shifted, and decoded to the nearest point of the lattice E8: its
cell. A vector enters its own cell and probes it and the neighbouring cells (of the
240 around it) that lie nearest. Vectors that meet in a cell are compared by cosine
in double precision. A pair may meet in several cells; it is counted in the first
only, which both vectors tell by themselves, so no list of pairs is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import attach, components, materialise
from .textkernel import mix

TABLES, PROBES = 4, 6
#: Size of a projected unit vector in lattice units: small enough that pairs at THRESHOLD nearly always meet.
SCALE = 0.7
THRESHOLD = 0.93
#: Vectors of a cell that enter and that probe in one comparison; larger cells are compared block by block.
ENTERING, PROBING = 1024, 4096


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or halves with an even number of minus signs."""
    out = []
    for a in range(8):
        for b in range(a):
            for s in (1.0, -1.0):
                for t in (1.0, -1.0):
                    v = np.zeros(8)
                    v[a], v[b] = s, t
                    out.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


_NEAR = _minimal()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer point of even sum: where rounding gives an odd one, the worst entry is rounded the other way."""
    point = np.rint(x)
    rest = x - point
    worst = np.abs(rest).argmax(axis=1)
    row = np.flatnonzero(point.sum(axis=1).astype(np.int64) & 1)
    point[row, worst[row]] += np.where(rest[row, worst[row]] >= 0, 1.0, -1.0)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 + 1/2, to each row."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


class LatticeTables:
    """The projections for vectors of one dimension."""

    def __init__(self, dimension: int, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 29):
        rng = np.random.default_rng([seed, dimension])
        self.tables, self.probes = tables, probes
        self._project = rng.normal(size=(tables, dimension, 8)) * scale
        self._shift = rng.uniform(0, 1, (tables, 8))
        self._weights = mix(np.arange(1, 9, dtype=np.uint64) + np.uint64(dimension << 8)) | np.uint64(1)

    def cells(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes) keys: own cell first, then the neighbours, nearest first."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), dtype=np.int64)
        tag = label.astype(np.int64).astype(np.uint64)
        for t in range(self.tables):
            # summed over dimensions in one order for every batch, so that a vector's cells never depend on its company
            x = np.einsum("nd,dk->nk", unit, self._project[t]) + self._shift[t]
            point = decode(x)
            order = np.argsort(-((x - point) @ _NEAR.T).round(9), axis=1, kind="stable")[:, : self.probes]
            every = np.concatenate([point[:, None, :], point[:, None, :] + _NEAR[order]], axis=1)
            code = ((2 * every).astype(np.int64).astype(np.uint64) * self._weights).sum(axis=2, dtype=np.uint64)
            out[:, t] = mix(code + (mix(tag) + np.uint64((t + 1) * 0xA24BAED4963EE407 % (1 << 64)))[:, None]).view(np.int64)
        return out


def _units(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), dtype="<f8").reshape(len(data), -1)
    x = x / np.abs(x).max(axis=1)[:, None]  # so that no square is lost or too large
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


#: Adding zero makes one of both zeros, so that equal vectors have equal bits.
_DOUBLES = "transform({0}, x -> cast(x as double) + 0D)"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (node, label, vector) to rows (key, node, enters)."""
    for batch in batches:
        node, label, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        for dim, rows in _by_dimension(vectors):
            cells = LatticeTables(dim).cells(_units([vectors[i] for i in rows]), label[rows])
            n, tables, each = cells.shape
            key = np.concatenate([cells[:, :, 0].ravel(), cells.ravel()])
            who = np.concatenate([np.repeat(node[rows], tables), np.repeat(node[rows], tables * each)])
            enters = np.zeros(len(key), dtype=bool)
            enters[: n * tables] = True
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who), pa.array(enters)], ["key", "node", "enters"])


def _by_dimension(vectors: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    size = np.array([len(v) // 8 for v in vectors], dtype=np.int64)
    for dim in np.unique(size).tolist():
        yield dim, np.flatnonzero(size == dim)


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Rows (cell, key, node, enters, label, vector, copies) to (node, other, links): links found here, and pairs that join."""
        cell = np.array(table.column("cell").to_pylist())
        out: list[tuple[int, int | None, int]] = []
        columns = {c: table.column(c).to_numpy() for c in ("key", "node", "label", "copies")}
        enters, vectors = np.asarray(table.column("enters").to_pylist(), dtype=bool), table.column("vector").to_pylist()
        _, group = np.unique(cell, return_inverse=True)
        order = np.argsort(group, kind="stable")
        cut = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
        for lo, hi in zip(cut, np.append(cut[1:], len(order)), strict=True):
            mine = order[lo:hi]
            for dim, pick in _by_dimension([vectors[i] for i in mine]):
                rows = mine[pick]
                if enters[rows].any() and not enters[rows].all():
                    out += _cell(rows, columns, enters, vectors, dim, threshold)
        names = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in names], names=["node", "other", "links"])

    return run


def _cell(rows: np.ndarray, columns: dict, enters: np.ndarray, vectors: list, dim: int, threshold: float) -> list[tuple[int, int | None, int]]:
    inside, probing = rows[enters[rows]], rows[~enters[rows]]
    node, label, copies = columns["node"], columns["label"], columns["copies"]
    left, right = _units([vectors[i] for i in probing]), _units([vectors[i] for i in inside])
    p, e = np.nonzero((left @ right.T >= threshold) & (label[probing][:, None] == label[inside][None]) & (node[probing][:, None] != node[inside][None]))
    if len(p) == 0:
        return []
    tables = LatticeTables(dim)
    used_p, p = np.unique(p, return_inverse=True)
    used_e, e = np.unique(e, return_inverse=True)
    cells_p, cells_e = tables.cells(left[used_p], label[probing[used_p]]), tables.cells(right[used_e], label[inside[used_e]])
    probing, inside = probing[used_p], inside[used_e]
    key = columns["key"][rows[0]]
    first = np.zeros(len(p), dtype=bool)
    for at in range(0, len(p), 100_000):
        part = slice(at, at + 100_000)
        first[part] = _meets_here_first(cells_p[p[part]], cells_e[e[part]], node[probing[p[part]]], node[inside[e[part]]], key)
    p, e = p[first], e[first]
    out: list[tuple[int, int | None, int]] = []
    for who, found in ((probing, np.bincount(p, weights=copies[inside[e]], minlength=len(probing))), (inside, np.bincount(e, weights=copies[probing[p]], minlength=len(inside)))):
        out += [(int(node[i]), None, int(n)) for i, n in zip(who, found, strict=True) if n]
    # pairs that join: a forest over the vectors here
    root = {int(x): int(x) for x in (*node[probing], *node[inside])}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(node[probing[p]].tolist(), node[inside[e]].tolist(), strict=True):
        a_top, b_top = top(a), top(b)
        if a_top != b_top:
            root[max(a_top, b_top)] = min(a_top, b_top)
            out.append((a, b, 0))
    return out


def _meets_here_first(probe: np.ndarray, enter: np.ndarray, a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """Whether a pair, a probing cell `key` that b entered, meets here for the first time.

    Tables come in turn. In a table, a pair with one own cell meets there, the
    smaller node probing; else where the smaller node probes the other's cell; else
    where the larger one does.
    """
    small, large = np.where((a < b)[:, None, None], probe, enter), np.where((a < b)[:, None, None], enter, probe)
    out = np.zeros(len(a), dtype=bool)
    done = np.zeros(len(a), dtype=bool)
    for t in range(probe.shape[1]):
        by_small = (small[:, t] == large[:, t, :1]).any(axis=1)
        by_large = (large[:, t] == small[:, t, :1]).any(axis=1) & ~by_small
        here = np.where(a < b, by_small & (large[:, t, 0] == key), by_large & (small[:, t, 0] == key))
        out |= here & ~done
        done |= by_small | by_large
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    Vectors are compared within a label (of any type) and a dimension. A null label, and a vector
    that is null, empty, zero or holds a null or non-finite component, links with
    nothing. Equal vectors are linked and compared with others once. Rows with a
    null id link like others; a component without any id has a null one. An empty
    table gives no rows; other columns are ignored.
    """
    v = F.col(vector_col)
    sound = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    doubles = F.expr(_DOUBLES.format(f"`{vector_col}`"))
    # labels of any type, by the hash of their text
    label = F.xxhash64(F.lit(3), F.col(label_col).cast("string"))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.coalesce(sound, F.lit(False)).alias("sound"), label.alias("label"), doubles.alias("vector"),
        F.xxhash64(F.lit(1), label, doubles).alias("node"), F.xxhash64(F.lit(2), label, doubles).alias("check"),
    )
    classes = rows.where("sound").groupBy("label", "node", "check").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    pack = lambda batches: (_packed(b) for b in batches)
    classes = classes.mapInArrow(pack, "label long, node long, check long, first_id long, copies long, vector binary")
    classes = materialise(classes, "classes")
    placed = materialise(classes.select("node", "label", "vector").mapInArrow(_place, "key long, node long, enters boolean"), "cells")
    held = placed.groupBy("key").agg(F.count_if("enters").alias("n_in"), F.count_if(~F.col("enters")).alias("n_out")).where("n_in >= 1 and n_out >= 2")
    busy = placed.join(held, "key")
    ins, outs = F.ceil(F.col("n_in") / ENTERING).cast("int"), F.ceil(F.col("n_out") / PROBING).cast("int")
    own = lambda parts: F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
    busy = busy.withColumn("a", F.when(F.col("enters"), F.array(own(ins))).otherwise(F.sequence(F.lit(0), ins - 1))).withColumn("b", F.when(F.col("enters"), F.sequence(F.lit(0), outs - 1)).otherwise(F.array(own(outs))))
    busy = busy.withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).withColumn("cell", F.concat_ws("/", F.col("key").cast("string"), "a", "b"))
    full = busy.select("cell", "key", "node", "enters").join(classes.select("node", "label", "vector", "copies"), "node")
    total = max(1, classes.count() // 1000)
    found = full.withColumn("bin", F.pmod(F.xxhash64("cell"), F.lit(total))).select("bin", "cell", "key", "node", "enters", "label", "vector", "copies").groupBy("bin").applyInArrow(_compare(threshold), "node long, other long, links long")
    found = materialise(found, "found")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    sets = classes.select("node", "check", "first_id", "copies").join(links, "node", "left").join(joined, "node", "left").withColumn("team", F.coalesce("component", "node"))
    sets = materialise(sets, "members")
    lowest = sets.groupBy("team").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_count"))
    sets = attach(sets, lowest, "team", sets.count()).select(F.col("node").alias("_node"), F.col("check").alias("_check"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.col("component_id").alias("_component"))
    out = rows.select("vec_id", "sound", "node", "check").join(sets, F.col("sound") & (F.col("node") == F.col("_node")) & (F.col("check") == F.col("_check")), "left")
    component = F.when(F.col("sound"), F.col("_component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The last column's vectors as bytes of 64-bit floats."""
    data = [np.array(x, dtype="<f8").tobytes() for x in batch.column(5).to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(data, pa.binary())], batch.schema.names)
