"""A clustered layout of four columns, and how many files a query of each row's cell touches.

Each value becomes one of `parts` coordinates by the share of rows below it; a
row's *cell* is its four coordinates, and rows are ordered by interleaving their
binary digits, then cut into files. What queries need is then small: at most
parts**4 cells ask, files with equal bounds count once with a weight, and a cell
lies in one interval of files.

* A file is the eight-dimensional point of its bounds' corners. Its bounds meet a
  box exactly if the point is dominated by the box's own corner, so the files
  touched are counted by a KD-tree with subtree counts. Corners and cells are dealt
  into blocks and every pair of blocks is a task; counts are summed.
* Cells that share source and lang coordinates, parts**2 at most, form a tree of the
  same kind, which lists the file intervals of the cells in a box; their union is
  the files that hold a match.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kdtree import KdTree
from .storage import attach, discard, materialise, running

PARTS, PER_FILE, REACH = 16, 500, 2
#: The order of columns in bounds, and in a round of interleaving.
COLUMNS = ("source", "lang", "length", "date")
ROUND = ("length", "source", "date", "lang")
#: Blocks of file corners and of cells.
CORNER_BLOCKS, CELL_BLOCKS = 8, 4
_BOUNDS = [f"{end}_{c}" for c in COLUMNS for end in ("low", "high")]


def _coordinates(rows: DataFrame, n: int, parts: int) -> DataFrame:
    """Adds the coordinate of each column. The least value of each coordinate, parts of them a column, is all that reaches the driver."""
    as_name = lambda c: F.col(c) if c in ("source", "lang") else F.lit(None).cast("binary")
    as_number = lambda c: F.lit(None).cast("int") if c in ("source", "lang") else F.col(c)
    entries = F.array(*[F.struct(F.lit(k).alias("dim"), as_name(c).alias("name"), as_number(c).alias("number")) for k, c in enumerate(COLUMNS)])
    values = rows.select(F.explode(entries).alias("v")).select("v.*").groupBy("dim", "name", "number").agg(F.count(F.lit(1)).alias("rows"))
    # every column has n rows, so those of the columns before are taken off
    placed = running(values, ["dim", "name", "number"], "before", "rows").withColumn("part", F.expr(f"{parts} * (before - dim * {n}) div {max(n, 1)}"))
    least = placed.groupBy("dim", "part").agg(F.min(F.struct("name", "number")).alias("first")).collect()
    discard(placed)
    out = rows
    for k, c in enumerate(COLUMNS):
        begins = sorted(((r["part"], r["first"]["name"] if c in ("source", "lang") else r["first"]["number"]) for r in least if r["dim"] == k), reverse=True)
        at = F.lit(0)
        for part, value in reversed(begins[:-1]):  # a null, or a value below all others', has coordinate 0
            at = F.when(F.col(c) >= F.lit(value), F.lit(int(part))).otherwise(at)
        out = out.withColumn(f"at_{c}", at)
    return out


def _interleaved(parts: int) -> F.Column:
    z = F.lit(0).cast("long")
    for bit in reversed(range((parts - 1).bit_length())):
        for c in ROUND:
            z = z * 2 + F.shiftright(F.col(f"at_{c}"), bit).bitwiseAND(1)
    return z


def _boxes(cells: pd.DataFrame, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The query of each cell: its source and lang, and length and date at most `reach` away."""
    at = cells[[f"at_{c}" for c in COLUMNS]].to_numpy(dtype=np.int64)
    away = np.array([0, 0, reach, reach])
    return at - away, at + away


def _touched(reach: int):
    def run(corners: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        low = corners[[f"low_{c}" for c in COLUMNS]].to_numpy(dtype=np.int64)
        high = corners[[f"high_{c}" for c in COLUMNS]].to_numpy(dtype=np.int64)
        begin, end = _boxes(cells, reach)
        corner = np.hstack([end, -begin])
        n = KdTree(np.hstack([low, -high]), corners["files"].to_numpy()).count(np.full_like(corner, -(1 << 40)), corner)
        return pd.DataFrame({"z": cells["z"], "files": n})

    return run


def _matching(reach: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("z", ignore_index=True)
        points = cells[[f"at_{c}" for c in COLUMNS]].to_numpy(dtype=np.int64)
        box, cell = KdTree(points, np.ones(len(points), dtype=np.int64)).report(*_boxes(cells, reach))
        by = np.lexsort((cell, box))
        box, first, last = box[by], cells["first_file"].to_numpy()[cell[by]], cells["last_file"].to_numpy()[cell[by]]
        # cells come in the order of their files: each adds what the one before did not reach
        again = np.append(False, box[1:] == box[:-1])
        fresh = np.where(again, np.maximum(first, np.append(-1, last[:-1]) + 1), first)
        n = np.zeros(len(cells), dtype=np.int64)
        np.add.at(n, box, np.maximum(0, last - fresh + 1))
        return pd.DataFrame({"z": cells["z"], "files_matching": n})

    return run


def clustered(docs: DataFrame, parts: int = PARTS, per_file: int = PER_FILE, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, z, position, file, files_touched, files_matching, file_bounds for every row.

    A null is the smallest value of its column, and the length of a null text is -1;
    a null id has a null date and comes first in its cell. Rows that repeat an id each
    have a place, in no promised order. Equal values share a coordinate, so a value
    held by a third of the rows fills one, and its rows are told apart by id. An
    empty table gives no rows; other columns are ignored.
    """
    number = F.col(id_col).cast("long")
    rows = docs.select(
        number.alias("doc_id"), F.col(source_col).cast("string").cast("binary").alias("source"), F.col(lang_col).cast("string").cast("binary").alias("lang"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(-1)).cast("int").alias("length"), (F.crc32(number.cast("string").cast("binary")) % 365).cast("int").alias("date"), F.monotonically_increasing_id().alias("tie"),
    )
    rows = materialise(rows, "rows")
    n = rows.count()
    ats = [f"at_{c}" for c in COLUMNS]
    keyed = _coordinates(rows, n, parts).select("doc_id", "tie", *ats).withColumn("z", _interleaved(parts))
    placed = running(keyed, ["z", "doc_id", "tie"], "position").withColumn("file", F.expr(f"position div {per_file}"))
    discard(rows)
    ends = [f(f"at_{c}").alias(f"{end}_{c}") for c in COLUMNS for end, f in (("low", F.min), ("high", F.max))]
    files = materialise(placed.groupBy("file").agg(*ends), "files")
    cells = materialise(placed.groupBy("z", *ats).agg(F.min("file").alias("first_file"), F.max("file").alias("last_file"), F.count(F.lit(1)).alias("_count")), "cells")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    corners = files.groupBy(*_BOUNDS).agg(F.count(F.lit(1)).alias("files"))
    corners = corners.withColumn("a", F.pmod(F.xxhash64(*_BOUNDS), F.lit(CORNER_BLOCKS)).cast("int")).withColumn("b", each(CELL_BLOCKS))
    asking = cells.select("z", *ats).withColumn("b", F.pmod(F.xxhash64("z"), F.lit(CELL_BLOCKS)).cast("int")).withColumn("a", each(CORNER_BLOCKS))
    touched = corners.groupBy("a", "b").cogroup(asking.groupBy("a", "b")).applyInPandas(_touched(reach), "z long, files long").groupBy("z").agg(F.sum("files").alias("files_touched"))
    matching = cells.groupBy("at_source", "at_lang").applyInPandas(_matching(reach), "z long, files_matching long")
    answers = materialise(cells.select("z", "_count").join(touched, "z").join(matching, "z"), "answers")
    discard(cells)
    bounds = files.select("file", F.concat_ws(",", *_BOUNDS).alias("file_bounds"))
    out = attach(placed.select("z", "doc_id", "position", "file"), answers, "z", n).join(bounds, "file")
    return out.select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")
