"""Merkle manifest of a table, with each row's authentication path by fractal traversal.

Rows are leaves, ordered within their source; runs of 16 nodes become one until one
node is left, the source's subroot, and the subroots make the root likewise.

1. Upwards: leaves are numbered along (source, id) by ranges and cut into aligned
   blocks of 16**3, and each block is folded by itself, so a source that holds a
   third of all rows is many blocks. Block tops are folded the same way until every
   source has one node, and then the subroots until there is one.
2. Downwards: the path from each block top to the root is made once and sent to
   the block. Within a block a traversal keeps, for each level, an *existing*
   subtree, the run that the current leaf's path goes through, and a *desired* one,
   the next run, which takes in one leaf below it for each path that leaves; when
   the path moves to the next run, the desired subtree takes the existing one's
   place. Paths leave in the order of the leaves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .storage import attach, discard, materialise, running

ARITY = 16
#: Levels of a block: it has ARITY ** HEIGHT nodes at most.
HEIGHT = 3
#: A path's share of one level: the place of the own node in its run, and the hex digests of the others in order.
Step = tuple[int, str]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels(count: int, most: int = 64) -> int:
    """Levels above `count` nodes, `most` at most: none above a single one."""
    n = 0
    while ARITY**n < count and n < most:
        n += 1
    return n


def fold(nodes: Sequence[str], height: int) -> str:
    """The node `height` levels above a block's nodes."""
    for _ in range(height):
        nodes = [digest("".join(nodes[a : a + ARITY])) for a in range(0, len(nodes), ARITY)]
    return nodes[0]


def climb(node: str, path: Sequence[Step]) -> str:
    """The top that a node and its path give."""
    for place, others in path:
        node = digest(others[: 64 * place] + node + others[64 * place :])
    return node


class _Subtree:
    """A run of nodes of one level, grown from the leaves below it one at a time; of each lower level only the run under way is held."""

    def __init__(self, level: int):
        self._under_way: list[list[str]] = [[] for _ in range(level + 1)]

    def take(self, leaf: str) -> None:
        node = leaf
        for level, run in enumerate(self._under_way):
            run.append(node)
            if len(run) < ARITY or level + 1 == len(self._under_way):
                return
            node = digest("".join(run))
            run.clear()

    def finish(self) -> list[str]:
        """The run, whatever is short below it closed as it is."""
        for run, above in zip(self._under_way[:-1], self._under_way[1:], strict=True):
            if run:
                above.append(digest("".join(run)))
        return self._under_way[-1]


def traverse(leaves: Sequence[str], height: int) -> Iterator[list[Step]]:
    """The path of each of a block's leaves to its top, from the leaf's level up."""
    existing, desired = [], [_Subtree(k) for k in range(height)]
    for k in range(height):
        first = _Subtree(k)
        for leaf in leaves[: ARITY ** (k + 1)]:
            first.take(leaf)
        existing.append(first.finish())
    for i in range(len(leaves)):
        path = []
        for k, run in enumerate(existing):
            place = i // ARITY**k % ARITY
            path.append((place, "".join(run[:place]) + "".join(run[place + 1 :])))
        yield path
        for k in range(height):
            span = ARITY ** (k + 1)
            if i + span < len(leaves):
                desired[k].take(leaves[i + span])
            if (i + 1) % span == 0:
                existing[k], desired[k] = desired[k].finish(), _Subtree(k)


def _written(path: Sequence[Step]) -> str:
    return "".join(f"{place}:{others};" for place, others in path)


def _read(path: str) -> list[Step]:
    steps = (step.partition(":") for step in path.split(";")[:-1])
    return [(int(place), others) for place, _, others in steps]


_NODES = "tree binary, index long, node string, count long"


def _tops(height: int):
    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        """A block of nodes (tree, index, node, count) to its top."""
        nodes = nodes.sort_values("index")
        count = int(nodes["count"].iloc[0])
        top = fold(nodes["node"].tolist(), levels(count, height))
        return pd.DataFrame({"tree": nodes["tree"].iloc[:1], "index": int(nodes["index"].iloc[0]) // ARITY**height, "node": top, "count": -(-count // ARITY**height)})

    return run


def _block_paths(height: int):
    def run(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        """Paths of a block's nodes to the root, given the path of its top."""
        nodes = nodes.sort_values("index")
        rest = above["path"].iloc[0]
        paths = [_written(path) + rest for path in traverse(nodes["node"].tolist(), levels(int(nodes["count"].iloc[0]), height))]
        return nodes[["tree", "index"]].assign(path=paths)

    return run


def _proofs(height: int):
    def run(leaves: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        """Leaves (id, index, node, tampered, count) of a block to their rows of the result."""
        leaves = leaves.sort_values("index")
        nodes = leaves["node"].tolist()
        rest, subroot, root = above.iloc[0][["path", "subroot", "root"]]
        upper = _read(rest)
        shared = "".join(others for _, others in upper)
        rows = []
        for doc_id, leaf, tampered, path in zip(leaves["doc_id"], nodes, leaves["tampered"], traverse(nodes, levels(int(leaves["count"].iloc[0]), height)), strict=True):
            folded = climb(climb(tampered or leaf, path), upper)
            rows.append((leaf, subroot, root, digest("".join(others for _, others in path) + shared), folded, folded == root))
        out = pd.DataFrame(rows, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        return out.assign(doc_id=leaves["doc_id"].to_numpy())[["doc_id", *out.columns]]

    return run


def _upwards(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The tables of nodes from the one given to that with one node a tree, a block's height apart."""
    stages = [nodes]
    while (stages[-1].agg(F.max("count")).first()[0] or 0) > 1:
        stages.append(materialise(_in_blocks(stages[-1], height).applyInPandas(_tops(height), _NODES), "nodes"))
    return stages


def _in_blocks(nodes: DataFrame, height: int) -> GroupedData:
    return nodes.withColumn("block", F.expr(f"index div {ARITY**height}")).groupBy("tree", "block")


def _downwards(stages: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """Paths (tree, index, path) of the nodes of the lowest stage, given those of the highest."""
    for nodes in reversed(stages[:-1]):
        tops = above.select("tree", F.col("index").alias("block"), "path").groupBy("tree", "block")
        above = _in_blocks(nodes, height).cogroup(tops).applyInPandas(_block_paths(height), "tree binary, index long, path string")
    return above


def _field(value: F.Column) -> F.Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")).cast("binary")


_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    Tampering lower-cases A-Z of a text where 5 divides the CRC-32 of the id; a row
    whose text that leaves as it is (null, empty or without capitals) stays
    verified. A null source is a tree of its own and comes first, null ids come
    first in their source and are never tampered with. Rows that repeat an id are
    ordered by leaf, and equal rows are leaves of their own. An empty table gives no
    rows; other columns are ignored.
    """
    number, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    leaf = lambda t: F.sha2(F.concat(*[_field(x) for x in (number, F.col(source_col), F.col(lang_col), F.col(chars_col), t)]), 256)
    source = F.col(source_col).cast("string").cast("binary")
    tree = F.when(source.isNull(), F.lit(bytearray(b"\0"))).otherwise(F.concat(F.lit(bytearray(b"\1")), source))
    tamper = F.crc32(number.cast("string").cast("binary")) % 5 == 0
    rows = docs.select(number.alias("doc_id"), tree.alias("tree"), leaf(text).alias("node"), F.when(tamper, leaf(F.translate(text, _UPPER, _UPPER.lower()))).alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    ordered = running(rows, ["tree", "doc_id", "node", "tie"], "at")
    trees = ordered.groupBy("tree").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("count")).withColumn("_count", F.col("count"))
    leaves = attach(ordered.select("tree", "at", "doc_id", "node", "tampered"), trees, "tree", ordered.count())
    leaves = materialise(leaves.select("tree", (F.col("at") - F.col("start")).alias("index"), "node", "count", F.col("doc_id").cast("string").alias("doc_id"), "tampered"), "leaves")
    discard(ordered)
    stages = _upwards(leaves.select("tree", "index", "node", "count"), height)
    subroots = stages[-1].select("tree", F.col("node").alias("subroot"))
    numbered = running(subroots, ["tree"], "index")
    forest = materialise(numbered.select(F.lit(bytearray(b"")).alias("tree"), "index", F.col("subroot").alias("node"), F.lit(numbered.count()).cast("long").alias("count"), F.col("tree").alias("source")), "nodes")
    over = _upwards(forest.select("tree", "index", "node", "count"), height)
    root = over[-1].select(F.col("node").alias("root"))  # a row, or none
    to_root = _downwards(over, over[-1].select("tree", "index", F.lit("").alias("path")), height).drop("tree")
    tops = forest.join(to_root, "index").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("index"), "path")
    above = _downwards(stages[1:], tops, height) if len(stages) > 1 else tops
    above = above.join(subroots, "tree").join(F.broadcast(root))
    uppers = materialise(above.withColumnRenamed("index", "block"), "paths").groupBy("tree", "block")
    return _in_blocks(leaves, height).cogroup(uppers).applyInPandas(_proofs(height), "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").withColumn("doc_id", F.col("doc_id").cast("long"))  # pandas would make floats of ids with nulls among them
