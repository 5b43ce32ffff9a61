"""The clustered layout and the Merkle manifest against brute force, on awkward rows and on an empty table."""

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brightvane.llm import layout, merkle
from brightvane.llm.kdtree import KdTree
from brightvane.llm.queries import oracle_sql

# extra columns bear names that the operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, z int, node string, tree string, file long, at_lang int, tie string, rows int"


def rows_of(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice([None, "", "Same Text", "é" * rng.randrange(30), "Ab " * rng.randrange(400)])
        source = rng.choice(["hot"] * 4 + [None, "", "a", "é", "z" + str(i % 7)])
        out.append((i * 3 - 50, text, rng.choice(["en", "fr", None, ""]), source, rng.choice([None, 5]), 1, "n", "t", 2, 3, "x", 4))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(700, 3), SCHEMA).repartition(5)


def layout_truth(rows, per_file, parts=16, reach=2):
    facts = [(r[0], r[3], r[2], -1 if r[1] is None else len(r[1].encode()), zlib.crc32(str(r[0]).encode()) % 365) for r in rows]
    n = len(facts)
    at = np.zeros((n, 4), dtype=int)
    for k in range(4):
        order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
        below = {}
        for i, v in enumerate(sorted((f[k + 1] for f in facts), key=order)):
            below.setdefault(v, i)
        at[:, k] = [parts * below[f[k + 1]] // n for f in facts]
    z = [int("".join(f"{at[i, k] >> bit & 1}" for bit in (3, 2, 1, 0) for k in (2, 0, 3, 1)), 2) for i in range(n)]
    position = {i: p for p, i in enumerate(sorted(range(n), key=lambda i: (z[i], facts[i][0])))}
    file = np.array([position[i] // per_file for i in range(n)])
    bounds = [(at[file == f].min(axis=0), at[file == f].max(axis=0)) for f in range(file.max() + 1)]
    out = {}
    for i in range(n):
        low, high = at[i] - [0, 0, reach, reach], at[i] + [0, 0, reach, reach]
        touched = sum((a <= high).all() and (b >= low).all() for a, b in bounds)
        mine = bounds[file[i]]
        out[facts[i][0]] = (z[i], position[i], int(file[i]), touched, len(set(file[((at >= low) & (at <= high)).all(axis=1)])), ",".join(f"{a},{b}" for a, b in zip(*mine, strict=True)))
    return out


@pytest.mark.parametrize("per_file", [1, 7, 500])
def test_layout_equals_brute_force(table, per_file):
    got = layout.clustered(table, per_file=per_file)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == layout_truth([tuple(r) for r in table.collect()], per_file)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"]


def test_layout_of_awkward_rows(spark, table):
    rows = [(None, "a", "en", "s")] * 60 + [(7, "x", None, None)] * 40 + [(7, "other words", "en", "s"), (8, "y" * 3_000_000, "en", "t")]
    got = layout.clustered(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4), per_file=10).collect()
    assert sorted(r.position for r in got) == list(range(102)) and Counter(r.doc_id for r in got) == {None: 60, 7: 41, 8: 1}
    assert max(Counter(r.file for r in got).values()) == 10 and all(1 <= r.files_matching <= r.files_touched <= 11 for r in got)
    assert layout.clustered(table.limit(0)).count() == 0
    odd = spark.sql("select 1L doc_id, cast(X'61FF2062' as string) text, cast(X'FF' as string) lang, cast(X'FE' as string) source")
    assert layout.clustered(odd).first().position == 0


def test_tree_counts_and_reports_like_a_scan():
    rng = np.random.default_rng(5)
    for n, d in ((0, 3), (1, 8), (40, 8), (900, 4)):
        points, weights = rng.integers(0, 9, (n, d)), rng.integers(1, 5, n)
        low = rng.integers(-1, 7, (50, d))
        high = low + rng.integers(0, 6, (50, d))
        hit = ((points[None] >= low[:, None]) & (points[None] <= high[:, None])).all(axis=2)
        tree = KdTree(points, weights)
        assert (tree.count(low, high) == hit @ weights).all()
        box, point = tree.report(low, high)
        assert sorted(zip(box.tolist(), point.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(hit)), strict=True))


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][a : a + 16])) for a in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        first = i // 16 * 16
        yield level[first:i], level[i + 1 : first + 16]
        i //= 16


def merkle_truth(rows):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    field = lambda v: b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode())
    leaf = lambda r, text: sha(b"".join(map(field, (r[0], r[3], r[2], r[4], text))))
    by = defaultdict(list)
    for r in rows:
        tampered = r[1].translate(lower) if r[1] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1]
        by[r[3]].append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), leaf(r, tampered), r[0]))
    trees = {s: levels_of([x[1] for x in sorted(v)]) for s, v in by.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, own, changed, doc_id) in enumerate(sorted(by[s])):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            for left, right in path:
                changed = sha("".join(left) + changed + "".join(right))
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in path)), changed, changed == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_equals_brute_force(spark, table, height):
    """With blocks of 16 nodes the hot source needs several stages of blocks, and so do 300 sources of a row or two."""
    many = table.union(spark.createDataFrame([(i + 10_000, "T" * (i % 3), "en", f"one{i % 290}", i, 1, "n", "t", 2, 3, "x", 4) for i in range(300)], SCHEMA))
    odd = many.union(spark.createDataFrame([(None, "Null id", "en", "hot", 7, 1, "n", "t", 2, 3, "x", 4)] * 20 + [(4, "Twice", "en", "hot", 7, 1, "n", "t", 2, 3, "x", 4)] * 3 + [(4, "other Text", "en", "hot", 7, 1, "n", "t", 2, 3, "x", 4)], SCHEMA))
    got = merkle.manifest(odd.repartition(4), height=height)
    assert Counter(tuple(r) for r in got.collect()) == merkle_truth([tuple(r) for r in odd.collect()])


def test_manifest_of_one_row_and_of_none(spark, table):
    one = table.where("doc_id = 4")
    assert Counter(tuple(r) for r in merkle.manifest(one).collect()) == merkle_truth([tuple(r) for r in one.collect()])
    assert merkle.manifest(table.limit(0)).count() == 0
    odd = spark.sql("select 5L doc_id, cast(X'61FF2062' as string) text, cast(null as string) lang, cast(X'FE' as string) source, 4L n_chars")
    assert merkle.manifest(odd).first().verified


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 700])
def test_traversal_gives_every_path(n):
    leaves = [sha(str(i)) for i in range(n)]
    height = merkle.levels(n)
    tree = levels_of(leaves)
    assert len(tree) == height + 1 and merkle.fold(leaves, height) == tree[-1][0]
    paths = list(merkle.traverse(leaves, height))
    assert [[others for _, others in p] for p in paths] == [["".join(a + b) for a, b in siblings(tree, i)] for i in range(n)]
    assert {merkle.climb(leaf, p) for leaf, p in zip(leaves, paths, strict=True)} == {tree[-1][0]}


def test_traversal_holds_two_runs_a_level():
    """Of 4096 leaves, what the traversal keeps is bounded by two runs a level and those under way below them."""

    class Counted(list):
        taken = 0

        def __getitem__(self, key):
            if not isinstance(key, slice):
                Counted.taken += 1
            return super().__getitem__(key)

    leaves = Counted(sha(str(i)) for i in range(4096))
    walk = merkle.traverse(leaves, 3)
    next(walk)
    assert Counted.taken == 0
    for _ in range(100):
        next(walk)
    assert Counted.taken == 200  # one leaf a path for each of the two lower levels; the top run has no next one


def test_both_have_sql():
    assert {"op11_layout", "op12_merkle"} <= set(oracle_sql())
