"""Vectors, archives, shared helpers and the pipeline."""

import gzip
import hashlib
import io
import re
import struct
import zipfile
from collections import Counter

import numpy as np
import pytest

from brightvane.llm import lattice_hash, language_id, quality_fm, queries, storage, wacz
from brute import jaccard_truth


def truth(rows, least=0.93):
    links, root = Counter(), {i: i for i, *_ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [(i, np.array(v, dtype=float), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    for k, (i, v, a) in enumerate(good):
        for j, w, b in good[k + 1 :]:
            if a == b and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= least:
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], top(i)) for i in root}


@pytest.mark.parametrize("block", [4096, 8])
def test_lattice_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice_hash, "ENTERING", block)
    monkeypatch.setattr(lattice_hash, "PROBING", block)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        near = rows[int(rng.integers(0, len(rows)))][1] if rows and i % 3 else None
        v = rng.normal(size=16) if near is None else np.array(near) + rng.normal(size=16) * 0.07
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [1.0, None], 0), (206, [], 0), (207, rows[0][1], None), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0)]
    table = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, node int, key string")
    want = truth(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice_hash.near_duplicates(table).collect()}
    assert set(got) == set(want) and all(n <= want[i][0] for i, (n, _) in got.items())
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert lattice_hash.near_duplicates(table.limit(0)).count() == 0


def test_decode_gives_the_nearest_lattice_point():
    x = np.random.default_rng(6).uniform(-2, 2, (300, 8))
    point = lattice_hash.decode(x)
    assert ((point * 2) % 1 == 0).all() and (np.ptp((point * 2).astype(int) % 2, axis=1) == 0).all() and (point.sum(axis=1) % 2 == 0).all()
    distance = ((x - point) ** 2).sum(axis=1)
    assert (distance <= 1 + 1e-9).all() and (distance[:, None] <= ((x[:, None] - point[:, None] - lattice_hash._NEAR[None]) ** 2).sum(axis=2) + 1e-9).all()


PAGES = [(1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200), (3, "http://c/", "tiny"), (4, "http://d/", "tiny"), (5, None, None), (6, "http://e/", ""), (7, "http://é/\r\nX: y", "é" * 100), (8, "u", "é" * 100), (8, "u", "é" * 100), (None, "u", "z" * 300)]


def test_archives_round_trip(spark):
    table = spark.createDataFrame([(*r, "k") for r in PAGES], "page_id long, url string, html string, payload string")
    rows = wacz.round_trip(table).collect()
    assert len(rows) == len(PAGES) and wacz.round_trip(table.limit(0)).count() == 0
    got = {(r.page_id, r.record_type, r.refers_to) for r in rows}
    assert got == {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 7), (None, "response", None)}
    for r in rows:
        payload = next((p or "").encode() for i, _, p in PAGES if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_reader(tmp_path, zip64):
    members = [("archive/data.warc.gz", b"0123456789" * 50), ("empty", b""), ("indexes/ü", b"PK\x05\x06 not the end")]
    data = wacz.write_zip(members, zip64=zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as plain:
        assert [(i.filename, plain.read(i)) for i in plain.infolist()] == members
    path = tmp_path / "x.wacz"
    path.write_bytes(data)
    source = wacz.FileSource(str(path))
    reader = wacz.ZipReader(source)
    assert reader.read("archive/data.warc.gz", 13, 9) == b"345678901" and reader.read("empty") == b""
    with pytest.raises(ValueError):
        reader.read("archive/data.warc.gz", 495, 6)
    source.close()
    with pytest.raises(ValueError):
        wacz.ZipReader(wacz.BytesSource(b"no archive"))


def test_damage_is_found():
    records = [(i, gzip.compress(wacz.warc_record(i, "u", b"x" * 200, "d", None))) for i in range(3)]
    data = wacz.package(records)
    assert [h["warc-record-id"] for h, _ in wacz.records(wacz.BytesSource(data))] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:2>"]
    at = data.index(records[1][1]) + 4
    hurt = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
    with pytest.raises(ValueError, match="damaged archive"):
        list(wacz.records(wacz.BytesSource(hurt)))
    assert storage.store("file:/a/b")[1] == storage.store("file:///a/b")[1] == storage.store("/a/b")[1] == "/a/b"


def test_a_long_page_is_one_record(spark):
    page = "é<p>" * 1_500_000
    (row,) = wacz.round_trip(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()
    assert (row.payload_bytes, row.payload_digest) == (len(page.encode()), hashlib.sha256(page.encode()).hexdigest())


def test_zip_with_comment_and_compressed_member():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a", b"stored")
        z.writestr("b", b"packed" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"a PK\x05\x06 comment"
    reader = wacz.ZipReader(wacz.BytesSource(raw.getvalue()))
    assert reader.read("a") == b"stored"
    with pytest.raises(ValueError):
        reader.read("b")
    assert struct.calcsize("<Q") == 8


@pytest.mark.parametrize("hub", [20_000, 3])
def test_components_of_chains_and_stars(spark, monkeypatch, hub):
    monkeypatch.setattr(storage, "HUB", hub)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in storage.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert storage.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("weight", [None, "w"])
def test_running_counts_without_one_task(spark, weight):
    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then null else id % 2 end as g", "id % 7 as w").repartition(5)
    got = storage.running(rows, ["g", "id"], "before", weight)
    before = 0
    for r in sorted(got.collect(), key=lambda r: (r.g is not None, r.g or 0, r.id)):
        assert r.before == before
        before += r.w if weight else 1
    assert storage.running(rows.limit(0), ["g", "id"], "before", weight).count() == 0


def test_a_repeated_page_id_loses_no_payload(spark):
    rows = [(0, "u", "X" * 200), (1, "u", "X" * 200), (1, "u", "Y" * 200), (2, "u", "Y" * 200), (None, "u", "Y" * 200)]
    got = Counter((r.page_id, r.payload_digest[:6], r.record_type, r.refers_to) for r in wacz.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    x, y = (hashlib.sha256(c * 200).hexdigest()[:6] for c in (b"X", b"Y"))
    assert got == Counter([(0, x, "response", None), (1, x, "revisit", 0), (1, y, "response", None), (2, y, "revisit", 1), (None, y, "response", None)])


def test_payloads_that_are_not_text_are_kept(spark):
    row = wacz.round_trip(spark.sql("select 1L page_id, cast(X'FF2F' as string) url, cast(X'61FF2062' as string) html")).first()
    assert (row.payload_bytes, row.payload_digest) == (4, hashlib.sha256(b"a\xff b").hexdigest())


def test_vectors_in_double_precision(spark):
    """Pairs a hair below the threshold are not linked, lengths of any order of magnitude are, and labels may be strings."""

    def pair(cosine):
        return [[1.0, 0.0], [cosine, (1 - cosine * cosine) ** 0.5]]

    rows = [(i, v, "below") for i, v in enumerate(pair(0.93 - 1e-9))] + [(10 + i, v, "above") for i, v in enumerate(pair(0.93 + 1e-9))]
    rows += [(20, [1.0, 0.0], "scale"), (21, [1e-300, 0.0], "scale"), (22, [1e300, 1e285], "scale"), (23, [-0.0, 0.0], "scale"), (30, [0.0, 1.0], "zero"), (31, [-0.0, 1.0], "zero"), (40, [1.0, 0.0], None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice_hash.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 10: (1, 10), 11: (1, 10), 20: (2, 20), 21: (2, 20), 22: (2, 20), 23: (0, 23), 30: (1, 30), 31: (1, 30), 40: (0, 40)}


REPEATED = [(1, "plain words in a row " * 5), (2, "plain words in a row " * 5), (2, "quite other words stand in this place " * 3), (None, "plain words in a row " * 5), (None, "a text that no other row has at all " * 3), (2, None)]


@pytest.mark.parametrize("stage", ["exact dedup", "n-gram Jaccard join"])
def test_stages_keep_every_text_of_a_repeated_id(spark, stage):
    """Texts go only where a row with an equal or similar one stays; columns of any name come through."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "k", 1, 2, "x") for i, t in REPEATED], "doc_id long, text string, text_a string, text_b int, n_shingles int, text_sha256 string")
    after = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert after.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter([REPEATED[0], REPEATED[2], REPEATED[4], REPEATED[5]])


def test_queries_are_registered():
    names = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # the decisions of the two models come from their operators; all else from plain Python
    known = {r.doc_id for r in language_id.identify(docs, language_id.train_language_model(docs)).collect() if r.lang_pred != "und" and r.score >= 0.3}
    left = docs.where(docs.doc_id.isin(known))
    good = {r.doc_id for r in quality_fm.score_quality(left, quality_fm.train_quality(left, labels)).collect() if r.predicted == 1}
    texts = {r.doc_id: r.text or "" for r in left.collect() if r.doc_id in good}
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    texts = {i: texts[i] for i in first.values()}
    _, component = jaccard_truth(texts)
    plain = tokenizers.Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items() if component[i] == i}
    got, held = Counter(), Counter()
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
        held[r.sequence_id] += r.length
    assert len(known) <= docs.count() and len(good) < len(known) and got == want and max(held.values()) <= 2048


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empties, repeats and an empty table in every stage: the columns of documents stay, nothing fails, and the rules of the docstrings hold."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    rows = [(1, "plain words in a row " * 5), (1, "plain words in a row " * 5), (2, None), (3, ""), (4, "!!! 12"), (None, "plain words in a row " * 5), (5, "other words stand here now " * 4), (6, "other words stand here now " * 4 + "too")]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], schema)
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        ids = Counter(r.doc_id for r in after.collect())
        if name == "language ID":
            assert ids == {1: 2, None: 1, 5: 1, 6: 1}
        elif name == "quality classifier":
            assert sum(ids.values()) == len(rows)
        elif name == "exact dedup":
            assert ids == {1: 2, 2: 1, 4: 1, 5: 1, 6: 1}
        else:
            assert ids == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    _, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs.limit(0), str(tmp_path)).count() == 0 and len({(r.doc_id, r.piece) for r in last(spark, docs, str(tmp_path)).collect()}) == 7
