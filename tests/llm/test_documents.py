"""The operators on documents, on a table of awkward rows, on an empty one, and against brute force."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brightvane.llm import bpe_transducer, ef_trie_lm, exact_dedup, language_id, ngram_join, packing, quality_fm, sampling, sharding, storage
from brute import jaccard_truth, words

# extra columns bear names that the operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n int, fp string, row string, score double, _text string, rank int"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
BASE = " ".join(f"word{i % 97}x{i}" for i in range(60))
ROWS = [
    (1, BASE, "en", "a"), (2, BASE.replace(" ", "\n"), "en", "a"), (3, BASE + " tail", "en", None), (4, None, None, "b"), (5, "", "en", "b"), (6, " \t\n", "en", "b"),
    (7, "one two", "en", "b"), (8, "One  two", "en", "b"), (9, "!!! 123 ???", "en", "a"), (10, LONG, "en", "a"), (11, "Ünïcödé 日本語 text, don't we'll 's", "fr", "a"), (12, "same", "en", "a"), (12, "same", "en", "a"), (None, "same", "en", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "d", 1, "f", "r", 0.5, "t", 3) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_exact_groups(docs, nothing):
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, frequent=2).collect())
    groups = defaultdict(list)
    for i, text, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    want = [(i or 0, min(x for x in ids if x is not None), len(ids), i == min(x for x in ids if x is not None)) for ids in groups.values() for i in ids]
    assert got == sorted(want)
    assert got == sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, frequent=10**6).collect())
    assert exact_dedup.exact_groups(nothing).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    ids = Counter(r.doc_id for r in kept.collect())
    # the group of "same": id 12 twice, and a null id, which goes
    assert kept.columns == docs.columns and ids == {1: 1, 3: 1, 4: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 2}


def test_digest_is_of_normalised_text(docs):
    for r in exact_dedup.exact_groups(docs.where("doc_id in (2, 4)")).collect():
        text = BASE if r.doc_id == 2 else ""
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_shards_are_gapless_and_mixed(spark, docs, nothing):
    rows = sharding.stratified_shards(docs, shards=4).collect()
    assert len(rows) == len(ROWS) and {r.law for r in rows} == {"rows"}
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1
    for shard in per:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(per[shard]))
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].size == 16 and by_id[4].text_crc32 == 0 and by_id[1].text_crc32 == zlib.crc32(BASE.encode())
    assert sharding.stratified_shards(nothing).count() == 0
    many = spark.range(4000).selectExpr("id as doc_id", "'x' as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 5) end as source")
    mixed = defaultdict(Counter)
    for r in sharding.stratified_shards(many, shards=10).collect():
        mixed[r.shard][r.source] += 1
    share = Counter(r.source for r in many.collect())
    assert all(abs(mixed[s][k] - share[k] / 10) <= 2 for s in mixed for k in share)


def test_bpe_as_tiktoken(spark, docs, nothing):
    tiktoken = pytest.importorskip("tiktoken")
    vocabularies = pytest.importorskip("public_tokenizers")
    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(path), special_tokens={})
    assert bpe_transducer.encode_decode(nothing, path).count() == 0
    texts = {i: t or "" for i, t, *_ in ROWS if i is not None}
    for r in bpe_transducer.encode_decode(docs.where("doc_id is not null"), path, chunk=3).collect():
        ids = np.array(known.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_begins_afresh_within_a_piece(monkeypatch):
    """One piece that makes more moves than are kept: its encoding is that of the definition."""
    vocabularies = pytest.importorskip("public_tokenizers")
    ranks = bpe_transducer.read_ranks(vocabularies.path("byte_bpe_multi_50k.tiktoken"))
    machine = bpe_transducer.Transducer(ranks)
    monkeypatch.setattr(bpe_transducer, "MOVES", 50)
    draw = random.Random(3)
    for _ in range(40):
        piece = bytes(draw.choice(b"etaoinshrdlu") for _ in range(200))
        assert machine.encode(piece) == bpe_transducer.merge(piece, ranks)


def test_decoder_is_the_incremental_machine():
    """Any bytes in any chunks: what is held is the end that begins a character without completing it."""
    draw = random.Random(4)
    begun = {chr(c).encode()[:k] for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 for k in range(1, len(chr(c).encode()))}
    decoder = bpe_transducer.StreamingDecoder({bytes((b,)): b for b in range(256)})
    odd = [0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC2, 0xE0, 0xE2, 0xED, 0xF0, 0xF4, 0xF5, 0xFF]
    for _ in range(2000):
        data, out, at = bytes(draw.choice(odd) for _ in range(draw.randrange(14))), b"", 0
        while at < len(data):
            part = data[at : at + draw.randrange(1, 7)]
            at = min(at + len(part), len(data))
            out += decoder.feed(np.frombuffer(part, dtype=np.uint8).astype(np.int64))
            assert decoder._held == next((data[max(0, at - k) : at] for k in (3, 2, 1) if data[max(0, at - k) : at] in begun), b"")
        assert out + decoder.finish() == data


def test_decoder_holds_incomplete_characters():
    decoder = bpe_transducer.StreamingDecoder({bytes((b,)): b for b in range(256)})
    out = [decoder.feed(np.array([b])) for b in "é日🙂a".encode()]
    assert all(x.decode() is not None for x in out) and b"".join(out).decode() == "é日🙂a" and decoder.finish() == b""


def test_packing_covers_every_token(docs, nothing):
    vocabularies, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = vocabularies.path("word_bpe_49k.json")
    assert packing.pack(nothing, path).count() == 0
    rows = packing.pack(docs, path, capacity=512).collect()
    plain = tokenizers.Tokenizer.from_file(path)
    want = Counter()
    for i, text, *_ in ROWS:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(0, len(ids), 512):
            want[i, k // 512, k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(held) <= -(-sum(r.length for r in rows) // 512) + 2


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 65, 30), rng.integers(1, 50, 30), strict=True)}
        used = Counter()
        for times, lengths in packing.plan(counts, 64):
            assert sum(lengths) <= 64 and times > 0
            for x in lengths:
                used[x] += times
        assert used == counts


def test_ngram_join_edges(docs, nothing):
    assert ngram_join.jaccard_components(nothing).count() == 0
    sizes, truth = jaccard_truth({i: t for i, t, *_ in ROWS if i is not None})
    for r in ngram_join.jaccard_components(docs).collect():
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], truth[r.doc_id])


@pytest.mark.parametrize(("codes", "bucket", "hub"), [(500_000, 1_500_000, 20_000), (600, 700, 5)])
def test_ngram_join_against_brute_force(spark, monkeypatch, codes, bucket, hub):
    """Once at the usual sizes, once with many buckets, groups that are taken apart or cut into blocks, and hubs."""
    monkeypatch.setattr(ngram_join, "TASK_CODES", codes)
    monkeypatch.setattr(ngram_join, "BUCKET_SHINGLES", bucket)
    monkeypatch.setattr(storage, "HUB", hub)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(160):
        if i % 4 and texts:
            w = words(texts[int(rng.integers(0, max(1, i - i % 4)))])
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(vocabulary))
        else:
            w = list(rng.choice(vocabulary, int(rng.integers(5, 120))))
        texts[i] = " ".join(w) + (" this passage stands in very many texts of all kinds" if i % 3 == 0 else "")
    sizes, truth = jaccard_truth(texts)
    got = ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], truth[i]) for i in texts}


def test_large_teams_are_compared_whole(spark, monkeypatch):
    """Both ways of a team too large for a task: every two sets of a list meet in some unit of some bin."""
    monkeypatch.setattr(ngram_join, "TASK_CODES", 40)
    chain = [(k, f) for k in range(60) for f in (k, k + 1)]
    dense = [(1000 + k, 500 + f) for k in range(9) for f in range(12) if f % 9 != k]
    keys = spark.createDataFrame([(k, f, 9) for k, f in chain + dense], "key long, fp long, n long")
    member = spark.createDataFrame([(f, 10, 0, 610) for f in range(61)] + [(500 + f, 10, 500, 120) for f in range(12)], "fp long, w long, team long, total long")
    met, moved = set(), Counter()
    units = defaultdict(set)
    for r in ngram_join._large_teams(member, keys, 730).collect():
        units[r.bin, r.unit].add(r.fp)
        moved[r.fp >= 500] += 1
    for held in units.values():
        met |= {(a, b) for a in held for b in held}
    for rows in (chain, dense):
        lists = defaultdict(set)
        for k, f in rows:
            lists[k].add(f)
        assert all((a, b) in met for held in lists.values() for a in held for b in held)
    assert moved[False] == 120 and moved[True] <= 12 * 6


@pytest.mark.parametrize("bucket", [2_000_000, 2000])
def test_language_model_against_its_definition(docs, nothing, monkeypatch, bucket):
    """Once in one bucket and block; once in 15 buckets with hot words, of which some blocks hold one or none."""
    monkeypatch.setattr(ef_trie_lm, "BUCKET_TOKENS", bucket)
    docs = docs if bucket > 2000 else docs.repartition(7)
    assert ef_trie_lm.score_texts(nothing).count() == 0
    rows = [(i, [*words(t), None]) for i, t, *_ in ROWS]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    one, two = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            one.update(t)
            two.update(zip(t, t[1:], strict=False))
    n, v, m = sum(one.values()), len(one), ef_trie_lm.STRENGTH
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    want = sorted((i or 0, held(i), len(t), sum(one[w] > 0 for w in t), n, sum(math.log10(p(w)) for w in t), math.log10(p(t[0])) + sum(math.log10((two[a, b] + m * p(b)) / (one[a] + m)) for a, b in zip(t, t[1:], strict=False))) for i, t in rows)
    got = sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ef_trie_lm.score_texts(docs).collect())
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and abs(a[6] - b[6]) < 0.03 * a[2]


def test_elias_fano_searches_like_a_sorted_array():
    rng = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 5), (900, 2000), (3000, 1 << 50), (4000, 60)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        coded = ef_trie_lm.EliasFano(ef_trie_lm.EliasFano.build(values))
        asked = rng.integers(0, 2 * top, 500).astype(np.uint64)
        at, equal = coded.successor(asked)
        if n:
            assert (coded.access(np.arange(n)) == values).all()
            where = np.searchsorted(values, asked)
            assert (at == where).all() and (equal == ((where < n) & (values[np.minimum(where, n - 1)] == asked))).all()


def test_language_id(spark, sf_dir, docs, nothing):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language_id.train_language_model(table)
    rows = {r.doc_id: r for r in language_id.identify(table, net).collect()}
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    held = [r for r in rows.values() if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9
    odd = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs, net).collect()]
    assert len(odd) == len(ROWS) and all(x[1:] == ("und", 0.0) for x in odd if x[0] in (4, 5, 6, 9)) and all(0 <= x[2] <= 1 for x in odd)
    assert language_id.train_language_model(nothing) is None and language_id.identify(nothing, None).count() == 0
    kept = language_id.keep_identified(docs, net, minimum=0.0)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4


def test_folded_tables_score_as_the_network():
    net = language_id.ByteConvNet(["a", "b"])
    x = np.random.default_rng(1).integers(0, language_id.CLASSES, (9, language_id.WINDOW))
    pooled = []
    for w, f in zip(language_id.WIDTHS, net.filters, strict=True):
        span = language_id.WINDOW - w + 1
        pooled.append(sum((net.embed @ f[k])[x[:, k : k + span]] for k in range(w)).max(axis=1))
    logits = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    assert np.allclose(net.probabilities(x), p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_quality(spark, docs, nothing):
    good = [(i, "plain words stand here in a row, and they read well. " * (1 + i % 5), 0) for i in range(120)]
    bad = [(1000 + i, "BUY!! NOW!! $$$ ### CHEAP!! " * (1 + i % 5), 0) for i in range(120)]
    table = spark.createDataFrame([(i, t, len(t)) for i, t, _ in good + bad], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in good + bad] + [(1, None)], "doc_id long, quality int")
    machine = quality_fm.train_quality(table, labels)
    for r in quality_fm.score_quality(table, machine).collect():
        assert r.predicted == int(r.doc_id < 1000)
    odd = quality_fm.score_quality(docs, machine).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert quality_fm.train_quality(nothing, labels.limit(0)) is None and quality_fm.score_quality(nothing, machine).count() == 0
    assert quality_fm.keep_good(docs, machine).columns == docs.columns


def test_statistics_against_plain_python():
    texts = ["", "One two two.\nOne two two.\nA b!? 12 'x' | é", "x" * 40 + " z", "\n\n", LONG]
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    buckets, _ = quality_fm.word_buckets(raw, at)
    got = quality_fm.statistics(raw, at, np.array([len(t) for t in texts], dtype=float), buckets)
    for row, text in zip(got, texts, strict=True):
        data, own = text.encode(), words(text)
        plain = re.findall(rb"[^\x20\x09-\x0D]+", data)
        lines = [x for x in re.findall(rb"[^\n]*\n|[^\n]+", data)]
        assert np.isclose(row[0], sum(b in b" \t\n\v\f\r" for b in data) / max(1, len(data)))
        assert np.isclose(row[1], sum(48 <= b < 58 for b in data) / max(1, len(data)))
        assert np.isclose(row[10], math.log1p(len(plain))) and np.isclose(row[11], sum(map(len, plain)) / max(1, len(plain)))
        assert np.isclose(row[12], sum(len(w) > 16 for w in plain) / max(1, len(plain)))
        assert np.isclose(row[17], (len(lines) - len(set(lines))) / max(1, len(lines))) and np.isclose(row[18], math.log1p(len(lines)))
        assert np.isclose(row[19], sum(a == b for a, b in zip(own, own[1:], strict=False)) / max(1, len(own)))
        assert np.isclose(row[20], math.log1p(len(text)))


def test_language_score_weighs_windows_by_letters():
    net = language_id.ByteConvNet(["a", "b", "c"])
    texts = ["", "short", LONG[:1000] + "1" * 700, "é" * 500]
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    best, score = net.score(raw, at)
    for i, text in enumerate(texts):
        data = text.encode()
        parts = [data[k : k + language_id.WINDOW] for k in range(0, max(1, len(data)), language_id.WINDOW)]
        windows = np.zeros((len(parts), language_id.WINDOW), dtype=np.int64)
        for w, part in zip(windows, parts, strict=True):
            w[: len(part)] = [language_id._CLASS[b] for b in part]
        weight = np.array([sum(b >= 128 or chr(b).isalpha() for b in part) + 1e-9 for part in parts])
        mean = (net.probabilities(windows) * weight[:, None]).sum(axis=0) / weight.sum()
        assert best[i] == mean.argmax() and abs(score[i] - mean.max()) < 1e-5


def test_many_sources_of_one_row_are_spread(spark):
    """A third of the rows have one source, each other row has its own: places are spread, shares hold in every shard."""
    many = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text", "case when id % 3 = 0 then 'hot' else concat('s', id) end as source")
    rows = sharding.stratified_shards(many, shards=10).collect()
    assert Counter(r.shard for r in rows) == {s: 300 for s in range(10)}
    assert all(abs(sum(r.source == "hot" for r in rows if r.shard == s) - 100) <= 25 for s in range(10))


def test_packing_of_special_strings_and_other_vocabularies(spark, tmp_path):
    vocabularies, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = vocabularies.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "x<|endoftext|>y. <|Endoftext|>", "< |endoftext|>"] * 2
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in packing.pieces(table, path).collect():
        ids = np.array([*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids))
    rules = json.loads(open(path, encoding="utf-8").read())
    rules["normalizer"] = {"type": "NFC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(rules))
    with pytest.raises(ValueError, match="can be packed"):
        packing.SegmentTokenizer(str(other))


def test_texts_longer_than_a_block(spark):
    """Texts of more than one block of 2 MB: results as for short ones."""
    unit = " ".join(f"w{i}" for i in range(3000)) + " "
    texts = {1: unit * 180, 2: unit * 180 + "end", 3: "Ünï " * 700_000, 4: None}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table).collect()}
    assert rows == {1: (3000, 1), 2: (3001, 1), 3: (1, 3), 4: (0, 4)}
    assert {r.doc_id: r.n_tokens for r in ef_trie_lm.score_texts(table).collect()} == {1: 540_001, 2: 540_002, 3: 700_001, 4: 1}
    net = language_id.ByteConvNet(["a", "b"])
    assert {r.doc_id: r.lang_pred == "und" for r in language_id.identify(table, net).collect()} == {1: False, 2: False, 3: False, 4: True}
    assert {r.doc_id: r.group_size for r in exact_dedup.exact_groups(table).collect()} == {i: 1 for i in texts}
    assert {r.doc_id: r.size for r in sharding.stratified_shards(table.withColumn("source", table.text)).collect()} == {i: len((t or "").encode()) + 16 for i, t in texts.items()}


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    machine = quality_fm.FactorisationMachine()
    machine.word[:] = rng.normal(0, 0.3, machine.word.shape)
    buckets = np.array([5, 9, 9, 40])
    stats = np.zeros((1, quality_fm.STATISTICS))
    unit = quality_fm._WORD_SCALE / 4
    v = machine.word[buckets].astype(float)
    logit = v[:, 0].sum() * unit + sum(v[i, 1:] @ v[j, 1:] for i in range(4) for j in range(i)) * unit**2
    assert abs(machine.score(buckets, np.array([0, 4]), stats)[0] - 1 / (1 + math.exp(-logit))) < 1e-5


def not_text(spark):
    return spark.sql("select 1L doc_id, cast(X'61FF2062' as string) text, 's' source, 'en' lang, 4L n_chars")


def test_bytes_that_are_not_text(spark):
    """They count as U+FFFD where ids are made, and as themselves elsewhere."""
    tokenizers, tiktoken = pytest.importorskip("tokenizers"), pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(ranks), special_tokens={})
    row = bpe_transducer.encode_decode(not_text(spark), ranks, pattern=P.PATTERN).first()
    assert row.ids_sha256 == hashlib.sha256(np.array(plain.encode_ordinary("a\ufffd b"), dtype="<u4").tobytes()).hexdigest()
    with pytest.raises(ValueError):
        bpe_transducer.encode_decode(not_text(spark), ranks, pattern=r"\S+")
    words = P.path("word_bpe_49k.json")
    ids = [*tokenizers.Tokenizer.from_file(words).encode("a\ufffd b", add_special_tokens=False).ids, 0]
    row = packing.pack(not_text(spark), words).first()
    assert (row.length, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    assert sharding.stratified_shards(not_text(spark)).first().text_crc32 == zlib.crc32(b"a\xff b")
    assert exact_dedup.exact_groups(not_text(spark)).first().kept and ngram_join.jaccard_components(not_text(spark)).first().n_shingles == 1


def test_rows_alike_take_places_of_their_own(spark):
    """Ten thousand rows without an id and with one text, and the pieces of one long text."""
    pytest.importorskip("tokenizers")
    import public_tokenizers as P

    table = spark.range(10_000).selectExpr("cast(null as long) doc_id", "'same text' text", "'s' source")
    rows = sharding.stratified_shards(table, shards=7).collect()
    shards = Counter(r.shard for r in rows)
    assert sorted(shards) == list(range(7)) and max(shards.values()) - min(shards.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in shards.items())
    pieces = packing.pack(table.union(spark.createDataFrame([(1, "word and more " * 40_000, "s")], table.schema)), P.path("word_bpe_49k.json")).collect()
    held = defaultdict(list)
    for r in pieces:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(pieces) == 10_000 + -(-120_001 // 2048)


def test_samples_are_bounded(spark):
    rows = spark.range(5000).selectExpr("1L id", "'a' kind", "cast(id as string) text").union(spark.range(50).selectExpr("id", "'b'", "'t'"))
    picked, sizes = sampling.stratified(rows, "kind", "id", 5001, 3)
    assert sizes == {"a": 5000, "b": 50} and sampling.capped(picked, "kind", ["id", "text"], 100).groupBy("kind").count().count() == 2
    assert {r[0]: r[1] for r in sampling.capped(picked, "kind", ["id", "text"], 100).groupBy("kind").count().collect()} == {"a": 200, "b": 50}
