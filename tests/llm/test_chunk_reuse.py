"""Chunk reuse against the tokenizers library."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brightvane.llm import chunk_reuse
from brightvane.llm.textkernel import _WHITE

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, block string, bucket int, data string, _text int, _row int, n_tokens int"


def truth(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, "d", 2, 3, 4) for i, t in rows], SCHEMA).repartition(3)


def check(spark, rows):
    got = Counter(tuple(r) for r in chunk_reuse.encode_decode(frame(spark, rows), PATH).collect())
    assert got == Counter((i, *truth(t)) for i, t in rows)


WORDS = ["plain", "Words", "don't", "we'll", "naïve", "12345", "é", "́", "日本語", "!!!", "a.b,c", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "ſ", "İ", " ", "\x85", "ﬁ", "x" * 90, "…"]


def mess(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\n", "", "\t\r\n", "-"]) for _ in range(n))


def test_awkward_texts(spark):
    rng = random.Random(8)
    shared = mess(rng, 900)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "日本語" * 20_000), (6, "x" * 50_000), (7, " " * 40_000), (8, shared), (9, "before " + shared + " after"), (9, shared), (None, shared), (None, None)]
    rows += [(20 + i, mess(rng, rng.randrange(1500))) for i in range(25)]
    check(spark, rows)


def test_text_longer_than_a_block(spark):
    rng = random.Random(9)
    part = mess(rng, 3000)
    text = part * (chunk_reuse.BLOCK_BYTES // len(part.encode()) + 2)
    assert len(text.encode()) > chunk_reuse.BLOCK_BYTES
    check(spark, [(1, text), (2, part)])


def test_empty_table_and_bytes_that_are_not_text(spark):
    assert chunk_reuse.encode_decode(frame(spark, [(1, "a")]).limit(0), PATH).count() == 0
    got = chunk_reuse.encode_decode(spark.sql("select 1L doc_id, cast(X'61FF2062' as string) text"), PATH).first()
    assert tuple(got)[1:] == truth("a� b")


def whole(texts):
    """The operator's steps in one process: the ids of each text, and how many chunks were reused."""
    tokenizer = chunk_reuse._tokenizer(PATH)
    data = "".join(texts).encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    outline = chunk_reuse.Repairer(tokenizer).repair(data, np.flatnonzero(_WHITE[raw]), list(zip(at[:-1].tolist(), chunk_reuse.cut_points(raw, at), strict=True)))
    out, reused = [], 0
    for chunks, windows in outline:
        ids = list(windows[0][0])
        for k, (a, b) in enumerate(chunks):
            mine = tokenizer.encode(raw[a:b], np.array([0, b - a]))[0].tolist()
            before, after = windows[k][2], windows[k + 1][1]
            assert mine[: len(before)] == before and mine[len(mine) - len(after) :] == after
            ids += mine[len(before) : len(mine) - len(after)] + windows[k + 1][0]
        out.append(ids)
        reused += len(chunks)
    return out, reused


@pytest.mark.parametrize("bits,least,most", [(4, 24, 100), (6, 64, 300), (10, 256, 8192)])
def test_every_way_of_cutting_gives_the_same_ids(monkeypatch, bits, least, most):
    for name, value in (("USUAL_BITS", bits), ("LEAST", least), ("MOST", most)):
        monkeypatch.setattr(chunk_reuse, name, value)
    rng = random.Random(bits)
    texts = [mess(rng, rng.randrange(400)) for _ in range(60)] + ["word " * 2000, "a" * 3000, ("the cat sat on " * 50 + "x" * 400) * 5]
    got, reused = whole(texts)
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts] and reused > 20


def test_a_window_grows_until_it_agrees(monkeypatch):
    """Where the first windows are said to disagree, both chunks join the window, up to whole texts."""
    texts = [" ".join(f"word{i * i}" for i in range(900))]
    asked = []
    encode = chunk_reuse.Repairer.encode
    monkeypatch.setattr(chunk_reuse.Repairer, "encode", lambda self, texts: asked.append(texts) or encode(self, texts))
    monkeypatch.setattr(chunk_reuse.Repairer, "agrees", lambda self, w, left, right: left is None and right is None)
    got, reused = whole(texts)
    assert got == [LIBRARY.encode(texts[0], add_special_tokens=False).ids] and reused == 0 and len(asked) > 1


def test_cuts_depend_on_content_only():
    rng = random.Random(4)
    passage = " ".join(str(rng.random()) for _ in range(2000))
    texts = [passage, "other beginning " * 40 + passage, passage[:9000]]
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ends = chunk_reuse.cut_points(raw, at)
    chunks = [[raw[a:b].tobytes() for a, b in zip([s, *e[:-1]], e, strict=True)] for s, e in zip(at.tolist(), ends, strict=False)]
    assert [b"".join(c).decode() for c in chunks] == texts
    assert len(set(chunks[0]) & set(chunks[1])) >= len(chunks[0]) - 4 and len(set(chunks[0]) & set(chunks[2])) >= len(chunks[2]) - 1
    alone = chunk_reuse.cut_points(raw[at[1] : at[2]], np.array([0, at[2] - at[1]]))[0]
    assert [e + at[1] for e in alone] == ends[1]


def test_ids_pack_and_unpack():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, dtype=np.uint16), np.array([49407], dtype=np.uint16), rng.integers(0, 49408, 200_000).astype(np.uint16), rng.zipf(1.4, 5000).astype(np.uint64) % 3000, np.arange(257)):
        ids = ids.astype(np.uint16)
        assert np.array_equal(chunk_reuse.unpack_ids(*chunk_reuse.pack_ids(ids)), ids)
