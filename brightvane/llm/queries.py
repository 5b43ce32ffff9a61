"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_transducer, chunk_reuse, ef_trie_lm, exact_dedup, language_id, lattice_hash, layout, merkle, ngram_join, packing, quality_fm, sharding, wacz


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train_language_model(docs))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ef_trie_lm.score_texts(_table(spark, sf_dir, "documents"))


def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_hash.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_transducer.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wacz.round_trip(_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_fm.score_quality(docs, quality_fm.train_quality(docs, _table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op11_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.clustered(_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return chunk_reuse.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_lm_scoring, op3_lattice_dedup, op4_sharding, op5_exact_dedup, op6_bpe, op7_warc, op8_quality, op9_packing, op10_ngram_join, op11_layout, op12_merkle, op13_chunk_reuse)}


OP5_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""

OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


#: CRC-32 of doc_id in decimal, digit by digit: `crc` has (doc_id, crc).
_CRC_SQL = """
RECURSIVE bits AS (
  SELECT i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
digits AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s, CAST(4294967295 AS UBIGINT) AS c, 1 AS k FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT d.doc_id, d.s, xor(d.c >> 8, b.c), d.k + 1 FROM digits d JOIN bits b ON b.k = 8 AND b.i = xor(d.c & 255, CAST(ascii(substr(d.s, d.k, 1)) AS UBIGINT)) WHERE d.k <= length(d.s)
),
crc AS (SELECT doc_id, CAST(xor(c, CAST(4294967295 AS UBIGINT)) AS BIGINT) AS crc FROM digits WHERE k = length(s) + 1)
"""


def _layout_sql() -> str:
    columns = {"source": "s", "lang": "g", "length": "n", "date": "d"}
    at = ", ".join(f"CAST(16 * (rank() OVER (ORDER BY {c} NULLS FIRST) - 1) // count(*) OVER () AS BIGINT) AS {a}" for c, a in columns.items())
    z = " + ".join(f"(({a} >> {bit} & 1) << {4 * bit + 3 - k})" for bit in range(4) for k, a in enumerate("nsdg"))
    bounds = ", ".join(f"min({a}) AS {a}0, max({a}) AS {a}1" for a in columns.values())
    meets = " AND ".join(f"f.{a}0 <= q.{a} + {r} AND f.{a}1 >= q.{a} - {r}" for a, r in zip("sgnd", (0, 0, 2, 2), strict=True))
    return f"""
WITH {_CRC_SQL},
v AS (SELECT doc_id, source, lang, coalesce(octet_length(encode(text)), -1) AS length, crc % 365 AS date FROM documents LEFT JOIN crc USING (doc_id)),
a AS (SELECT doc_id, {at} FROM v),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM (SELECT *, {z} AS z FROM a)),
r AS (SELECT *, position // 500 AS file FROM p),
f AS (SELECT file, {bounds} FROM r GROUP BY file),
cells AS (SELECT DISTINCT z, s, g, n, d, file FROM r),
q AS (SELECT DISTINCT z, s, g, n, d FROM r),
t AS (SELECT q.z, count(*) AS files_touched FROM q JOIN f ON {meets} GROUP BY q.z),
m AS (SELECT q.z, count(DISTINCT c.file) AS files_matching FROM q JOIN cells c ON c.s = q.s AND c.g = q.g AND abs(c.n - q.n) <= 2 AND abs(c.d - q.d) <= 2 GROUP BY q.z)
SELECT doc_id, r.z, position, r.file, files_touched, files_matching, concat_ws(',', s0, s1, g0, g1, n0, n1, d0, d1) AS file_bounds
FROM r JOIN f ON f.file = r.file JOIN t ON t.z = r.z JOIN m ON m.z = r.z
"""


#: Levels that the SQL of op12 unrolls for a source, and for the sources: enough for 16**5 and 16**2 nodes.
_LEVELS, _SOURCE_LEVELS = 5, 2


def _merkle_sql() -> str:
    field = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    steps = [f"""
WITH {_CRC_SQL},
l0 AS (
  SELECT doc_id, source AS tree, {leaf("text")} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} ELSE {leaf("text")} END AS own,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i0
  FROM documents LEFT JOIN crc USING (doc_id)
),
n0 AS (SELECT tree, i0 AS i, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM l0)"""]
    for k in range(_LEVELS + _SOURCE_LEVELS):
        if k == _LEVELS:  # the subroots, in order, are one more tree
            steps.append(f"subroots AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i FROM n{k})")
            steps.append(f"m{k} AS (SELECT NULL AS tree, i, subroot AS node, count(*) OVER () AS n FROM subroots)")
        nodes = f"m{k}" if k >= _LEVELS else f"n{k}"
        above = f"m{k + 1}" if k >= _LEVELS else f"n{k + 1}"
        steps.append(f"{above} AS (SELECT tree, i, node, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, i // 16 AS i, CASE WHEN max(n) = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node FROM {nodes} GROUP BY tree, i // 16))")
        steps.append(f"""s{k} AS (
  SELECT a.tree, a.i, max(a.n) AS n, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {nodes} a JOIN {nodes} b ON a.tree IS NOT DISTINCT FROM b.tree AND a.i // 16 = b.i // 16 GROUP BY a.tree, a.i
)""")
    place = lambda k: f"l0.i0 // {16**k}" if k < _LEVELS else f"subroots.i // {16 ** (k - _LEVELS)}"
    joins = "".join(f" JOIN s{k} ON s{k}.tree IS NOT DISTINCT FROM {'l0.tree' if k < _LEVELS else 'NULL'} AND s{k}.i = {place(k)}" for k in range(_LEVELS + _SOURCE_LEVELS))
    last = _LEVELS + _SOURCE_LEVELS
    proof = " || ".join(f"CASE WHEN s{k}.n > 1 THEN s{k}.l || s{k}.r ELSE '' END" for k in range(last))
    steps.append(f"p0 AS (SELECT l0.doc_id, leaf, subroot, own AS x, sha256({proof}) AS proof_sha256, {', '.join(f's{k}.n AS n{k}, s{k}.l AS l{k}, s{k}.r AS r{k}' for k in range(last))} FROM l0 JOIN subroots ON subroots.tree IS NOT DISTINCT FROM l0.tree{joins})")
    for k in range(last):
        steps.append(f"p{k + 1} AS (SELECT * REPLACE (CASE WHEN n{k} > 1 THEN sha256(l{k} || x || r{k}) ELSE x END AS x) FROM p{k})")
    return ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, x AS folded_root, x = root AS verified FROM p{last} CROSS JOIN (SELECT node AS root FROM m{last})"


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op7_warc": OP7_SQL, "op11_layout": _layout_sql(), "op12_merkle": _merkle_sql()}
