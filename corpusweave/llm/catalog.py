"""Registered queries of the pipeline operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .exact_dedup import exact_duplicates
from .jaccard import similar_documents
from .language_model import score_texts
from .license_scan import find_notices, license_digest
from .merkle import merkle_manifest
from .mixing import mix_sources
from .packing import pack_documents
from .quality import score_quality, train_quality
from .sharding import shard_by_bytes
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .warc import read_captures, write_archives
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


@_query("op1_quality_rules")
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_query("op2_pack_documents")
def _(spark, sf_dir):
    return pack_documents(_table(spark, sf_dir, "documents"))


@_query("op4_count_tokens")
def _(spark, sf_dir):
    return count_tokens(_table(spark, sf_dir, "documents"))


@_query("op5_token_files")
def _(spark, sf_dir):
    return read_token_files(spark, write_token_files(_table(spark, sf_dir, "documents")))


@_query("op7_ngram_jaccard")
def _(spark, sf_dir):
    return similar_documents(_table(spark, sf_dir, "documents"))


@_query("op6_lm_scores")
def _(spark, sf_dir):
    return score_texts(_table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIX = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM rows GROUP BY source),
-- round by round: sources whose share exceeds twice their size are fixed at that
rounds AS (
  SELECT 0 AS round, source, source_size, weight, false AS capped FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight,
    capped OR (weight * (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) FILTER (capped) OVER (), 0))
      / greatest(1, coalesce(sum(weight) FILTER (NOT capped) OVER (), 0)) >= 2.0 * source_size)
  FROM rounds WHERE round < 40),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN 2.0 * source_size
      ELSE weight * ((1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) FILTER (capped) OVER (), 0))
        / greatest(1, coalesce(sum(weight) FILTER (NOT capped) OVER (), 0))) END AS target
  FROM rounds WHERE round = 40),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT r.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
    sum(size) OVER (PARTITION BY r.source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY r.source, hash) AS same
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (size * (whole + CASE WHEN 2 * upto - same < 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed"""


@_query("op3_mix_sources", _MIX)
def _(spark, sf_dir):
    return mix_sources(_table(spark, sf_dir, "documents")).drop("copies")


_WARC = r"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS original FROM hashed)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM firsts"""


@_query("op8_warc_transactions", _WARC)
def _(spark, sf_dir):
    manifest = write_archives(_table(spark, sf_dir, "pages"))
    captures = read_captures(spark, manifest, payloads=False)
    return captures.select("page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", "response.refers_to")


@_query(
    "op9_exact_dedup",
    f"""WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t""",
)
def _(spark, sf_dir):
    return exact_duplicates(_table(spark, sf_dir, "documents")).drop("row")


# crc32 byte by byte: the table of 256 entries is made from the polynomial
_SHARDS = """
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS entries FROM steps WHERE k = 8),
rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
      lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM documents, crc),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM rows),
sharded AS (SELECT *, least(23, ((upto * 2 - size) * 24) // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY upto) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM sharded"""


@_query("op10_shard_by_bytes", _SHARDS)
def _(spark, sf_dir):
    return shard_by_bytes(_table(spark, sf_dir, "documents"))


@_query("op11_license_scan")
def _(spark, sf_dir):
    return license_digest(find_notices(_table(spark, sf_dir, "documents")))


# nodes level by level, proofs by looking siblings up, folds level by level
_MERKLE = """
WITH RECURSIVE rows AS (
  SELECT *, (n_chars IS NOT NULL AND 7 * (crc // 7) = crc) AS struck FROM (
    SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
      lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1]))) AS crc
    FROM documents d, (
      WITH RECURSIVE steps AS (
        SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
        UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8)
      SELECT list(c ORDER BY byte) AS entries FROM steps WHERE k = 8))),
fields AS (
  SELECT doc_id, lang, struck, n_chars,
    [coalesce(strlen(f) || ':' || f, '-') FOR f IN [doc_id::VARCHAR, source, lang]] AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM rows),
leaves AS (
  SELECT doc_id, lang,
    sha256(array_to_string(head, '') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN struck THEN sha256(array_to_string(head, '') || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS other
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT DISTINCT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx) OVER (PARTITION BY tree, idx // 2)),
    (n + 1) // 2 FROM nodes WHERE n > 1),
subroots AS (SELECT tree, h AS subroot, level AS height FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS idx, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT DISTINCT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx) OVER (PARTITION BY idx // 2)), (n + 1) // 2 FROM tops WHERE n > 1),
root AS (SELECT h AS root, level AS top_height FROM tops WHERE n = 1),
steps AS (
  SELECT p.tree, p.pos, k AS step, s.h AS sibling, (p.pos >> k) & 1 AS right_side
  FROM placed p JOIN subroots r USING (tree), range(64) t(k)
  LEFT JOIN nodes s ON s.tree = p.tree AND s.level = k AND s.idx = xor(p.pos >> k, 1) WHERE k < r.height
  UNION ALL
  SELECT p.tree, p.pos, r.height + k, s.h, (p.tree >> k) & 1
  FROM placed p JOIN subroots r USING (tree), root, range(64) t(k)
  LEFT JOIN tops s ON s.level = k AND s.idx = xor(p.tree >> k, 1) WHERE k < top_height),
proofs AS (SELECT tree, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY tree, pos),
folds AS (
  SELECT tree, pos, 0 AS step, coalesce(other, leaf) AS h FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.step + 1, sha256(CASE WHEN right_side = 1 THEN coalesce(sibling, '') || h ELSE h || coalesce(sibling, '') END)
  FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.step = f.step)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM placed p JOIN subroots r USING (tree) CROSS JOIN root LEFT JOIN proofs q USING (tree, pos)
JOIN folds f ON f.tree = p.tree AND f.pos = p.pos AND f.step = r.height + top_height"""


@_query("op12_merkle_manifest", _MERKLE)
def _(spark, sf_dir):
    return merkle_manifest(_table(spark, sf_dir, "documents"))


@_query("op13_whitening")
def _(spark, sf_dir):
    return whiten(_table(spark, sf_dir, "embeddings"))
