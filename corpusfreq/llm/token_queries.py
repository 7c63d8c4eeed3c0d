"""Queries of the operators on tokens of more than one tokenizer, and the manifest."""

from __future__ import annotations

import functools
import posixpath
import uuid

from pyspark.sql import functions as F

from corpusfreq.llm import align, merkle, token_counts
from corpusfreq.llm.registry import query, table
from corpusfreq.llm.store import shared_dir
from corpusfreq.llm.tokenizers import public_file

# Documents with more tokens are over the limit.
CONTEXT_TOKENS = 1024


@query("op13_token_counts")
def op13(spark, sf_dir):
    """The cache is new for each call, so every distinct text is encoded."""
    cache = posixpath.join(shared_dir(spark), spark.sparkContext.applicationId, f"token-counts-{uuid.uuid4().hex}")
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > CONTEXT_TOKENS)


@query("op12_tokenizer_alignment")
def op12(spark, sf_dir):
    return align.alignment(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model"))


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(_field(v) for v in values) + ")"


def _half_byte_step(c: str) -> str:
    return f"xor(t[({c} & 15) + 1], {c} >> 4)"


def _tree(name: str, leaves: str) -> str:
    """Nodes (g, level, pos, node, size) over (g, pos, node, size), where size is the level's."""
    return f"""
{name}(g, level, pos, node, size) AS (
  SELECT g, 0, pos, node, size FROM {leaves}
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(size) + 1) // 2
  FROM {name} WHERE size > 1 GROUP BY g, level, pos // 2)"""


def _climb(name: str, start: str, tree: str) -> str:
    """Nodes (k, g, level, pos, node, size) from every node of ``start`` to the tree's root."""
    return f"""
{name}(k, g, level, pos, node, size) AS (
  SELECT k, g, 0, pos, node, size FROM {start}
  UNION ALL
  SELECT c.k, c.g, c.level + 1, c.pos // 2,
    sha256(CASE WHEN s.node IS NULL THEN c.node WHEN s.pos < c.pos THEN s.node || c.node ELSE c.node || s.node END),
    (c.size + 1) // 2
  FROM {name} c LEFT JOIN {tree} s ON s.g = c.g AND s.level = c.level AND s.pos = xor(c.pos, 1)
  WHERE c.size > 1)"""


# The checksum takes a byte as two half bytes; t holds its 16 remainders (polynomial 0xEDB88320).
_REMAINDERS = "[" + ", ".join(
    str(functools.reduce(lambda c, _: c >> 1 ^ 0xEDB88320 * (c & 1), range(4), k)) for k in range(16)
) + "]::BIGINT[]"
_CRC = f"""xor(4294967295, list_reduce(
  list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: {_half_byte_step(_half_byte_step("xor(c, b)"))}, 4294967295::BIGINT))"""

MERKLE_SQL = f"""
WITH RECURSIVE
src AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('=' || lang, '-') AS g, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS changed,
         coalesce({_CRC} % 7 = 0, false) AS tampered
  FROM documents, (SELECT {_REMAINDERS} AS t)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size FROM src),
leaves AS (SELECT k, g, pos, leaf AS node, size FROM ranked),
claims AS (SELECT k, g, pos, CASE WHEN tampered THEN changed ELSE leaf END AS node, size FROM ranked),
{_tree("tree", "leaves")},
subroots AS (
  SELECT g AS lang_key, '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, node, count(*) OVER () AS size FROM tree WHERE size = 1),
{_tree("top", "subroots")},
{_climb("plain", "leaves", "tree")},
{_climb("claimed", "claims", "tree")},
upper_claims AS (
  SELECT c.k, s.g, s.pos, c.node, s.size FROM claimed c JOIN subroots s ON s.lang_key = c.g WHERE c.size = 1),
{_climb("folded", "upper_claims", "top")},
upper_plain AS (
  SELECT c.k, s.g, s.pos, c.node, s.size FROM plain c JOIN subroots s ON s.lang_key = c.g WHERE c.size = 1),
{_climb("upper", "upper_plain", "top")},
siblings AS (
  SELECT c.k, 0 AS part, c.level, s.node FROM plain c JOIN tree s ON s.g = c.g AND s.level = c.level AND s.pos = xor(c.pos, 1)
  UNION ALL
  SELECT c.k, 1, c.level, s.node FROM upper c JOIN top s ON s.g = c.g AND s.level = c.level AND s.pos = xor(c.pos, 1)),
proofs AS (SELECT k, sha256(string_agg(node, '' ORDER BY part, level)) AS proof_sha256 FROM siblings GROUP BY k)
SELECT r.doc_id, r.leaf, s.node AS subroot, t.node AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.node AS folded_root, f.node = t.node AS verified
FROM ranked r JOIN subroots s ON s.lang_key = r.g JOIN (SELECT node FROM top WHERE size = 1) t ON true
JOIN (SELECT k, node FROM folded WHERE size = 1) f ON f.k = r.k LEFT JOIN proofs p ON p.k = r.k
"""


@query("op11_merkle_manifest", MERKLE_SQL)
def op11(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    manifest = merkle.build(merkle.rows_of(table(spark, sf_dir, "documents"), tampered))
    return merkle.proofs(manifest).withColumnRenamed("id", "doc_id")
