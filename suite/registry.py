"""Registered queries with the SQL that gives the same result."""

from __future__ import annotations

import functools
import os
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            name_storage(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name_storage(spark: SparkSession) -> None:
    """Some queries store tables. A test session on one machine that names no folder for
    them gets one here; on a cluster the setting is the cluster's."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return
    if re.match(r"local(\[|$)", context.master):
        context.setCheckpointDir(f"file://{os.path.join(tempfile.gettempdir(), 'corpusfreq-suite')}")


# Text of one task: the hash table that counts its n-grams stays in the memory of a core.
TASK_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to all cores and to tasks of bounded text: the test files have
    a single row group, and a task as large as a core's part would spill its counts."""
    docs = table(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    waves = max(1, -(-size // (cores * TASK_BYTES)))
    return docs.repartition(cores * waves, "doc_id")


# Common table expressions of the SQL side.

# word, norm, doc_id, ord
WORDS = r"""
words AS MATERIALIZED (
  SELECT doc_id, word, lower(word) AS norm, i - 1 AS ord
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}]+') AS w FROM documents)))
"""

# The same for the benchmark texts.
BENCH_WORDS = r"""
bench AS (
  SELECT item_id, lower(word) AS norm, i - 1 AS ord
  FROM (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
        FROM (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{M}]+') AS w FROM benchmark)))
"""

# lines; and tokens with line, start, end
TOKENS = r"""
lines AS (
  SELECT doc_id, unnest(l) AS txt, (generate_subscripts(l, 1) - 1)::INT AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
runs AS (
  SELECT doc_id, line, unnest(r) AS t, generate_subscripts(r, 1) AS k
  FROM (SELECT doc_id, line, regexp_extract_all(txt, '[\p{L}\p{M}]+|[^\p{L}\p{M}]+') AS r FROM lines)),
ends AS (
  SELECT doc_id, line, t, k, sum(length(t)) OVER (PARTITION BY doc_id, line ORDER BY k) AS e FROM runs),
tokens AS (
  SELECT doc_id, t AS word, lower(t) AS norm, line,
         (e - length(t))::INT AS start, e::INT AS "end",
         (row_number() OVER (PARTITION BY doc_id ORDER BY line, k) - 1)::INT AS ord
  FROM ends WHERE regexp_matches(t, '^[\p{L}\p{M}]'))
"""

FREQS = WORDS + """,
freqs AS (SELECT norm AS item, count(*) AS count FROM words GROUP BY norm)
"""

BIGRAMS = FREQS + """,
pairs AS (
  SELECT norm AS w1, lead(norm) OVER (PARTITION BY doc_id ORDER BY ord) AS w2 FROM words),
bigrams AS (SELECT w1, w2, count(*) AS count FROM pairs WHERE w2 IS NOT NULL GROUP BY w1, w2)
"""

NR = FREQS + """,
nr AS (SELECT count AS r, count(*) AS n FROM freqs GROUP BY count)
"""
