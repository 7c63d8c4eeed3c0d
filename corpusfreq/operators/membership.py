"""Which documents contain a token: exact type sets and data skipping on files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.functions.text import norms


def with_types(
    docs: DataFrame, text: str = "text", stop: Sequence[str] | None = None
) -> DataFrame:
    """Add the set of token types of each document."""
    return docs.withColumn("types", F.array_distinct(norms(F.col(text), stop=stop)))


def doc_types(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", stop: Sequence[str] | None = None
) -> DataFrame:
    """The same sets in long form, one row per document and type."""
    types = F.array_distinct(norms(F.col(text), stop=stop))
    return docs.select(doc, F.explode(types).alias("norm"))


def docs_containing(docs: DataFrame, target: str, types: str = "types") -> DataFrame:
    """Keep documents whose type set holds the token; those without a set pass."""
    return docs.where(F.col(types).isNull() | F.array_contains(types, target))


def docs_containing_types(
    docs: DataFrame, types: DataFrame, target: str, doc: str = "doc_id"
) -> DataFrame:
    """The same through a long type table, e.g. one read back with row-group skipping."""
    hits = types.where(F.col("norm") == target).select(F.col(doc).alias("__doc"))
    return docs.join(hits, F.col(doc) == F.col("__doc"), "left_semi")


def write_types(types: DataFrame, path: str, key: str = "norm", doc: str = "doc_id") -> None:
    """Store a long type table or index so that a lookup skips most row groups.

    Sorting by token gives tight min/max statistics, the Parquet Bloom filter
    excludes the rest; the document id in the range key splits frequent tokens
    over many files.
    """
    (
        types.repartitionByRange(key, doc)
        .sortWithinPartitions(key, doc)
        .write.option(f"parquet.bloom.filter.enabled#{key}", "true")
        .parquet(path)
    )
