"""Reading corpora, tagging documents, stop lists and two-column files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfreq.functions.text import TOKEN_PATTERN, matches


def load_corpus(spark: SparkSession, root: str, encoding: str = "UTF-8") -> DataFrame:
    """One row per file under ``root`` (a folder, walked recursively, or one file).

    Hidden files (leading dot) are skipped; Spark's file listing also skips names
    that start with an underscore. ``ISO-8859-1`` reads Latin-1 corpora.
    """
    return visible_files(spark, root).select(
        F.col("path").alias("doc_id"), decode_text(F.col("content"), encoding).alias("text")
    )


def visible_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, modificationTime, length, content`` of the files under ``root`` that are not hidden."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    hidden = F.exists(F.split(_below(F.col("path"), root), "/"), lambda p: p.startswith("."))
    return files.where(~hidden)


def _below(path: Column, root: str) -> Column:
    """The part of ``path`` below ``root``: hidden parents of the root do not count.

    Of a root with wildcards, the folders before the first one are the root.
    """
    fixed = re.split(r"[*?\[{]", root, maxsplit=1)[0]
    if fixed != root:
        fixed = fixed[: fixed.rfind("/") + 1]
    tail = fixed.rstrip("/").split(":")[-1].lstrip("/")
    if not tail:
        return base_name(path)
    return F.when(
        F.instr(path, tail) > 0, F.substring_index(path, tail, -1)
    ).otherwise(base_name(path))


def decode_text(content: Column, encoding: str = "UTF-8") -> Column:
    return F.decode(content, encoding)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def make_corpus(docs: DataFrame, order_by: str, doc: str = "doc_id") -> DataFrame:
    """Keep one row per document id: the one added last.

    Only ids and the order are aggregated. The rows meet the last place of their id in a
    hash join that builds on these, so no text is sorted; the versions of an id lie in
    different tasks. Rows of equal id and order are one by one compared, the greatest stays.
    """
    number = F.count("*").alias("n")
    places = docs.groupBy(F.col(doc).alias("__doc"), F.col(order_by).alias("__at")).agg(number)
    latest = places.groupBy("__doc").agg(F.max(F.struct("__at", "n")).alias("__last"))
    latest = latest.select("__doc", F.col("__last.__at").alias("__at"), F.col("__last.n").alias("__n"))
    found = docs.join(
        latest.hint("shuffle_hash"), F.col(doc).eqNullSafe(F.col("__doc")) & F.col(order_by).eqNullSafe(F.col("__at"))
    )
    rest = [c for c in docs.columns if c != doc]
    single = found.where(F.col("__n") == 1).select(doc, *rest)
    ties = found.where(F.col("__n") > 1).groupBy(doc).agg(F.max(F.struct(*rest)).alias("__latest"))
    return single.unionByName(ties.select(doc, "__latest.*"))


def add_documents(
    corpus: DataFrame, added: DataFrame, doc: str = "doc_id", order_by: str | None = None
) -> DataFrame:
    """Add documents; a document that already exists is replaced.

    Of several added rows of one id the last by ``order_by`` stays, or without it the
    greatest row. The corpus itself only loses the replaced ids; none of its texts is
    sorted.
    """
    if order_by is None:
        rest = F.struct(*[c for c in added.columns if c != doc])
        latest = added.groupBy(doc).agg(F.max(rest).alias("__latest")).select(doc, "__latest.*")
    else:
        latest = make_corpus(added, order_by, doc)
    replaced = latest.select(F.col(doc).alias("__replaced"))
    kept = corpus.join(replaced, F.col(doc) == F.col("__replaced"), "left_anti")
    return kept.unionByName(latest.select(*corpus.columns))


def tag_by_name(
    docs: DataFrame,
    rules: Sequence[tuple[str, str]] = (("spm", "SPAM"),),
    default: str = "HAM",
    path: str = "doc_id",
    out: str = "tag",
) -> DataFrame:
    """Tag from the file's base name: the first rule whose prefix matches, else default."""
    name = base_name(F.col(path).cast("string"))
    tag = F.lit(default)
    for prefix, value in reversed(list(rules)):
        tag = F.when(name.startswith(prefix), F.lit(value)).otherwise(tag)
    return docs.withColumn(out, tag)


def load_stop_words(
    spark: SparkSession, path: str, lower: bool = True, pattern: str = TOKEN_PATTERN
) -> DataFrame:
    """Distinct tokens of a file; ``lower=False`` keeps them as written."""
    return stop_words(spark.read.text(path), "value", lower, pattern)


def stop_words(
    lines: DataFrame, text: str, lower: bool = True, pattern: str = TOKEN_PATTERN
) -> DataFrame:
    word = F.explode(matches(F.col(text), pattern)).alias("norm")
    words = lines.select(word)
    return (words.select(F.lower("norm").alias("norm")) if lower else words).distinct()


def read_pairs(
    spark: SparkSession,
    path: str,
    key: str = "key string",
    value: str = "value string",
) -> DataFrame:
    """Two tab-separated columns; other lines are dropped and the last line of a
    key wins. ``key`` and ``value`` give name and type."""
    (key_name, key_type), (value_name, value_type) = key.split(), value.split()
    rows = spark.read.text(path).select(
        F.split("value", "\t", -1).alias("f"),
        # A split is read in order by one task, so this orders the lines of a file.
        F.struct(
            "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()
        ).alias("__seq"),
    )
    pairs = rows.where(F.size("f") == 2).select(
        F.expr(f"try_cast(f[0] AS {key_type})").alias(key_name),
        F.expr(f"try_cast(f[1] AS {value_type})").alias(value_name),
        "__seq",
    )
    pairs = pairs.where(F.col(key_name).isNotNull() & F.col(value_name).isNotNull())
    return pairs.groupBy(key_name).agg(F.max_by(value_name, "__seq").alias(value_name))


def write_pairs(df: DataFrame, path: str, key: str, value: str) -> None:
    """Write a two-column table as tab-separated text, one folder of part files."""
    df.select(F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string"))).write.text(
        path
    )
