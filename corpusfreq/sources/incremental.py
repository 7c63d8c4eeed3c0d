"""A stored corpus that follows a folder of files.

Each refresh lists the folder, which reads no content, compares path, modification time
and length with what is stored, and adds a version that holds the files that are new or
changed and names those that are gone. Only files at least as old as the oldest changed
one are opened; the time is a filter of the scan itself.

A version is one Parquet write. A refresh that fails leaves nothing that is read, and the
next one finds the same files changed. Refreshes of one store run one after the other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfreq.session import stored
from corpusfreq.sources.corpus import decode_text, make_corpus, visible_files

VERSIONS = "doc_id string, text string, modified timestamp, length bigint, present boolean, version int"


def versions(spark: SparkSession, store: str) -> DataFrame:
    """Every version of every file: ``VERSIONS``."""
    try:
        return spark.read.schema(VERSIONS).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def known_files(spark: SparkSession, store: str) -> DataFrame:
    """``doc_id, modified, length``: the last version of the files that were there."""
    last = versions(spark, store).groupBy("doc_id").agg(F.max(F.struct("version", "modified", "length", "present")).alias("v"))
    return last.where("v.present").select("doc_id", "v.modified", "v.length")


def changed_files(spark: SparkSession, root: str, store: str) -> DataFrame:
    """``doc_id, modified, length, present``: files that differ from the stored corpus.

    A file that is gone has ``present`` false.
    """
    now = visible_files(spark, root).select(F.col("path").alias("doc_id"), F.col("modificationTime").alias("modified"), "length")
    before = known_files(spark, store).select(F.col("doc_id").alias("k"), F.col("modified").alias("m"), F.col("length").alias("l"))
    both = now.join(before, F.col("doc_id") == F.col("k"), "full")
    same = F.col("doc_id").isNotNull() & F.col("k").isNotNull() & (F.col("modified") == F.col("m")) & (F.col("length") == F.col("l"))
    return both.where(~F.coalesce(same, F.lit(False))).select(
        F.coalesce("doc_id", "k").alias("doc_id"), "modified", "length", F.col("doc_id").isNotNull().alias("present")
    )


def refresh(spark: SparkSession, root: str, store: str, encoding: str = "UTF-8") -> int:
    """Bring the stored corpus up to date; returns how many files were new, changed or gone."""
    changed = stored(changed_files(spark, root, store), "changed")
    count, since = changed.agg(F.count("*"), F.min("modified")).first()
    if not count:
        return 0
    number = versions(spark, store).agg(F.coalesce(F.max("version") + 1, F.lit(0))).first()[0]
    gone = changed.where(~F.col("present")).select("doc_id", F.lit(None).cast("string").alias("text"), "modified", "length", "present")
    rows = gone
    if since is not None:
        wanted = changed.where("present").select(F.col("doc_id").alias("w"))
        # What is read decides what is stored: a file may change once more meanwhile.
        files = visible_files(spark, root).where(F.col("modificationTime") >= F.lit(since))
        read = files.join(wanted, F.col("path") == F.col("w"), "left_semi").select(
            F.col("path").alias("doc_id"), decode_text(F.col("content"), encoding).alias("text"),
            F.col("modificationTime").alias("modified"), "length", F.lit(True).alias("present"),
        )
        rows = read.unionByName(gone)
    rows.write.parquet(f"{store}/version={number}")
    return count


def current(spark: SparkSession, store: str) -> DataFrame:
    """``doc_id, text`` of the files that were there at the last refresh."""
    return make_corpus(versions(spark, store), "version").where("present").select("doc_id", "text")
