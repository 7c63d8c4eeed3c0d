"""Site-relative line deduplication.

A line is boilerplate of a host if the share of the host's pages that contain it
exceeds ``ratio``. A host with P pages of L distinct lines each on average then has
fewer than L / ratio boilerplate lines, so its list is small whatever P is; the
documents meet that list in one join on the host and are cut in their own row.

Defined cases: null hosts form one host of their own; null texts stay null and count
as pages; blank lines are never dropped; a line found on fewer than ``min_pages``
pages is never dropped, so small hosts keep their text; repeated rows are pages of
their own; a document whose lines all go stays with an empty text; texts of any length
are cut whole. All other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfreq.llm.store import stored

RATIO = 0.05
MIN_PAGES = 5


def _key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, line, pages, total): ``line`` is the key of a boilerplate line of the host."""
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("body"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    lines = F.array_distinct(F.split("body", "\n", -1))
    each = pages.select("host", F.explode_outer(lines).alias("one")).where(F.trim("one") != "")
    counts = each.groupBy("host", _key(F.col("one")).alias("line")).agg(F.count("*").alias("pages"))
    frequent = counts.where(F.col("pages") >= min_pages)
    return (
        frequent.join(totals.withColumnRenamed("host", "site"), F.col("host").eqNullSafe(F.col("site")))
        .where(F.col("pages") > F.lit(ratio) * F.col("total"))
        .select("host", "line", "pages", "total")
    )


def drop_boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    n_lines: str | None = None, n_dropped: str | None = None,
) -> DataFrame:
    """``docs`` with the boilerplate lines cut out of the text; optionally line counts."""
    # A listed line stands on more than ``ratio`` of its host's pages, so a host has at most
    # 1 / ratio times as many as a page has lines on average. Stored, the lists have a size
    # that the planner knows: it broadcasts them if they are small and moves no text.
    lists = boilerplate(docs, host_col, text_col, ratio, min_pages).groupBy("host").agg(
        F.collect_list("line").alias("__ld_lines")
    ).withColumnRenamed("host", "__ld_host")
    lists = stored(lists, "boilerplate")
    joined = docs.join(lists, docs[host_col].eqNullSafe(F.col("__ld_host")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    keep = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__ld_lines"), _key(x)))
    kept = F.when(F.col("__ld_lines").isNull(), lines).otherwise(keep)
    joined = joined.withColumn("__ld_kept", kept)
    columns = [
        F.array_join("__ld_kept", "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns
    ]
    if n_lines:
        columns.append(F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines))
    if n_dropped:
        gone = F.size(lines) - F.size("__ld_kept")
        columns.append(F.when(F.col(text_col).isNull(), 0).otherwise(gone).cast("long").alias(n_dropped))
    return joined.select(*columns)


def with_lengths(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the length column, if there is one, brought in line with the text."""
    if length_col not in docs.columns:
        return docs
    return docs.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
