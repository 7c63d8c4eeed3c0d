"""Neighbourhood windows over long sequences.

A window partitioned by the sequence key alone would put a whole sequence into
one task. Cutting each sequence into fixed-length blocks bounds the task; the few
rows that windows of a neighbouring block can reach are copied into that block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 50_000


def with_halo(
    rows: DataFrame, ord_col: str, before: int, after: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``__block`` and ``__own``; rows near a block edge appear in both blocks.

    ``ord_col`` must be dense inside each sequence, so that the window of a row
    is exactly the rows whose ordinal lies ``before`` below to ``after`` above.
    """
    size = F.lit(max(block_rows, before + after, 1))
    ordinal = F.col(ord_col).cast("long")
    lowest = F.greatest(ordinal - F.lit(after), F.lit(0).cast("long"))
    first, last = F.floor(lowest / size), F.floor((ordinal + F.lit(before)) / size)
    return rows.withColumn("__block", F.explode(F.sequence(first, last))).withColumn(
        "__own", F.col("__block") == F.floor(ordinal / size)
    )


def block_window(doc_col: str, ord_col: str) -> WindowSpec:
    return Window.partitionBy(doc_col, "__block").orderBy(ord_col)


def owned(rows: DataFrame) -> DataFrame:
    return rows.where("__own").drop("__block", "__own")


def leads(item: str, n: int, window: WindowSpec) -> list[Column]:
    """The item and its n-1 successors as columns ``w1 … wn``."""
    return [F.lead(item, k).over(window).alias(f"w{k + 1}") for k in range(n)]
