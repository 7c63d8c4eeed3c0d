"""Reports: top-n lists and collocate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfreq.operators.freqs import frequencies


def freq_report(freqs: DataFrame, n: int) -> DataFrame:
    """The n most frequent items, ties in item order, with a tab-separated line."""
    top = freqs.orderBy(F.desc("count"), F.asc("item")).limit(n)
    line = F.concat_ws("\t", F.col("item").cast("string"), F.col("count").cast("string"))
    return top.withColumn("line", line)


def freq_show_report(df: DataFrame, item: str | Column, n: int) -> DataFrame:
    """Count first, then report."""
    return freq_report(frequencies(df, item), n)


def collocate_report(stats: DataFrame) -> DataFrame:
    """Pairs seen at least twice, by ascending variance, then alphabetically."""
    return (
        stats.where((F.col("n") >= 2) & F.col("variance").isNotNull())
        .select("head", "pair", "n", "mean", "variance")
        .orderBy("variance", "head", "pair")
    )
