"""Counts and statistics of a stream whose state stays bounded.

Rows carry their time. A window is emitted once, when the watermark, the latest time seen
less the allowed lateness, has passed its end; then its state goes. So the state holds the
keys of the open windows, however long the stream runs.

Late rows: one that comes after the watermark has passed the end of its window is dropped
and changes nothing that was emitted; one within the allowed lateness always counts. A row
without time belongs to no window. Write with ``append_to``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfreq.operators.stats import summary_stats_by


def _windowed(rows: DataFrame, ts: str, window: str, late: str, slide: str | None) -> DataFrame:
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.withColumn("window", F.window(ts, window, slide or window))


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *rest)


def windowed_frequencies(
    tokens: DataFrame, ts: str, window: str, late: str, item: str | Column = "norm", slide: str | None = None
) -> DataFrame:
    """``start, end, item, count`` of each closed window; ``slide`` makes windows overlap."""
    value = F.col(item) if isinstance(item, str) else item
    rows = _windowed(tokens.withColumn("__item", value), ts, window, late, slide)
    return _flat(rows.groupBy("window", F.col("__item").alias("item")).agg(F.count("*").alias("count")))


def windowed_summary_by(
    df: DataFrame, value: str | Column, ts: str, window: str, late: str, slide: str | None = None, **keys: str | Column
) -> DataFrame:
    """``start, end, …keys, n, mean, variance`` of each closed window."""
    named = {k: F.col(v) if isinstance(v, str) else v for k, v in keys.items()}
    rows = _windowed(df.withColumns({f"__{k}": v for k, v in named.items()}), ts, window, late, slide)
    return _flat(summary_stats_by(rows, value, window="window", **{k: f"__{k}" for k in named}))
