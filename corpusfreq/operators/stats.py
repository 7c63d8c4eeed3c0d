"""Summary statistics: count, mean and sample variance, by key and mergeable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfreq.functions import scores
from corpusfreq.plans.skew import lookup_join


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def summary_stats(df: DataFrame, value: str | Column) -> DataFrame:
    """One row ``n, mean, variance``; the variance of fewer than two rows is NULL."""
    x = _col(value).cast("double")
    return df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance")
    )


def summary_stats_by(
    df: DataFrame, value: str | Column, **keys: str | Column
) -> DataFrame:
    """The same per key; keys are given as ``name=expression``."""
    x = _col(value).cast("double")
    return df.groupBy(*[_col(k).alias(name) for name, k in keys.items()]).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance")
    )


def stats_state(df: DataFrame, value: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mergeable state ``n, mean, m2`` (m2: sum of squared deviations) per key."""
    x = _col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2"),
    )


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine any number of states per key, pairwise merging being associative.

    The common mean is found first, then the squared deviations are moved to it.
    """
    means = states.groupBy(*keys).agg(
        F.sum("n").alias("__n"),
        F.count("*").alias("__rows"),
        F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")), F.lit(0.0)).alias(
            "__mean"
        ),
    )
    moved = lookup_join(states, means, list(keys), "__rows", {"__mean": "__mean"})
    shift = F.col("mean") - F.col("__mean")
    return moved.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.first("__mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * shift * shift).alias("m2"),
    )


def complete_stats(states: DataFrame) -> DataFrame:
    """State to statistics: mean and variance are undefined below two observations."""
    enough = F.col("n") >= 2
    rest = [c for c in states.columns if c not in ("n", "mean", "m2")]
    return states.select(
        *rest,
        "n",
        F.when(enough, F.col("mean")).alias("mean"),
        F.when(enough, F.col("m2") / (F.col("n") - 1)).alias("variance"),
    )


def z_scores(
    df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "z"
) -> DataFrame:
    """Standard scores, over the whole table or within each key.

    The statistics are aggregated first and joined back, so a key that holds a
    large share of the rows is never sorted or buffered in one task.
    """
    x = F.col(value).cast("double")
    if not keys:
        stats = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
        return df.withColumn(
            out, scores.z_score(x, stats.select("m").scalar(), stats.select("s").scalar())
        )
    stats = df.groupBy(*keys).agg(
        F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"), F.count("*").alias("__n")
    )
    joined = lookup_join(df, stats, list(keys), "__n", {"__m": "__m", "__s": "__s"})
    return joined.withColumn(out, scores.z_score(x, F.col("__m"), F.col("__s"))).drop(
        "__m", "__s"
    )
