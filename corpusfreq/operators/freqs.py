"""Frequency tables ``item, count`` and conditional ones ``cond, item, count``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfreq.functions.text import norms
from corpusfreq.plans.ranking import running_total
from corpusfreq.plans.skew import lookup_join
from corpusfreq.session import stored

# A frequency row is expanded in pieces of this many copies.
EXPAND_CHUNK = 100_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def frequencies(df: DataFrame, item: str | Column = "norm") -> DataFrame:
    return df.groupBy(_col(item).alias("item")).agg(F.count("*").alias("count"))


def word_frequencies(
    docs: DataFrame, text: str = "text", stop: Sequence[str] | None = None
) -> DataFrame:
    """Lower-cased word counts straight from the texts, without positions."""
    word = F.explode(norms(F.col(text), lower=False))
    words = docs.select(word.alias("w")).select(F.lower("w").alias("norm"))
    return frequencies(words.where(~F.col("norm").isin(*stop)) if stop else words)


def merge(*tables: DataFrame) -> DataFrame:
    """Add frequency tables, plain or conditional: every column but ``count`` is key."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out.groupBy(*[c for c in out.columns if c != "count"]).agg(
        F.sum("count").alias("count")
    )


def count_all(freqs: DataFrame, df: DataFrame, item: str | Column = "norm") -> DataFrame:
    """Add more observations to an existing table."""
    return merge(freqs, frequencies(df, item))


def lookup(query: DataFrame, freqs: DataFrame, item: str = "item") -> DataFrame:
    """Frequency of each queried item, 0 if absent."""
    found = lookup_join(query, freqs, {item: "item"}, None, {"count": "count"})
    return found.withColumn("count", F.coalesce("count", F.lit(0)))


def lookup_conditional(
    query: DataFrame, freqs: DataFrame, cond: str = "cond", item: str = "item"
) -> DataFrame:
    """Frequency of each queried (condition, item), 0 if absent."""
    keys = {cond: "cond", item: "item"}
    found = lookup_join(query, freqs, keys, None, {"count": "count"})
    return found.withColumn("count", F.coalesce("count", F.lit(0)))


def items(freqs: DataFrame) -> DataFrame:
    return freqs.select("item")


def total(freqs: DataFrame) -> DataFrame:
    """Sum of all counts, for plain and conditional tables alike."""
    return freqs.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def bins(freqs: DataFrame) -> DataFrame:
    return freqs.agg(F.count("*").alias("bins"))


def hapaxes(freqs: DataFrame) -> DataFrame:
    return freqs.where(F.col("count") == 1).select("item")


def replace_from_set(
    rows: DataFrame,
    members: DataFrame,
    marker: str,
    item: str = "norm",
    freqs: DataFrame | None = None,
) -> DataFrame:
    """Replace items that belong to the set by a marker.

    With the frequency table of ``rows`` at hand the membership test cannot be
    skewed by frequent items; without it the planner chooses the join by the set's bytes.
    """
    column = members.columns[0]
    flagged = members.select(F.col(column).alias("__m"), F.lit(True).alias("__in")).distinct()
    if freqs is None:
        marked = rows.join(flagged, F.col(item) == F.col("__m"), "left")
    else:
        table = freqs.join(flagged, F.col("item") == F.col("__m"), "left")
        marked = lookup_join(rows, table, {item: "item"}, "count", {"__in": "__in"})
    replaced = F.when(F.col("__in"), F.lit(marker)).otherwise(F.col(item))
    return marked.withColumn(item, replaced).select(*rows.columns)


def replace_freqs_from_set(freqs: DataFrame, members: DataFrame, marker: str) -> DataFrame:
    """The same on a frequency table; collapsed rows are summed."""
    replaced = replace_from_set(freqs, members, marker, "item")
    return replaced.groupBy("item").agg(F.sum("count").alias("count"))


def reconstitute(freqs: DataFrame) -> DataFrame:
    """Expand a table back to repeated items, large counts in many small pieces."""
    last = F.floor((F.col("count") - 1) / F.lit(EXPAND_CHUNK))
    pieces = freqs.where(F.col("count") > 0).select(
        "item", "count", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")
    )
    copies = F.least(F.lit(EXPAND_CHUNK), F.col("count") - F.col("piece") * EXPAND_CHUNK)
    spread = pieces.repartition("item", "piece")
    return spread.select(
        "item", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("__n")
    ).select("item")


def conditional_freqs(df: DataFrame, cond: str | Column, item: str | Column) -> DataFrame:
    return df.groupBy(_col(cond).alias("cond"), _col(item).alias("item")).agg(
        F.count("*").alias("count")
    )


def conditions(freqs: DataFrame) -> DataFrame:
    return freqs.select("cond").distinct()


def group_freqs_by(freqs: DataFrame, cond: str | Column, item: str | Column) -> DataFrame:
    """Regroup an existing table by key and value expressions, adding the counts."""
    return freqs.groupBy(_col(cond).alias("cond"), _col(item).alias("item")).agg(
        F.sum("count").alias("count")
    )


def marginal(freqs: DataFrame) -> DataFrame:
    """Counts of the items over all conditions."""
    return freqs.groupBy("item").agg(F.sum("count").alias("count"))


def conditional_totals(freqs: DataFrame) -> DataFrame:
    return freqs.groupBy("cond").agg(F.sum("count").alias("total"))


def count_of_counts(freqs: DataFrame) -> DataFrame:
    """``r, n``: how many items occur r times."""
    return freqs.groupBy(F.col("count").alias("r")).agg(F.count("*").alias("n"))


def r_nr(freqs: DataFrame, known_bins: int | None = None) -> DataFrame:
    """Count of counts with a row r = 0: the known bins never observed, or 0."""
    unseen = F.lit(0) if known_bins is None else F.lit(known_bins) - F.count("*")
    zero = freqs.agg(unseen.cast("long").alias("n")).select(
        F.lit(0).cast("long").alias("r"), "n"
    )
    return count_of_counts(freqs).unionByName(zero)


def cumulative_freqs(
    freqs: DataFrame,
    sample: DataFrame,
    order_by: Sequence[str],
    item: str = "item",
    weights: DataFrame | None = None,
) -> DataFrame:
    """Walk a sample in order and add up each item's frequency (0 if unknown).

    ``weights`` is the sample's own frequency table if it differs from ``freqs``;
    it only steers the join of frequent items. The frequencies and the scored sample are
    stored: the lookup and the range partitioning read them more than once.
    """
    freqs = stored(freqs, "freqs")
    table = freqs.select("item", "count", F.col("count").alias("__w"))
    if weights is not None:
        own = weights.select(F.col("item").alias("__i"), F.col("count").alias("__w"))
        table = freqs.join(own, F.col("item") == F.col("__i"), "full").select(
            F.coalesce("item", "__i").alias("item"), "count", F.coalesce("__w", F.lit(0)).alias("__w")
        )
    scored = lookup_join(sample, table, {item: "item"}, "__w", {"__f": "count"})
    scored = stored(scored.withColumn("__f", F.coalesce("__f", F.lit(0)).cast("double")), "scored")
    return running_total(scored, list(order_by), "__f", "cumulative").drop("__f")


def token_type_ratio(freqs: DataFrame) -> DataFrame:
    """Tokens divided by types."""
    return freqs.agg(F.try_divide(F.sum("count"), F.count("*")).alias("ratio"))


def max_value(freqs: DataFrame) -> DataFrame:
    """The most frequent item, the smallest one on a tie; no row for no items."""
    return freqs.orderBy(F.desc("count"), F.asc("item")).limit(1)


def probabilities(freqs: DataFrame) -> DataFrame:
    """``item, p``: count divided by the total."""
    everything = freqs.agg(F.sum("count")).scalar()
    return freqs.select("item", F.try_divide("count", everything).alias("p"))


def conditional_probabilities(freqs: DataFrame) -> DataFrame:
    """``cond, item, p``: count divided by the condition's total."""
    totals = conditional_totals(freqs)
    joined = lookup_join(freqs, totals, "cond", "total", {"__total": "total"})
    return joined.select("cond", "item", F.try_divide("count", "__total").alias("p"))
