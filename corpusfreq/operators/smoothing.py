"""Smoothing from counts of counts ``r, n``.

A table of N tokens has at most sqrt(2N) distinct counts, so the count-of-counts
table stays small enough for an unpartitioned window at any corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfreq.functions import scores

# Fixed value: the usual multiplier of the standard deviation (95 %).
CONFIDENCE = 1.96


def sgt_table(
    counts: DataFrame, confidence: float = CONFIDENCE, compat: bool = False
) -> DataFrame:
    """Simple Good-Turing: ``r, n, r_star, p`` for every observed count.

    Turing estimates are used for small r until they stop differing significantly
    from the log-linear fit, from there on the fit. ``compat`` uses the cut-off
    with the square root taken of only a part of the variance.
    """
    counts = counts.where(F.col("r") > 0)
    by_r = Window.orderBy("r")
    below = F.coalesce(F.lag("r").over(by_r), F.lit(0))
    above = F.coalesce(F.lead("r").over(by_r), 2 * F.col("r") - below)
    next_n = F.when(F.lead("r").over(by_r) == F.col("r") + 1, F.lead("n").over(by_r))
    points = counts.select(
        "r",
        "n",
        (2.0 * F.col("n") / (above - below)).alias("z"),
        next_n.cast("double").alias("next_n"),
    )
    logs = points.select(F.ln("r").alias("x"), F.ln("z").alias("y"))
    # The fit's intercept cancels in the ratio of two fitted values.
    points = points.withColumn("slope", logs.agg(F.regr_slope("y", "x")).scalar())
    slope = F.col("slope")
    r, n, nn = F.col("r"), F.col("n").cast("double"), F.col("next_n")
    turing = (r + 1) * nn / n
    fitted = (r + 1) * F.exp(slope * (F.ln(r + 1) - F.ln(r)))
    if compat:
        cutoff = confidence * (r + 1) * nn / (n * n * (1 + nn / n))
    else:
        cutoff = confidence * F.sqrt((r + 1) * (r + 1) * nn / (n * n) * (1 + nn / n))
    switch = nn.isNull() | (F.abs(turing - fitted) <= cutoff)
    so_far = by_r.rowsBetween(Window.unboundedPreceding, 0)
    switched = points.withColumn("turing", turing).withColumn("fitted", fitted)
    switched = switched.withColumn("switched", F.max(switch.cast("int")).over(so_far) == 1)
    starred = switched.select(
        "r", "n", F.when(F.col("switched"), F.col("fitted")).otherwise(F.col("turing")).alias("r_star")
    )
    mass = starred.agg(F.sum(F.col("n") * F.col("r_star"))).scalar()
    return starred.withColumn("p", (1 - unseen_mass(counts)) * F.col("r_star") / mass)


def sgt_fit(counts: DataFrame) -> DataFrame:
    """Slope and intercept of the log-log regression behind the fit."""
    counts = counts.where(F.col("r") > 0)
    by_r = Window.orderBy("r")
    below = F.coalesce(F.lag("r").over(by_r), F.lit(0))
    above = F.coalesce(F.lead("r").over(by_r), 2 * F.col("r") - below)
    logs = counts.select(
        F.ln("r").alias("x"), F.ln(2.0 * F.col("n") / (above - below)).alias("y")
    )
    return logs.agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")
    )


def _seen_once() -> Column:
    return F.sum(F.when(F.col("r") == 1, F.col("n")).otherwise(F.lit(0)))


def _tokens() -> Column:
    return F.sum(F.col("r") * F.col("n"))


def unseen_mass(counts: DataFrame) -> Column:
    """P0: the probability of all unseen items together."""
    return counts.agg(F.try_divide(_seen_once(), _tokens())).scalar()


def sgt_with_unseen(
    counts: DataFrame, confidence: float = CONFIDENCE, compat: bool = False
) -> DataFrame:
    """``r, r_star, p`` including the row r = 0 with the unseen mass."""
    fitted = sgt_table(counts, confidence, compat).select(
        F.col("r").cast("long").alias("r"), "r_star", "p"
    )
    zero = counts.agg(F.lit(0).cast("long").alias("r"), F.lit(0.0).alias("r_star"))
    return zero.withColumn("p", unseen_mass(counts).cast("double")).unionByName(fitted)


def absolute_discounting(
    query: DataFrame, counts: DataFrame, theta: float, bins: int, r: str = "r", out: str = "p"
) -> DataFrame:
    """Absolutely discounted probability for every count in ``query``."""
    totals = counts.agg(F.struct(_seen_once().alias("once"), _tokens().alias("tokens")))
    with_totals = query.withColumn("__t", totals.scalar())
    once, tokens = F.col("__t")["once"], F.col("__t")["tokens"]
    p = scores.absolute_discount(F.col(r), once, tokens, F.lit(bins), theta)
    return with_totals.withColumn(out, p).drop("__t")
