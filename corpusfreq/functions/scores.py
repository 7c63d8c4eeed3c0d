"""Test statistics, association scores and smoothing formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    return F.try_divide(x - mean, sd)


def t_test(sample_mean: Column, expected_mean: Column, sd: Column, n: Column) -> Column:
    return F.try_divide(sample_mean - expected_mean, F.try_divide(sd, F.sqrt(n)))


def t_difference(c1: Column, c2: Column) -> Column:
    """Does a word go with v1 (count c1) more than with v2 (count c2)?"""
    return F.try_divide((c1 - c2).cast("double"), F.sqrt((c1 + c2).cast("double")))


def log2_likelihood(k: Column, n: Column, p: Column) -> Column:
    """log2 of p^k (1-p)^(n-k), with 0·log 0 taken as 0; NULL where impossible."""
    hits = F.when(k == 0, F.lit(0.0)).otherwise(k * F.log2(p))
    misses = F.when(n == k, F.lit(0.0)).otherwise((n - k) * F.log2(1 - p))
    return hits + misses


def is_possible(k: Column, n: Column, p: Column) -> Column:
    """Whether that likelihood exists, told without a logarithm."""
    return p.isNotNull() & ((k == 0) | (p > 0)) & ((n == k) | (p < 1))


def likelihood_ratio(
    c1: Column, c2: Column, c12: Column, n: Column, p: Column, p1: Column, p2: Column
) -> Column:
    """-2·log2 of the ratio of two binomial hypotheses.

    ``p`` is the pooled probability of the second word, ``p1`` its probability
    after the first word and ``p2`` its probability elsewhere.
    """
    return -2 * (
        log2_likelihood(c12, c1, p)
        + log2_likelihood(c2 - c12, n - c1, p)
        - log2_likelihood(c12, c1, p1)
        - log2_likelihood(c2 - c12, n - c1, p2)
    )


def dunning_parameters(c1: Column, c2: Column, c12: Column, n: Column) -> tuple[Column, ...]:
    """The maximum-likelihood parameters of the textbook: pooled, after, elsewhere."""
    return F.try_divide(c2, n), F.try_divide(c12, c1), F.try_divide(c2 - c12, n - c1)


def dunning_ratio(c1: Column, c2: Column, c12: Column, n: Column) -> Column:
    """The likelihood ratio with those parameters."""
    return likelihood_ratio(c1, c2, c12, n, *dunning_parameters(c1, c2, c12, n))


def pmi(p_xy: Column, p_x: Column, p_y: Column) -> Column:
    return F.log2(F.try_divide(p_xy, p_x * p_y))


def pmi_first_marginal(p_x: Column) -> Column:
    """Compatibility form in which the joint probability cancels out."""
    return -F.log2(p_x)


def pmi_counts(c_xy: Column, c_x: Column, c_y: Column, n: Column) -> Column:
    return pmi(F.try_divide(c_xy, n), F.try_divide(c_x, n), F.try_divide(c_y, n))


def mle(c_ngram: Column, c_history: Column) -> Column:
    return F.try_divide(c_ngram, c_history)


def lidstone(c: Column, n: Column, gamma: float, bins: Column) -> Column:
    return F.try_divide(c + F.lit(gamma), n + bins * F.lit(gamma))


def absolute_discount(r: Column, n1: Column, total: Column, bins: Column, theta: float) -> Column:
    """Probability of an item seen r times; unseen mass is scaled by the number of
    items seen once."""
    return F.when(r == 0, F.try_divide((bins - n1) * F.lit(theta), n1 * total)).otherwise(
        F.try_divide(r - F.lit(theta), total)
    )


def log_probability(p: Column, compat: bool = False) -> Column:
    """log2 p, NULL at p = 0; ``compat`` gives the reciprocal form."""
    positive = F.when(p > 0, p)
    return F.try_divide(F.lit(1.0), F.log2(positive)) if compat else F.log2(positive)
