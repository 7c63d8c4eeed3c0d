"""Association measures over frequency tables.

N-gram tables have columns ``w1 … wn, count``, item tables ``item, count``. A word
cannot start more distinct n-grams than it has occurrences, so its count bounds
the fan-out of every join below. The two tables are read several times, for the totals and
for either part of a lookup, so the matrices store them first: the corpus is tokenised once
for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfreq.functions import scores
from corpusfreq.plans.skew import Lookup, lookup_join, lookup_joins
from corpusfreq.session import stored


def _with_totals(rows: DataFrame, items: DataFrame, ngrams: DataFrame) -> DataFrame:
    """Add the token total ``__n`` and the n-gram total ``__m``.

    As columns each total is planned once, however often a formula uses it.
    """
    total = lambda freqs: freqs.agg(F.sum("count")).scalar()
    return rows.withColumns({"__n": total(items), "__m": total(ngrams)})


def with_item_counts(
    ngrams: DataFrame, items: DataFrame, words: Sequence[str], bounded: bool = True
) -> DataFrame:
    """Add ``c_<word>``, the count of each word of an n-gram, all in one lookup."""
    weight = "count" if bounded else None
    return lookup_joins(ngrams, [Lookup(items, {w: "item"}, weight, {f"c_{w}": "count"}) for w in words])


def _t_score(words: Sequence[str], compat: bool) -> Column:
    n, total = F.col("__m"), F.col("__n")
    expected = F.lit(1.0)
    for word in words:
        expected = expected * F.coalesce(f"c_{word}", F.lit(0)) / total
    actual = F.try_divide("count", n)
    spread = F.col("count") * F.pow(1 - actual, 2) + (n - F.col("count")) * F.pow(actual, 2)
    t = scores.t_test(actual, expected, F.sqrt(spread / n), n)
    return -t if compat else t


def t_test_matrix(
    ngrams: DataFrame, items: DataFrame, words: Sequence[str] = ("w1", "w2"), compat: bool = False
) -> DataFrame:
    """t score of every observed n-gram against independence of its words.

    Positive when the n-gram is more frequent than expected; ``compat`` flips it.
    """
    items, ngrams = stored(items, "items"), stored(ngrams, "ngrams")
    counted = _with_totals(with_item_counts(ngrams, items, words), items, ngrams)
    return counted.select(*words, "count", _t_score(words, compat).alias("t"))


def t_test_ngram(
    targets: DataFrame,
    ngrams: DataFrame,
    items: DataFrame,
    words: Sequence[str] = ("w1", "w2"),
    compat: bool = False,
) -> DataFrame:
    """The same for given n-grams; an n-gram never observed has no t score."""
    items, ngrams = stored(items, "items"), stored(ngrams, "ngrams")
    found = stored(lookup_join(targets, ngrams, list(words), None, {"count": "count"}), "targets")
    found = found.withColumn("count", F.coalesce("count", F.lit(0)))
    counted = with_item_counts(found, items, words, bounded=False)
    counted = _with_totals(counted, items, ngrams)
    return counted.select(*targets.columns, "count", _t_score(words, compat).alias("t"))


def neighbours(bigrams: DataFrame, target: str, min_count: int = 2) -> DataFrame:
    """``v, n``: words next to the target on either side, from bigrams seen at least
    ``min_count`` times."""
    word = F.when(F.col("w1") == target, F.col("w2")).when(F.col("w2") == target, F.col("w1"))
    found = bigrams.where(F.col("count") >= min_count).select(word.alias("v"), "count")
    return (
        found.where(F.col("v").isNotNull()).groupBy("v").agg(F.sum("count").alias("n"))
    )


def t_differences(
    bigrams: DataFrame,
    target: str,
    against: Sequence[str],
    min_count: int = 2,
    compat: bool = False,
) -> DataFrame:
    """Does the target collocate with one word more than with another?

    Every neighbour of the target is compared with the words in ``against``, so
    the work grows with the neighbours, not with their square. Each unordered
    pair appears once, in word order; ``compat`` repeats it.
    """
    near = neighbours(bigrams, target, min_count)
    chosen = list(dict.fromkeys(against))
    # At most one row per word of the given list.
    rivals = near.where(F.col("v").isin(chosen)).select(
        F.col("v").alias("__v"), F.col("n").alias("__n")
    )
    wanted = near.withColumn("__r", F.explode(F.array(*[F.lit(w) for w in chosen])))
    pairs = wanted.join(F.broadcast(rivals), F.col("__r") == F.col("__v")).where(
        (F.col("v") != F.col("__v")) & ~(F.col("v").isin(chosen) & (F.col("v") > F.col("__v")))
    )
    ordered = F.col("v") < F.col("__v")
    pairs = pairs.select(
        F.when(ordered, F.col("v")).otherwise(F.col("__v")).alias("v1"),
        F.when(ordered, F.col("n")).otherwise(F.col("__n")).alias("n1"),
        F.when(ordered, F.col("__v")).otherwise(F.col("v")).alias("v2"),
        F.when(ordered, F.col("__n")).otherwise(F.col("n")).alias("n2"),
    )
    if compat:
        pairs = pairs.withColumn("__twice", F.explode(F.array(F.lit(0), F.lit(1)))).drop("__twice")
    return pairs.withColumn("t", scores.t_difference(F.col("n1"), F.col("n2")))


def t_difference_table(
    bigrams: DataFrame,
    wanted: DataFrame,
    k: int | None = None,
    min_count: int = 2,
    blocks: int = 64,
) -> DataFrame:
    """``target, rival, v, n_rival, n_v, t``: rows of the t-difference matrices of many targets.

    ``wanted`` has (target, rival), a table of any size. Every neighbour v of a target is
    compared with each of its rivals that is a neighbour too: t is positive if the target
    goes more with v. With ``k`` only the k neighbours of greatest t stay for each target and
    rival, ties to the smaller word.

    The neighbours of a frequent target are dealt to ``blocks`` blocks, to which its few
    rivals are copied, so no task holds them all; each block keeps its own k first. The
    neighbours are never paired with each other.
    """
    asked = stored(wanted.select("target", "rival").distinct(), "wanted")
    targets = asked.select(F.col("target").alias("__t")).distinct()
    sides = F.array(F.struct(F.col("w1").alias("w"), F.col("w2").alias("v")), F.struct(F.col("w2").alias("w"), F.col("w1").alias("v")))
    # A word next to itself is one neighbour, not two.
    sides = F.when(F.col("w1") == F.col("w2"), F.slice(sides, 1, 1)).otherwise(sides)
    both = bigrams.where(F.col("count") >= min_count).select("count", F.explode(sides).alias("s")).select("s.w", "s.v", "count")
    near = both.join(targets, F.col("w") == F.col("__t"), "left_semi").groupBy("w", "v").agg(F.sum("count").alias("n"))
    near = stored(near.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks))), "neighbours")
    rivals = asked.join(near, (F.col("target") == F.col("w")) & (F.col("rival") == F.col("v"))).select(
        "target", "rival", F.col("n").alias("n_rival"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block")
    )
    met = near.join(rivals, (F.col("w") == F.col("target")) & (F.col("block") == F.col("__block"))).where("v <> rival")
    scored = met.select(
        "target", "rival", "v", "n_rival", F.col("n").alias("n_v"), scores.t_difference(F.col("n"), F.col("n_rival")).alias("t"), "block"
    )
    if k is None:
        return scored.drop("block")
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("t"), "v"))
    first = scored.withColumn("__r", best("target", "rival", "block")).where(F.col("__r") <= k)
    return first.withColumn("__r", best("target", "rival")).where(F.col("__r") <= k).drop("__r", "block")


def likelihood_matrix(items: DataFrame, bigrams: DataFrame, compat: bool = False) -> DataFrame:
    """Log-likelihood ratio per bigram with the probabilities of its parts.

    ``compat`` uses the pair's own probability and the two marginals as the
    hypotheses. Rows without a score are dropped; in log space every score that
    exists is finite.
    """
    items, bigrams = stored(items, "items"), stored(bigrams, "bigrams")
    # The filter below would be repeated, with its formulas, in either part of the lookup.
    counted = stored(with_item_counts(bigrams, items, ("w1", "w2")), "counted")
    counted = _with_totals(counted, items, bigrams)
    n = F.col("__n")
    c1, c2, c12 = F.col("c_w1"), F.col("c_w2"), F.col("count")
    parts = counted.withColumns({"p1": c1 / n, "p2": c2 / n, "p12": c12 / F.col("__m")})
    if compat:
        pooled, after, elsewhere = F.col("p12"), F.col("p1"), F.col("p2")
    else:
        pooled, after, elsewhere = scores.dunning_parameters(c1, c2, c12, n)
    # Named first, so that the formula refers to columns instead of repeating them.
    parts = parts.withColumns({"__p": pooled, "__after": after, "__else": elsewhere})
    p, after, elsewhere = F.col("__p"), F.col("__after"), F.col("__else")
    rest, others = c2 - c12, n - c1
    scored = parts.where(
        scores.is_possible(c12, c1, p)
        & scores.is_possible(rest, others, p)
        & scores.is_possible(c12, c1, after)
        & scores.is_possible(rest, others, elsewhere)
    )
    score = scores.likelihood_ratio(c1, c2, c12, n, p, after, elsewhere)
    return scored.select("w1", "p1", "w2", "p2", "p12", score.alias("llr"))


def pmi_matrix(items: DataFrame, bigrams: DataFrame, compat: bool = False) -> DataFrame:
    """Pointwise mutual information per bigram with its marginals and joint."""
    items, bigrams = stored(items, "items"), stored(bigrams, "bigrams")
    counted = _with_totals(with_item_counts(bigrams, items, ("w1", "w2")), items, bigrams)
    n = F.col("__n")
    p1, p2, p12 = F.col("c_w1") / n, F.col("c_w2") / n, F.col("count") / F.col("__m")
    score = scores.pmi_first_marginal(p1) if compat else scores.pmi(p12, p1, p2)
    return counted.select(
        "w1", p1.alias("p1"), "w2", p2.alias("p2"), p12.alias("p12"), score.alias("pmi")
    )


def mle_matrix(bigrams: DataFrame) -> DataFrame:
    """P(second | first) for first words with more than one continuation."""
    bigrams = stored(bigrams, "bigrams")
    heads = bigrams.groupBy("w1").agg(
        F.sum("count").alias("total"), F.count("*").alias("continuations")
    )
    heads = stored(heads, "heads")
    joined = lookup_join(
        bigrams, heads, "w1", "continuations", {"total": "total", "continuations": "continuations"}
    )
    return joined.where(F.col("continuations") > 1).select(
        "w1", "w2", "count", scores.mle(F.col("count"), F.col("total")).alias("p")
    )


def score_rows(freqs: DataFrame, score: Column, out: str = "score") -> DataFrame:
    """Apply any scoring expression to every row of a frequency table."""
    return freqs.withColumn(out, score)
