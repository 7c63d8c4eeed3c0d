"""N-grams as columns ``w1 … wn`` and n-gram models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusfreq.plans.blocks import BLOCK_ROWS, block_window, leads, owned, with_halo
from corpusfreq.plans.packed import packed_ngrams, packed_sums
from corpusfreq.plans.skew import Lookup, lookup_joins
from corpusfreq.session import stored


def word_columns(n: int) -> list[str]:
    return [f"w{k + 1}" for k in range(n)]


def ngram_array(vector: Column, n: int, drop_last: bool = False) -> Column:
    """All runs of n neighbours as an array of structs, by zipping shifted slices."""
    count = F.greatest(F.size(vector) - F.lit(n if drop_last else n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(vector, k + 1, count) for k in range(n)])


def ngrams(
    docs: DataFrame,
    n: int,
    vector: str = "vector",
    drop_last: bool = False,
    keep: Sequence[str] = (),
    with_ord: bool = False,
) -> DataFrame:
    """N-grams of token vectors; never across documents, no shuffle.

    ``drop_last`` leaves out the final n-gram of every document. A document
    shorter than n, or n < 1, yields nothing.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    grams = ngram_array(F.col(vector), n, drop_last)
    if with_ord:
        rows = docs.select(*keep, F.posexplode(grams).alias("ord", "__g"))
        return rows.select(*keep, "ord", "__g.*").toDF(*keep, "ord", *word_columns(n))
    rows = docs.select(*keep, F.explode_outer(grams).alias("__g")).where(F.col("__g").isNotNull())
    return rows.select(*keep, "__g.*").toDF(*keep, *word_columns(n))


def ngrams_of_rows(
    tokens: DataFrame,
    n: int,
    doc: str = "doc_id",
    ord_col: str = "ord",
    item: str = "norm",
    drop_last: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """N-grams of a token table with dense ordinals, for sequences of any length."""
    reach = n if drop_last else n - 1
    blocks = with_halo(tokens.select(doc, ord_col, item), ord_col, 0, reach, block_rows)
    window = block_window(doc, ord_col)
    beyond = F.lead(item, reach).over(window).alias("__last")
    grams = blocks.select(doc, ord_col, "__block", "__own", *leads(item, n, window), beyond)
    return owned(grams.where(F.col("__last").isNotNull())).drop("__last")


def ngram_freqs(
    docs: DataFrame, n: int, vector: str = "vector", drop_last: bool = False
) -> DataFrame:
    """``w1 … wn, count``; shuffled as blocks, in which a word is written once."""
    kind = docs.schema[vector].dataType
    if n >= 1 and not docs.isStreaming and isinstance(kind, ArrayType) and kind.elementType == StringType():
        return packed_ngrams(docs, vector, word_columns(n), drop_last)
    return ngrams(docs, n, vector, drop_last).groupBy(*word_columns(n)).agg(F.count("*").alias("count"))


def ngram_models(
    docs: DataFrame, vector: str = "vector", full_counts: bool = False, store: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unigram, bigram and trigram counts.

    Only positions with two successors count; ``full_counts`` counts every unigram and
    bigram. ``store`` writes the tables to the shared folder, so that models used more than
    once do not read the corpus again: but for full counts all three follow from the
    trigrams. Without it each model is counted from the vectors alone, so that no trigrams are
    shuffled for the others.
    """
    tri = ngram_freqs(docs, 3, vector)
    if store:
        tri = stored(tri, "trigrams")
    if full_counts:
        uni, bi = ngram_freqs(docs, 1, vector), ngram_freqs(docs, 2, vector)
    elif store:
        uni = tri.groupBy("w1").agg(F.sum("count").alias("count"))
        bi = packed_sums(tri, ["w1", "w2"], ["count"])
    else:
        followed = F.slice(F.col(vector), 1, F.greatest(F.size(vector) - 2, F.lit(0)))
        uni = docs.select(F.explode(followed).alias("w1")).groupBy("w1").agg(F.count("*").alias("count"))
        bi = ngram_freqs(docs, 2, vector, drop_last=True)
    if store:
        uni, bi = stored(uni, "unigrams"), stored(bi, "bigrams")
    return (
        uni.select(F.col("w1").alias("item"), "count"),
        bi.select(F.col("w1").alias("cond"), F.col("w2").alias("item"), "count"),
        tri.select(F.struct("w1", "w2").alias("cond"), F.col("w3").alias("item"), "count"),
    )


def _asked_counts(query: DataFrame, table: DataFrame, keys: dict[str, str], name: str) -> DataFrame:
    """``__k0 …, name``: the counts in ``table`` of the query's keys (query column to table column).

    The query's keys are added up with the table's, in packed blocks: a join would shuffle
    every row of the table, as whole strings.
    """
    columns = [f"__k{i}" for i in range(len(keys))]
    have = table.select(*[F.col(c).alias(k) for k, c in zip(columns, keys.values())], F.col("count").cast("long").alias(name), F.lit(0).alias("__asked"))
    ask = query.select(*[F.col(q).alias(k) for k, q in zip(columns, keys)], F.lit(0).cast("long").alias(name), F.lit(1).alias("__asked"))
    # A null equals nothing.
    both = have.unionByName(ask).dropna(subset=columns)
    return packed_sums(both, columns, [name, "__asked"], name).where((F.col("__asked") > 0) & (F.col(name) > 0)).drop("__asked")


def interpolate(
    query: DataFrame,
    models: tuple[DataFrame, DataFrame, DataFrame],
    weights: tuple[float, float, float],
    out: str = "p",
    store: bool = True,
) -> DataFrame:
    """Linear interpolation for rows ``w1, w2, w3``; unseen events add 0.

    Each model is read for its own counts and for the totals of the next one, so it is
    written first; ``store=False`` if the models lie in files already.
    """
    uni, bi, tri = models
    if store:
        uni, bi, tri = (stored(m, name) for m, name in zip(models, ("unigrams", "bigrams", "trigrams"), strict=True))
    l1, l2, l3 = weights
    tri = tri.select(
        F.col("cond.w1").alias("a"), F.col("cond.w2").alias("b"), F.col("item").alias("c"), "count"
    )
    after_one = bi.groupBy("cond").agg(F.sum("count").alias("count"))
    # Counts and their totals are looked up for the query's keys only, so no
    # probability is computed for an event that nobody asks for. Pairs and triples
    # are many and small: plain joins. Single words are few and frequent. The totals
    # after a pair are the trigrams added up by their first two words.
    query = stored(query, "query")
    scored = query
    for keys, table, name in (
        ({"w1": "a", "w2": "b", "w3": "c"}, tri, "__c3"),
        ({"w1": "a", "w2": "b"}, tri, "__n3"),
        ({"w2": "cond", "w3": "item"}, bi, "__c2"),
    ):
        condition = [F.col(q) == F.col(f"__k{i}") for i, q in enumerate(keys)]
        found = _asked_counts(query, table, keys, name)
        scored = scored.join(found, condition, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    # Either part of the lookups below would repeat the joins above.
    scored = stored(scored, "counted")
    words = [
        Lookup(after_one, {"w2": "cond"}, "count", {"__n2": "count"}),
        Lookup(uni, {"w3": "item"}, "count", {"__c1": "count"}),
    ]
    scored = lookup_joins(scored, words)
    scored = scored.withColumn("__n1", uni.agg(F.sum("count")).scalar())
    part = lambda weight, k: F.lit(weight) * F.coalesce(
        F.try_divide(f"__c{k}", f"__n{k}"), F.lit(0.0)
    )
    return scored.select(*query.columns, (part(l1, 1) + part(l2, 2) + part(l3, 3)).alias(out))
