"""Vocabularies: a dense integer id for every distinct item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.plans.ranking import dense_index
from corpusfreq.plans.skew import lookup_join


def build_vocab(
    rows: DataFrame, item: str = "norm", order_by: Sequence[str] = ("doc_id", "ord"), start: int = 0
) -> DataFrame:
    """``item, ix, count``: ids in first-seen order and the item's frequency."""
    first = rows.groupBy(F.col(item).alias("item")).agg(
        F.min(F.struct(*order_by)).alias("__first"), F.count("*").alias("count")
    )
    return dense_index(first, ["__first"], out="ix", start=start).select("item", "ix", "count")


def extend_vocab(
    vocab: DataFrame,
    rows: DataFrame,
    item: str = "norm",
    order_by: Sequence[str] = ("doc_id", "ord"),
) -> DataFrame:
    """Existing ids stay; unseen items follow in first-seen order."""
    seen = rows.groupBy(F.col(item).alias("item")).agg(
        F.min(F.struct(*order_by)).alias("__first"), F.count("*").alias("count")
    )
    known = vocab.select(F.col("item").alias("__item"))
    fresh = seen.join(known, F.col("item") == F.col("__item"), "left_anti")
    size = vocab.agg(F.coalesce(F.max("ix") + 1, F.lit(0))).scalar()
    added = dense_index(fresh, ["__first"], out="__rank").select(
        "item", (F.col("__rank") + size).alias("ix"), "count"
    )
    return vocab.select("item", "ix", "count").unionByName(added)


def lookup_items(query: DataFrame, vocab: DataFrame, item: str = "norm") -> DataFrame:
    """Item to id; NULL for unknown items."""
    return lookup_join(query, vocab, {item: "item"}, None, {"ix": "ix"})


def lookup_ids(query: DataFrame, vocab: DataFrame, ix: str = "ix") -> DataFrame:
    """Id to item; NULL for unknown ids."""
    return lookup_join(query, vocab, {ix: "ix"}, None, {"item": "item"})


def known_items(query: DataFrame, vocab: DataFrame, item: str = "norm") -> DataFrame:
    """Only the rows whose item is in the vocabulary."""
    found = lookup_join(query, vocab, {item: "item"}, None, {"__ix": "ix"})
    return found.where(F.col("__ix").isNotNull()).select(*query.columns)


def vocab_size(vocab: DataFrame) -> DataFrame:
    """Size and emptiness as one row."""
    return vocab.agg(F.count("*").alias("size")).withColumn("is_empty", F.col("size") == 0)


def encode_corpus(tokens: DataFrame, vocab: DataFrame, norm: str = "norm") -> DataFrame:
    """Replace every token by its id; frequent tokens meet a bounded broadcast."""
    return lookup_join(tokens, vocab, {norm: "item"}, "count", {"ix": "ix"}).drop(norm)
