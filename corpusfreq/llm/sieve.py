"""Splitting a wide table by a list of keys without moving the rows that are not on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfreq.llm.urls import MAX_BLOCKS, blocked_bloom, bloom_bits


def split(rows: DataFrame, key: Column, listed: DataFrame, listed_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows surely not listed, rows possibly listed with their key as ``__sv_key``).

    The test is a blocked Bloom filter of bounded size. ``listed`` is read for it and
    again by whoever joins the second part, so it should be stored.
    """
    bloom = blocked_bloom(listed.select(F.col(listed_key).alias("k")).where("k IS NOT NULL"), "k", MAX_BLOCKS)
    bloom = bloom.select(F.col("block").alias("__sv_block"), F.col("mask").alias("__sv_mask"))
    h = F.xxhash64("__sv_key")
    met = rows.withColumn("__sv_key", key).join(
        F.broadcast(bloom), F.pmod(h, F.lit(MAX_BLOCKS)) == F.col("__sv_block"), "left"
    )
    maybe = F.coalesce(F.col("__sv_mask").bitwiseAND(bloom_bits(h)) == bloom_bits(h), F.lit(False))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return met.where(~maybe).select(*columns), met.where(maybe).select(*columns, "__sv_key")


def without(rows: DataFrame, key: Column, listed: DataFrame, listed_key: str) -> DataFrame:
    """``rows`` whose key is not listed; null keys stay."""
    clear, maybe = split(rows, key, listed, listed_key)
    keys = listed.select(F.col(listed_key).alias("__sv_listed"))
    kept = maybe.join(keys, F.col("__sv_key") == F.col("__sv_listed"), "left_anti").drop("__sv_key")
    return clear.unionByName(kept)
