"""Joins that stay balanced when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it carries at least a 1/share part of the total weight, so there
# can never be more than ``share`` hot keys, whatever the size of the data. The share
# follows the shuffle partitions: a key that is not hot holds a quarter of an average
# partition at most.
LEAST_SHARE = 100_000
SHARES_PER_PARTITION = 4

# What a key that is not hot finds.
COLD = "__cold"


def default_share(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_SHARE, SHARES_PER_PARTITION * partitions)


@dataclass(frozen=True)
class Lookup:
    """``values`` of ``table`` (one row per key) for the rows' key columns.

    ``on`` maps row columns to table columns (a plain name means the same on
    both sides); ``values`` maps output names to table columns. ``weight`` names a
    column of ``table`` that bounds, up to a constant factor, how many rows carry the
    key; a frequency table's own count is such a bound. With None the keys of the
    rows are counted first, which is exact for any input and costs one more pass over
    them (over ``counted``, if given: a table with the same keys that is cheaper to read).
    """

    table: DataFrame
    on: str | Sequence[str] | dict[str, str]
    weight: str | None
    values: dict[str, str]
    counted: DataFrame | None = None


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: str | Sequence[str] | dict[str, str],
    weight: str | None,
    values: dict[str, str],
    hot_share: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Left-join one lookup onto ``rows``, see ``lookup_joins``."""
    return lookup_joins(rows, [Lookup(table, on, weight, values, counted)], hot_share)


def lookup_joins(rows: DataFrame, lookups: Sequence[Lookup], hot_share: int | None = None) -> DataFrame:
    """Left-join the values of every lookup onto ``rows``.

    Keys holding at least ``1/hot_share`` of the total weight are at most
    ``hot_share`` many and are broadcast at any scale. Rows that these and missing
    keys answer completely are finished there and never shuffled. The others are parted
    by the lookups that are still open, and a part takes an ordinary join for each of
    those and for no other; all keys in it are small. Every part reads ``rows`` again,
    two to the power of the lookups in all: store a table that is costly to make.
    """
    share = default_share(rows) if hot_share is None else hot_share
    hits, colds, marked = [], [], rows
    for j, lookup in enumerate(lookups):
        keys, hot, cold = _split(rows, lookup, share, j)
        condition = _all(F.col(r) == F.col(t) for r, t in keys.items())
        marked = marked.join(F.broadcast(hot), condition, "left").drop(*keys.values())
        colds.append((keys, cold))
        hits.append(f"__hit{j}")
    served = [
        F.col(hit).isNotNull() | _any(F.col(r).isNull() for r in keys) for hit, (keys, _) in zip(hits, colds)
    ]
    new = [(dst, f"__hit{j}") for j, lookup in enumerate(lookups) for dst in lookup.values]
    kept = [c for c in rows.columns if c not in dict(new)]
    parts = []
    for asks in product((False, True), repeat=len(lookups)):
        part = marked.where(_all(~s if ask else s for s, ask in zip(served, asks)))
        for hit, (keys, cold), ask in zip(hits, colds, asks):
            if ask:
                condition = _all(F.col(r) == F.col(t) for r, t in keys.items())
                part = part.drop(hit).join(cold.withColumnRenamed(COLD, hit), condition, "left").drop(*keys.values())
        parts.append(part.select(*kept, *hits))
    every = reduce(DataFrame.unionByName, parts)
    return every.select(*kept, *[F.col(hit)[dst].alias(dst) for dst, hit in new])


def _split(rows: DataFrame, lookup: Lookup, share: int, j: int) -> tuple[dict[str, str], DataFrame, DataFrame]:
    """Row key to table key columns, the hot part of the table, and the cold one."""
    table, keys, values, weight = lookup.table, _key_map(lookup.on), lookup.values, lookup.weight
    if weight is None:
        table = _with_row_counts(rows if lookup.counted is None else lookup.counted, table, keys, values)
        keys, values, weight = {r: r for r in keys}, {dst: dst for dst in values}, "__rows"
    renamed = {r: f"__t{j}_{i}" for i, r in enumerate(keys)}
    payload = F.struct(*[F.col(src).alias(dst) for dst, src in values.items()])
    keyed = table.select(*[F.col(t).alias(renamed[r]) for r, t in keys.items()], payload.alias("__p"), F.col(weight).alias("__w"))
    total = keyed.agg(F.sum("__w")).scalar()
    is_hot = F.coalesce(F.col("__w") * F.lit(share) >= total, F.lit(False))
    hot = keyed.where(is_hot).drop("__w").withColumnRenamed("__p", f"__hit{j}")
    cold = keyed.where(~is_hot).drop("__w").withColumnRenamed("__p", COLD)
    return renamed, hot, cold


def _with_row_counts(
    rows: DataFrame, table: DataFrame, keys: dict[str, str], values: dict[str, str]
) -> DataFrame:
    """The keys occurring in ``rows`` with their row counts and their table values."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__rows"))
    right = table.select(
        *[F.col(t).alias(f"__q{i}") for i, t in enumerate(keys.values())],
        *[F.col(src).alias(f"__v{i}") for i, src in enumerate(values.values())],
    )
    condition = _all(F.col(r) == F.col(f"__q{i}") for i, r in enumerate(keys))
    return counts.join(right, condition, "left").select(
        *keys, "__rows", *[F.col(f"__v{i}").alias(dst) for i, dst in enumerate(values)]
    )


def _key_map(on: str | Sequence[str] | dict[str, str]) -> dict[str, str]:
    if isinstance(on, str):
        return {on: on}
    if isinstance(on, dict):
        return dict(on)
    return {c: c for c in on}


def _all(conditions) -> Column:
    conditions = list(conditions)
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions) -> Column:
    conditions = list(conditions)
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
