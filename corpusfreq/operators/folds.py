"""Random order and cross-validation folds, repeatable and free of a global sort
in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfreq.plans.ranking import dense_index

FOLDS = 10


def shuffle_key(doc: str = "doc_id", seed: int = 0) -> Column:
    """A pseudo-random sort key that depends on the seed and the id only."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(doc).cast("string")))


def shuffled(docs: DataFrame, doc: str = "doc_id", seed: int = 0, out: str = "place") -> DataFrame:
    """Number the documents in a random order, every permutation being possible.

    All columns travel and are stored: pass the ids alone and join the places back.
    """
    keyed = docs.withColumn("__key", shuffle_key(doc, seed))
    return dense_index(keyed, ["__key", doc], out=out).drop("__key")


def split_folds(
    docs: DataFrame, k: int = FOLDS, place: str = "place", out: str = "fold"
) -> DataFrame:
    """k contiguous chunks of the order, the first ``n mod k`` of them one larger."""
    docs = docs.withColumn("__n", docs.agg(F.count("*")).scalar())
    n = F.col("__n")
    size, larger = F.floor(n / k), F.pmod(n, F.lit(k))
    border = larger * (size + 1)
    i = F.col(place)
    fold = F.when(i < border, F.floor(i / (size + 1))).otherwise(
        larger + F.floor((i - border) / F.greatest(size, F.lit(1)))
    )
    return docs.withColumn(out, fold.cast("int")).drop("__n")


def hash_folds(
    docs: DataFrame, k: int = FOLDS, doc: str = "doc_id", seed: int = 0, out: str = "fold"
) -> DataFrame:
    """Folds of nearly equal size from a hash of the id: no sort, no shuffle."""
    digest = F.conv(F.left(shuffle_key(doc, seed), F.lit(8)), 16, 10).cast("long")
    return docs.withColumn(out, F.pmod(digest, F.lit(k)).cast("int"))


def leave_one_out(rows: DataFrame, counted: DataFrame, fold: str = "fold") -> DataFrame:
    """Training counts for every fold at once: the total minus the fold's own counts.

    ``counted`` has the fold, key columns and ``count``. ``rows`` lists the
    (fold, key…) combinations wanted, so no fold's complement is copied.
    """
    keys = [c for c in counted.columns if c not in (fold, "count")]
    totals = counted.groupBy(*keys).agg(F.sum("count").alias("__all"))
    own = counted.withColumnRenamed("count", "__own")
    joined = rows.join(totals, keys, "left").join(own, [fold, *keys], "left")
    held_in = F.coalesce("__all", F.lit(0)) - F.coalesce("__own", F.lit(0))
    return joined.select(*rows.columns, held_in.alias("count"))
