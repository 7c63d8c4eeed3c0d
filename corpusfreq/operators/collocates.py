"""Collocates: pairs of tokens within a span, with their signed distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from corpusfreq.functions.arrays import let
from corpusfreq.plans.blocks import BLOCK_ROWS, block_window, owned, with_halo
from corpusfreq.plans.packed import packed_sums


def _distances(before: int, after: int) -> list[int]:
    return [d for d in range(-before, after + 1) if d != 0]


def _distance_array(before: int, after: int) -> Column:
    # A cast to a named array type would make the distances nullable.
    distances = [F.lit(d) for d in _distances(before, after)]
    return F.array(*distances) if distances else F.array().cast("array<int>")


def collocates(
    docs: DataFrame, before: int, after: int, vector: str = "vector", keep: Sequence[str] = ()
) -> DataFrame:
    """``head, pair, dist`` for every neighbour from ``before`` left to ``after`` right.

    For each distance the vector is zipped with itself, shifted; nothing is
    shuffled and pairs never cross documents.
    """
    shifted = docs.select(
        *keep, F.col(vector).alias("__v"), F.explode(_distance_array(before, after)).alias("__d")
    )
    count = F.greatest(F.size("__v") - F.abs("__d"), F.lit(0))
    heads = F.slice("__v", F.greatest(-F.col("__d"), F.lit(0)) + 1, count)
    pairs = F.slice("__v", F.greatest(F.col("__d"), F.lit(0)) + 1, count)
    rows = shifted.select(*keep, F.col("__d"), F.explode_outer(F.arrays_zip(heads, pairs)).alias("__g"))
    return rows.where(F.col("__g").isNotNull()).select(*keep, "__g.*", "__d").toDF(*keep, "head", "pair", "dist")


def collocates_of_rows(
    tokens: DataFrame,
    before: int,
    after: int,
    doc: str = "doc_id",
    ord_col: str = "ord",
    item: str = "norm",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The same on a token table with dense ordinals, for sequences of any length."""
    blocks = with_halo(tokens.select(doc, ord_col, item), ord_col, before, after, block_rows)
    window = block_window(doc, ord_col)
    neighbours = [
        F.struct(F.lead(item, d).over(window).alias("pair"), F.lit(d).alias("dist"))
        for d in _distances(before, after)
    ]
    near = blocks.withColumn("__near", F.array(*neighbours))
    rows = owned(near).select(
        doc, ord_col, F.col(item).alias("head"), F.inline("__near").alias("pair", "dist")
    )
    return rows.where(F.col("pair").isNotNull())


def collocate_pairs(collocates: DataFrame) -> DataFrame:
    """Head and pair without the distance."""
    return collocates.select("head", "pair")


def _around(vector: Column, centers: Column, before: int, after: int) -> Column:
    distances = _distance_array(before, after)

    def one(center: Column) -> Column:
        near = F.transform(
            distances,
            lambda d: F.struct(
                center.cast("int").alias("ord"),
                F.get(vector, center).alias("head"),
                F.get(vector, center + d).alias("pair"),
                d.alias("dist"),
            ),
        )
        return F.filter(near, lambda c: c["head"].isNotNull() & c["pair"].isNotNull())

    return F.flatten(F.transform(centers, one))


def collocates_around(
    docs: DataFrame,
    hits: DataFrame,
    before: int,
    after: int,
    vector: str = "vector",
    doc: str = "doc_id",
    ord_col: str = "ord",
) -> DataFrame:
    """Collocates of the positions in ``hits`` (document, ordinal) only.

    The hits of a document are packed into one row, bounded by the document's
    length, so its vector travels once. Positions outside a document yield none.
    """
    centers = hits.groupBy(F.col(doc).alias("__doc")).agg(F.collect_set(ord_col).alias("__c"))
    found = docs.join(centers, F.col(doc) == F.col("__doc"))
    return found.select(doc, F.inline(_around(F.col(vector), F.col("__c"), before, after)))


def get_collocates(
    docs: DataFrame,
    target: str,
    before: int = 0,
    after: int = 3,
    vector: str = "vector",
    doc: str = "doc_id",
) -> DataFrame:
    """Collocates of every occurrence of a token; row by row, so it runs on streams.

    The vector is read once; take vectors of the target's documents only, as
    ``corpus_vectors`` gives them.
    """

    def build(words: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == F.lit(target)
        )
        return _around(words, places, before, after)

    rows = docs.select(doc, F.inline_outer(let(F.col(vector), build)))
    return rows.where(F.col("ord").isNotNull())


def collocate_stats(collocates: DataFrame, sample_variance: bool = False) -> DataFrame:
    """Count, mean distance and variance per pair.

    Population variance by default; the sample form is NULL for a pair seen once.
    Whole distances are shuffled as their sums, in packed blocks that hold a word once for
    all its pairs. A table whose distances may be missing or are not whole numbers, and a
    stream, take Spark's own averages.
    """
    kinds = {f.name: f for f in collocates.schema.fields}
    whole = isinstance(kinds["dist"].dataType, (ByteType, ShortType, IntegerType)) and not kinds["dist"].nullable
    if whole and kinds["head"].dataType == kinds["pair"].dataType and not collocates.isStreaming:
        distance = F.col("dist").cast("int")
        square = distance.cast("long") * distance
        rows = collocates.select("head", "pair", distance.alias("s"), square.alias("q"))
        return _stats_of_sums(packed_sums(rows, ["head", "pair"], ["s", "q"], "n"), sample_variance)
    variance = F.var_samp if sample_variance else F.var_pop
    distance = F.col("dist").cast("double")
    return collocates.groupBy("head", "pair").agg(
        F.count("*").alias("n"),
        F.avg(distance).alias("mean"),
        variance(distance).alias("variance"),
    )


def _stats_of_sums(sums: DataFrame, sample_variance: bool) -> DataFrame:
    # Distances are taken from the whole part of their mean, in whole numbers: the sum of
    # squares that is left is about as large as the variance, so nothing cancels.
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    near = sums.withColumn("__m", F.expr("s div n")).withColumns(
        {"__r": s - n * F.col("__m"), "__e": q - 2 * F.col("__m") * s + n * F.col("__m") * F.col("__m")}
    )
    rest = F.col("__r").cast("double")
    squares = F.greatest(F.col("__e") - rest * rest / n, F.lit(0.0))
    variance = F.when(n > 1, squares / (n - 1)) if sample_variance else squares / n
    return near.select("head", "pair", "n", (s / n).alias("mean"), variance.alias("variance"))
