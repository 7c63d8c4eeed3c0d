"""Context windows: by number of items and by total measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfreq.functions.arrays import let, running_sums
from corpusfreq.plans.blocks import BLOCK_ROWS, block_window, owned, with_halo


def context_windows(
    docs: DataFrame, before: int, after: int, vector: str = "vector", keep: Sequence[str] = ()
) -> DataFrame:
    """Every item with up to ``before`` items to its left and ``after`` to its right."""
    words = F.col(vector)
    windows = F.transform(
        words,
        lambda w, i: F.struct(
            i.alias("ord"),
            F.slice(words, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before))).alias(
                "before"
            ),
            w.alias("view"),
            F.slice(words, i + 2, F.lit(after)).alias("after"),
        ),
    )
    return docs.select(*keep, F.inline(windows))


def context_windows_of_rows(
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
    near = lambda a, b: F.collect_list(item).over(window.rowsBetween(a, b))
    nothing = F.array().cast("array<string>")
    framed = blocks.select(
        doc,
        ord_col,
        "__block",
        "__own",
        (near(-before, -1) if before else nothing).alias("before"),
        F.col(item).alias("view"),
        (near(1, after) if after else nothing).alias("after"),
    )
    return owned(framed)


def reach_back(sums: Column, last: Column, size: int, most: int) -> Column:
    """How many items ending at index ``last`` fit: those after them measure at most
    ``size``, so the first one may overshoot."""
    low = F.greatest(last - most + 1, F.lit(0))
    end = F.get(sums, last)
    return F.size(
        F.filter(F.slice(sums, low + 1, last - low + 1), lambda c: end - c <= F.lit(size))
    )


def measured_contexts(
    docs: DataFrame,
    size: int,
    vector: str = "vector",
    keep: Sequence[str] = (),
    trim_after: bool = False,
) -> DataFrame:
    """For every item the most recent items up to it whose measure fits ``size``.

    An item measures its length plus one, and one overshooting item is kept. The
    limit is applied before the item is pushed, or after it with ``trim_after``.
    """
    words = F.col(vector)

    def contexts(sums: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            if trim_after:
                held = reach_back(sums, i, size, size + 2)
            else:
                held = 1 + F.when(i == 0, 0).otherwise(reach_back(sums, i - 1, size, size + 2))
            # Named first: the slice takes it twice.
            return let(
                held,
                lambda h: F.struct(i.alias("ord"), F.slice(words, i + 2 - h, h).alias("context")),
            )

        return F.transform(words, one)

    sums = running_sums(F.transform(words, lambda w: F.length(w) + 1))
    return docs.select(*keep, F.inline(let(sums, contexts)))


def measured_contexts_of_rows(
    tokens: DataFrame,
    size: int,
    doc: str = "doc_id",
    ord_col: str = "ord",
    item: str = "norm",
    trim_after: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The same on a token table with dense ordinals, for sequences of any length.

    Inside a block the measures are summed up, and the items that fit stand in a range of
    these sums. An item measures at least one, so a context never reaches farther back than
    ``size + 1`` items, which is the halo of a block.
    """
    if size < 0:
        raise ValueError("size must not be negative")
    blocks = with_halo(tokens.select(doc, ord_col, item), ord_col, size + 2, 0, block_rows)
    window = block_window(doc, ord_col)
    measure = F.coalesce(F.length(item), F.lit(0)) + 1
    summed = blocks.withColumn("__c", F.sum(measure).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    near = Window.partitionBy(doc, "__block").orderBy("__c").rangeBetween(-size, 0)
    held = summed.withColumn("context", F.collect_list(item).over(near))
    if not trim_after:
        earlier = F.coalesce(F.lag("context").over(window), F.array().cast("array<string>"))
        held = held.withColumn("context", F.concat(earlier, F.array(F.col(item))))
    return owned(held.select(doc, ord_col, "context", "__block", "__own"))
