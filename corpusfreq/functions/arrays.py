"""Small array helpers built from higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this length a plain fold is cheaper than scanning in blocks.
SHORT_SCAN = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold_scan(values: Column) -> Column:
    empty = F.array().cast("array<int>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
    return F.aggregate(values, empty, lambda acc, x: F.array_append(acc, x + last(acc)))


def _block_scan(values: Column, step: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(values) - 1, step)
    blocks = F.transform(starts, lambda s: _fold_scan(F.slice(values, s + 1, step)))

    def stitch(done: Column) -> Column:
        ends = _fold_scan(F.transform(done, lambda b: F.element_at(b, -1)))
        shift = lambda b, e: let(
            e - F.element_at(b, -1), lambda off: F.transform(b, lambda x: x + off)
        )
        return F.flatten(F.zip_with(done, ends, shift))

    return let(blocks, stitch)


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an int array.

    A fold copies its result at every step, so long arrays are scanned in blocks
    of about the square root of their length.
    """
    return let(
        values,
        lambda xs: F.when(F.size(xs) <= SHORT_SCAN, _fold_scan(xs)).otherwise(
            let(F.ceil(F.sqrt(F.size(xs))).cast("int"), lambda step: _block_scan(xs, step))
        ),
    )
