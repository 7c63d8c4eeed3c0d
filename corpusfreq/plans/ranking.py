"""Global ranks and running totals without a single-partition window.

Rows are range-partitioned on the sort key, sorted inside each partition and
materialised; the per-partition totals (one row per shuffle partition, so a
bounded table) then give every partition its starting offset.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusfreq.plans.skew import lookup_join
from corpusfreq.session import durable, stored

# monotonically_increasing_id keeps the partition number above bit 33.
PARTITION_SHIFT = 33
ROW_MASK = (1 << PARTITION_SHIFT) - 1


def _placed(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *order_by).sortWithinPartitions(*order_by)
    # Materialised so that both uses below see one and the same placement.
    return durable(ranged.withColumn("__mid", F.monotonically_increasing_id()))


def _partition(mid: str = "__mid") -> Column:
    return F.shiftright(mid, PARTITION_SHIFT)


def dense_index(
    df: DataFrame, order_by: Sequence[str | Column], out: str = "ix", start: int = 0
) -> DataFrame:
    """Number the rows ``start, start+1, …`` in the order of ``order_by``.

    The sort key should be unique, otherwise ties are numbered arbitrarily.
    """
    placed = _placed(df, order_by)
    sizes = placed.groupBy(_partition().alias("__pid")).agg(F.count("*").alias("__n"))
    offsets = sizes.select(
        "__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off")
    )
    ix = F.col("__off") + F.col("__mid").bitwiseAND(F.lit(ROW_MASK)) + F.lit(start)
    return placed.join(F.broadcast(offsets), _partition() == F.col("__pid")).select(
        *df.columns, ix.alias(out)
    )


def running_total(
    df: DataFrame, order_by: Sequence[str | Column], value: str, out: str
) -> DataFrame:
    """Inclusive running sum of ``value`` over the whole table in sort order; null adds nothing.

    The sums inside a sorted partition are formed as it is written, since a window would
    shuffle all rows once more; what is left is one offset for each partition.
    """
    kind = "bigint" if isinstance(df.schema[value].dataType, IntegralType) else "double"
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__local", F.coalesce(F.col(value).cast(kind), F.lit(0).cast(kind)))
    ranged = rows.repartitionByRange(partitions, *order_by).sortWithinPartitions(*order_by)
    # Only the values go to the worker; the other columns wait beside it.
    sums_of = F.arrow_udf(running_sums(), kind)
    local = ranged.withColumn("__local", sums_of("__local")).withColumn("__pid", F.spark_partition_id())
    placed = stored(local, "running")
    # The last sum of a partition is its total, whatever the signs of its values.
    sums = placed.groupBy("__pid").agg(F.sum(F.col(value).cast(kind)).alias("__s"))
    offsets = sums.select(
        F.col("__pid").alias("__opid"),
        F.coalesce(F.sum("__s").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(kind)).alias("__off"),
    )
    return placed.join(F.broadcast(offsets), F.col("__pid") == F.col("__opid")).select(
        *df.columns, (F.col("__off") + F.col("__local")).alias(out)
    )


def running_sums() -> Callable[[Iterator], Iterator]:
    """A function from a partition's values, array by array, to their running sums.

    Made here and not defined by the module, so that it travels to the workers by value:
    they need not have this package.
    """

    import pyarrow

    def run(arrays):
        import pyarrow as pa
        import pyarrow.compute as pc

        before = 0
        for values in arrays:
            sums = pc.add(pc.cumulative_sum(values), pa.scalar(before, values.type))
            if len(sums):
                before = sums[len(sums) - 1].as_py()
            yield sums

    run.__annotations__ = {"arrays": Iterator[pyarrow.Array], "return": Iterator[pyarrow.Array]}
    return run


def ordinal_within(
    df: DataFrame, group: str, order_by: Sequence[str], out: str = "ord"
) -> DataFrame:
    """0-based position of each row inside its group, for groups of any size.

    A group may span many range partitions: its rows are consecutive in the
    global index, so the position is the index minus the group's smallest one.
    """
    indexed = dense_index(df, [group, *order_by], out="__ix")
    starts = indexed.groupBy(group).agg(F.min("__ix").alias("__first"), F.count("*").alias("__n"))
    placed = lookup_join(indexed, starts, group, "__n", {"__start": "__first"})
    return placed.select(*df.columns, (F.col("__ix") - F.col("__start")).alias(out))
