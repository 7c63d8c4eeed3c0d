"""Inverted indexes.

An index is a long table with one row per posting. The nested form groups the
postings per token and document, or in blocks of bounded length, because the list
of one frequent token could be as large as the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from corpusfreq.functions.arrays import let
from corpusfreq.functions.text import line_tokens
from corpusfreq.operators.membership import write_types
from corpusfreq.operators.tokens import tokenizer
from corpusfreq.plans.ranking import dense_index
from corpusfreq.plans.skew import lookup_join
from corpusfreq.session import stored

BLOCK_POSTINGS = 4096


def inverse_index(df: DataFrame, key: Column, pos: Column) -> DataFrame:
    """Long index of any table: key and position are expressions."""
    return df.select(key.alias("key"), pos.alias("pos"))


def posting_blocks(
    index: DataFrame, key: str = "key", pos: str = "pos", block_postings: int = BLOCK_POSTINGS, by_rank: bool = True
) -> DataFrame:
    """Nested form: sorted posting lists cut into blocks of bounded length.

    Blocks follow the global (key, position) order, so the lists of a key,
    concatenated by block number, are that key's sorted postings.

    By default a block's number is its postings' global rank divided by ``block_postings``,
    for which every posting is ranked and stored and then grouped. With ``by_rank=False`` the
    sorted postings are cut where they lie, from the first posting of a key in a partition on:
    they are shuffled once, and the numbers only follow the order.
    """
    if not by_rank:
        return _blocks_in_place(index.select(key, pos), key, pos, block_postings)
    placed = dense_index(index.select(key, pos), [key, pos], out="__ix")
    block = F.floor(F.col("__ix") / F.lit(block_postings)).alias("block")
    return placed.groupBy(key, block).agg(F.array_sort(F.collect_list(pos)).alias("positions"))


def _blocks_in_place(rows: DataFrame, key: str, pos: str, block_postings: int) -> DataFrame:
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A list holds no null positions, here as in collect_list.
    ordered = rows.where(F.col(pos).isNotNull()).repartitionByRange(partitions, key, pos).sortWithinPartitions(key, pos)
    fields = ordered.schema
    nested = StructType([
        StructField(key, fields[key].dataType), StructField("positions", ArrayType(fields[pos].dataType, False)),
    ])
    cut = ordered.mapInArrow(block_cutter(block_postings), nested)
    # Partitions follow the order, and so do the ids that Spark gives the rows of each.
    return cut.select(key, F.monotonically_increasing_id().alias("block"), "positions")


def block_cutter(block_postings: int) -> Callable[[Iterator], Iterator]:
    """A function from a partition's sorted (key, position) batches to (key, positions) rows.

    Made here and not defined by the module, so that it travels to the workers by value:
    they need not have this package.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def changes(keys):
            """Where a key differs from the one before it; two nulls, and two NaN, are one key."""
            a, b = keys.slice(0, len(keys) - 1), keys.slice(1)
            if pa.types.is_nested(keys.type):
                return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
            other = pc.fill_null(pc.not_equal(a, b), False)
            if pa.types.is_floating(keys.type):
                other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
            return pc.or_(other, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)

        def lists(keys, positions, edges):
            values = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), positions.slice(0, edges[-1]))
            return pa.RecordBatch.from_arrays([keys.take(pa.array(edges[:-1])), values], names)

        keys = positions = names = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.schema.names[0], "positions"]
            # What is left of the last batch is the beginning of one block.
            keys = batch.column(0) if keys is None else pa.concat_arrays([keys, batch.column(0)])
            positions = batch.column(1) if positions is None else pa.concat_arrays([positions, batch.column(1)])
            at = np.arange(len(keys))
            opens = np.concatenate([[True], changes(keys)])
            inside = at - np.maximum.accumulate(np.where(opens, at, 0))
            edges = np.flatnonzero(inside % block_postings == 0)
            if len(edges) > 1:
                yield lists(keys, positions, edges)
                keys, positions = keys.slice(edges[-1]), positions.slice(edges[-1])
        if keys is not None:
            yield lists(keys, positions, np.array([0, len(keys)]))

    return run


def index_documents(docs: DataFrame, doc: str = "doc_id", **options) -> DataFrame:
    """Long index of a corpus: norm, document, line, start, end."""
    return tokenizer(docs, doc=doc, **options).select("norm", doc, "ord", "line", "start", "end")


def document_postings(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", stop: Sequence[str] | None = None
) -> DataFrame:
    """Sorted postings per token and document; a list is bounded by its document.

    A document's tokens are sorted by norm and place and cut where the norm changes,
    all inside its row: nothing is shuffled.
    """
    tokens = line_tokens(F.col(text), lower=True, stop=stop)

    def cut(ordered: Column) -> Column:
        norm = lambda i: F.get(ordered, i)["norm"]
        opens = lambda i: (i == 0) | (norm(i) != norm(i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), opens)

        def runs(begin: Column) -> Column:
            stops = F.concat(F.slice(begin, 2, F.size(begin)), F.array(F.size(ordered)))
            place = lambda t: F.struct(
                t["line"].alias("line"), t["start"].alias("start"), t["end"].alias("end")
            )
            return F.zip_with(
                begin,
                stops,
                lambda a, b: F.struct(
                    norm(a).alias("norm"), F.transform(F.slice(ordered, a + 1, b - a), place).alias("postings")
                ),
            )

        return let(starts, runs)

    # sort_array compares whole structs; array_sort would evaluate an expression for each pair.
    nested = F.when(F.size(tokens) > 0, let(F.sort_array(tokens), cut))
    rows = docs.select(doc, F.inline_outer(nested))
    return rows.where(F.col("norm").isNotNull()).select("norm", doc, "postings")


def map_postings(index: DataFrame, **columns: Column) -> DataFrame:
    """Apply expressions to the position columns of an index."""
    return index.withColumns(columns)


def merge_indexes(*indexes: DataFrame) -> DataFrame:
    """Union of indexes, concatenating the postings of equal tokens."""
    out = indexes[0]
    for other in indexes[1:]:
        out = out.unionByName(other)
    return out


def merge_posting_blocks(*indexes: DataFrame, key: str = "key", positions: str = "positions") -> DataFrame:
    """Merge block indexes as ``posting_blocks`` makes them: ``key, block, positions``.

    Only the heads of the blocks (their lengths, first and last positions) are put in order
    by key. Where the positions of a key in one index all lie before those in the next, its
    blocks stay as they are and only get new numbers; these come from one row for each key
    and index, which is broadcast for frequent keys, so that their postings are not shuffled.
    Keys with a single block need none. Keys whose indexes overlap are cut at the first
    positions of their blocks.

    Blocks are numbered from 0 within their key and hold at most one block's postings of
    every index, and more only where a position is repeated through whole blocks. ``start``
    is the number of the key's postings before the block.
    """
    if any(not {key, "block", positions} <= set(index.columns) for index in indexes):
        raise ValueError(f"an index lacks one of the columns {key}, block, {positions}")
    blocks = [
        index.select(F.col(key), F.lit(i).alias("__src"), F.col("block").cast("long").alias("__block"), F.col(positions))
        for i, index in enumerate(indexes)
    ]
    every = blocks[0]
    for more in blocks[1:]:
        every = every.unionByName(more)
    every = every.where(F.col(key).isNotNull() & (F.size(positions) > 0))
    first, last = F.get(F.col(positions), F.lit(0)), F.get(F.col(positions), F.size(positions) - 1)
    heads = stored(
        every.select(key, "__src", "__block", F.size(positions).cast("long").alias("__n"), first.alias("__lo"), last.alias("__hi")),
        "heads",
    )
    runs = stored(_runs(heads, key), "runs")
    placed = lookup_join(every, runs, [key, "__src"], "__total", {"__runs": "__runs", "__full": "__full"})
    run = F.try_element_at(F.filter("__runs", lambda r: r["block"] <= F.col("__block")), F.lit(-1))
    since = F.col("__block") - F.col("__run.block")
    # A key that the table leaves out has this block only.
    overlaps = F.col("__full").isNotNull() & F.col("__runs").isNull()
    kept = placed.where(~overlaps).withColumn("__run", run).select(
        key,
        F.coalesce(F.col("__run.nth") + since, F.lit(0)).alias("block"),
        F.coalesce(F.col("__run.start") + since * F.col("__full"), F.lit(0)).alias("start"),
        positions,
    )
    overlapping = runs.where(F.col("__runs").isNull())
    if overlapping.isEmpty():
        return kept
    fewer = heads.join(overlapping.select(key, "__src"), [key, "__src"], "left_semi")
    open_blocks = placed.where(overlaps).select(key, "__src", "__block", positions)
    return kept.unionByName(_cut_at_fences(open_blocks, fewer, key, positions, len(indexes)))


def _runs(heads: DataFrame, key: str) -> DataFrame:
    """One row for each index of a key with more than one block: the ``__runs`` of its blocks
    and their ``__full`` length.

    In a run the numbers are consecutive and all blocks but the last are full, so the place
    of a block follows from the run's beginning. The runs of a key's later indexes count
    on from the earlier ones; they are null where the positions of two indexes overlap.
    """
    parts = Window.partitionBy(key, "__src")
    order = parts.orderBy("__block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = heads.repartition(key).select(
        "*",
        (F.row_number().over(order) - 1).cast("long").alias("__nth"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        F.lag("__block").over(order).alias("__prior"), F.lag("__n").over(order).alias("__length"),
        F.max("__n").over(parts).alias("__full"),
    )
    goes_on = (F.col("__prior") + 1 == F.col("__block")) & (F.col("__length") == F.col("__full"))
    begins = F.struct(F.col("__block").alias("block"), F.col("__nth").alias("nth"), F.col("__start").alias("start"))
    spans = numbered.groupBy(key, "__src").agg(
        F.min("__lo").alias("lo"), F.max("__hi").alias("hi"), F.count("*").alias("blocks"), F.sum("__n").alias("total"),
        F.max("__full").alias("full"), F.sort_array(F.collect_list(F.when(~F.coalesce(goes_on, F.lit(False)), begins))).alias("runs"),
    )
    span = F.struct("lo", "hi", F.col("__src").alias("src"), "blocks", "total", "full", "runs")
    keyed = spans.groupBy(key).agg(F.sort_array(F.collect_list(span)).alias("__spans"))
    at = lambda i: F.get("__spans", i)
    many = F.size("__spans") > 1
    follows = F.forall(F.sequence(F.lit(1), F.size("__spans") - 1), lambda i: at(i)["lo"] >= at(i - 1)["hi"])
    earlier = lambda i, name: F.aggregate(F.slice("__spans", 1, i), F.lit(0).cast("long"), lambda n, s: n + s[name])
    shifted = F.transform(
        "__spans",
        lambda s, i: F.struct(
            s["src"].alias("__src"), s["total"].alias("__total"), s["full"].alias("__full"), s["runs"].alias("runs"),
            earlier(i, "blocks").alias("blocks"), earlier(i, "total").alias("start"),
        ),
    )
    moved = F.transform(
        "runs", lambda r: F.struct(r["block"].alias("block"), (r["nth"] + F.col("blocks")).alias("nth"), (r["start"] + F.col("start")).alias("start"))
    )
    rows = keyed.where(many | (at(F.lit(0))["blocks"] > 1)).select(key, F.when(many, follows).otherwise(F.lit(True)).alias("__apart"), F.inline(shifted))
    return rows.select(key, "__src", "__total", "__full", F.when(F.col("__apart"), moved).alias("__runs"))


def _cut_at_fences(every: DataFrame, heads: DataFrame, key: str, positions: str, sources: int) -> DataFrame:
    """The blocks of keys whose indexes overlap, cut at the first positions of all of them.

    Between two fences of a key every index has at most one block that began earlier and
    the blocks that begin there, so a merged block sorts few short slices.
    """
    numbered = Window.partitionBy(key, "__src").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.drop("__hi").withColumn("__before", F.coalesce(F.sum("__n").over(numbered), F.lit(0)))
    entry = F.struct(F.col("__block").alias("from"), F.col("__before").alias("before"))
    began = [F.max(F.when(F.col("__src") == i, entry)).alias(f"__b{i}") for i in range(sources)]
    fences = heads.groupBy(key, "__lo").agg(*began)
    order = Window.partitionBy(key).orderBy("__lo")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spans = fences.select(
        F.col(key).alias("__key"), "__lo", F.lead("__lo").over(order).alias("__hi"),
        (F.row_number().over(order) - 1).cast("long").alias("block"),
        F.array_compact(F.array(*[_entry(i, F.last(f"__b{i}", ignorenulls=True).over(before)) for i in range(sources)])).alias("__open"),
    )
    # Blocks that reach into a span from before it, and those that begin with it.
    reach = spans.select("__key", "__lo", "__hi", "block", F.inline("__open"))
    begin = heads.join(spans.select("__key", F.col("__lo").alias("__at"), "__hi", F.col("block")), (F.col(key) == F.col("__key")) & (F.col("__lo") == F.col("__at")))
    links = reach.unionByName(
        begin.select("__key", "__lo", "__hi", "block", F.col("__src").alias("src"), F.col("__block").alias("from"), F.col("__before").alias("before"))
    )
    met = every.join(
        links, (F.col(key) == F.col("__key")) & (F.col("__src") == F.col("src")) & (F.col("__block") == F.col("from"))
    )
    inside = lambda x: (x >= F.col("__lo")) & (F.col("__hi").isNull() | (x < F.col("__hi")))
    # A slice may be empty: where it would begin tells how many postings of its index come earlier.
    earlier = F.col("before") + F.size(F.filter(positions, lambda x: x < F.col("__lo")))
    slices = met.select(key, "block", "src", F.filter(positions, inside).alias("__slice"), earlier.alias("__earlier"))
    starts = [F.coalesce(F.min(F.when(F.col("src") == i, F.col("__earlier"))), F.lit(0)) for i in range(sources)]
    return slices.groupBy(key, "block").agg(
        reduce(add, starts).alias("start"), F.array_sort(F.flatten(F.collect_list("__slice"))).alias(positions)
    )


def _entry(source: int, block: Column) -> Column:
    return F.when(block.isNotNull(), F.struct(F.lit(source).alias("src"), block["from"].alias("from"), block["before"].alias("before")))


def docs_for_token(
    index: DataFrame, docs: DataFrame, target: str, doc: str = "doc_id", columns: Sequence[str] = ()
) -> DataFrame:
    """Each position of the target with its document; unknown documents are dropped."""
    hits = index.where(F.col("norm") == target).select(F.col(doc).alias("__doc"), "ord")
    found = docs.join(hits, F.col(doc) == F.col("__doc"))
    return found.select("ord", doc, *columns)


def write_index(index: DataFrame, path: str, doc: str = "doc_id") -> None:
    """Store an index sorted by token, so a lookup reads few row groups."""
    write_types(index, path, "norm", doc)
