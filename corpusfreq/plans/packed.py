"""Sums by string keys, shuffled as packed blocks.

N-grams hardly repeat inside a task, so a plain aggregate shuffles a row of several strings
for nearly every occurrence. Here a task adds up its rows in pieces of bounded size and sends
what it found as one block for each bucket of keys: the distinct words once, and columns of
small numbers that point to them. A bucket's blocks meet in one task, which adds them up
bucket by bucket, so a task holds one piece or one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Rows, or words of vectors, and bytes of a task's piece.
PIECE_ROWS, PIECE_BYTES = 1 << 21, 128 << 20
BUCKETS_PER_PARTITION = 4
BLOCK = "bucket int, words binary, entries binary"


def packed_sums(rows: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), count: str = "count") -> DataFrame:
    """``keys``, the number of rows, and the sum of each of the columns ``sums``, whole numbers
    and none of them null. ``count`` may be among the sums: then it is added up, too.

    The same rows as ``groupBy(*keys)``. A stream, and keys that are not plain strings, are
    left to Spark's aggregate.
    """
    if rows.isStreaming or any(rows.schema[k].dataType != StringType() for k in keys):
        rows_of = F.sum(count) if count in sums else F.count("*")
        return rows.groupBy(*keys).agg(rows_of.alias(count), *[F.sum(s).alias(s) for s in sums if s != count])
    counted, sums = count in sums, [s for s in sums if s != count]
    plain = rows.select(*[F.col(k).cast("binary").alias(k) for k in keys], *([count] if counted else []), *sums)
    return _added(plain, keys, [count, *sums], counted)


def packed_ngrams(docs: DataFrame, vector: str, names: Sequence[str], drop_last: bool = False) -> DataFrame:
    """``names, count``: the runs of neighbours in arrays of plain strings, as many as there are
    names. Whole arrays go to the worker: a row for each run would cost more than its count."""
    return _added(docs.select(F.col(vector).cast("array<binary>")), names, ["count"], False, (len(names), drop_last))


def _added(plain: DataFrame, keys: Sequence[str], sums: Sequence[str], counted: bool, runs: tuple[int, bool] | None = None) -> DataFrame:
    partitions = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pack, add_up = workers([*keys], [*sums], counted, runs, partitions * BUCKETS_PER_PARTITION, PIECE_ROWS, PIECE_BYTES)
    blocks = plain.mapInArrow(pack, BLOCK).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    schema = ", ".join([*[f"`{k}` binary" for k in keys], *[f"`{s}` bigint" for s in sums]])
    return blocks.mapInArrow(add_up, schema).select(*[F.col(k).cast("string").alias(k) for k in keys], *sums)


def workers(
    keys: list[str], sums: list[str], counted: bool, runs: tuple[int, bool] | None, buckets: int, piece_rows: int, piece_bytes: int
) -> tuple[Callable, Callable]:
    """What packs the rows of a task, and what adds up the blocks of a partition.

    Made here and not defined by the module, so that both travel to the workers by value:
    they need not have this package.
    """
    n_keys, names = len(keys), [*keys, *sums]

    def grouped(codes, sizes):
        """The order that brings equal combinations together, and where each begins."""
        import numpy as np

        def ordered(ids):
            order = np.argsort(ids)
            ids = ids[order]
            return order, np.concatenate([[True], ids[1:] != ids[:-1]])

        ids, bound = codes[0].astype(np.int64), sizes[0]
        for code, size in zip(codes[1:], sizes[1:], strict=True):
            if bound > (1 << 62) // size:  # numbered anew
                order, new = ordered(ids)
                ids[order] = np.cumsum(new) - 1
                bound = len(ids)
            ids *= size
            ids += code
            bound *= size
        order, new = ordered(ids)
        return order, np.flatnonzero(new)

    def block(names, columns):
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays(columns, names=names)
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def narrow(values):
        import numpy as np
        import pyarrow as pa

        low, high = int(values.min()), int(values.max())
        kinds = (np.uint8, np.uint16, np.uint32, np.int64) if low >= 0 else (np.int8, np.int16, np.int32, np.int64)
        return pa.array(values.astype(next(k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max)))

    def bucket_of(words, codes):
        """Buckets by the bytes of the words, the same in all tasks."""
        import zlib

        import numpy as np

        sums_of = np.array([0 if w is None else zlib.crc32(w) + 1 for w in words.to_pylist()], np.uint64)
        mixed = np.zeros(codes.shape[1], np.uint64)
        for code in codes:
            mixed = (mixed ^ sums_of[code]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        return (mixed % np.uint64(buckets)).astype(np.int32)

    def parted(held):
        """(words, their numbers for each key, values) of the rows of a piece."""
        import numpy as np
        import pyarrow as pa

        if runs is None:
            table = pa.Table.from_batches(held)
            words = pa.concat_arrays([c for k in range(n_keys) for c in table.column(k).chunks])
            words = words.dictionary_encode(null_encoding="encode")
            values = [table.column(i).to_numpy() for i in range(n_keys, table.num_columns)]
            return words.dictionary, words.indices.to_numpy().reshape(n_keys, -1), values
        words = pa.concat_arrays([b.column(0).flatten() for b in held]).dictionary_encode(null_encoding="encode")
        lengths = np.concatenate([b.column(0).value_lengths().fill_null(0).to_numpy() for b in held])
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words))
        starts = np.flatnonzero(left >= runs[0] + runs[1])
        code = words.indices.to_numpy()
        return words.dictionary, np.stack([code[starts + k] for k in range(n_keys)]), []

    def packed(held):
        import numpy as np
        import pyarrow as pa

        words, codes, values = parted(held)
        if not codes.shape[1]:
            return
        order, starts = grouped([*codes], [len(words)] * n_keys)
        totals = [np.add.reduceat(v[order], starts, dtype=np.int64) for v in values]
        if not counted:
            totals.insert(0, np.diff(np.append(starts, len(order))))
        codes = codes[:, order[starts]]
        bucket = bucket_of(words, codes)
        order = np.argsort(bucket, kind="stable")
        bucket, codes, totals = bucket[order], codes[:, order], [t[order] for t in totals]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            used, local = np.unique(codes[:, lo:hi], return_inverse=True)
            columns = [*local.reshape(n_keys, -1), *[t[lo:hi] for t in totals]]
            entries = block([str(i) for i in range(len(columns))], [narrow(c) for c in columns])
            own = block(["word"], [words.take(pa.array(used))])
            yield pa.RecordBatch.from_pylist(
                [{"bucket": int(bucket[lo]), "words": own, "entries": entries}],
                pa.schema({"bucket": pa.int32(), "words": pa.binary(), "entries": pa.binary()}),
            )

    def cut(batch):
        """The batch with how many rows each part counts for; batches of long vectors in parts."""
        import numpy as np

        if runs is None:
            yield batch, batch.num_rows
            return
        ends = np.cumsum(batch.column(0).value_lengths().fill_null(0).to_numpy().astype(np.int64))
        piece = ends // piece_rows
        edges = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(ends)]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(lo, hi - lo), int(ends[hi - 1] - (ends[lo - 1] if lo else 0))

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, rows, size = [], 0, 0
        for batch in batches:
            for part, n in cut(batch) if batch.num_rows else ():
                held.append(part)
                rows, size = rows + n, size + part.nbytes
                if rows >= piece_rows or size >= piece_bytes:
                    yield from packed(held)
                    held, rows, size = [], 0, 0
        if held:
            yield from packed(held)
        held = None
        pa.default_memory_pool().release_unused()

    def added(held):
        import numpy as np
        import pyarrow as pa

        read = lambda data: pa.ipc.open_stream(data).read_next_batch()
        words = [read(w).column(0).cast(pa.large_binary()) for w, _ in held]
        entries = [read(e) for _, e in held]
        offsets = np.cumsum([0, *map(len, words)])
        words = pa.concat_arrays(words).dictionary_encode(null_encoding="encode")
        place = words.indices.to_numpy()
        column = lambda i: [e.column(i).to_numpy().astype(np.int64) for e in entries]
        codes = [place[np.concatenate([c + o for c, o in zip(column(i), offsets[:-1], strict=True)])] for i in range(n_keys)]
        order, starts = grouped(codes, [len(words.dictionary)] * n_keys)
        totals = [np.add.reduceat(np.concatenate(column(i))[order], starts) for i in range(n_keys, entries[0].num_columns)]
        first = order[starts]
        for lo in range(0, len(first), 1 << 16):
            part = first[lo : lo + (1 << 16)]
            keys = [words.dictionary.take(pa.array(c[part])).cast(pa.binary()) for c in codes]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(s[lo : lo + (1 << 16)]) for s in totals]], names=names)

    def add_up(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, bucket = [], None
        for batch in batches:
            for row in range(batch.num_rows):
                b, words, entries = (batch.column(i)[row] for i in range(3))
                if held and b.as_py() != bucket:
                    yield from added(held)
                    held = []
                bucket = b.as_py()
                held.append((words.as_py(), entries.as_py()))
        if held:
            yield from added(held)
        held = None
        pa.default_memory_pool().release_unused()

    return pack, add_up
