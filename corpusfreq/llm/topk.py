"""Exact top-k by integer inner product in three phases with a uniform threshold.

The dimensions are dealt to ``LISTS`` lists; a candidate's score is the sum of its
local scores, its inner products with the query over each list's dimensions.

1. Every list gives its k best candidates; the k-th best exact score among them is a
   safe cutoff for the query.
2. The cutoff travels with the queries to all candidates. A candidate that reaches it
   has a local score of at least cutoff / ``LISTS`` in one list; all such entries are taken.
3. The entries' remaining local scores are added, and the k best exact scores stay.

Queries and candidates are packed into blocks of bounded size. Both are dealt to a grid of
as many cells as there are tasks to use; in a cell every query block meets every candidate
block, which is one matrix product per list. A cell keeps the k best of each query: queries
that the lengths of a block's vectors cannot bring to their k-th best score, or in the
second phase to a list's share of the cutoff, skip the block, and only totals that reach the
cutoff are kept. What leaves a cell is at most k rows for each query.

Defined cases: vectors that are null or hold null or non-finite components, and rows with
a null id, take no part; missing trailing components count as 0; repeated rows of one id
and vector count once; a query never meets rows of its own id; equal scores go to the
smaller id; with fewer than k candidates all are returned; scores outside 64 bits are
clipped to it. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusfreq.llm.store import stored
from corpusfreq.llm.workers import package_path

LISTS = 4
SCALE = 1024
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
# Query blocks whose best entries a task holds at once.
RUNNING = 64
EXACT = 2.0**53
BLOCK = "ids binary, dims int, kind string, data binary, cutoffs binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, each id and vector once."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.where(~F.exists("v", bad)).distinct()


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows (id, v, optional cutoff)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)
                lists = part.column(1)
                lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                dims = int(lengths.max(initial=0))
                data = np.zeros((len(ids), dims))
                held = np.arange(dims) < lengths[:, None]
                data[held] = np.floor(SCALE * np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float))
                # Whole numbers, as narrow as they are; beyond 32 bits they stay doubles.
                most = np.abs(data).max(initial=0)
                kind = next((k for k in ("int16", "int32") if most <= np.iinfo(k).max), "float64")
                data = data.astype(kind)
                cutoffs = np.zeros(0)
                if part.num_columns > 2:
                    cutoffs = np.asarray(part.column(2).to_numpy(zero_copy_only=False), float)
                values = [[ids.tobytes()], [dims], [kind], [data.tobytes()], [cutoffs.tobytes()]]
                types = [pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
                arrays = [pa.array(v, t) for v, t in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["ids", "dims", "kind", "data", "cutoffs"])

    return rows.mapInArrow(run, BLOCK)


def _local_scores(queries: np.ndarray, candidates: np.ndarray) -> list[np.ndarray]:
    """One queries x candidates matrix of local scores per list, exact integers."""
    dims = max(queries.shape[1], candidates.shape[1])
    queries = np.pad(queries, ((0, 0), (0, dims - queries.shape[1])))
    candidates = np.pad(candidates, ((0, 0), (0, dims - candidates.shape[1])))
    largest = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(dims, 1)
    if largest >= EXACT / 2:  # beyond exact doubles: whole numbers of any size
        queries = np.vectorize(int, otypes=[object])(queries) if queries.size else queries.astype(object)
        candidates = np.vectorize(int, otypes=[object])(candidates) if candidates.size else candidates.astype(object)
    parts = np.array_split(np.arange(dims), LISTS)
    return [queries[:, p] @ candidates[:, p].T for p in parts]


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    firsts = np.searchsorted(query[order], query[order], side="left")
    return order[np.arange(len(order)) - firsts < k]


def _norms(data: np.ndarray) -> np.ndarray:
    """(rows x LISTS) length of each vector over each list's dimensions."""
    return np.stack([np.sqrt((data[:, p] ** 2).sum(axis=1)) for p in np.array_split(np.arange(data.shape[1]), LISTS)], axis=1)


class _Running:
    """The best entries of one block of queries that a task has seen."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, cutoffs: np.ndarray | None, k: int):
        self.ids, self.data, self.k = ids, data, k
        self.cutoffs = cutoffs
        self.least = np.full(len(ids), -np.inf) if cutoffs is None else cutoffs.copy()
        self.query, self.vec, self.total = (np.zeros(0, np.int64) for _ in range(3))

    def reach(self, data: np.ndarray) -> np.ndarray:
        """Which queries a block of candidates may still give something.

        No score exceeds the product of the lengths, list by list, and with a cutoff one
        list must give its share of it.
        """
        dims = max(self.data.shape[1], data.shape[1])
        wide = lambda x: np.pad(x, ((0, 0), (0, dims - x.shape[1])))
        bound = _norms(wide(self.data)) * _norms(wide(data)).max(axis=0, initial=0.0) * (1 + 1e-9) + 1
        open_ = bound.sum(axis=1) >= self.least
        if self.cutoffs is not None:
            open_ &= (bound * LISTS >= self.least[:, None]).any(axis=1)
        return np.flatnonzero(open_)

    def take(self, c_ids: np.ndarray, c_data: np.ndarray) -> None:
        active = self.reach(c_data)
        if not len(active) or not len(c_ids):
            return
        local = _local_scores(self.data[active], c_data)
        own = self.ids[active][:, None] == c_ids[None, :]
        taken = np.zeros(own.shape, bool)
        if self.cutoffs is None:  # one more than k: a query's own row may stand among them
            top = min(self.k + 1, len(c_ids))
            for scores in local:
                best = np.argpartition(-scores, top - 1, axis=1)[:, :top]
                np.put_along_axis(taken, best, True, axis=1)
        else:
            share = np.nextafter(self.cutoffs[active], -np.inf)[:, None]
            for scores in local:
                taken |= (scores * LISTS >= share).astype(bool)
        query, at = np.nonzero(taken & ~own)
        totals = sum(scores[query, at] for scores in local)
        if totals.dtype == object:
            totals = np.array([min(max(t, -(2**63) + 1), 2**63 - 1) for t in totals], np.int64)
        else:
            totals = totals.astype(np.int64)
        wanted = totals >= np.nextafter(self.least[active][query], -np.inf)
        query = np.concatenate([self.query, active[query[wanted]]])
        vec = np.concatenate([self.vec, c_ids[at[wanted]]])
        total = np.concatenate([self.total, totals[wanted]])
        keep = _best(query, vec, total, self.k)
        self.query, self.vec, self.total = query[keep], vec[keep], total[keep]
        # The k-th best of a query, where it has k: nothing below it can be wanted.
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.ids)) >= self.k)
        if len(full):
            worst = np.full(len(self.ids), np.inf)
            np.minimum.at(worst, self.query, self.total.astype(float))
            self.least[full] = np.maximum(self.least[full], worst[full])

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.query]), pa.array(self.vec), pa.array(self.total)], names=["query_id", "vec_id", "score"]
        )


def _meet(queries: DataFrame, candidates: DataFrame, k: int, grid: tuple[int, int], heads: bool) -> DataFrame:
    """(query_id, vec_id, score) of what each cell gives to phase 1 or to phases 2 and 3.

    Candidate blocks are dealt to the rows of a grid and query blocks to its columns; a cell
    is one task and keeps k rows for each of its queries. Both sides are shuffled: the
    planner does not see how often a block is copied, and would send all copies through the
    driver where it takes the blocks themselves for small.
    """
    high, wide = grid
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = [F.col(c).alias(f"c_{c}") for c in ("ids", "dims", "kind", "data")]
    left = candidates.select(*block, F.pmod(F.xxhash64("ids"), F.lit(high)).cast("int").alias("row"), every(wide).alias("column"))
    right = queries.withColumns({"row2": every(high), "column2": F.pmod(F.xxhash64("ids"), F.lit(wide)).cast("int")})
    pairs = left.hint("merge").join(right, (F.col("row") == F.col("row2")) & (F.col("column") == F.col("column2"))).select(
        "ids", "dims", "kind", "data", "cutoffs", "c_ids", "c_dims", "c_kind", "c_data"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: dict[bytes, _Running] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_dims, q_kind, q_data, cutoffs, c_ids, c_dims, c_kind, c_data = (batch.column(i)[row].as_py() for i in range(9))
                if q_ids not in running:
                    if len(running) >= RUNNING:
                        yield running.pop(next(iter(running))).rows()
                    ids = np.frombuffer(q_ids, np.int64)
                    running[q_ids] = _Running(ids, np.frombuffer(q_data, q_kind).astype(float).reshape(len(ids), q_dims), None if heads else np.frombuffer(cutoffs), k)
                ids = np.frombuffer(c_ids, np.int64)
                running[q_ids].take(ids, np.frombuffer(c_data, c_kind).astype(float).reshape(len(ids), c_dims))
        for left_over in running.values():
            yield left_over.rows()

    return pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _grid(candidates: int, queries: int, tasks: int) -> tuple[int, int]:
    """Rows and columns: at most as many cells as there are tasks, or block pairs if these are fewer.

    Every column copies all candidates, so none is added for the rest of the division.
    """
    high = max(1, min(candidates, tasks))
    return high, max(1, min(queries, tasks // high))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    package_path(spark)
    asked = stored(usable(queries, id_col, vector_col), "topk-queries")
    rows = stored(usable(vectors, id_col, vector_col), "topk-vectors")
    n_queries, n_blocks = -(-asked.count() // QUERY_BLOCK), -(-rows.count() // CANDIDATE_BLOCK)
    blocks = stored(_pack(rows.coalesce(max(1, n_blocks)), CANDIDATE_BLOCK), "topk-blocks")
    grid = _grid(n_blocks, n_queries, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = max(1, n_queries)

    heads = _meet(_pack(asked.repartition(spread, "id"), QUERY_BLOCK), blocks, k, grid, heads=True)
    ranked = heads.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    # Below the k-th best score seen no candidate can be wanted.
    cutoffs = ranked.where(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("least"))
    limited = asked.join(cutoffs, F.col("id") == F.col("query_id"), "left").select(
        "id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("cutoff")
    )
    limited = stored(limited, "topk-cutoffs")

    entries = _meet(_pack(limited.repartition(spread, "id"), QUERY_BLOCK), blocks, k, grid, heads=False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
