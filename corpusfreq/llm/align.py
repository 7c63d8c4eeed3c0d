"""Alignment of the tokens of two tokenizers over the bytes of the same text.

Tokenizer A is a byte-level BPE file, tokenizer B a piece model with byte fallback. Both see
a space and the text, so their tokens cut the same bytes. Two tokens are linked where their
bytes overlap; byte offsets where tokens of both end cut the text into groups.

The work of a batch is a chain of Arrow tables, with no loop over tokens:

* the id lists are flattened, each token keeps its text as parent index;
* token ends are a cumulative sum of token lengths, less the sum before the text;
* a full outer Acero join of A's and B's ends on the document-end key, sorted, holds every
  piece of the text that one token of each covers, which is one link; the tokens of a piece
  are the next ends, so gaps are filled backwards; ends of both are the cuts of groups;
* ``Table.group_by`` makes the distinct links of a text with their number, and the partial
  counts of texts by id pair, which Spark adds up.

The aligned rows are stored once: texts are encoded a single time. Each row then meets the
counts of its pairs. The ``MAX_HOT`` pairs of most documents, a bounded table, are broadcast;
by the skew of token pairs they answer nearly all links. The links left are exploded and
joined by a shuffle, where no pair is frequent. Nothing is dropped, at any size.

Defined cases: a null or empty text has no tokens, and so has one whose A or B tokens do not
give its bytes back (B reads U+2581 as a space); it has zeros and an empty digest. Texts of
any length are read whole. Every row counts as a document, repeated rows and null ids too.
Other columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.llm.store import stored
from corpusfreq.llm.token_counts import runs
from corpusfreq.llm.wordwise import ByteLevelWords, id_lists
from corpusfreq.llm.workers import held, package_path, task

# Pairs that are broadcast, at 17 bytes each.
MAX_HOT = 1 << 20
# Links a task gathers before it counts their texts.
GATHER = 1 << 21
SPACE_MARK = "▁"

ALIGNED = (
    "id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<bigint>, links array<int>"
)


def byte_level_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary.

    Bytes that print in Latin-1 stand for themselves, the others in their order for the
    characters from 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TwoTokenizers:
    """Both tokenizers of a worker, and the bytes and decimals of their ids."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        pa.set_cpu_count(1)  # a task has one core
        self.a = tokenizers.Tokenizer.from_buffer(a_file)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        alphabet, added = byte_level_alphabet(), self.a.get_added_tokens_decoder()
        bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            bytes_a[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())
        self.size_b = len(bytes_b)
        self.bytes = pa.array(bytes_a, pa.binary()), pa.array(bytes_b, pa.binary())
        self.words = ByteLevelWords(self.a)
        self.decimals = tuple(pa.array([str(i) for i in range(len(x))], pa.string()) for x in self.bytes)

    def ids(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        return id_lists(self.words.ids([" " + t for t in texts])), pa.array(self.b.encode(texts, num_threads=1), pa.list_(pa.int32()))


def _offsets(lists: pa.Array) -> np.ndarray:
    """Places in the flattened values where each list starts, and the end."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])


def _gives_back(lists: pa.Array, vocabulary: pa.Array, expected: list[bytes]) -> np.ndarray:
    """Which lists' tokens, joined, are the expected bytes."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(_offsets(lists), pa.int32()), vocabulary.take(lists.flatten())), b"")
    return np.array(pc.equal(joined, pa.array(expected, pa.binary())))


def _ends(lists: pa.Array, vocabulary: pa.Array, name: str) -> pa.Table:
    """(at, name): the document-end key of every token, and its place in the flattened ids."""
    flat = pc.list_flatten(lists)
    parent = pc.list_parent_indices(lists).cast(pa.int64())
    widths = pc.binary_length(vocabulary.take(flat)).cast(pa.int64())
    total = pc.cumulative_sum(widths)
    before = np.concatenate([[0], total.to_numpy()])[_offsets(lists)[:-1]]
    end = pc.subtract(total, pa.array(before, pa.int64()).take(parent))
    return pa.table({"at": pc.add(pc.shift_left(parent, pa.scalar(32, pa.int64())), end), name: pa.array(np.arange(len(flat)), pa.int64())})


def _written(starts: np.ndarray, flat: pa.Array, decimals: pa.Array) -> pa.Array:
    """The ids from each start to the next as decimals, joined by commas."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), decimals.take(flat)), ",")


def align(two: TwoTokenizers, texts: list[str]) -> dict[str, pa.Array]:
    """Columns of ``ALIGNED`` after the id for texts that are not empty."""
    n = len(texts)
    a, b = two.ids(texts)
    expected = [b" " + t.encode() for t in texts]
    good = _gives_back(a, two.bytes[0], expected) & _gives_back(b, two.bytes[1], expected)
    if not good.all():
        none = pa.scalar([], a.type)
        a, b = pc.if_else(pa.array(good), a, none), pc.if_else(pa.array(good), b, none)
    flat_a, flat_b = pc.list_flatten(a), pc.list_flatten(b)
    ends = _ends(a, two.bytes[0], "a").join(_ends(b, two.bytes[1], "b"), keys="at", join_type="full outer", use_threads=False)
    ends = ends.take(pc.sort_indices(ends["at"])).combine_chunks()
    at, place_a, place_b = (ends[c].combine_chunks() if ends.num_rows else pa.array([], pa.int64()) for c in ("at", "a", "b"))
    cut = pc.and_(pc.is_valid(place_a), pc.is_valid(place_b))
    doc = pc.shift_right(at, pa.scalar(32, pa.int64()))

    # Groups: from the token behind the last cut to the token of this one.
    first = lambda places: np.concatenate([[0], places.filter(cut).to_numpy() + 1])
    group_docs = np.bincount(doc.filter(cut).to_numpy(), minlength=n)
    sides = [_written(first(p), f, d) for p, f, d in zip((place_a, place_b), (flat_a, flat_b), two.decimals, strict=True)]
    groups = pc.binary_join_element_wise(*sides, "|")
    by_doc = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(group_docs)]), pa.int32()), groups)
    written = pc.binary_join(by_doc, ";")
    digests = [hashlib.sha256(w.as_buffer()).hexdigest() if k else "" for w, k in zip(written, group_docs, strict=True)]

    # Links: a piece of the text is covered by the tokens that end next.
    id_a = flat_a.take(pc.fill_null_backward(place_a)).cast(pa.int64())
    id_b = flat_b.take(pc.fill_null_backward(place_b)).cast(pa.int64())
    pair = pc.add(pc.multiply(id_a, pa.scalar(two.size_b, pa.int64())), id_b)
    linked = pa.table({"doc": doc, "pair": pair})
    distinct = linked.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    distinct = distinct.take(pc.sort_indices(distinct["doc"])).combine_chunks()
    column = lambda name, kind: (distinct[name].combine_chunks() if distinct.num_rows else pa.array([], kind)).cast(kind)
    per_doc = pa.array(np.concatenate([[0], np.cumsum(np.bincount(column("doc", pa.int64()).to_numpy(), minlength=n))]), pa.int32())
    return {
        "n_a": pc.list_value_length(a).cast(pa.int64()),
        "n_b": pc.list_value_length(b).cast(pa.int64()),
        "n_groups": pa.array(group_docs, pa.int64()),
        "n_links": pa.array(np.bincount(doc.to_numpy(), minlength=n), pa.int64()),
        "groups_sha256": pa.array(digests, pa.string()),
        "pairs": pa.ListArray.from_arrays(per_doc, column("pair", pa.int64())),
        "links": pa.ListArray.from_arrays(per_doc, column("count_all", pa.int32())),
    }


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links) of every row.

    ``pairs`` holds the distinct linked id pairs, A's id times the size of B's vocabulary plus
    B's id, and ``links`` how many links have each.
    """
    spark = docs.sparkSession
    package_path(spark)
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())
    name = hashlib.sha256(files[0] + files[1]).hexdigest()
    shared = spark.sparkContext.broadcast(files)  # two vocabulary files, a few megabytes

    @task("align")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = held("align", name, lambda: TwoTokenizers(*shared.value))
        for batch in batches:
            texts, lo = ["" if t is None else t for t in batch.column(1).to_pylist()], 0
            for part in runs(texts):
                full = [t for t in part if t]
                # Rows without text take the values of the null row that follows the others.
                place = np.cumsum([bool(t) for t in part]) - 1
                place = pa.array(np.where([bool(t) for t in part], place, -1))
                rows = align(two, full) if full else None
                yield _batch(batch.column(0).slice(lo, len(part)), rows, place)
                lo += len(part)

    schema = ALIGNED.format(id=docs.schema[id_col].dataType.simpleString())
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


_EMPTY = {"groups_sha256": pa.scalar("", pa.string()), "pairs": pa.scalar([], pa.list_(pa.int64())), "links": pa.scalar([], pa.list_(pa.int32()))}


def _batch(ids: pa.Array, rows: dict[str, pa.Array] | None, place: pa.Array) -> pa.RecordBatch:
    """The rows at their places; -1 is a row without tokens."""
    names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links")
    none = lambda c: _EMPTY.get(c, pa.scalar(0, pa.int64()))
    if rows is None:
        columns = [pa.array([none(c).as_py()] * len(place), none(c).type) for c in names]
    elif pc.min(place).as_py() < 0:
        there = pc.greater_equal(place, 0)
        at = pc.if_else(there, place, 0)
        columns = [pc.if_else(there, rows[c].take(at), none(c)) for c in names]
    else:
        columns = [rows[c] for c in names]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["id", *names])


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, docs, best): documents that hold the pair linked; whether none of its A id has more."""

    @task("align")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.Table] = []
        size = 0

        def counted() -> pa.Table:
            whole = pa.concat_tables(gathered).group_by("pair", use_threads=False).aggregate([("docs", "sum")])
            return whole.rename_columns({"docs_sum": "docs"}).select(["pair", "docs"])

        for batch in batches:
            flat = pc.list_flatten(batch.column(0))
            gathered.append(pa.table({"pair": flat, "docs": pa.array(np.ones(len(flat), np.int64))}))
            size += len(flat)
            if size > GATHER:
                gathered, size = [counted()], 0
                if gathered[0].num_rows > GATHER // 2:
                    yield from gathered.pop().to_batches(max_chunksize=1 << 16)
        if gathered:
            yield from counted().to_batches(max_chunksize=1 << 16)

    partial = rows.select("pairs").mapInArrow(run, "pair bigint, docs bigint")
    counts = stored(partial.groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    a = F.expr(f"pair div {size_b}")
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    # One row for each id of A's vocabulary at most.
    best = counts.join(F.broadcast(most), a == F.col("a"))
    return stored(best.select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "best")


@dataclass
class HotPairs:
    """Counts of the pairs of most documents, sorted by pair."""

    pairs: np.ndarray
    docs: np.ndarray
    best: np.ndarray


def _hot(counts: DataFrame, most: int) -> HotPairs:
    table = counts.orderBy(F.desc("docs"), "pair").limit(most).toArrow()
    pairs = table.column("pair").to_numpy()
    order = np.argsort(pairs)
    return HotPairs(pairs[order], table.column("docs").to_numpy()[order], np.array(table.column("best"))[order])


def _sums(rows: DataFrame, hot: HotPairs) -> DataFrame:
    """(row, best, total, cold): sums over the hot links of a row, and its other links."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    @task("align")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            starts = _offsets(batch.column(1))
            pairs, links = pc.list_flatten(batch.column(1)).to_numpy(), pc.list_flatten(batch.column(2)).to_numpy()
            met = np.zeros(len(pairs), bool)
            docs, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            if len(known.pairs):
                at = np.minimum(np.searchsorted(known.pairs, pairs), len(known.pairs) - 1)
                met = known.pairs[at] == pairs
                docs, best = np.where(met, known.docs[at] * links, 0), np.where(met, known.best[at] * links, 0)
            add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
            cold = pa.array(np.concatenate([[0], np.cumsum(add(~met))]), pa.int32())
            left = pa.StructArray.from_arrays([pa.array(pairs[~met], pa.int64()), pa.array(links[~met], pa.int32())], names=["pair", "links"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(add(best)), pa.array(add(docs)), pa.ListArray.from_arrays(cold, left)],
                names=["row", "best", "total", "cold"],
            )

    schema = "row bigint, best bigint, total bigint, cold array<struct<pair:bigint,links:int>>"
    return rows.select("row", "pairs", "links").mapInArrow(run, schema)


def alignment(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", max_hot: int = MAX_HOT
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``n_best`` are the links whose pair has the highest count of all pairs of its A id, ties
    included; ``count_sum`` adds the counts of all links.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    rows = aligned(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "aligned")
    counts = pair_counts(rows, size_b)
    sums = stored(_sums(rows, _hot(counts, max_hot)), "sums")
    cold = sums.select("row", F.explode("cold").alias("link")).select("row", F.col("link.pair").alias("p"), F.col("link.links").alias("n"))
    rest = cold.join(counts, F.col("p") == F.col("pair")).groupBy(F.col("row").alias("r")).agg(
        F.sum(F.col("docs") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best")
    )
    whole = sums.select(F.col("row").alias("s"), "best", "total").join(rest, F.col("s") == F.col("r"), "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).cast("long")
    kept = rows.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return kept.join(whole, F.col("row") == F.col("s")).select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        plus("best", "more_best").alias("n_best"), plus("total", "more").alias("count_sum"), "groups_sha256",
    )
