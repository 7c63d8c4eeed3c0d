"""Merkle manifest of a dataset, its nodes in van Emde Boas order.

Every row is a leaf, every value of the group column has a tree over its leaves, and the
trees' roots are the leaves of one more tree. While a level has several nodes, every two
consecutive ones become the digest of both, a last one alone becomes its own digest.

* A tree is cut into aligned blocks of 2**``HEIGHT`` leaves. A block is one table row whose
  nodes lie in van Emde Boas order: a subtree of h levels is its top half followed by its
  bottom subtrees, each laid out alike. ``address`` finds any node by arithmetic alone; it
  serves construction and the reading of siblings, and a path touches few cache lines
  whatever their size.
* The roots of all blocks of a tree are the leaves of the next round, until a tree has one
  block. Rounds grow with the logarithm of the largest group to the base 2**``HEIGHT``; each
  is an aggregate of at most 2**``HEIGHT`` short rows per block, so a group that holds a third
  of all rows is many blocks.
* Positions come from a range sort of the leaves, pinned by writing it, and one offset for
  each sorted partition and group. Texts are hashed where they are read and never moved.
* Proofs go down again: a block hands every entry the siblings inside it and those above.

Digests are SHA-256 over hexadecimal text. A value enters a leaf as its length in bytes, a
colon and its text; null is a dash.

Defined cases: leaves ascend by id, null first, and rows of one id by their leaf; repeated
rows are leaves of their own; a null group is a group, the first; empty and long texts are
hashed whole; a null id is never chosen for tampering; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfreq.llm.store import stored
from corpusfreq.llm.workers import package_path, task

# Levels below a block's root.
HEIGHT = 8
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Steps of a path: no sibling, or one on the left or on the right.
ALONE, LEFT, RIGHT = 0, 1, 2

BLOCK = "`group` string, block bigint, size bigint, n int, nodes binary, entries array<struct<pos:bigint,digest:binary,id:bigint,claimed:binary>>"


def address(levels: int, depth: int, index):
    """Place of the ``index``-th node at ``depth`` in a complete tree of ``levels`` levels."""
    if levels == 1:
        return index * 0
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = depth - top
    bottom = levels - top
    return ((1 << top) - 1) + (index >> below) * ((1 << bottom) - 1) + address(bottom, below, index & ((1 << below) - 1))


@cache
def _places(height: int, level: int) -> list[int]:
    """Byte offsets of the nodes ``level`` levels above the leaves."""
    depth = height - level
    return (address(height + 1, depth, np.arange(1 << depth)) * DIGEST).tolist()


def digest(*inputs: bytes) -> bytes:
    """Digest of digests, which enter as hexadecimal text."""
    return hashlib.sha256(b"".join(inputs).hex().encode()).digest()


def height_of(size: int) -> int:
    """Height of the blocks of a tree of ``size`` leaves."""
    return min(HEIGHT, (size - 1).bit_length())


def lay_out(leaves: list[bytes], height: int) -> bytes:
    """The nodes over the leaves of a block; missing ones are zero."""
    nodes = bytearray(DIGEST * ((2 << height) - 1))
    row = leaves
    for level in range(height + 1):
        if level:
            row = [digest(*row[i : i + 2]) for i in range(0, len(row), 2)]
        for place, node in zip(_places(height, level), row, strict=False):
            nodes[place : place + DIGEST] = node
    return bytes(nodes)


def path(nodes: bytes, height: int, n: int, leaf: int) -> bytes:
    """The steps from a leaf of a block to its root."""
    steps = []
    for level in range(height):
        other = (leaf >> level) ^ 1
        if other << level >= n:
            steps.append(b"\x00")
        else:
            place = _places(height, level)[other]
            steps.append((b"\x02" if other & 1 else b"\x01") + nodes[place : place + DIGEST])
    return b"".join(steps)


def fold(node: bytes, steps: bytes) -> bytes:
    """The root that a leaf and its steps lead to."""
    at = 0
    while at < len(steps):
        side = steps[at]
        if side == ALONE:
            node, at = digest(node), at + 1
            continue
        other = steps[at + 1 : at + 1 + DIGEST]
        node = digest(other, node) if side == LEFT else digest(node, other)
        at += 1 + DIGEST
    return node


def proof(steps: bytes) -> bytes:
    """Digest of the siblings of a path, from below."""
    found, at = [], 0
    while at < len(steps):
        if steps[at] == ALONE:
            at += 1
        else:
            found.append(steps[at + 1 : at + 1 + DIGEST])
            at += 1 + DIGEST
    return digest(*found)


def leaf(values: Sequence[Column]) -> Column:
    """Binary digest of a row's values."""
    written = []
    for value in values:
        text = value.cast("string")
        written.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*written), 256))


def group_key(group: Column) -> Column:
    """The group as a text that is never null and sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in its ``group`` by ``order``, and the group's ``size``."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(partitions, "group", *order).sortWithinPartitions("group", *order)
    placed = stored(ranged.withColumn("mid", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("mid", 33)
    pieces = placed.groupBy(part.alias("part"), F.col("group").alias("g")).agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    # One row for each partition and group that meet.
    pieces = stored(pieces, "pieces")
    whole = Window.partitionBy("g")
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n")
    offsets = pieces.select("part", "g", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    return placed.join(offsets, (part == F.col("part")) & (F.col("group") == F.col("g"))).select(
        *rows.columns, (F.col("mid") + F.col("shift")).alias("pos"), "size"
    )


def _blocks(nodes: DataFrame) -> DataFrame:
    """The blocks over (group, pos, size, digest, id, claimed)."""

    @task("merkle")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            laid = []
            for size, entries in zip(batch.column("size").to_pylist(), batch.column("entries"), strict=True):
                leaves = entries.values.field("digest").to_pylist()
                laid.append(lay_out(leaves, height_of(size)))
            columns = [batch.column(c) for c in ("group", "block", "size", "n")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(laid, pa.binary()), batch.column("entries")], names=["group", "block", "size", "n", "nodes", "entries"]
            )

    package_path(nodes.sparkSession)
    block = F.shiftright("pos", HEIGHT).alias("block")
    gathered = nodes.groupBy("group", block, "size").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "id", "claimed"))).alias("entries")
    )
    rows = gathered.select("group", "block", "size", F.size("entries").alias("n"), F.lit(None).cast("binary").alias("nodes"), "entries")
    return stored(rows.mapInArrow(run, BLOCK), "blocks")


@dataclass
class Forest:
    """The trees of all groups: the blocks of each round, from the leaves up."""

    rounds: list[DataFrame]

    def roots(self) -> DataFrame:
        """(group, digest) of every tree."""
        done = [r.where(F.col("size") <= 1 << HEIGHT).select("group", F.substring("nodes", 1, DIGEST).alias("digest")) for r in self.rounds]
        whole = done[0]
        for more in done[1:]:
            whole = whole.unionByName(more)
        return whole


def plant(nodes: DataFrame) -> Forest:
    """Trees over (group, pos, size, digest, id, claimed)."""
    rounds = [_blocks(nodes)]
    while True:
        above = rounds[-1].where(F.col("size") > 1 << HEIGHT)
        if above.isEmpty():
            return Forest(rounds)
        # The root is at address 0.
        upper = above.select(
            "group", F.col("block").alias("pos"), F.shiftright(F.col("size") + F.lit((1 << HEIGHT) - 1), HEIGHT).alias("size"),
            F.substring("nodes", 1, DIGEST).alias("digest"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("binary").alias("claimed"),
        )
        rounds.append(_blocks(upper))


def _descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(group, pos, id, digest, claimed, steps, top): entries of blocks with all steps to the top.

    ``above`` has (group, block, steps, top): what leads from a block's root to the top.
    """

    @task("merkle")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, n = batch.column("size")[i].as_py(), batch.column("n")[i].as_py()
                nodes, more = batch.column("nodes")[i].as_py(), batch.column("steps")[i].as_py()
                height = height_of(size)
                entries = batch.column("entries")[i].values
                steps = [path(nodes, height, n, k) + more for k in range(n)]
                same = lambda c: pa.array([batch.column(c)[i].as_py()] * n, batch.column(c).type)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        same("group"), entries.field("pos"), entries.field("id"), entries.field("digest"),
                        entries.field("claimed"), pa.array(steps, pa.binary()), same("top"),
                    ],
                    names=["group", "pos", "id", "digest", "claimed", "steps", "top"],
                )

    schema = "`group` string, pos bigint, id bigint, digest binary, claimed binary, steps binary, top struct<subroot:binary,root:binary>"
    upper = above.select(F.col("group").alias("g"), F.col("block").alias("b"), "steps", "top")
    met = blocks.join(upper, (F.col("group") == F.col("g")) & (F.col("block") == F.col("b")))
    return met.select("group", "size", "n", "nodes", "entries", "steps", "top").mapInArrow(run, schema)


def paths(forest: Forest, tops: DataFrame) -> DataFrame:
    """The leaves of a forest with their steps; ``tops`` has (group, steps, top) of each tree."""
    last, above = len(forest.rounds) - 1, None
    for k in range(last, -1, -1):
        blocks = forest.rounds[k]
        done = blocks.where(F.col("size") <= 1 << HEIGHT).select(F.col("group").alias("d"))
        ends = tops.join(done, F.col("group") == F.col("d"), "left_semi").select("group", F.lit(0).cast("bigint").alias("block"), "steps", "top")
        found = _descend(blocks, ends if above is None else ends.unionByName(above))
        if k:
            above = stored(found.select("group", F.col("pos").alias("block"), "steps", "top"), "steps")
    return found


@dataclass
class Manifest:
    leaves: Forest
    groups: Forest  # one tree, over the roots of the groups

    def root(self) -> DataFrame:
        """(root) in hexadecimal, no row for an empty dataset."""
        return self.groups.roots().select(F.lower(F.hex("digest")).alias("root"))

    def subroots(self) -> DataFrame:
        """(group, subroot) in hexadecimal."""
        group = F.when(F.col("group") != "-", F.expr("substring(`group`, 2)"))
        return self.leaves.roots().select(group.alias("group"), F.lower(F.hex("digest")).alias("subroot"))


def build(rows: DataFrame) -> Manifest:
    """The manifest of (group, id, digest, claimed): a group key, an id, a leaf and one to check."""
    # Ties and repeated rows are spread by the place where they are first written.
    leaves = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    trees = plant(numbered(leaves, ["id", "digest", "tie"]))
    roots = trees.roots().select(F.lit("").alias("group"), F.lit(None).cast("bigint").alias("id"), "digest", F.col("group").cast("binary").alias("claimed"))
    return Manifest(trees, plant(numbered(roots, ["claimed"])))


def proofs(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf."""
    none = F.lit(None).cast("binary")
    tree = manifest.groups.roots().select(
        "group", F.lit(b"").alias("steps"), F.struct(none.alias("subroot"), F.col("digest").alias("root")).alias("top")
    )
    tops = paths(manifest.groups, tree).select(
        F.col("claimed").cast("string").alias("group"), "steps",
        F.struct(F.col("digest").alias("subroot"), F.col("top.root").alias("root")).alias("top"),
    )
    found = paths(manifest.leaves, stored(tops, "tops"))

    @task("merkle")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proved, folded = [], []
            for first, claimed, steps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                proved.append(proof(steps))
                folded.append(fold(claimed or first, steps))
            columns = [batch.column(0), batch.column(1), pa.array(proved, pa.binary()), pa.array(folded, pa.binary()), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "proof", "folded", "top"])

    schema = "id bigint, digest binary, proof binary, folded binary, top struct<subroot:binary,root:binary>"
    checked = found.select("id", "digest", "claimed", "steps", "top").mapInArrow(run, schema)
    written = lambda c: F.lower(F.hex(c))
    return checked.select(
        "id", written("digest").alias("leaf"), written("top.subroot").alias("subroot"), written("top.root").alias("root"),
        written("proof").alias("proof_sha256"), written("folded").alias("folded_root"), (F.col("folded") == F.col("top.root")).alias("verified"),
    )


def rows_of(docs: DataFrame, tampered: Column, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS) -> DataFrame:
    """Leaves of ``docs``; rows where ``tampered`` holds are checked with 1 added to ``n_chars``."""
    plain = [F.col(f"`{c}`") for c in fields]
    # Wider than any integer column, so that adding never overflows.
    changed = [(F.col(f"`{c}`").cast("decimal(20,0)") + F.lit(1)).cast("decimal(20,0)") if c == "n_chars" else F.col(f"`{c}`") for c in fields]
    return docs.select(
        group_key(F.col(f"`{group_col}`")).alias("group"), F.col(f"`{id_col}`").cast("bigint").alias("id"), leaf(plain).alias("digest"),
        F.when(F.coalesce(tampered, F.lit(False)), leaf(changed)).alias("claimed"),
    )
