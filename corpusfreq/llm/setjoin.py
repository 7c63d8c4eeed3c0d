"""Size-aware heavy-light Jaccard join of documents on word n-grams.

A document's set holds its distinct word n-grams. Two documents link when
100 * intersection >= percent * union. Sets of s and t elements can link only if they
share c(s, t) = ceil(percent * (s + t) / (100 + percent)) elements.

* Equal sets are one class from the start; only classes take part below.
* Light sets, of up to x elements, are joined with light ones by their subsets: both
  sides list all their subsets of c(s, t) elements, and a common one is a link.
* Pairs with a heavy set are found by inverted lists. Elements are ordered by rising
  frequency; the first element that linked sets share stands among the first
  s - c(s, t) + 1 of both, so only those are listed, and elements that surely occur
  once are not listed at all. A list is first scanned around one hub per size band, the
  set with the fewest rare elements; what these links join is one component. Then all
  pairs of different components within a list are looked at. Every candidate pair is
  verified with its whole sets.
* x is where listing a set's subsets starts to cost more than scanning its lists,
  whose mean length is the mean frequency of an element.

The result is every document's component, so pairs inside a component that is already
known need no test; no link between different components is lost. Elements and classes
are named by 64-bit hashes.

Frequencies only order the elements, any order gives the same links. They are counted
over all documents by 40-bit codes. Broadcast are the ``MAX_FREQUENT`` most frequent
codes and a bitmap of ``1 << BITMAP_BITS`` bits that marks those met twice or more: with
far more distinct elements than bits it marks too many, which makes lists longer and
loses nothing.

Defined cases: null and word-less texts have an empty set, link with nothing and are their
own component; a text of fewer than n words has its whole sequence as one element; rows
with equal ids are one document; ids are cast to 64-bit integers; a row with a null id
links with nothing and has a null component; texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.llm.bytes_np import chunks, mix, word_hashes, word_spans
from corpusfreq.llm.components import components
from corpusfreq.llm.sieve import split, without
from corpusfreq.llm.store import stored
from corpusfreq.llm.workers import package_path, task

MAX_FREQUENT = 200_000
FREQUENT = 4
COUNT_BUCKETS = 256
# Codes that a task gathers before it sends them off.
PACKED = 1 << 20
BITMAP_BITS = 27
MAX_LIGHT = 24

_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def overlap(s: int, t: int, percent: int) -> int:
    """Least common elements of linked sets of s and t elements."""
    return -(-percent * (s + t) // (100 + percent))


def prefix_length(s, percent: int):
    return s + (-percent * s // 100) + 1


def word_ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, element): the distinct n-gram hashes of every text, by text and hash."""
    starts, stops, rows = word_spans(data, offsets)
    words = word_hashes(data, starts, stops)
    elements, owners = [], []
    if len(words) >= n:
        whole = rows[: len(rows) - n + 1] == rows[n - 1 :]
        grams = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            grams += words[i : len(words) - n + 1 + i] * _FACTORS[i]
        elements.append(mix(grams[whole]))
        owners.append(rows[: len(rows) - n + 1][whole])
    per_text = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((per_text > 0) & (per_text < n))
    if len(short):
        mine = per_text[rows] < n
        first = np.concatenate([[0], np.cumsum(per_text)])
        place = np.arange(len(rows))[mine] - first[rows[mine]]
        sums = np.zeros(len(per_text), np.uint64)
        np.add.at(sums, rows[mine], words[mine] * _FACTORS[place])
        elements.append(mix(sums[short] + per_text[short].astype(np.uint64)))
        owners.append(short)
    if not elements:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    element, owner = np.concatenate(elements), np.concatenate(owners)
    order = np.lexsort((element, owner))
    element, owner = element[order], owner[order]
    fresh = np.ones(len(element), bool)
    fresh[1:] = (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], element[fresh]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over consecutive runs of the given sizes."""
    out = np.zeros(len(sizes), values.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, np.concatenate([[0], np.cumsum(sizes)[:-1]])[full])
    return out


def _node(element: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Name of each text's set: equal sets have equal names."""
    return mix(_sums(mix(element ^ np.uint64(0x5851F42D4C957F2D)), sizes) + sizes.astype(np.uint64)).view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    package_path(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))


def signatures(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, node) of every document."""

    @task("setjoin")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                owner, element = word_ngrams(data, offsets, n)
                sizes = np.bincount(owner, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(_node(element, sizes))],
                    names=["id", "size", "node"],
                )

    return _texts(docs, id_col, text_col).mapInArrow(run, "id bigint, size bigint, node bigint")


def _coarse(element: np.ndarray) -> np.ndarray:
    """The 40 leading bits of an element, by which frequencies are counted."""
    return element >> np.uint64(24)


@dataclass
class Frequencies:
    """What tasks know about the frequency of elements."""

    bitmap: np.ndarray  # bits of codes met twice or more
    codes: np.ndarray  # the most frequent codes, sorted
    counts: np.ndarray
    list_length: float

    def of(self, element: np.ndarray) -> np.ndarray:
        """0 for an element that surely occurs once, else 1 or the known count."""
        code = _coarse(element)
        bit = code >> np.uint64(40 - BITMAP_BITS)
        again = (self.bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        out = again.astype(np.int64)
        often = np.flatnonzero(out)
        if len(self.codes) and len(often):
            wanted = code[often]
            at = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
            out[often] = np.where(self.codes[at] == wanted, self.counts[at], 1)
        return out


def element_frequencies(docs: DataFrame, n: int, text_col: str) -> Frequencies:
    """Count the codes of all elements of all documents.

    Each task sends its codes sorted into buckets, as packed arrays; a bucket's task
    counts them and gives its part of the bitmap and its frequent codes.
    """

    @task("setjoin")
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                gathered.append(_coarse(word_ngrams(data, offsets, n)[1]))
                size += len(gathered[-1])
            if size >= PACKED:
                yield sorted_out(gathered)
                gathered, size = [], 0
        if size:
            yield sorted_out(gathered)

    def sorted_out(gathered: list[np.ndarray]) -> pa.RecordBatch:
        coarse = np.concatenate(gathered)
        coarse.sort()
        cuts = np.searchsorted(coarse, np.arange(COUNT_BUCKETS + 1, dtype=np.uint64) << np.uint64(32))
        rest = coarse.astype(np.uint32)
        blobs = [rest[a:b].tobytes() for a, b in itertools.pairwise(cuts)]
        return pa.RecordBatch.from_arrays(
            [pa.array(range(COUNT_BUCKETS), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "packed"]
        )

    bits = BITMAP_BITS - COUNT_BUCKETS.bit_length() + 1  # of one bucket

    def count(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        parts = [np.frombuffer(b.as_buffer(), np.uint32) for b in table.column("packed")]
        values = np.sort(np.concatenate(parts))
        edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, int)
        found, each = values[edges[:-1]], np.diff(edges).astype(np.int64)
        marks = np.zeros(1 << bits, bool)
        marks[found[each > 1] >> np.uint32(32 - bits)] = True
        often = each >= FREQUENT
        codes = (bucket << 32) + found[often].astype(np.int64)
        # One more row carries the bitmap, the number of distinct codes and of all.
        bitmap = np.packbits(marks, bitorder="little").tobytes()
        return pa.table(
            {
                "code": pa.array(np.concatenate([[-1 - bucket], codes]), pa.int64()),
                "n": pa.array(np.concatenate([[len(found)], each[often]]), pa.int64()),
                "size": pa.array(np.concatenate([[len(values)], np.zeros(len(codes), np.int64)]), pa.int64()),
                "marks": pa.array([bitmap] + [None] * len(codes), pa.binary()),
            }
        )

    package_path(docs.sparkSession)
    packed = docs.select(F.col(text_col).alias("t")).mapInArrow(pack, "bucket int, packed binary")
    schema = "code bigint, n bigint, size bigint, marks binary"
    counted = stored(packed.groupBy("bucket").applyInArrow(count, schema), "frequencies")
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    elements, distinct = 0, 0
    for row in counted.where("code < 0").toLocalIterator():  # COUNT_BUCKETS rows
        part = np.frombuffer(row["marks"], np.uint8)
        at = -1 - row["code"]
        bitmap[at * len(part) : (at + 1) * len(part)] = part
        elements, distinct = elements + row["size"], distinct + row["n"]
    top = counted.where("code >= 0").orderBy(F.desc("n"), "code").limit(MAX_FREQUENT).select("code", "n").toArrow()
    codes, counts = top.column("code").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    order = np.argsort(codes)
    return Frequencies(bitmap, codes[order], counts[order], elements / max(distinct, 1))


def light_bound(percent: int, list_length: float) -> int:
    """The largest size up to which listing subsets costs no more than scanning lists.

    Scanning reads the lists of the first elements and compares whole sets with each set
    that stands in them; subsets need no comparison.
    """
    bound = 0
    for s in range(1, MAX_LIGHT + 1):
        partners = range(-(-percent * s // 100), 100 * s // percent + 1)
        subsets = sum(math.comb(s, c) for c in {overlap(s, t, percent) for t in partners} if c <= s)
        if subsets > prefix_length(s, percent) * (1 + list_length * (1 + s)):
            break
        bound = s
    return bound


def list_entries(
    docs: DataFrame, n: int, percent: int, least: int, frequencies: Frequencies, id_col: str, text_col: str
) -> DataFrame:
    """(element, node, size, place) of the rarest elements of every set of at least ``least`` elements.

    ``place`` is the element's place in the set's order. Elements that surely occur once
    hold places, too, but are not listed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)

    @task("setjoin")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                owner, element = word_ngrams(data, offsets, n)
                sizes = np.bincount(owner, minlength=hi - lo)
                node = _node(element, sizes)
                frequency = shared.value.of(element)
                order = np.lexsort((element, frequency, owner))
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                place = np.arange(len(owner)) - first[owner]
                named = batch.column(0).slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)
                wanted = np.where((sizes >= least) & named, prefix_length(sizes, percent), 0)
                keep = (place < wanted[owner]) & (frequency[order] > 0)
                chosen, whose = element[order][keep], owner[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chosen.view(np.int64)), pa.array(node[whose]),
                        pa.array(sizes[whose], pa.int32()), pa.array(place[keep], pa.int32()),
                    ],
                    names=["element", "node", "size", "place"],
                )

    schema = "element bigint, node bigint, size int, place int"
    return _texts(docs, id_col, text_col).mapInArrow(run, schema)


def light_links(docs: DataFrame, n: int, percent: int, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(u, v) links that common subsets of light sets prove."""

    def subsets(element: np.ndarray) -> Iterator[tuple[int, bool]]:
        """(key, sizes equal) for each subset that a linked light set of another class would share."""
        s = len(element)
        marks = [int(x) for x in mix(element ^ np.uint64(0x2545F4914F6CDD1D))]
        total, mask = sum(marks), (1 << 64) - 1
        for t in range(-(-percent * s // 100), min(100 * s // percent, bound) + 1):
            c = overlap(s, t, percent)
            if c > min(s, t) or s == t == c:
                continue
            pair = (min(s, t) * 1000 + max(s, t)) * 0x9E3779B97F4A7C15
            for gone in itertools.combinations(marks, s - c):
                yield (total - sum(gone) + pair) & mask, s == t

    @task("setjoin")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                owner, element = word_ngrams(data, offsets, n)
                sizes = np.bincount(owner, minlength=hi - lo)
                node = _node(element, sizes)
                named = batch.column(0).slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.cumsum(sizes)])
                keys, nodes, side, alike = [], [], [], []
                for i in np.flatnonzero((sizes > 0) & (sizes <= bound) & named):
                    for key, even in subsets(element[first[i] : first[i + 1]]):
                        keys.append(key)
                        nodes.append(node[i])
                        side.append(sizes[i])
                        alike.append(even)
                mixed = mix(np.array(keys, np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mixed, pa.int64()), pa.array(alike, pa.bool_()),
                        pa.array(nodes, pa.int64()), pa.array(side, pa.int32()),
                    ],
                    names=["key", "even", "node", "size"],
                )

    schema = "key bigint, even boolean, node bigint, size int"
    rows = stored(_texts(docs, id_col, text_col).mapInArrow(run, schema).distinct(), "light")
    groups = rows.groupBy(F.col("key").alias("k"), F.col("even").alias("e")).agg(
        F.min("node").alias("hub"), F.count("*").alias("members"), F.min("size").alias("a"), F.max("size").alias("b")
    )
    # A common subset for sizes s < t links sets of s with sets of t, not those of one size
    # with each other; with both sizes there, all are one component.
    proof = groups.where("members > 1 AND (e OR a <> b)")
    joined = rows.join(proof, (F.col("key") == F.col("k")) & (F.col("even") == F.col("e")))
    return joined.select(F.col("node").alias("u"), F.col("hub").alias("v")).where("u <> v").distinct()


def candidate_sets(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(node, packed): the sorted sets of the wanted (id, node) documents."""

    @task("setjoin")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                owner, element = word_ngrams(data, offsets, n)
                sizes = np.bincount(owner, minlength=hi - lo)
                node = _node(element, sizes)
                first = np.concatenate([[0], np.cumsum(sizes)])
                packed = [element[a:b].tobytes() for a, b in itertools.pairwise(first)]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(packed, pa.binary())], names=["node", "packed"])

    wanted = stored(wanted, "wanted")
    texts = _texts(docs, id_col, text_col).where("id IS NOT NULL")
    _, maybe = split(texts, F.col("id"), wanted, "id")
    asked = maybe.join(wanted.select(F.col("id").alias("asked")), F.col("__sv_key") == F.col("asked"), "left_semi")
    found = asked.select("id", "t").mapInArrow(run, "node bigint, packed binary")
    # An id may stand on rows with other texts too.
    return found.groupBy("node").agg(F.first("packed").alias("packed"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets link."""
    left = sets.select(F.col("node").alias("nu"), F.col("packed").alias("su"))
    right = sets.select(F.col("node").alias("nv"), F.col("packed").alias("sv"))
    both = pairs.join(left, F.col("u") == F.col("nu")).join(right, F.col("v") == F.col("nv")).select("u", "v", "su", "sv")

    @task("setjoin")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                b = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[at] == a).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))],
                names=["u", "v"],
            )

    return both.mapInArrow(run, "u bigint, v bigint")


def _grouped(entries: DataFrame, percent: int) -> DataFrame:
    """``entries`` of lists with two sets or more, each with its size band."""
    lengths = entries.groupBy(F.col("element").alias("e")).agg(F.count("*").alias("members")).where("members > 1")
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(100 / percent))).cast("int")
    kept = entries.join(lengths, F.col("element") == F.col("e"))
    return kept.select("element", "node", "size", "place", band.alias("band"))


def _can_be_first(percent: int):
    """Whether a common element at these places may be the first of a linked pair.

    Behind it each set must hold the other c(s, t) - 1 common elements.
    """
    both = F.col("size") + F.col("other_size")
    common = F.floor((both * percent + (99 + percent)) / F.lit(100 + percent))
    return (F.col("place") + common <= F.col("size")) & (F.col("other_place") + common <= F.col("other_size"))


def _hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(u, v): each set with the hub of its size band, and of the band below, in each of its lists.

    The hub has the listed element in the earliest place: few of its elements are rare, so
    it is likely in the middle of the sets like it.
    """
    hubs = lists.groupBy(F.col("element").alias("e"), F.col("band").alias("b")).agg(
        F.min(F.struct("place", "size", "node")).alias("hub")
    ).select(
        "e", "b", F.col("hub.node").alias("other"), F.col("hub.size").alias("other_size"),
        F.col("hub.place").alias("other_place"),
    )
    near = lists.withColumn("near", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    met = near.join(hubs, (F.col("element") == F.col("e")) & (F.col("near") == F.col("b")))
    pairs = met.where(F.col("node") != F.col("other")).where(_can_be_first(percent))
    return pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def _rest_pairs(lists: DataFrame, found: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs in a list that lie in different components and were not tried."""
    root = F.coalesce("root", "node").alias("root")
    placed = lists.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "element", "node", "size", "place", "band", root
    )
    mixed = placed.groupBy(F.col("element").alias("e")).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    open_ = placed.join(mixed, F.col("element") == F.col("e")).select("element", "node", "size", "place", "band", "root")
    open_ = stored(open_, "open")
    other = open_.select(
        F.col("element").alias("e"), F.col("node").alias("other"), F.col("size").alias("other_size"),
        F.col("place").alias("other_place"), F.col("root").alias("other_root"), F.col("band").alias("other_band"),
    )
    near = open_.withColumn("near", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    met = near.join(other, (F.col("element") == F.col("e")) & (F.col("near") == F.col("other_band")))
    pairs = met.where("node < other AND root <> other_root").where(_can_be_first(percent))
    fresh = pairs.select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()
    asked = tried.select(F.col("u").alias("tu"), F.col("v").alias("tv"))
    return fresh.join(asked, (F.col("u") == F.col("tu")) & (F.col("v") == F.col("tv")), "left_anti")


def linked_components(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, size, component) of every row: set size and least id reachable by links."""
    signed = stored(signatures(docs, n, id_col, text_col), "signatures")
    classes = stored(
        signed.where("size > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.first("size").alias("size")),
        "classes",
    )
    frequencies = element_frequencies(docs, n, text_col)
    bound = light_bound(percent, frequencies.list_length)
    least = -(-percent * (bound + 1) // 100)
    raw = list_entries(docs, n, percent, least, frequencies, id_col, text_col)
    entries = stored(raw.distinct(), "entries")
    lists = stored(_grouped(entries, percent), "lists")

    pairs = stored(_hub_pairs(lists, percent), "pairs")
    links = [light_links(docs, n, percent, bound, id_col, text_col)]
    # Rows of one id are one document, whatever their texts: all are linked to the least.
    sets = signed.where("size > 0 AND id IS NOT NULL").select("id", "node")
    twice = sets.groupBy(F.col("id").alias("i")).agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u <> last")
    same = sets.join(twice, F.col("id") == F.col("i")).where("u <> node")
    links.append(same.select("u", F.col("node").alias("v")).distinct())

    def sets_of(some: DataFrame) -> DataFrame:
        nodes = some.select(F.col("u").alias("w")).unionByName(some.select(F.col("v").alias("w"))).distinct()
        wanted = classes.join(nodes, F.col("node") == F.col("w")).select(F.col("least").alias("id"), "node")
        return candidate_sets(docs, wanted, n, id_col, text_col)

    links.append(verified(pairs, sets_of(pairs), percent))
    joined = stored(links[0].unionByName(links[1]).unionByName(links[2]), "found")
    first = stored(components(joined), "first")
    rest = stored(_rest_pairs(lists, first, pairs, percent), "rest")
    more = stored(verified(rest, sets_of(rest), percent), "more")
    # The components found first are stars already: only what joins them is new.
    final = components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))

    rooted = classes.join(final.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        F.col("node").alias("n"), F.coalesce("root", "node").alias("root"), "least"
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    component = rooted.join(named.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("n", "component")
    return signed.join(component, (F.col("node") == F.col("n")) & (F.col("size") > 0), "left").select(
        "id", "size", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")
    )


def keep_one_of_each(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document of each component, the one of least id.

    Rows with a null id or an empty set stay. Of rows with one id, which are one document,
    the first by text stays.
    """
    found = stored(linked_components(docs, n, percent, id_col, text_col), "components")
    gone = found.where("component < id").select("id")
    kept = without(docs, F.col(id_col).cast("long"), gone, "id")
    repeated = found.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")
    if repeated.isEmpty():
        return kept
    again = repeated.select(F.col("id").alias("__sj_again"))
    single = kept.join(again, F.col(id_col).cast("long") == F.col("__sj_again"), "left_anti")
    several = kept.join(again, F.col(id_col).cast("long") == F.col("__sj_again"), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    body = F.coalesce(F.col(text_col), F.lit(""))
    first = several.groupBy(F.col(id_col).cast("long")).agg(F.min_by(F.struct(*columns), body).alias("__sj_row"))
    return single.unionByName(first.select("__sj_row.*"))
