"""Benchmark decontamination by a broadcast table of normalised n-grams.

The n-grams of the test items are kept in one hash table under their rarest word.
Every word of a training text looks itself up there; where it is found, the token
window around it is compared with the n-gram word by word, so a hit is exact. The
table is broadcast while it has at most ``BROADCAST_GRAMS`` n-grams of bounded length.
Beyond that, words that pass a Bloom filter of the rarest words are joined by a shuffle,
each with the few words that a window around it can hold.

Texts are judged by content: equal texts are looked at as one, so repeated rows and
repeated ids get the same answer, each in its own row.

Defined cases: a null or word-less text has no words and is clean; a null or word-less
item has no n-gram; null item ids are not reported but their windows count as hits; an
empty benchmark makes every document clean; an item shorter than ``n`` words is one
window; texts of any length are read whole. Other columns of the documents are never read
under a fixed name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfreq.llm.sieve import split, without
from corpusfreq.llm.store import stored

N = 13
BROADCAST_GRAMS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A word before lower-casing, with the separators that follow it.
WORD_AND_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-case A-Z, then maximal runs of digits, letters a-z and non-ASCII characters."""
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""), F.array().cast("array<string>"))


def item_grams(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, gram): every window of ``n`` words of an item, or the whole shorter item."""
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    placed = items.select("item", "w", F.explode(starts).alias("s"))
    return placed.select("item", F.slice("w", F.col("s"), n).alias("gram")).distinct()


def anchored(grams: DataFrame) -> DataFrame:
    """(anchor, off, gram): each distinct n-gram with its rarest word and that word's place.

    Rarest means in the fewest n-grams, then the longest: such words are rare in the
    training texts too, and few windows need a comparison.
    """
    each = grams.select("gram").distinct().select("gram", F.posexplode("gram").alias("off", "anchor"))
    freq = each.groupBy("anchor").agg(F.count("*").alias("f")).withColumnRenamed("anchor", "term")
    best = F.min(F.struct("f", (-F.length("anchor")).alias("l"), "anchor", "off")).alias("best")
    chosen = each.join(freq, F.col("anchor") == F.col("term")).groupBy("gram").agg(best)
    return chosen.select(F.col("best.anchor").alias("anchor"), F.col("best.off").alias("off"), "gram")


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def find_hits(docs: DataFrame, grams: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, start, n, gram, n_words): where an n-gram stands in a distinct text, words from 0."""
    table = stored(anchored(grams), "anchors")
    count, longest = table.agg(F.count("*"), F.coalesce(F.max(F.size("gram")), F.lit(1))).first()
    texts = docs.select(F.col(text_col).alias("body")).select("body", words(F.col("body")).alias("w"))
    start, n = (F.col("pos") - F.col("off")).alias("start"), F.size("gram").alias("n")
    if count <= BROADCAST_GRAMS:
        scanned = texts.select("body", "w", F.posexplode_outer("w").alias("pos", "word"))
        met = scanned.join(F.broadcast(table), F.col("word") == F.col("anchor"))
        window = F.when(F.col("pos") >= F.col("off"), F.slice("w", F.col("pos") - F.col("off") + 1, F.size("gram")))
        n_words = F.size("w").cast("long").alias("n_words")
        return met.where(window == F.col("gram")).select(text_key(F.col("body")).alias("key"), start, n, "gram", n_words).distinct()
    # Only words that pass a Bloom filter of the anchors move, each with the words that a
    # window around it can hold, and never with its text.
    keyed = texts.select(text_key(F.col("body")).alias("key"), "w", F.posexplode_outer("w").alias("pos", "word"))
    _, maybe = split(keyed, F.col("word"), table, "anchor")
    low = F.greatest(F.col("pos") - F.lit(longest - 1), F.lit(0))
    near = maybe.select(
        "key", F.size("w").cast("long").alias("n_words"), "pos", "word", low.alias("low"),
        F.slice("w", low + 1, F.lit(2 * longest - 1)).alias("near"),
    )
    met = near.join(table, F.col("word") == F.col("anchor"))
    window = F.when(F.col("pos") >= F.col("off"), F.slice("near", F.col("pos") - F.col("off") - F.col("low") + 1, F.size("gram")))
    return met.where(window == F.col("gram")).select("key", start, n, "gram", "n_words").distinct()


def covered(hits: DataFrame) -> DataFrame:
    """(key, n_hit, spans): words covered per text, and the merged [start, stop) spans."""
    runs = hits.groupBy("key", "start").agg(F.max(F.col("start") + F.col("n")).alias("stop"))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = runs.withColumn("reach", F.coalesce(F.max("stop").over(before), F.lit(0)))
    fresh = F.greatest(F.col("stop") - F.greatest("start", "reach"), F.lit(0))
    opens = F.when(F.col("start") >= F.col("reach"), 1).otherwise(0)
    order = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    parts = reach.withColumn("fresh", fresh).withColumn("run", F.sum(opens).over(order))
    merged = parts.groupBy("key", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("fresh").alias("fresh")
    )
    return merged.groupBy("key").agg(
        F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")
    )


def found_items(hits: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, items): ids of the items with a window in the text, sorted as strings."""
    named = grams.where("item IS NOT NULL").select(F.col("item").cast("string").alias("item"), F.col("gram").alias("g"))
    pairs = hits.select("key", "gram").distinct().join(named, F.col("gram") == F.col("g")).select("key", "item")
    return pairs.distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per document: id, n_words, n_hit, spans of hit words and the items found."""
    grams = item_grams(benchmark, n, item_col, item_text_col)
    hits = stored(find_hits(docs, grams, text_col), "hits")
    items = found_items(hits, grams).withColumnRenamed("key", "k")
    found = covered(hits).join(items, F.col("key") == F.col("k"), "left").drop("k")
    base = docs.select(
        F.col(id_col), text_key(F.col(text_col)).alias("text_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
    )
    none = F.array().cast("array<string>")
    return base.join(found, F.col("text_key") == F.col("key"), "left").select(
        id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
        F.coalesce("items", none).alias("items"),
    )


def is_contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """At least one word in ``share`` stands in a benchmark window."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", spans_only: bool = False,
) -> DataFrame:
    """``docs`` without contaminated documents or, with ``spans_only``, without the hit words."""
    hits = stored(find_hits(docs, item_grams(benchmark, n, item_col, item_text_col), text_col), "hits")
    found = covered(hits)
    key = text_key(F.col(text_col))
    if not spans_only:
        sizes = hits.groupBy(F.col("key").alias("k")).agg(F.max("n_words").alias("n_words"))
        dirty = found.join(sizes, F.col("key") == F.col("k")).where(is_contaminated(F.col("n_hit"), F.col("n_words")))
        return without(docs, key, stored(dirty.select("key"), "dirty"), "key")
    clear, maybe = split(docs, key, hits, "key")
    spans = found.select(F.col("key").alias("__bd_key"), F.col("spans").alias("__bd_spans"))
    joined = maybe.join(spans, F.col("__sv_key") == F.col("__bd_key"), "left")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD_AND_GAP})"), 1)
    hit = lambda i: F.exists("__bd_spans", lambda s: (i >= s["start"]) & (i < s["stop"]))
    rest = F.array_join(F.filter(pieces, lambda _, i: ~hit(i)), "")
    text = F.when(F.col("__bd_spans").isNull(), F.col(text_col)).otherwise(rest)
    cut = joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    return clear.unionByName(cut)
