"""Structured Streaming forms.

Tokenising, n-grams, collocates and concordances work inside one row, so the batch
operators run on a stream as they are; this module adds what is specific to
streams. Input rows carry their document id and line number, because files of a
stream arrive in no order.

Counting and statistics keep one state entry per key. The state grows with the
vocabulary, not with the stream; put it on disk with the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusfreq.functions.text import line_tokens, matches, norms
from corpusfreq.operators.collocates import get_collocates
from corpusfreq.operators.freqs import frequencies
from corpusfreq.operators.ngrams import ngrams
from corpusfreq.operators.stats import summary_stats_by
from corpusfreq.operators.tokens import StopWords, _as_list, explode_tokens, remove_stop_words

# Fixed value: the state store that keeps large state on local disk.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_tokens(
    chunks: DataFrame,
    doc: str = "doc_id",
    line: str = "line",
    text: str = "text",
    lower: bool = True,
    stop: StopWords = None,
) -> DataFrame:
    """Tokens of a stream of numbered text chunks.

    A chunk's number is the line number of its first line. A stop list given as a
    table becomes a stream-static anti join.
    """
    tokens = line_tokens(F.col(text), lower=lower, offset=F.col(line), stop=_as_list(stop))
    rows = explode_tokens(chunks.select(doc, tokens.alias("tokens")), keep=(doc,)).drop("ord")
    return remove_stop_words(rows, stop) if isinstance(stop, DataFrame) else rows


def stream_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lower-cased words of a stream of texts, without positions."""
    words = docs.select(F.explode(matches(F.col(text))).alias("w"))
    return words.select(F.lower("w").alias("norm"))


def stream_frequencies(tokens: DataFrame, item: str | Column = "norm") -> DataFrame:
    """Running counts; write them in update mode."""
    return frequencies(tokens, item)


def stream_summary_by(df: DataFrame, value: str | Column, **keys: str | Column) -> DataFrame:
    """Running count, mean and sample variance per key."""
    return summary_stats_by(df, value, **keys)


def stream_collocates(
    docs: DataFrame, target: str, before: int, after: int, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Collocates of a token in each arriving document."""
    vectors = docs.select(doc, norms(F.col(text)).alias("vector"))
    return get_collocates(vectors, target, before, after, "vector", doc)


def stream_docs_for_token(
    postings: DataFrame, docs: DataFrame, target: str, doc: str = "doc_id", columns: Sequence[str] = ()
) -> DataFrame:
    """Arriving postings of a token, joined with a static document table."""
    known = docs.select(F.col(doc).alias("__doc"), *columns)
    hits = postings.where(F.col("norm") == target)
    return hits.join(known, F.col(doc) == F.col("__doc")).drop("__doc")


def stream_ngrams(
    docs: DataFrame, n: int, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """N-grams of each arriving document; one shorter than n yields none."""
    vectors = docs.select(doc, norms(F.col(text)).alias("vector"))
    return ngrams(vectors, n, keep=(doc,))


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows of a stateless stream as Parquet, each exactly once."""
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


def updates_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changed rows of each micro-batch into a folder of that batch.

    Overwriting the folder makes a repeated batch harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The current result: for every key the row of its last batch."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__row"))
    return latest.select(*keys, "__row.*")
