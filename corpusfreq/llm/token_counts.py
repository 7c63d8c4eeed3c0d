"""Token counts by a cache of digests.

A count depends on the text and on the tokenizer, so it is stored under the SHA-256 of the
normalised text and the digest of the tokenizer's version (its file, its kind and the
release of its library). A call joins the digests of its documents to the stored counts,
encodes each text that is missing once, however many rows hold it, appends the new counts
and joins all counts back to the rows.

* Only digests are joined: 32 bytes a row. Of the texts, those that a blocked Bloom filter
  of the missing digests lets through are shuffled, one copy of each from every task.
* A cache is a folder of Parquet files, one part for each tokenizer version. Two calls at
  the same time may both append a text; every reader takes one row of a digest, and the
  counts are equal. An append that does not end shows nothing or whole files; whatever is
  missing is counted by the next call.
* A digest that stands in a third of all rows is encoded once; the join back leaves it to
  adaptive skew handling, since both of its sides are plain shuffles.

By default the normalised text is the text itself, a null one being empty. Another
normalisation may only unite texts that the tokenizer counts alike.

Defined cases: a null text counts as empty, with 0 bytes and 0 tokens; texts of any length
are encoded whole; every row gets its count, repeated rows and null ids too; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfreq.llm.sieve import split
from corpusfreq.llm.store import stored
from corpusfreq.llm.wordwise import ByteLevelWords
from corpusfreq.llm.workers import held, package_path, task

SCHEMA = "digest binary, n_tokens bigint"
# Texts are encoded together until they have this many characters; a longer one goes alone.
CHUNK_CHARS = 1 << 18


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


class Counter:
    """Counts tokens as the library of a tokenizer file does by default."""

    def __init__(self, kind: str, content: bytes):
        if kind == ".json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import tokenizers

            self.model = tokenizers.Tokenizer.from_buffer(content)
            self.model.no_truncation()
            self.model.no_padding()
            words = ByteLevelWords(self.model)
            self.count = lambda texts: [len(ids) // 4 for ids in words.ids(texts)]
        elif kind == ".model":
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.count = lambda texts: [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no library for a tokenizer file of kind {kind!r}")


class TokenizerFile:
    """A tokenizer file as the driver reads it; its bytes are broadcast, a few megabytes."""

    def __init__(self, path: str):
        self.kind = os.path.splitext(path)[1]
        with open(path, "rb") as f:
            self.content = f.read()
        self.version = self._version()

    def _version(self) -> str:
        """Digest of all that a count depends on besides the text."""
        if self.kind == ".json":
            import tokenizers as library
        elif self.kind == ".model":
            import sentencepiece as library
        else:
            raise ValueError(f"no library for a tokenizer file of kind {self.kind!r}")
        named = f"{self.kind} {library.__name__} {library.__version__} plain ".encode()
        return hashlib.sha256(named + self.content).hexdigest()


def runs(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The texts in runs of at most ``limit`` characters, or of one text."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _encode(texts: DataFrame, tokenizer: TokenizerFile) -> DataFrame:
    """(digest, n_tokens) of (digest, content)."""
    package_path(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast((tokenizer.kind, tokenizer.content))
    version = tokenizer.version

    @task("token_counts")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held("token_counts", version, lambda: Counter(*shared.value))
        for batch in batches:
            counts = [n for part in runs(batch.column(1).to_pylist()) for n in counter.count(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "content").mapInArrow(run, SCHEMA)


def part_of(cache: str, tokenizer: TokenizerFile) -> str:
    """The folder of a tokenizer version in a cache."""
    return f"{cache.rstrip('/')}/version={tokenizer.version}"


def cached(spark: SparkSession, cache: str, tokenizer: TokenizerFile) -> DataFrame:
    """(digest, n_tokens) stored for the tokenizer version; a digest may stand there twice."""
    try:
        return spark.read.schema(SCHEMA).parquet(part_of(cache, tokenizer))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = whole_text,
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; counts that ``cache`` lacks are appended to it.

    ``n_bytes`` is the length of the text itself in UTF-8.
    """
    spark = docs.sparkSession
    tokenizer = TokenizerFile(tokenizer_path)
    content = normalise(F.col(text_col))
    digest = F.unhex(F.sha2(content, 256))
    keyed = docs.select(
        F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        digest.alias("digest"),
    )
    keyed = stored(keyed, "digests")
    # One row for each digest of this call, with the stored count if there is one.
    known = cached(spark, cache, tokenizer).withColumnRenamed("digest", "known")
    wanted = keyed.select("digest").distinct().join(known, F.col("digest") == F.col("known"), "left")
    wanted = stored(wanted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "wanted")
    missing = wanted.where("n_tokens IS NULL").select(F.col("digest").alias("missing"))

    texts = docs.select(content.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    _, maybe = split(texts, F.col("digest"), missing, "missing")
    single = maybe.groupBy("digest").agg(F.first("content").alias("content"))
    misses = single.join(missing, F.col("digest") == F.col("missing"), "left_semi")
    fresh = stored(_encode(misses, tokenizer), "fresh")
    fresh.write.mode("append").parquet(part_of(cache, tokenizer))

    counts = wanted.where("n_tokens IS NOT NULL").unionByName(fresh).select(F.col("digest").alias("d"), "n_tokens")
    return keyed.join(counts, F.col("digest") == F.col("d"), "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
