"""Results that every micro-batch extends: a vocabulary and a classifier's counts.

Each batch writes a folder of its own, named by the batch's id, from what earlier batches
left and its own rows. A batch that is repeated after a failure overwrites that folder with
the same content, so nothing is counted or numbered twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusfreq.operators.bayes import BayesCounts, posteriors, to_training, train
from corpusfreq.operators.tokens import StopWords
from corpusfreq.plans.ranking import dense_index

# Batches whose counts are read one by one before they are merged into one table.
MERGE_EVERY = 16

VOCABULARY = "item string, ix bigint, count bigint, batch bigint"
LABELS = "label string, count bigint, batch bigint"
FEATURES = "label string, feature string, value boolean, count bigint, batch bigint"


def _each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The folders of all batches under ``path``; none yet is an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def add_to_vocab(
    batch: DataFrame, batch_id: int, path: str, item: str = "norm", order_by: Sequence[str] = ("doc_id", "ord")
) -> None:
    """Number the items of a batch that no earlier batch held, in first-seen order.

    Ids of earlier batches never change. Null items are left out.
    """
    known = _read(batch.sparkSession, path, VOCABULARY).where(F.col("batch") < batch_id)
    size = known.agg(F.coalesce(F.max("ix") + 1, F.lit(0))).first()[0]
    seen = batch.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(
        F.min(F.struct(*order_by)).alias("__first"), F.count("*").alias("count")
    )
    fresh = seen.join(known.select(F.col("item").alias("__known")), F.col("item") == F.col("__known"), "left_anti")
    added = dense_index(fresh, ["__first", "item"], out="ix", start=size)
    added.select("item", F.col("ix").cast("long"), "count").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def vocab_from(
    tokens: DataFrame, path: str, checkpoint: str, item: str = "norm", order_by: Sequence[str] = ("doc_id", "ord")
) -> StreamingQuery:
    """Extend the vocabulary under ``path`` with the items of a stream."""
    return _each_batch(tokens, lambda batch, i: add_to_vocab(batch, i, path, item, order_by), checkpoint)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``item, ix, count``: ids, and the frequency in the batch that brought the item."""
    return _read(spark, path, VOCABULARY).drop("batch")


def add_to_model(batch: DataFrame, batch_id: int, path: str, merge_every: int = MERGE_EVERY) -> None:
    """Store the counts of a batch of training rows; now and then merge those stored so far."""
    kept = batch.persist()
    try:
        counts = train(kept)
        counts.features.write.mode("overwrite").parquet(f"{path}/features/batch={batch_id}")
        counts.labels.write.mode("overwrite").parquet(f"{path}/labels/batch={batch_id}")
    finally:
        kept.unpersist()
    if merge_every and (batch_id + 1) % merge_every == 0:
        merged = model(batch.sparkSession, path, batch_id, before=True)
        merged.features.write.mode("overwrite").parquet(f"{path}/merged_features/batch={batch_id}")
        # A merge counts as soon as its labels are there, so they come last.
        merged.labels.write.mode("overwrite").parquet(f"{path}/merged_labels/batch={batch_id}")


def train_from(training: DataFrame, path: str, checkpoint: str, merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Train on a stream of rows as ``to_training`` makes them."""
    return _each_batch(training, lambda batch, i: add_to_model(batch, i, path, merge_every), checkpoint)


def newest(spark: SparkSession, path: str) -> int:
    """The last batch that the model under ``path`` holds, -1 if none."""
    return _read(spark, f"{path}/labels", LABELS).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def model(spark: SparkSession, path: str, upto: int | None = None, before: bool = False) -> BayesCounts:
    """The counts of all batches, or of those up to ``upto``.

    The last merged table and the batches behind it are added up; with ``before`` only
    tables merged before ``upto`` are used, since that one is being made.
    """
    last = newest(spark, path) if upto is None else upto
    merged = _read(spark, f"{path}/merged_labels", LABELS).where(F.col("batch") < last + (0 if before else 1))
    base = merged.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def summed(name: str, schema: str) -> DataFrame:
        since = _read(spark, f"{path}/{name}", schema).where((F.col("batch") > base) & (F.col("batch") <= last))
        whole = since if base < 0 else since.unionByName(_read(spark, f"{path}/merged_{name}", schema).where(F.col("batch") == base))
        return whole.groupBy(*[c for c in whole.columns if c not in ("count", "batch")]).agg(F.sum("count").alias("count"))

    return BayesCounts(summed("labels", LABELS), summed("features", FEATURES))


def classify_batch(
    batch: DataFrame, batch_id: int, model_path: str, out: str, doc: str = "doc_id", text: str = "text", stop: StopWords = None
) -> None:
    """Score a batch with the newest model; a repeated batch takes the model it took before."""
    spark = batch.sparkSession
    taken = _read(spark, f"{out}/versions", "version bigint, batch bigint").where(F.col("batch") == batch_id).first()
    if taken is None:
        version = newest(spark, model_path)
        spark.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("overwrite").parquet(f"{out}/versions/batch={batch_id}")
    else:
        version = taken["version"]
    scores = posteriors(model(spark, model_path, version), to_training(batch, F.lit("?"), doc, text, stop), doc)
    scores.write.mode("overwrite").parquet(f"{out}/scores/batch={batch_id}")


def classify_from(
    docs: DataFrame, model_path: str, out: str, checkpoint: str, doc: str = "doc_id", text: str = "text", stop: StopWords = None
) -> StreamingQuery:
    """Score arriving documents with the model that another stream may still be training."""
    return _each_batch(docs, lambda batch, i: classify_batch(batch, i, model_path, out, doc, text, stop), checkpoint)


def scored(spark: SparkSession, out: str) -> DataFrame:
    """What ``classify_from`` has written: ``doc_id, scores`` as ``posteriors`` gives them."""
    return spark.read.parquet(f"{out}/scores").drop("batch")
