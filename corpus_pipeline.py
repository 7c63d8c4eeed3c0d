"""A document pipeline made of the operators of ``corpusfreq.llm``.

Every stage works on all that its predecessor kept. All but the last return the columns
of ``documents``; the last returns the token ids of every document that is left.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfreq.llm import decontaminate, langid, lines, pieces, setjoin
from corpusfreq.llm.store import shared_dir
from corpusfreq.llm.tokenizers import model_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; ``lang`` becomes the prediction.

    The classifier learns from the texts that have a language.
    """
    model = langid.fit(docs)
    judged = langid.predict(docs, model, keep=tuple(docs.columns), names=("__lang", "__score", "__unsure"))
    kept = judged.where(F.col("__lang") != langid.UNKNOWN)
    return kept.select(*[F.col("__lang").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; ``n_chars`` follows the text."""
    return lines.with_lengths(lines.drop_boilerplate(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one of least id stays."""
    return setjoin.keep_one_of_each(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule names go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    # The executors have run four stages before.
    return pieces.digest_documents(docs, model_file(), lean=True)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

# Classifier, set join and tokenizer have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = posixpath.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
