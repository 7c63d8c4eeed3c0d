"""Queries over whole texts: tokenizer and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfreq.llm import langid, pieces, secrets, toxicity
from corpusfreq.llm.folds import fold
from corpusfreq.llm.registry import query, table
from corpusfreq.llm.tokenizers import model_file


@query("op1_sentencepiece")
def op1(spark, sf_dir):
    return pieces.digest_documents(table(spark, sf_dir, "documents"), model_file())


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    model = langid.fit(docs.where(~held))
    judged = langid.predict(docs.withColumn("held_out", held), model, keep=("doc_id", "held_out"))
    return judged.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    judged = toxicity.score(docs.withColumn("held_out", held), lexicon, keep=("doc_id", "held_out"))
    return judged.select("doc_id", "held_out", "score", "predicted", "n_matches")


@query("op4_secret_scan")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit_on_documents(docs))
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count("random"),
    )
