"""Near-duplicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfreq.llm import setjoin
from corpusfreq.llm.registry import query, table


@query("op3_ngram_jaccard_join")
def op3(spark, sf_dir):
    found = setjoin.linked_components(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))
