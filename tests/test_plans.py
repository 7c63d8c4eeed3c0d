"""What a plan reads, stores and repeats."""

import pytest
from pyspark.sql import functions as F

from corpusfreq.operators import association as assoc
from corpusfreq.operators import collocates as co
from corpusfreq.operators import context as cx
from corpusfreq.operators import index as ix
from corpusfreq.plans.skew import Lookup, lookup_joins


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("share", [1, 4, 1000])
def test_rows_take_only_the_joins_they_wait_for(spark, share):
    keys = ["a", "a", "a", "b", "c", "d", None]
    rows = [(x, y, z) for x in keys for y in keys for z in keys]
    table = {"a": 50, "b": 20, "c": 2}
    items = spark.createDataFrame(list(table.items()), "item string, count long")
    df = spark.createDataFrame(rows, "x string, y string, z string")
    found = lookup_joins(df, [Lookup(items, {k: "item"}, "count", {f"c_{k}": "count"}) for k in "xyz"], share)
    want = [(*r, *[table.get(k) for k in r]) for r in rows]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    # A row that has its answer is not dealt to a random place of another lookup's join.
    assert "monotonically_increasing_id" not in plan(found)


def test_mle_matrix_reads_its_bigrams_once(spark, tmp_path):
    rows = [("a", "b", 3), ("a", "c", 1), ("b", "a", 2)]
    spark.createDataFrame(rows, "w1 string, w2 string, count long").write.parquet(str(tmp_path / "bigrams"))
    matrix = assoc.mle_matrix(spark.read.parquet(str(tmp_path / "bigrams")))
    assert not [f for f in matrix.inputFiles() if str(tmp_path) in f]
    assert sorted(map(tuple, matrix.collect())) == [("a", "b", 3, 0.75), ("a", "c", 1, 0.25)]


@pytest.mark.parametrize("trim_after", [False, True])
def test_a_context_is_measured_once(spark, trim_after):
    docs = spark.createDataFrame([(["aa", "b", "cccc", "dd"],)], "vector array<string>")
    found = cx.measured_contexts(docs, 4, trim_after=trim_after)
    assert plan(found).count("filter(") == 1
    got = [r["context"] for r in found.orderBy("ord").collect()]
    sums = [3, 5, 10, 13]
    words = ["aa", "b", "cccc", "dd"]
    brute = []
    for i in range(4):
        last = i if trim_after else i - 1
        held = [j for j in range(last + 1) if sums[last] - sums[j] <= 4]
        brute.append([words[j] for j in held] + ([] if trim_after else [words[i]]))
    assert got == brute


def test_the_folded_training_rows_are_stored(spark, tmp_path):
    from suite.model_queries import folded

    spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = folded(spark, str(tmp_path))
    assert not [f for f in rows.inputFiles() if str(tmp_path) in f]
    assert rows.agg(F.count("*")).first()[0] == 2


@pytest.mark.parametrize("sample", [False, True])
def test_a_pair_and_its_mirror_image_are_counted_under_one_key(spark, sample):
    words = [list("abacabadaa"), ["x", None, "x", "a", None, None], [], None, ["a", "a", "a"]]
    docs = spark.createDataFrame([(v,) for v in words], "vector array<string>")
    near = co.collocates(docs, 2, 3)
    stats = co.collocate_stats(near, sample)
    assert "avg(" not in plan(stats) and "var_" not in plan(stats)
    # The same rows with a distance that may be missing are counted pair by pair.
    plain = co.collocate_stats(near.withColumn("dist", F.when(F.col("dist") < 99, F.col("dist"))), sample)
    assert "avg(" in plan(plain) and stats.columns == plain.columns
    rounded = lambda df: sorted(
        (str(r.head), str(r.pair), r.n, round(r["mean"], 9), None if r.variance is None else round(r.variance, 9)) for r in df.collect()
    )
    assert rounded(stats) == rounded(plain) != []


def test_variances_far_from_zero_keep_their_digits(spark):
    rows = [("a", "b", 30_000 + i % 2) for i in range(1000)] + [("b", "a", -30_000)] * 3
    near = spark.createDataFrame(rows, "head string, pair string, dist int")
    stats = co.collocate_stats(near.withColumn("dist", F.coalesce("dist", F.lit(0))))
    assert "avg(" not in plan(stats)
    assert sorted(map(tuple, stats.collect())) == [("a", "b", 1000, 30_000.5, 0.25), ("b", "a", 3, -30_000.0, 0.0)]


def test_postings_are_sorted_without_a_comparator(spark):
    docs = spark.createDataFrame([(1, "b a\nb A b"), (2, None), (3, "")], "doc_id int, text string")
    nested = ix.document_postings(docs)
    assert "array_sort(" not in plan(nested)
    got = {(r.norm, r.doc_id): [tuple(p) for p in r.postings] for r in nested.collect()}
    assert got == {("a", 1): [(0, 2, 3), (1, 2, 3)], ("b", 1): [(0, 0, 1), (1, 0, 1), (1, 4, 5)]}


def test_the_documents_are_dealt_to_more_tasks_as_they_grow(spark, tmp_path, monkeypatch):
    from suite import registry

    rows = [(i, None if i == 7 else "x" * 100) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert registry.documents(spark, str(tmp_path)).rdd.getNumPartitions() == cores
    monkeypatch.setattr(registry, "TASK_BYTES", 2000)
    docs = registry.documents(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() >= 99_900 / 2000 > cores
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(rows, key=str)
