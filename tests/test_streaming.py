import shutil

import pytest
from pyspark.sql import functions as F

from corpusfreq.operators import collocates as co
from corpusfreq.operators import freqs as fr
from corpusfreq.operators import ngrams as ng
from corpusfreq.operators import stats as st
from corpusfreq.operators import tokens as tk
from corpusfreq.streaming import streams as sr

TEXTS = ["The cat sat\non the mat", "a dog", "The end\nof the The", "x", "the dog the cat"]


@pytest.fixture
def source(spark, tmp_path):
    """Several files, so that a stream sees several micro-batches."""
    schema = "doc_id int, line int, text string"
    for i, t in enumerate(TEXTS):
        rows = spark.createDataFrame([(i, 3, t)], schema)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def open_stream():
        return (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", 2)
            .parquet(str(tmp_path / "in"))
        )

    return open_stream, spark.read.parquet(str(tmp_path / "in")), tmp_path


def run(query):
    query.awaitTermination(120)
    assert not query.isActive and query.exception() is None


def same(a, b):
    assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_stateless_streams(spark, source):
    open_stream, batch, tmp = source
    stop = spark.createDataFrame([("the",)], "norm string")
    vectors = tk.corpus_vectors(batch)
    cases = {
        "tokens": (
            sr.stream_tokens(open_stream()),
            tk.tokenizer(batch, offset=3).drop("ord"),
        ),
        "stopped": (
            sr.stream_tokens(open_stream(), stop=stop),
            tk.tokenizer(batch, stop=["the"], offset=3).drop("ord"),
        ),
        "ngrams": (sr.stream_ngrams(open_stream(), 2), ng.ngrams(vectors, 2, keep=["doc_id"])),
        "collocates": (
            sr.stream_collocates(open_stream(), "the", 1, 2),
            co.get_collocates(vectors, "the", 1, 2),
        ),
        "documents": (
            sr.stream_docs_for_token(
                sr.stream_tokens(open_stream()), batch.where("doc_id < 4"), "the", columns=["text"]
            ).select("doc_id", "start", "text"),
            tk.tokenizer(batch, keep=["text"])
            .where("norm = 'the' and doc_id < 4")
            .select("doc_id", "start", "text"),
        ),
    }
    for name, (stream, expected) in cases.items():
        run(sr.append_to(stream, str(tmp / name), str(tmp / f"{name}-checkpoint")))
        same(spark.read.parquet(str(tmp / name)), expected)


def test_stateful_streams(spark, source):
    open_stream, batch, tmp = source
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    sr.use_disk_state(spark)
    try:
        counts = sr.stream_frequencies(sr.stream_tokens(open_stream()))
        run(sr.updates_to(counts, str(tmp / "counts"), str(tmp / "counts-cp")))
        same(
            sr.latest_updates(spark, str(tmp / "counts"), ["item"]),
            fr.frequencies(tk.tokenizer(batch)),
        )
        lengths = F.length("norm")
        stats = sr.stream_summary_by(sr.stream_tokens(open_stream()), "start", size=lengths)
        run(sr.updates_to(stats, str(tmp / "stats"), str(tmp / "stats-cp")))
        got = sr.latest_updates(spark, str(tmp / "stats"), ["size"])
        want = st.summary_stats_by(tk.tokenizer(batch), "start", size=lengths)
        rounded = lambda df: df.select(
            "size", "n", F.round("mean", 9).alias("m"), F.round("variance", 9).alias("v")
        )
        assert set(rounded(got).collect()) == set(rounded(want).collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_second_run_continues_the_counts(spark, source):
    """The state outlives a run: files that arrive later add to what was counted."""
    open_stream, batch, tmp = source
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    sr.use_disk_state(spark)
    try:
        def go():
            counts = sr.stream_frequencies(sr.stream_tokens(open_stream()))
            run(sr.updates_to(counts, str(tmp / "counts"), str(tmp / "counts-cp")))
            return sr.latest_updates(spark, str(tmp / "counts"), ["item"])

        same(go(), fr.frequencies(tk.tokenizer(batch)))
        later = spark.createDataFrame([(9, 0, "the new cat")], batch.schema)
        later.coalesce(1).write.mode("append").parquet(str(tmp / "in"))
        whole = spark.read.parquet(str(tmp / "in"))
        assert whole.count() == len(TEXTS) + 1
        same(go(), fr.frequencies(tk.tokenizer(whole)))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("parts", [1, 3])
def test_a_table_arrives_as_one_file_and_as_a_folder(spark, tmp_path, parts):
    """The stream queries read a table that is a file, or a folder of part files."""
    from suite.stream_queries import arriving, arriving_events

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    events = spark.createDataFrame([(i,) for i in range(5)], "event_id int")
    for name, rows in (("documents", docs), ("events", events)):
        at = tmp_path / f"{name}.parquet"
        folder = tmp_path / f"parts-{name}" if parts == 1 else at
        rows.repartition(parts).write.parquet(str(folder))
        if parts == 1:
            shutil.copy(*folder.glob("part-*.parquet"), at)
    for name, stream, rows in (("d", arriving, docs), ("e", arriving_events, events)):
        run(sr.append_to(stream(spark, str(tmp_path)), str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")))
        same(spark.read.parquet(str(tmp_path / name)), rows)
