import pytest
from pyspark.sql import functions as F

from corpusfreq.operators import bayes as nb
from corpusfreq.operators import tokens as tk
from corpusfreq.operators import vocab as vo
from corpusfreq.streaming import batches as ba
from corpusfreq.streaming import streams as sr
from corpusfreq.streaming import windows as wi

DOCS = [
    (0, "ham", "lunch at noon today"),
    (1, "spam", "win money now money"),
    (2, "ham", "the noon meeting is now"),
    (3, "spam", "money for nothing"),
    (4, "ham", ""),
    (5, "spam", "win a lunch"),
]
SCHEMA = "doc_id int, label string, text string"


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def arriving(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def end(query):
    query.awaitTermination(240)
    assert query.exception() is None
    return query


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_windows_close_and_leave_no_state(spark, tmp_path):
    """Ten hours, one file each; windows of an hour, half an hour of lateness."""
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "ts timestamp, norm string, v double"
    at = lambda h, m: F.expr(f"timestamp'2024-01-01 {h:02d}:{m:02d}:00'")
    sizes = []

    def run():
        stream = wi.windowed_frequencies(arriving(spark, path, schema), "ts", "1 hour", "30 minutes")
        query = end(sr.append_to(stream, out, f"{tmp_path}/progress"))
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    for h in range(10):
        rows = spark.range(20).select(at(h, 20).alias("ts"), F.concat(F.lit(f"w{h}-"), "id").alias("norm"), F.lit(1.0).alias("v"))
        if h == 3:  # within the allowed lateness: window 2 is still open
            rows = rows.unionByName(spark.range(1).select(at(2, 59).alias("ts"), F.lit("w2-0").alias("norm"), F.lit(1.0).alias("v")))
        if h == 6:  # too late: window 0 has been emitted; and a row without time
            for t in (at(0, 10), F.lit(None).cast("timestamp")):
                rows = rows.unionByName(spark.range(1).select(t.alias("ts"), F.lit("w0-0").alias("norm"), F.lit(1.0).alias("v")))
        rows.coalesce(1).write.mode("append").parquet(path)
        if h in (2, 5, 9):
            run()
    assert max(sizes) <= 45  # two open windows, not two hundred keys
    got = {(r["start"].hour, r["item"]): r["count"] for r in spark.read.parquet(out).collect()}
    # The watermark stands at 8:50, so the windows up to 7-8 are closed.
    want = {(h, f"w{h}-{k}"): 1 for h in range(8) for k in range(20)}
    want[2, "w2-0"] = 2
    assert got == want


def test_windowed_statistics(spark, tmp_path):
    path, schema = f"{tmp_path}/in", "ts timestamp, kind string, v double"
    rows = [(f"2024-01-01 0{h}:30:00", k, float(h + i)) for h in range(4) for i, k in enumerate("aab")]
    frame = spark.createDataFrame(rows, "ts string, kind string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.coalesce(1).write.parquet(path)
    stream = wi.windowed_summary_by(arriving(spark, path, schema), "v", "ts", "2 hours", "0 minutes", "1 hour", kind="kind")
    end(sr.append_to(stream, f"{tmp_path}/out", f"{tmp_path}/progress"))
    got = {(r["start"].hour, r["kind"]): (r["n"], r["mean"], r["variance"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # Windows start every hour; those that end by 3:30 are closed.
    assert got[0, "a"] == pytest.approx((4, 1.0, 2 / 3))
    assert got[1, "b"] == (2, 3.5, 0.5)
    assert {h for h, _ in got} == {23, 0, 1}


def test_a_vocabulary_keeps_its_ids(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/vocab"
    tokens = lambda: tk.tokenizer(arriving(spark, path, SCHEMA))
    for part in (DOCS[:2], DOCS[2:3]):
        write(spark, path, part, SCHEMA)
    end(ba.vocab_from(tokens(), out, f"{tmp_path}/progress"))
    first = rows_of(ba.vocabulary(spark, out))
    write(spark, path, DOCS[3:], SCHEMA)
    end(ba.vocab_from(tokens(), out, f"{tmp_path}/progress"))
    got = rows_of(ba.vocabulary(spark, out))
    assert set(first) <= set(got)
    # The same as extending a vocabulary table by table.
    want = vo.build_vocab(tk.tokenizer(spark.createDataFrame(DOCS[:2], SCHEMA)))
    for part in (DOCS[2:3], DOCS[3:]):
        want = vo.extend_vocab(want, tk.tokenizer(spark.createDataFrame(part, SCHEMA)))
    assert got == rows_of(want)
    # A repeated batch, even one with later batches behind it, changes nothing.
    for i, part in ((2, DOCS[3:]), (1, DOCS[2:3])):
        ba.add_to_vocab(tk.tokenizer(spark.createDataFrame(part, SCHEMA)), i, out)
    assert rows_of(ba.vocabulary(spark, out)) == got


@pytest.mark.parametrize("merge_every", [0, 2])
def test_training_and_classifying_streams(spark, tmp_path, merge_every):
    path, kept, out = f"{tmp_path}/in", f"{tmp_path}/model", f"{tmp_path}/out"
    training = lambda: nb.to_training(arriving(spark, path, SCHEMA))
    for part in (DOCS[:2], DOCS[2:4]):
        write(spark, path, part, SCHEMA)
    end(ba.train_from(training(), kept, f"{tmp_path}/progress", merge_every))
    # Some are scored by the model of two batches, the others by that of three.
    asked = f"{tmp_path}/asked"
    write(spark, asked, DOCS[:3], SCHEMA)
    end(ba.classify_from(arriving(spark, asked, SCHEMA), kept, out, f"{tmp_path}/asked-progress"))
    write(spark, path, DOCS[4:], SCHEMA)
    end(ba.train_from(training(), kept, f"{tmp_path}/progress", merge_every))
    write(spark, asked, DOCS[3:], SCHEMA)
    end(ba.classify_from(arriving(spark, asked, SCHEMA), kept, out, f"{tmp_path}/asked-progress"))

    def batch(rows, test):
        counts = nb.train(nb.to_training(spark.createDataFrame(rows, SCHEMA)))
        return nb.posteriors(counts, nb.to_training(spark.createDataFrame(test, SCHEMA), F.lit("?")))

    rounded = lambda df: {(r["doc_id"], r["label"]): (round(r["score"], 9), round(r["p"], 9)) for r in nb.classify_proba(df).collect()}
    want = {**rounded(batch(DOCS[:4], DOCS[:3])), **rounded(batch(DOCS, DOCS[3:]))}
    assert rounded(ba.scored(spark, out)) == want
    counts = ba.model(spark, kept)
    whole = nb.train(nb.to_training(spark.createDataFrame(DOCS, SCHEMA)))
    assert rows_of(counts.features) == rows_of(whole.features.select(counts.features.columns))
    assert rows_of(counts.labels) == rows_of(whole.labels)
    # Repeated batches change neither the model nor the scores already given.
    ba.add_to_model(nb.to_training(spark.createDataFrame(DOCS[2:4], SCHEMA)), 1, kept, merge_every)
    ba.classify_batch(spark.createDataFrame(DOCS[:3], SCHEMA), 0, kept, out)
    assert rows_of(ba.model(spark, kept).features) == rows_of(counts.features)
    assert rounded(ba.scored(spark, out)) == want


def test_a_model_of_nothing(spark, tmp_path):
    assert ba.newest(spark, f"{tmp_path}/none") == -1
    assert ba.model(spark, f"{tmp_path}/none").features.count() == 0
