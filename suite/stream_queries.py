"""Streams over the documents: each query runs to the end of the input, then reads
what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfreq.operators import bayes as nb
from corpusfreq.operators.tokens import corpus_vectors
from corpusfreq.session import new_shared_path
from corpusfreq.sources.corpus import stop_words
from corpusfreq.streaming import batches as ba
from corpusfreq.streaming import chunks as ch
from corpusfreq.streaming import streams as sr
from corpusfreq.streaming import windows as wi
from suite.count_queries import NEAR, grams_sql, rounded_stat, stat_sql
from suite.model_queries import LABELLED, SCORED, rounded
from suite.registry import BENCH_WORDS, FREQS, TOKENS, documents, query, table
from suite.text_queries import TARGET, VOCAB_SQL, vector_words


def arriving_table(spark, sf, name):
    """The rows of a table as a stream of files.

    A stream reads a folder or a pattern, not a single file; the pattern finds the table
    as one file and as a folder of part files.
    """
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def arriving(spark, sf):
    """The documents as a stream of files."""
    return (
        arriving_table(spark, sf, "documents")
        .select("doc_id", "text")
        # The test input is one file with one row group.
        .repartition(spark.sparkContext.defaultParallelism, "doc_id")
    )


def arriving_lines(spark, sf):
    lines = F.posexplode(F.split("text", "\n", -1)).alias("line", "text")
    return arriving(spark, sf).select("doc_id", lines)


def appended(spark, stream):
    path, checkpoint = new_shared_path(spark, "stream"), new_shared_path(spark, "progress")
    sr.append_to(stream, path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


def updated(spark, stream, keys):
    """Counting keeps state per key, so it goes to disk."""
    sr.use_disk_state(spark)
    path, checkpoint = new_shared_path(spark, "stream"), new_shared_path(spark, "progress")
    sr.updates_to(stream, path, checkpoint).awaitTermination()
    return sr.latest_updates(spark, path, keys)


@query(
    "b7_tokenize_stream",
    f'WITH {TOKENS} SELECT doc_id, word AS norm, line, start, "end" FROM tokens',
)
def b7(spark, sf):
    """Tokens as written, from a stream of numbered lines."""
    return appended(spark, sr.stream_tokens(arriving_lines(spark, sf), lower=False))


@query(
    "m1_stream_tokens",
    f"""
    WITH {TOKENS}, {BENCH_WORDS}
    SELECT doc_id, norm, line, start, "end" FROM tokens WHERE norm NOT IN (SELECT norm FROM bench)
    """,
)
def m1(spark, sf):
    """Lower-cased and without the words of a static stop table."""
    stop = stop_words(table(spark, sf, "benchmark"), "text")
    return appended(spark, sr.stream_tokens(arriving_lines(spark, sf), stop=stop))


@query("m2_stream_frequencies", f"WITH {FREQS} SELECT item, count FROM freqs")
def m2(spark, sf):
    words = sr.stream_words(arriving(spark, sf))
    return updated(spark, sr.stream_frequencies(words), ["item"])


@query(
    "m3_stream_summary_by",
    f"""
    WITH {TOKENS}
    SELECT length(norm)::INT AS size, count(*) AS n, {stat_sql("avg(start)")} AS mean,
           {stat_sql("var_samp(start) / 1e6")} AS variance FROM tokens GROUP BY 1
    """,
)
def m3(spark, sf):
    """Where in their lines words of each length start."""
    tokens = sr.stream_tokens(arriving_lines(spark, sf))
    stats = updated(spark, sr.stream_summary_by(tokens, "start", size=F.length("norm")), ["size"])
    stats = stats.withColumn("variance", F.col("variance") / 1e6)
    return stats.select("size", "n", rounded_stat("mean"), rounded_stat("variance"))


@query(
    "m4_stream_collocates",
    f"WITH {NEAR} SELECT doc_id, ord::INT AS ord, head, pair, dist::INT AS dist FROM near",
)
def m4(spark, sf):
    return appended(spark, sr.stream_collocates(arriving(spark, sf), TARGET, 0, 3))


@query(
    "m4_stream_docs_for_token",
    f"""
    WITH {TOKENS}
    SELECT doc_id, norm, line, start, "end", lang FROM tokens JOIN documents USING (doc_id)
    WHERE norm = '{TARGET}'
    """,
)
def m4_docs(spark, sf):
    """Arriving postings joined with a static document table."""
    tokens = sr.stream_tokens(arriving_lines(spark, sf))
    return appended(spark, sr.stream_docs_for_token(tokens, documents(spark, sf), TARGET, columns=["lang"]))


@query("m5_stream_ngrams", f"WITH {grams_sql(2)} SELECT doc_id, w1, w2 FROM ngrams")
def m5(spark, sf):
    return appended(spark, sr.stream_ngrams(arriving(spark, sf), 2))


@query("f3_ngrams_stream", f"WITH {grams_sql(3)} SELECT doc_id, w1, w2, w3 FROM ngrams")
def f3(spark, sf):
    return appended(spark, sr.stream_ngrams(arriving(spark, sf), 3))


# --- state: chunks, windows, vocabularies, classifiers -----------------------

# Characters of a chunk, and files that its chunks are dealt to by their number, so that
# chunks of a document arrive out of order and in several micro-batches.
CHUNK_CHARS, CHUNK_FILES = 400, 4


def arriving_chunks(spark, sf):
    text = F.coalesce(F.col("text"), F.lit(""))
    count = F.greatest(F.ceil(F.length(text) / F.lit(CHUNK_CHARS)), F.lit(1))
    cut = lambda k: F.struct(
        k.alias("chunk"), F.substring(text, k * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)).alias("text"), (k == count - 1).alias("last")
    )
    chunks = documents(spark, sf).select("doc_id", F.inline(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), cut)))
    path = new_shared_path(spark, "chunks")
    # Each of these files is dealt to several tasks, which write a part of it.
    parts = max(spark.sparkContext.defaultParallelism // CHUNK_FILES, 1)
    dealt = [F.col("chunk") % CHUNK_FILES, F.pmod(F.hash("doc_id"), F.lit(parts))]
    chunks.repartition(CHUNK_FILES * parts, *dealt).write.parquet(path)
    return spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 2 * parts).parquet(path)


@query("f3_ngrams_of_chunks", f"WITH {grams_sql(3)} SELECT doc_id, w1, w2, w3 FROM ngrams")
def f3_chunks(spark, sf):
    """N-grams that go on across the chunks of a document."""
    return appended(spark, ch.chunk_ngrams(arriving_chunks(spark, sf), 3))


@query("m5_ngrams_of_chunks", f"WITH {grams_sql(2)} SELECT doc_id, w1, w2 FROM ngrams")
def m5_chunks(spark, sf):
    return appended(spark, ch.chunk_ngrams(arriving_chunks(spark, sf), 2))


@query(
    "b7_tokenize_chunks",
    f'WITH {TOKENS} SELECT doc_id, ord::BIGINT AS ord, word AS norm, line, start, "end" FROM tokens',
)
def b7_chunks(spark, sf):
    """Tokens with lines and offsets counted through the chunks of a document."""
    return appended(spark, ch.chunk_tokens(arriving_chunks(spark, sf), lower=False))


@query(
    "m1_tokens_of_chunks",
    f"""
    WITH {TOKENS}, {BENCH_WORDS}
    SELECT doc_id, ord::BIGINT AS ord, norm, line, start, "end" FROM tokens WHERE norm NOT IN (SELECT norm FROM bench)
    """,
)
def m1_chunks(spark, sf):
    stop = stop_words(table(spark, sf, "benchmark"), "text")
    return appended(spark, ch.chunk_tokens(arriving_chunks(spark, sf), stop=stop))


def arriving_events(spark, sf):
    return arriving_table(spark, sf, "events")


def closed(length: str, late: str) -> str:
    """Windows of events that the watermark has passed at the end of the input."""
    return f"""
    timed AS (SELECT *, time_bucket(INTERVAL '{length}', ts, TIMESTAMP '1970-01-01') AS opens FROM events),
    done AS (SELECT * FROM timed
             WHERE opens + INTERVAL '{length}' <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '{late}' FROM events))
    """


@query(
    "m2_windowed_frequencies",
    f"""
    WITH {closed("6 hours", "1 hour")}
    SELECT strftime(opens, '%Y-%m-%d %H') AS "window", event_type AS item, count(*) AS count FROM done GROUP BY 1, 2
    """,
)
def m2_windows(spark, sf):
    """Event types in windows of six hours; the state holds only open windows."""
    counts = wi.windowed_frequencies(arriving_events(spark, sf), "ts", "6 hours", "1 hour", "event_type")
    kept = appended(spark, counts)
    return kept.select(F.date_format("start", "yyyy-MM-dd HH").alias("window"), "item", "count")


@query(
    "m3_windowed_summary",
    f"""
    WITH {closed("1 day", "1 hour")}
    SELECT strftime(opens, '%Y-%m-%d') AS day, event_type, count(*) AS n, {stat_sql("avg(value)")} AS mean,
           {stat_sql("var_samp(value)")} AS variance FROM done GROUP BY 1, 2
    """,
)
def m3_windows(spark, sf):
    stats = wi.windowed_summary_by(arriving_events(spark, sf), "value", "ts", "1 day", "1 hour", event_type="event_type")
    kept = appended(spark, stats)
    return kept.select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", rounded_stat("mean"), rounded_stat("variance")
    )


@query(
    "d5_stream_vocab",
    f"""
    WITH {VOCAB_SQL}, {BENCH_WORDS},
    news AS (SELECT norm, item_id, ord FROM bench WHERE norm NOT IN (SELECT item FROM vocab)
             QUALIFY row_number() OVER (PARTITION BY norm ORDER BY item_id, ord) = 1)
    SELECT item, ix FROM vocab UNION ALL
    SELECT norm, (SELECT max(ix) FROM vocab) + row_number() OVER (ORDER BY item_id, ord) FROM news
    """,
)
def d5_stream(spark, sf):
    """The documents arrive first, the benchmark's texts in a later run of the same stream."""
    arrived, vocab, progress = (new_shared_path(spark, x) for x in ("texts", "vocab", "progress"))
    parts = [documents(spark, sf).select("doc_id", "text"), table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")]
    for part in parts:
        part.write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(part.schema).parquet(arrived)
        ba.vocab_from(vector_words(corpus_vectors(stream)), vocab, progress).awaitTermination()
    return ba.vocabulary(spark, vocab).select("item", "ix")


def trained_stream(spark, sf):
    """Where the counts of the arriving labelled documents are kept."""
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), "quality").alias("label"))
    marked = arriving(spark, sf).join(marks, F.col("doc_id") == F.col("id"))
    path = new_shared_path(spark, "model")
    ba.train_from(nb.to_training(marked), path, new_shared_path(spark, "progress"), merge_every=1).awaitTermination()
    return path


@query(
    "l2_stream_train",
    f"""
    WITH {LABELLED}
    SELECT label, feature, true AS value, count(*) AS count FROM feats GROUP BY label, feature
    """,
)
def l2_stream(spark, sf):
    return ba.model(spark, trained_stream(spark, sf)).features


@query(
    "l4_stream_classify",
    SCORED + "SELECT doc_id, label, round(score, 6) AS score, round(p, 6) AS p FROM post",
)
def l4_stream(spark, sf):
    """Arriving documents scored by the model that a stream has trained."""
    out = new_shared_path(spark, "scores")
    ba.classify_from(arriving(spark, sf), trained_stream(spark, sf), out, new_shared_path(spark, "progress")).awaitTermination()
    scored = nb.classify_proba(ba.scored(spark, out))
    return scored.select("doc_id", "label", rounded("score", 6), rounded("p", 6))
