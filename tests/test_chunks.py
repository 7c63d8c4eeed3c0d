import os
import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusfreq.operators import ngrams as ng
from corpusfreq.operators import tokens as tk
from corpusfreq.plans.ranking import running_sums
from corpusfreq.streaming import chunks as ch
from corpusfreq.streaming import streams as sr

SCHEMA = "doc_id string, chunk long, text string, last boolean"
TEXTS = {
    "a": "The cat sat\non the mat, the  cat\n\nsat Ως ΣΑΣ over",
    "b": "x",
    "c": "",
    "d": "\n\n--\n",
    "e": "onewordonly" * 5,
    "f": "é éa 𝔘𝔫 don't\nend. ",
}


def cut(texts, rnd, size):
    """Chunks of at most ``size`` characters, some of them empty."""
    rows = []
    for doc, text in texts.items():
        at, no = 0, 0
        while at < len(text) or not no:
            step = rnd.randint(0, size)
            rows.append((doc, no, text[at : at + step] or (None if step else ""), at + step >= len(text)))
            at, no = at + step, no + 1
    return rows


def run(stream, tmp, name):
    query = sr.append_to(stream, f"{tmp}/{name}", f"{tmp}/{name}-checkpoint")
    query.awaitTermination(240)
    assert query.exception() is None
    return query


def write(spark, tmp, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp}/in")


def arriving(spark, tmp):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")


def whole(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def same(a, b):
    assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize(("size", "order"), [(1, "shuffled"), (7, "reversed"), (200, "sorted")])
def test_tokens_and_ngrams_of_chunks(spark, tmp_path, size, order):
    rnd = random.Random(size)
    rows = cut(TEXTS, rnd, size)
    if order == "shuffled":
        rnd.shuffle(rows)
    elif order == "reversed":
        rows.reverse()
    third = max(len(rows) // 3, 1)
    for lo in range(0, len(rows), third):
        write(spark, tmp_path, rows[lo : lo + third])
    texts = whole(spark, TEXTS)
    run(ch.chunk_tokens(arriving(spark, tmp_path)), tmp_path, "tokens")
    same(spark.read.parquet(f"{tmp_path}/tokens"), tk.tokenizer(texts))
    n = {1: 4, 7: 2, 200: 1}[size]
    run(ch.chunk_ngrams(arriving(spark, tmp_path), n), tmp_path, "grams")
    same(spark.read.parquet(f"{tmp_path}/grams"), ng.ngrams(tk.corpus_vectors(texts), n, keep=["doc_id"]))


def test_a_restart_goes_on_in_the_middle(spark, tmp_path):
    rows = cut(TEXTS, random.Random(2), 4)
    first = [r for r in rows if r[1] % 2 == 0]
    write(spark, tmp_path, first)
    run(ch.chunk_ngrams(arriving(spark, tmp_path), 3), tmp_path, "grams")
    run(ch.chunk_tokens(arriving(spark, tmp_path), stop=["the"]), tmp_path, "tokens")
    # Chunks that were taken before come again with the others.
    write(spark, tmp_path, rows)
    run(ch.chunk_ngrams(arriving(spark, tmp_path), 3), tmp_path, "grams")
    query = run(ch.chunk_tokens(arriving(spark, tmp_path), stop=["the"]), tmp_path, "tokens")
    texts = whole(spark, {k: v for k, v in TEXTS.items() if sum(r[0] == k for r in rows) > 1})
    known = [r["doc_id"] for r in texts.collect()]
    same(
        spark.read.parquet(f"{tmp_path}/grams").where(F.col("doc_id").isin(known)),
        ng.ngrams(tk.corpus_vectors(texts), 3, keep=["doc_id"]),
    )
    # Positions are those of the whole text; the stop list only removes rows.
    found = spark.read.parquet(f"{tmp_path}/tokens").where(F.col("doc_id").isin(known))
    same(found, tk.tokenizer(texts).where("norm <> 'the'"))
    # Ended documents leave no state; documents of one chunk are open anew, they began again.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= len(TEXTS) - len(known)


def test_state_does_not_grow_with_a_document(spark, tmp_path):
    """After every chunk the state holds the open token and two tokens, not the text."""
    state = list(ch.START)
    state[6] = []
    for no in range(200):
        text = f"word{no} and tail"
        found = ["word", "and", "tail"]
        ch.stepper(3)(state, {"text": text, "last": False, "count": 3, "tail": found, "begins": True, "ends": True})
        assert state[0] == no + 1 and len(state[6]) == 2 and state[5] == "tail"
    assert state[4] == 200 * 2


def test_functions_travel_without_the_package(tmp_path):
    """A worker on another machine has Spark and Arrow, but not this package."""
    made = cloudpickle.dumps((running_sums(), ch.stepper(2)))
    code = """
import pickle, sys
import pyarrow as pa
sums, step = pickle.load(sys.stdin.buffer)
assert not any(m.startswith("corpusfreq") for m in sys.modules)
print([a.to_pylist() for a in sums(iter([pa.array([1, 2]), pa.array([3])]))])
print(step([0, 0, 0, 0, 0, "", [], "[]"], {"text": "a b", "last": True, "count": 2, "tail": ["a", "b"], "begins": True, "ends": True}))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], input=made, capture_output=True, cwd=tmp_path, env=env)
    assert done.returncode == 0, done.stderr.decode()
    assert done.stdout.decode().splitlines() == ["[[1, 3], [6]]", "(0, 0, 0, 0, 'a b', [])"]


@pytest.mark.parametrize("kind", ["string", "bigint", "binary"])
def test_documents_share_calls_of_the_state_function(spark, tmp_path, kind):
    """A bucket's documents are one row of the state and one call, whatever their ids."""
    rnd, texts = random.Random(4), list(TEXTS.values())
    ids = [None, *range(1, 300)] if kind == "bigint" else [None, "", "=", *[f"é{i}" for i in range(297)]]
    keys = [k.encode() if kind == "binary" and k is not None else k for k in ids]
    whole_texts = [texts[i % len(texts)] for i in range(len(keys))]
    rows = []
    for key, text in zip(keys, whole_texts):
        rows += [(key, *r[1:]) for r in cut({"x": text}, rnd, 5)]
    rnd.shuffle(rows)
    schema = f"doc_id {kind}, chunk long, text string, last boolean"
    # Every document is open after the first half: its end comes with the second.
    halves = [r for r in rows if not r[3]], [r for r in rows if r[3]]
    for i, part in enumerate(halves):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = run(ch.chunk_tokens(stream, buckets=8), tmp_path, "tokens")
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert 0 < state <= 8 if i == 0 else state == 0
    docs = spark.createDataFrame(list(zip(keys, whole_texts)), f"doc_id {kind}, text string")
    got, want = spark.read.parquet(f"{tmp_path}/tokens"), tk.tokenizer(docs)
    assert got.schema["doc_id"].dataType == want.schema["doc_id"].dataType
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
