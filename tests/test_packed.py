"""Packed counts against Spark's own aggregates."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusfreq.operators import collocates as co
from corpusfreq.operators import ngrams as ng
from corpusfreq.plans import packed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark):
    rnd = random.Random(3)
    words = ["a", "b", "é", "", "a b", "c" * 300, None, *[f"w{i}" for i in range(50)]]
    rows = [[rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 5, 40, 700]))] for _ in range(60)]
    rows += [None, [], [None], ["x", "x", "x", "x"], ["x", "x", "x", "x"]]
    return rows, spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id int, vector array<string>").repartition(3)


@pytest.mark.parametrize("piece", [1 << 21, 50])
@pytest.mark.parametrize("drop_last", [False, True])
@pytest.mark.parametrize("n", [1, 2, 4])
def test_packed_ngrams_are_those_of_an_aggregate(spark, monkeypatch, n, drop_last, piece):
    monkeypatch.setattr(packed, "PIECE_ROWS", piece)
    rows, docs = vectors(spark)
    want = Counter()
    for v in rows:
        v = v or []
        want.update(tuple(v[i : i + n]) for i in range(len(v) - n + 1 - drop_last))
    found = ng.ngram_freqs(docs, n, drop_last=drop_last)
    # Words are shuffled in blocks, not once for every n-gram they stand in.
    assert "hashpartitioning(w1" not in plan(found) and "hashpartitioning(bucket" in plan(found)
    assert {tuple(r)[:n]: r["count"] for r in found.collect()} == want
    assert ng.ngram_freqs(docs.where("id < 0"), n).count() == 0


def test_ngrams_of_other_items_are_counted(spark):
    docs = spark.createDataFrame([([1, 2, 1, 2],)], "vector array<int>")
    assert {tuple(r) for r in ng.ngram_freqs(docs, 2).collect()} == {(1, 2, 2), (2, 1, 1)}


def test_packed_sums_are_those_of_an_aggregate(spark, monkeypatch):
    monkeypatch.setattr(packed, "PIECE_ROWS", 100)
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None, "é"]), rnd.choice(["a", "ab", None, ""]), rnd.randint(-(2**40), 2**40), rnd.randint(0, 3)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, `l m` string, s long, count int").repartition(5)
    plain = df.groupBy("k", "l m").agg(F.sum("count").alias("count"), F.sum("s").alias("s"))
    added = packed.packed_sums(df, ["k", "l m"], ["s", "count"])
    assert added.columns == plain.columns
    assert Counter(map(tuple, added.collect())) == Counter(map(tuple, plain.collect()))
    rows_of = packed.packed_sums(df, ["k"], count="n").collect()
    assert {r.k: r.n for r in rows_of} == Counter(r[0] for r in rows)


def test_models_are_counted_without_the_trigrams_of_the_others(spark):
    rows, docs = vectors(spark)
    uni, bi, _ = ng.ngram_models(docs)
    assert "w3" not in plan(uni) and "w3" not in plan(bi)
    pairs = Counter((v[i], v[i + 1]) for v in rows if v for i in range(len(v) - 2))
    single = Counter()
    for (a, _), k in pairs.items():
        single[a] += k
    assert {(r.cond, r["item"]): r["count"] for r in bi.collect()} == pairs
    assert {r["item"]: r["count"] for r in uni.collect()} == single
    stored = ng.ngram_models(docs, store=True)
    for one, other in zip(ng.ngram_models(docs), stored, strict=True):
        assert Counter(map(tuple, one.collect())) == Counter(map(tuple, other.collect()))


def test_interpolation_shuffles_no_whole_model(spark):
    rows, docs = vectors(spark)
    models = ng.ngram_models(docs, store=True)
    asked = [(rows[0] or ["x"])[:3], ["x", "x", "x"], [None, "x", "x"], ["x", "x", "none"], ["none", "x", "x"], ["x", "x", "x"]]
    query = spark.createDataFrame([tuple(v) for v in asked if len(v) == 3], "w1 string, w2 string, w3 string")
    grams = Counter(tuple(v[i : i + 3]) for v in rows if v for i in range(len(v) - 2))
    count = lambda *key, skip=0: sum(k for g, k in grams.items() if g[skip : skip + len(key)] == key)
    part = lambda a, b: a / b if b else 0.0
    want = []
    for r in query.collect():
        a, b, c = (object() if w is None else w for w in r)
        p = 0.2 * part(count(c), sum(grams.values())) + 0.3 * part(count(b, c), count(b)) + 0.5 * part(count(a, b, c), count(a, b))
        want.append((*r, round(p, 12)))
    scored = ng.interpolate(query, models, (0.2, 0.3, 0.5), store=False)
    assert Counter((*tuple(r)[:3], round(r.p, 12)) for r in scored.collect()) == Counter(want)
    assert len(scored.inputFiles()) > 0 and "hashpartitioning(__k0" not in plan(ng._asked_counts(query, models[1], {"w1": "cond", "w2": "item"}, "n"))


def test_collocates_are_shuffled_in_blocks(spark):
    rows, docs = vectors(spark)
    stats = co.collocate_stats(co.collocates(docs, 1, 2))
    assert "hashpartitioning(bucket" in plan(stats) and "hashpartitioning(head" not in plan(stats)
    want = Counter((v[i], v[j]) for v in rows if v for i in range(len(v)) for j in (i - 1, i + 1, i + 2) if 0 <= j < len(v))
    assert {(r["head"], r["pair"]): r.n for r in stats.collect()} == want
