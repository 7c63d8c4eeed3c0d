"""Set join, components, language model and top-k search against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusfreq.llm import classlm, components, setjoin, topk
from corpusfreq.llm.bytes_np import word_hashes, word_spans
from corpusfreq.llm.folds import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ngrams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    """(id, size) -> component for every row."""
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, ngrams(t, n)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return Counter((i, len(ngrams(t, n)), root(i) if i is not None and ngrams(t, n) else i) for i, t in rows)


@pytest.mark.parametrize(("n", "percent", "light"), [(4, 85, None), (2, 80, 24), (1, 60, 8), (4, 85, 0)])
def test_components_of_documents(spark, docs, monkeypatch, n, percent, light):
    if light is not None:  # whatever the boundary, the links are the same
        monkeypatch.setattr(setjoin, "light_bound", lambda *_: min(light, 9 if percent == 60 else light))
    more = spark.createDataFrame([(None, "a b c"), (2000, "a b c"), (2001, "A  b\tc"), (2001, "zz yy")], "doc_id long, text string")
    some = docs.select("doc_id", "text").unionByName(more)
    rows = [tuple(r) for r in some.collect()]
    found = setjoin.linked_components(some.withColumns({"node": some.doc_id, "id": some.text}), n, percent)
    got = Counter((r["id"], r["size"], r["component"]) for r in found.collect())
    assert got == brute(rows, n, percent)


def test_subsets_of_light_sets(spark):
    """Small sets that lack one or two elements of each other."""
    rnd = random.Random(9)
    rows = []
    for _ in range(60):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(1, 20))]
        rows.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            for _ in range(rnd.randint(0, 2)):
                near[rnd.randrange(len(near))] = f"w{rnd.randrange(10**6)}"
            rows.append(" ".join(near[: rnd.choice([len(near), len(near) - 1, 30]) or 1]))
    rows = list(enumerate(rows))
    some = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["id"], r["size"], r["component"]) for r in setjoin.linked_components(some, 1, 80).collect())
    assert got == brute(rows, 1, 80)


def test_hub_does_not_lose_links(spark):
    """A chain of sets around a common core: the hub of a list links with few of them."""
    rows = []
    for k in range(30):
        rows.append((k, " ".join([f"c{i}" for i in range(60)] + [f"x{k + j}" for j in range(12)])))
    some = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["id"], r["size"], r["component"]) for r in setjoin.linked_components(some, 1, 85).collect())
    assert got == brute(rows, 1, 85)


def test_set_join_of_empty_tables(empty, docs):
    assert setjoin.linked_components(empty).count() == 0
    assert setjoin.keep_one_of_each(empty).columns == docs.columns
    blank = docs.where("doc_id in (1000, 1001, 1002)")
    assert {(r["id"], r["size"], r["component"]) for r in setjoin.linked_components(blank).collect()} == {
        (1000, 0, 1000), (1001, 0, 1001), (1002, 0, 1002)
    }


def test_one_of_each_stays(docs):
    kept = setjoin.keep_one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    groups = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in groups})


def test_long_paths(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7), (None, 3)]
    found = components.components(spark.createDataFrame(links, "u long, v long"))
    assert {r["node"]: r["root"] for r in found.collect()} == {**dict.fromkeys(range(201), 0), 400: 400, 450: 400, 500: 400}


def test_light_bound_follows_cost():
    assert setjoin.light_bound(85, 1.0) <= setjoin.light_bound(85, 1000.0) <= setjoin.MAX_LIGHT


def test_language_model(docs, prose):
    held = fold("doc_id", 10) == 0
    model, vocabulary = classlm.fit(docs.where(~held))
    rows = classlm.score(docs.withColumn("held_out", held), model, vocabulary, keep=("doc_id", "held_out")).collect()
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    counts = Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*words(t), None])
    total, types = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        w = [*words(t), None]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w)
        want[(i, len(w), sum(x in counts for x in w), total, round(base, 5))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)


def test_rare_words_meet_their_counts_in_the_join(docs, monkeypatch):
    some = docs.where("doc_id < 120")
    usual = {r["doc_id"]: r for r in classlm.score(some, *classlm.fit(some)).collect()}
    monkeypatch.setattr(classlm, "FREQUENT", 20)
    for r in classlm.score(some, *classlm.fit(some)).collect():
        assert math.isclose(r["base_score"], usual[r["doc_id"]]["base_score"], rel_tol=1e-9)
        assert r["n_known"] == usual[r["doc_id"]]["n_known"]


def test_class_probabilities_sum_to_one(docs):
    model, vocabulary = classlm.fit(docs)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    units = model.frequent.units
    pairs = [(r["word"], r["suffix"], r["n"]) for r in vocabulary.collect()]
    word, suffix, n = (np.array(x) for x in zip(*pairs))
    cls = model.owner[units(word, suffix)]
    mass = np.bincount(cls, (n + 0.1) / 10 ** model.emission[cls], classlm.CLASSES)
    used = np.unique(cls)
    # What is left is the share of one unseen word.
    assert np.allclose(mass[used] + 0.1 / 10 ** model.emission[used], 1)


def test_classes_separate_alternating_words():
    """Two kinds of words that always alternate end up in different classes."""
    rng = np.random.default_rng(0)
    table = np.zeros((20, 20))
    for _ in range(5000):
        a, b = rng.integers(10), 10 + rng.integers(10)
        table[a, b] += 1
        table[b, rng.integers(10)] += 1
    owner = classlm.exchange(table, 2)
    assert len(set(owner[:10])) == len(set(owner[10:])) == 1 and owner[0] != owner[10]


def test_language_model_without_training(docs, empty):
    model, vocabulary = classlm.fit(empty)
    rows = classlm.score(docs.where("doc_id < 10"), model, vocabulary).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["base_score"]) < 1e-9 for r in rows)
    assert classlm.score(empty, *classlm.fit(docs)).count() == 0


def test_top_k(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-1, 0, 1, 2]) * rnd.random() for _ in range(7)]) for i in range(500)]
    rows += [(i, [1.0, 0.5, 0.25, 0.125, 0.0, 0.0, 0.0]) for i in range(500, 540)]  # ties
    rows += [(540, None), (541, [1.0, None]), (542, [float("nan")] * 7), (600, [float("inf")] * 7), (None, [1.0] * 7)]
    rows += [(543, [0.5, -0.5]), (700, [0.25] * 7), (700, [0.25] * 7), (544, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS ids")
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = [math.floor(1024 * x) for x in v]
    want = set()
    for q in good:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)
            want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:10])}
    found = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()} == want


def test_top_k_of_few_or_large(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(none, none).count() == 0
    few = spark.createDataFrame([(0, [3e6, 1.0]), (1, [2e6, 1.0]), (2, [-1e6, 3.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(few, few.where("vec_id = 0")).orderBy("rank").collect()]
    s = lambda a, b: sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b))
    assert got == [(0, 1, 1, s([3e6, 1.0], [2e6, 1.0])), (0, 2, 2, s([3e6, 1.0], [-1e6, 3.0]))]


def test_all_texts_of_one_id_are_one_document(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcde"]
    rows = [(50, t) for t in texts] + [(10 + i, t + " more") for i, t in enumerate(texts)] + [(99, "something else entirely here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["id"], r["component"]) for r in setjoin.linked_components(docs).collect()}
    assert found == {(50, 10), (99, 99), *((10 + i, 10) for i in range(5))}
    assert sorted(r["doc_id"] for r in setjoin.keep_one_of_each(docs).collect()) == [10, 99]


def test_patterns_of_repetition_do_not_make_hashes_collide():
    swap = str.maketrans("ab", "ba")
    word, words = "a", []
    while len(word) < 4096:
        word += word.translate(swap)
        if len(word) >= 512:
            words += [word, word.translate(swap)]
    words += ["x" * n for n in (255, 256, 257, 512, 513)]
    data = np.frombuffer(" ".join([*words, words[0].upper()]).encode(), np.uint8)
    starts, stops, _ = word_spans(data, np.array([0, len(data)]))
    hashes = word_hashes(data, starts, stops)
    assert len(set(hashes[:-1].tolist())) == len(words)
    assert hashes[-1] == hashes[0]
    assert len(word_hashes(data, starts[:0], stops[:0])) == 0


def test_top_k_skips_blocks_that_cannot_matter(spark, monkeypatch):
    """Lengths from tiny to large over many blocks; the result is that of brute force."""
    rnd = np.random.default_rng(4)
    data = rnd.normal(size=(900, 9)) * np.exp(rnd.normal(size=(900, 1)) * 2)
    data[5] = data[6] = data[7]  # ties go to the smaller id
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(12)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    whole = np.floor(1024 * data)
    want = set()
    for q in range(0, 900, 30):
        scores = sorted((-int(whole[q] @ whole[c]), c) for c in range(900) if c != q)[:7]
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)}
    got = topk.top_k(vectors, vectors.where("vec_id % 30 = 0"), k=7).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want


def test_grid_grows_with_both_sides():
    assert topk._grid(0, 0, 8) == (1, 1)
    assert topk._grid(3, 50, 12) == (3, 4)
    assert topk._grid(1000, 50, 200) == (200, 1)
    assert topk._grid(2, 2, 200) == (2, 2)


def test_running_queries_skip_short_vectors():
    held = topk._Running(np.array([1, 2]), np.array([[3.0, 4.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]]), None, 1)
    held.take(np.array([10, 11]), np.array([[30.0, 40.0, 0.0, 0.0], [100.0, 0.0, 0.0, 0.0]]))
    assert dict(zip(held.ids[held.query].tolist(), held.total.tolist())) == {1: 300, 2: 100}
    assert len(held.reach(np.array([[1.0, 1.0, 1.0, 1.0]]))) == 0
    assert held.reach(np.array([[99.0, 0.0, 0.0, 0.0]])).tolist() == [0, 1]


def test_copies_of_query_blocks_are_not_broadcast(spark):
    """The planner would take them for as small as the blocks that are copied."""
    rows = [(i, [float(i % 7), 40.0 * i, -3e9 if i == 5 else 0.5]) for i in range(40)]
    vectors = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    blocks = topk._pack(vectors.repartition(4), 16)
    assert {r["kind"] for r in blocks.collect()} >= {"int32", "float64"}
    met = topk._meet(topk._pack(vectors.where("id < 3"), 2), blocks, 3, (2, 2), heads=True)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r["query_id"] for r in met.collect()} == {0, 1, 2}
