import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusfreq.operators import bayes as nb
from corpusfreq.operators import folds as fo

LABELS = ["ham", "spam"]


def documents(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        label = rng.choice(["ham", "ham", "spam"])
        pool = "abcdef" if label == "ham" else "defghi"
        words = [rng.choice(pool) for _ in range(rng.randint(0, 6))]
        out.append((i, label, " ".join(words)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, label string, text string")


def scores_of(train, words, compat=False):
    """Log scores by the definition, one probability at a time."""
    n = Counter(label for _, label, _ in train)
    c = Counter((label, w) for _, label, t in train for w in set(t.split()))
    known = {w for _, w in c}
    out = {}
    for label in n:
        s = math.log((n[label] + 0.5) / (len(train) + 0.5 * len(n)))
        for w in set(words) & known:
            if compat:
                if (label, w) in c:
                    s += math.log((c[label, w] + 0.5) / (c[label, w] + 0.5))
                continue
            missing = sum(c[m, w] for m in n) < len(train)
            s += math.log((c[label, w] + 0.5) / (n[label] + 0.5 * (1 + missing)))
        out[label] = s
    return out


def posterior(scores):
    top = max(scores.values())
    mass = sum(math.exp(s - top) for s in scores.values())
    return {k: math.exp(s - top) / mass for k, s in scores.items()}


def check(rows, truth):
    got = defaultdict(dict)
    for r in rows:
        got[r.doc_id][r.label] = (r.score, r.p)
    assert got.keys() == truth.keys()
    for doc, scores in truth.items():
        post = posterior(scores)
        assert got[doc].keys() == scores.keys()
        for label, s in scores.items():
            assert math.isclose(got[doc][label][0], s, rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(got[doc][label][1], post[label], rel_tol=1e-9)


def test_training_and_classification(spark):
    train, test = documents(60, 1), documents(20, 2) + [(99, "ham", "a z zz"), (100, "ham", "")]
    counts = nb.train(nb.to_training(frame(spark, train)))
    assert {r.label: r["count"] for r in counts.labels.collect()} == Counter(r[1] for r in train)
    c = Counter((label, w) for _, label, t in train for w in set(t.split()))
    assert {(r.label, r.feature): r["count"] for r in counts.features.collect()} == c
    assert counts.values().count() == len({w for _, w in c})

    for compat in (False, True):
        post = nb.posteriors(counts, nb.to_training(frame(spark, test)), compat=compat)
        truth = {i: scores_of(train, t.split(), compat) for i, _, t in test}
        check(nb.classify_proba(post).collect(), truth)
        best = {r.doc_id: r.predicted for r in nb.classify(post).collect()}
        assert best == {i: max(sorted(s), key=s.get) for i, s in truth.items()}

    n = Counter(r[1] for r in train)
    for compat in (False, True):
        for r in nb.finish_training(counts, compat).collect():
            k = c[r.label, r.feature]
            if compat:
                want = 1.0
            else:
                missing = sum(c[m, r.feature] for m in n) < len(train)
                want = (k + 0.5) / (n[r.label] + 0.5 * (1 + missing))
            assert math.isclose(r.p, want)
    prior = {r.label: r.p for r in nb.label_distribution(counts).collect()}
    assert math.isclose(prior["spam"], (n["spam"] + 0.5) / (60 + 1))


def test_features_with_several_values(spark):
    train = [("x", [("size", "big"), ("hue", "red")]), ("x", [("size", "small")]), ("y", [("size", "big")])]
    schema = "doc_id int, label string, features array<struct<feature:string,value:string>>"
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(train)], schema)
    test = spark.createDataFrame([(0, "?", [("size", "huge"), ("hue", "red")])], schema)
    post = nb.classify_proba(nb.posteriors(nb.train(table), test)).collect()
    got = {r.label: r.score for r in post}
    # size: two values, in every document; hue: one value, missing from two documents.
    want_x = math.log(2.5 / 4) + math.log(0.5 / (2 + 1.0)) + math.log(1.5 / (2 + 1.0))
    want_y = math.log(1.5 / 4) + math.log(0.5 / (1 + 1.0)) + math.log(0.5 / (1 + 1.0))
    assert math.isclose(got["x"], want_x) and math.isclose(got["y"], want_y)


def test_merged_trainers_equal_one(spark):
    rows = documents(40, 3)
    parts = [nb.train(nb.to_training(frame(spark, rows[a:b]))) for a, b in ((0, 15), (15, 40))]
    both, one = parts[0].merge(parts[1]), nb.train(nb.to_training(frame(spark, rows)))
    table = lambda df: sorted(tuple(r) for r in df.collect())
    assert table(both.labels) == table(one.labels)
    assert table(both.features) == table(one.features)


def test_cross_validation(spark):
    rows = documents(50, 4) + [(200, "rare", "a q")]
    training = fo.hash_folds(nb.to_training(frame(spark, rows)), 5)
    fold = {r.doc_id: r.fold for r in training.collect()}
    assert set(fold.values()) == set(range(5))
    post = nb.cross_validated(training)
    truth = {}
    for i, _, t in rows:
        rest = [r for r in rows if fold[r[0]] != fold[i]]
        truth[i] = scores_of(rest, t.split())
    check(nb.classify_proba(post).collect(), truth)

    results = nb.fold_results(post, training)
    label = {i: lab for i, lab, _ in rows}
    evaluated = {r.fold: r for r in nb.evaluate(results, "spam").collect()}
    for k in range(5):
        docs = [i for i in fold if fold[i] == k]
        best = {i: max(sorted(truth[i]), key=truth[i].get) for i in docs}
        own = [posterior(truth[i]).get(label[i], 0.0) for i in docs]
        tp = sum(best[i] == label[i] == "spam" for i in docs)
        said, are = sum(b == "spam" for b in best.values()), sum(label[i] == "spam" for i in docs)
        r = evaluated[k]
        assert (r.hits, r.n) == (sum(best[i] == label[i] for i in docs), len(docs))
        assert r.precision == (tp / said if said else None)
        assert r.recall == (tp / are if are else None)
        assert math.isclose(r.f1, 2 * tp / (said + are)) if said + are else r.f1 is None
        assert math.isclose(r.mse, sum((1 - p) ** 2 for p in own) / len(docs), rel_tol=1e-9)
        seen = [math.log(p) for p in own if p > 0]
        assert math.isclose(r.perplexity, math.exp(-sum(seen) / len(seen)), rel_tol=1e-9)
    mean = nb.average_folds(nb.evaluate(results, "spam")).first()
    assert mean.n == len(rows)
    assert math.isclose(mean.accuracy, sum(e.accuracy for e in evaluated.values()) / 5)


def test_whole_experiment_on_files(spark, tmp_path):
    from corpusfreq.sources.corpus import load_corpus, load_stop_words, tag_by_name

    for i, label, text in documents(30, 7):
        name = ("spm" if label == "spam" else "msg") + f"{i}.txt"
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text + " The")
    (tmp_path / "stop").write_text("the\na")
    docs = tag_by_name(load_corpus(spark, str(tmp_path / "in")))
    stop = load_stop_words(spark, str(tmp_path / "stop"))
    measured = nb.cross_validate(docs, stop=stop, k=3, seed=2).collect()
    assert sorted(r.n for r in measured) == [10, 10, 10]
    assert all(0 <= r.accuracy <= 1 for r in measured)
    listed = nb.cross_validate(docs, stop=["the", "a"], k=3, seed=2).collect()
    close = lambda a, b: a == b or math.isclose(a, b, rel_tol=1e-9)
    pairs = zip(sorted(map(tuple, measured)), sorted(map(tuple, listed)))
    assert all(close(x, y) for a, b in pairs for x, y in zip(a, b))


def test_stop_table_and_repeated_ids(spark):
    rows = frame(spark, documents(20, 8))
    stop = spark.createDataFrame([("a",), ("d",)], "norm string")
    features = lambda df, words: {
        r.doc_id: sorted(f.feature for f in r.features) for r in nb.to_training(df, stop=words).collect()
    }
    listed = features(rows, ["a", "d"])
    assert features(rows, stop) == listed
    many = stop.unionByName(spark.range(150_000).selectExpr("concat('none', id) AS norm"))
    assert features(rows, many) == listed
    assert all("a" not in v and "d" not in v for v in listed.values())
    # Rows that share an id keep their own types, whatever the size of the list.
    twice = spark.createDataFrame(
        [(1, "x", "alpha beta the"), (1, "y", "gamma the"), (2, "x", "delta"), (3, "x", "the"), (4, "y", None)],
        "doc_id int, label string, text string",
    )
    the = spark.createDataFrame([("the",)], "norm string")
    for words in (the, the.unionByName(spark.range(150_000).selectExpr("concat('none', id) AS norm"))):
        got = sorted((r.doc_id, r.label, sorted(f.feature for f in r.features)) for r in nb.to_training(twice, stop=words).collect())
        assert got == [(1, "x", ["alpha", "beta"]), (1, "y", ["gamma"]), (2, "x", ["delta"]), (3, "x", []), (4, "y", [])]


def test_shuffle_and_split(spark):
    docs = spark.range(23).select(F.col("id").alias("doc_id"))
    order = fo.shuffled(docs, seed=1)
    places = {r.doc_id: r.place for r in order.collect()}
    assert sorted(places.values()) == list(range(23))
    assert places != {i: i for i in range(23)}
    assert places == {r.doc_id: r.place for r in fo.shuffled(docs.repartition(5), seed=1).collect()}
    assert places != {r.doc_id: r.place for r in fo.shuffled(docs, seed=2).collect()}
    fold = {r.place: r.fold for r in fo.split_folds(order, 10).collect()}
    sizes = Counter(fold.values())
    assert [sizes[k] for k in range(10)] == [3, 3, 3] + [2] * 7
    assert [fold[i] for i in range(23)] == sorted(fold.values())
    few = fo.split_folds(order.where("place < 4"), 10)
    assert sorted(r.fold for r in few.collect()) == [0, 1, 2, 3]


def test_leave_one_out(spark):
    counted = spark.createDataFrame(
        [(0, "a", 3), (1, "a", 2), (1, "b", 5)], "fold int, item string, count long"
    )
    wanted = spark.createDataFrame(
        [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (0, "c")], "fold int, item string"
    )
    got = {(r.fold, r.item): r["count"] for r in fo.leave_one_out(wanted, counted).collect()}
    assert got == {(0, "a"): 2, (0, "b"): 5, (1, "a"): 3, (1, "b"): 0, (0, "c"): 0}
