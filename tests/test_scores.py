import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusfreq.functions import scores
from corpusfreq.operators import association as assoc
from corpusfreq.operators import distributions as di
from corpusfreq.operators import smoothing as sm
from corpusfreq.operators import stats as st
from corpusfreq.operators.freqs import count_of_counts

close = lambda a, b, tol=1e-9: math.isclose(a, b, rel_tol=tol, abs_tol=1e-12)


def tables(spark, words):
    uni = Counter(words)
    bi = Counter(zip(words, words[1:]))
    items = spark.createDataFrame(list(uni.items()), "item string, count long")
    grams = spark.createDataFrame([(*k, c) for k, c in bi.items()], "w1 string, w2 string, count long")
    return uni, bi, items, grams


def zipf_words(n, seed):
    rng = random.Random(seed)
    return [f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(n)]


def t_score(f, pairs, expected):
    actual = f / pairs
    sd = math.sqrt((f * (1 - actual) ** 2 + (pairs - f) * actual**2) / pairs)
    return (actual - expected) / (sd / math.sqrt(pairs))


def test_association(spark):
    words = zipf_words(1500, 1)
    uni, bi, items, grams = tables(spark, words)
    n, pairs = len(words), len(words) - 1

    t = {(r.w1, r.w2): r.t for r in assoc.t_test_matrix(grams, items).collect()}
    assert t.keys() == bi.keys()
    for (a, b), f in bi.items():
        assert close(t[a, b], t_score(f, pairs, uni[a] * uni[b] / n**2), 1e-9)
    flipped = assoc.t_test_matrix(grams, items, compat=True).first()
    assert close(flipped.t, -t[flipped.w1, flipped.w2])

    targets = spark.createDataFrame([("w1", "w2"), ("w1", "nope")], "w1 string, w2 string")
    one = {(r.w1, r.w2): r for r in assoc.t_test_ngram(targets, grams, items).collect()}
    assert close(one["w1", "w2"].t, t["w1", "w2"])
    assert one["w1", "nope"]["count"] == 0 and one["w1", "nope"].t is None

    pmi = assoc.pmi_matrix(items, grams).collect()
    assert len(pmi) == len(bi)
    for r in pmi:
        want = math.log2((bi[r.w1, r.w2] / pairs) / (uni[r.w1] / n * uni[r.w2] / n))
        assert close(r.pmi, want)
    compat = assoc.pmi_matrix(items, grams, compat=True).first()
    assert close(compat.pmi, -math.log2(uni[compat.w1] / n))

    heads = Counter(a for a, _ in bi)
    totals = Counter()
    for (a, _), f in bi.items():
        totals[a] += f
    mle = {(r.w1, r.w2): r.p for r in assoc.mle_matrix(grams).collect()}
    assert mle == {k: f / totals[k[0]] for k, f in bi.items() if heads[k[0]] > 1}

    def log_l(k, m, p):
        return (k * math.log2(p) if k else 0) + ((m - k) * math.log2(1 - p) if m > k else 0)

    for compat in (False, True):
        for r in assoc.likelihood_matrix(items, grams, compat).collect():
            c1, c2, c12 = uni[r.w1], uni[r.w2], bi[r.w1, r.w2]
            if compat:
                p, p1, p2 = c12 / pairs, c1 / n, c2 / n
            else:
                p, p1, p2 = c2 / n, c12 / c1, (c2 - c12) / (n - c1)
            want = -2 * (
                log_l(c12, c1, p) + log_l(c2 - c12, n - c1, p)
                - log_l(c12, c1, p1) - log_l(c2 - c12, n - c1, p2)
            )
            assert close(r.llr, want, 1e-6)

    doubled = assoc.score_rows(items, F.col("count") * 2).collect()
    assert {r.item: r.score for r in doubled} == {k: 2 * c for k, c in uni.items()}


def test_t_differences(spark):
    words = zipf_words(400, 2)
    _, bi, _, grams = tables(spark, words)
    near = Counter()
    for (a, b), f in bi.items():
        if f > 1 and a == "w1":
            near[b] += f
        elif f > 1 and b == "w1":
            near[a] += f
    assert {r.v: r.n for r in assoc.neighbours(grams, "w1").collect()} == near
    # Against every neighbour the result is the whole matrix.
    matrix = assoc.t_differences(grams, "w1", list(near)).collect()
    want = {
        (a, b): (near[a] - near[b]) / math.sqrt(near[a] + near[b])
        for a in near for b in near if a < b
    }
    assert len(matrix) == len(want)
    assert all(close(r.t, want[r.v1, r.v2]) for r in matrix)
    some = sorted(near)[:2]
    part = assoc.t_differences(grams, "w1", [*some, "missing"]).collect()
    assert {(r.v1, r.v2) for r in part} == {k for k in want if set(k) & set(some)}
    assert assoc.t_differences(grams, "w1", some, compat=True).count() == 2 * len(part)


def test_scalar_scores(spark):
    row = spark.range(1).select(
        scores.z_score(F.lit(7.0), F.lit(5.0), F.lit(4.0)).alias("z"),
        scores.t_test(F.lit(169.0), F.lit(158.0), F.sqrt(F.lit(2600.0)), F.lit(200)).alias("t"),
        scores.t_difference(F.lit(10), F.lit(0)).alias("d"),
        scores.mle(F.lit(3), F.lit(4)).alias("m"),
        scores.pmi_counts(F.lit(20), F.lit(42), F.lit(20), F.lit(14307668)).alias("i"),
        scores.log_probability(F.lit(0.25)).alias("l"),
        scores.log_probability(F.lit(0.25), compat=True).alias("lc"),
        scores.log_probability(F.lit(0.0)).alias("l0"),
        scores.log2_likelihood(F.lit(0), F.lit(5), F.lit(0.5)).alias("ll"),
    ).first()
    assert row.z == 0.5 and close(row.t, 3.0508, 1e-4) and close(row.d, math.sqrt(10))
    assert row.m == 0.75 and close(row.i, 18.38, 1e-3)
    assert (row.l, row.lc, row.l0, row.ll) == (-2.0, -0.5, None, -5.0)


def test_summary_statistics(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), rng.gauss(100, 3)) for _ in range(300)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    groups = {k: [v for g, v in rows if g == k] for k in "abc"}

    def truth(vs):
        m = sum(vs) / len(vs)
        return len(vs), m, sum((v - m) ** 2 for v in vs) / (len(vs) - 1) if len(vs) > 1 else None

    def same(got, want):
        return got[0] == want[0] and close(got[1], want[1]) and (
            got[2] == want[2] or close(got[2], want[2])
        )

    by = {r.k: (r.n, r.mean, r.variance) for r in st.summary_stats_by(df, "v", k="k").collect()}
    assert all(same(by[k], truth(vs)) for k, vs in groups.items())
    assert same(tuple(st.summary_stats(df, "v").first()), truth([v for _, v in rows]))

    parts = [st.stats_state(df.where(F.expr(f"hash(v) % 3 = {i}")), "v", ["k"]) for i in (-2, -1, 0, 1, 2)]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    merged = st.merge_states(states, ["k"])
    done = {r.k: (r.n, r.mean, r.variance) for r in st.complete_stats(merged).collect()}
    assert all(same(done[k], truth(groups[k])) for k in "ab")
    assert done["c"] == (1, None, None)
    empty = st.stats_state(df.where("false"), "v")
    assert tuple(empty.first()) == (0, 0.0, 0.0)

    z = st.z_scores(df, "v", ["k"])
    for r in z.collect():
        n, m, var = truth(groups[r.k])
        assert r.z is None if n < 2 else close(r.z, (r.v - m) / math.sqrt(var), 1e-7)
    whole = truth([v for _, v in rows])
    r = st.z_scores(df, "v").first()
    assert close(r.z, (r.v - whole[1]) / math.sqrt(whole[2]), 1e-7)


def good_turing(nr, confidence=1.96):
    """The published recipe, step by step on plain numbers."""
    rs = sorted(nr)
    total = sum(r * n for r, n in nr.items())
    points = []
    for j, r in enumerate(rs):
        below = rs[j - 1] if j else 0
        above = rs[j + 1] if j + 1 < len(rs) else 2 * r - below
        points.append((math.log(r), math.log(2 * nr[r] / (above - below))))
    mx = sum(x for x, _ in points) / len(points)
    my = sum(y for _, y in points) / len(points)
    slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
    intercept = my - slope * mx
    smooth = lambda r: math.exp(intercept + slope * math.log(r))
    star, use_fit = {}, False
    for r in rs:
        y = (r + 1) * smooth(r + 1) / smooth(r)
        if not use_fit and r + 1 in nr:
            x = (r + 1) * nr[r + 1] / nr[r]
            width = confidence * math.sqrt((r + 1) ** 2 * nr[r + 1] / nr[r] ** 2 * (1 + nr[r + 1] / nr[r]))
            use_fit = abs(x - y) <= width
        else:
            use_fit = True
        star[r] = y if use_fit else x
    p0 = nr.get(1, 0) / total
    mass = sum(nr[r] * star[r] for r in rs)
    return p0, star, {r: (1 - p0) * star[r] / mass for r in rs}, slope, intercept


# The prosody counts of Gale and Sampson's paper on the method.
PROSODY = {
    1: 120, 2: 40, 3: 24, 4: 13, 5: 15, 6: 5, 7: 11, 8: 2, 9: 2, 10: 1, 12: 3, 14: 2, 15: 1,
    16: 1, 17: 3, 19: 1, 20: 3, 21: 2, 23: 3, 24: 3, 25: 3, 26: 2, 27: 2, 28: 1, 31: 2, 32: 2,
    33: 1, 34: 2, 36: 2, 41: 3, 43: 1, 45: 3, 46: 1, 47: 1, 50: 1, 71: 1, 84: 1, 101: 1,
    105: 1, 121: 1, 124: 1, 146: 1, 162: 1, 193: 1, 199: 1, 224: 1, 226: 1, 254: 1, 257: 1,
    339: 1, 421: 1, 456: 1, 481: 1, 483: 1, 1140: 1, 1256: 1, 1322: 1, 1530: 1, 2131: 1,
    2395: 1, 6925: 1, 7846: 1,
}


def test_good_turing_matches_the_paper(spark):
    zipf = Counter(Counter(zipf_words(3000, 8)).values())
    for nr in (PROSODY, dict(zipf)):
        p0, star, p, slope, intercept = good_turing(nr)
        counts = spark.createDataFrame(list(nr.items()), "r long, n long")
        got = {r.r: r for r in sm.sgt_table(counts).collect()}
        assert got.keys() == nr.keys()
        assert all(close(got[r].r_star, star[r]) and close(got[r].p, p[r]) for r in nr)
        fit = sm.sgt_fit(counts).first()
        assert close(fit.slope, slope) and close(fit.intercept, intercept)
        whole = sm.sgt_with_unseen(counts).where("r = 0").first()
        assert close(whole.p, p0)
    counts = spark.createDataFrame(list(PROSODY.items()), "r long, n long")
    assert sum(r * n for r, n in PROSODY.items()) == 30902
    first = sm.sgt_table(counts).where("r = 1").first()
    assert abs(first.p - 2.468e-5) < 5e-9
    compat = sm.sgt_table(counts, compat=True).where("r = 1").first()
    assert compat.r_star == 2 * 40 / 120


def test_absolute_discounting(spark):
    counts = spark.createDataFrame([(1, 6), (2, 2), (5, 1)], "r long, n long")
    query = spark.createDataFrame([(0,), (1,), (5,)], "r long")
    got = {r.r: r.p for r in sm.absolute_discounting(query, counts, 0.5, 20).collect()}
    total = 6 + 4 + 5
    assert close(got[0], (20 - 6) * 0.5 / (6 * total))
    assert close(got[1], 0.5 / total) and close(got[5], 4.5 / total)


def dist(d):
    return {r["item"]: r["p"] for r in d.table.collect()}


def asked(spark, d, *items):
    query = spark.createDataFrame([(i,) for i in items], "item string")
    return {r["item"]: r["p"] for r in d.probability(query).collect()}


def test_distributions(spark):
    words = zipf_words(600, 3)
    truth = Counter(words)
    freqs = spark.createDataFrame(list(truth.items()), "item string, count long")
    n = len(words)

    uniform = di.UniformDist.of(freqs)
    assert set(dist(uniform).values()) == {1 / len(truth)}
    assert asked(spark, uniform, "unknown")["unknown"] == 1 / len(truth)
    extra = spark.createDataFrame([("new",), ("w1",)], "item string")
    assert set(dist(uniform.insert(extra)).values()) == {1 / (len(truth) + 1)}
    assert uniform.merge(di.UniformDist.of(extra)).size().first().size == len(truth) + 1
    assert di.UniformDist.of(freqs.where("false")).table.count() == 0

    weights = di.MapDist.of(freqs, weight="count")
    assert all(close(p, truth[i] / n) for i, p in dist(weights).items())
    assert asked(spark, weights, "unknown", "w1") == {"unknown": 0.0, "w1": truth["w1"] / n}
    logs = weights.log_probability(extra, "item").collect()
    assert {r.item: r.log_p for r in logs}["new"] is None
    both = dist(weights.merge(di.MapDist.of(extra.withColumn("weight", F.lit(1)))))
    assert close(both["new"], 0.25) and close(sum(both.values()), 1)
    assert weights.samples().count() == len(truth)
    best = max(truth.values())
    assert weights.max_probability().first().item == min(w for w, c in truth.items() if c == best)
    assert weights.discount().first().discount == 0.0

    mle = di.MleDist.of(freqs, F.length("item"))
    sizes = Counter()
    for w, c in truth.items():
        sizes[len(w)] += c
    assert dist(mle) == {w: c / sizes[len(w)] for w, c in truth.items()}
    assert close(dist(mle.merge(mle))["w1"], dist(mle)["w1"])
    assert asked(spark, mle, "unknown")["unknown"] == 0.0

    sgt = di.SgtDist.of(freqs)
    nr = count_of_counts(freqs)
    fitted = {r.r: r for r in sm.sgt_table(nr).collect()}
    assert all(close(p, fitted[truth[w]].p) for w, p in dist(sgt).items())
    p0 = sum(1 for c in truth.values() if c == 1) / n
    assert close(asked(spark, sgt, "unknown")["unknown"], p0)
    assert close(asked(spark, di.SgtDist.of(freqs, unseen_bins=4), "unknown")["unknown"], p0 / 4)
    assert close(sum(dist(sgt).values()), 1 - p0)
    assert close(sgt.discount().first().discount, fitted[1].r_star * n)
    assert close(sum(dist(sgt.merge(sgt)).values()), 1.0)

    lid = di.LidstoneDist.of(freqs, 0.5)
    assert close(dist(lid)["w1"], (truth["w1"] + 0.5) / (n + 0.5 * len(truth)))
    wide = di.LidstoneDist.of(freqs, 0.5, bins=1000)
    assert close(asked(spark, wide, "unknown")["unknown"], 0.5 / (n + 500))
    with pytest.raises(di.DistributionException):
        di.LidstoneDist.of(freqs, -1.0)
    with pytest.raises(Exception, match="fewer bins"):
        di.LidstoneDist.of(freqs, 0.5, bins=2).table.collect()
    narrow = di.LidstoneDist.of(freqs, 0.5, bins=2, strict=False)
    assert close(dist(narrow)["w1"], (truth["w1"] + 0.5) / (n + 1))
    assert close(asked(spark, narrow, "unknown")["unknown"], 0.5 / (n + 1))


def test_generate(spark):
    freqs = spark.createDataFrame([("a", 60), ("b", 30), ("c", 9), ("d", 1), ("e", 0)], "item string, count long")
    d = di.MapDist.of(freqs, weight="count")
    draws = d.generate(20_000, seed=3).collect()
    assert sorted(r.draw for r in draws) == list(range(20_000))
    drawn = Counter(r.item for r in draws)
    for item, p in dist(d).items():
        assert abs(drawn[item] / 20_000 - p) < 0.015
    assert "e" not in drawn and drawn["d"] > 0
    again = d.generate(20_000, seed=3).collect()
    assert sorted(map(tuple, draws)) == sorted(map(tuple, again))
    assert sorted(map(tuple, draws)) != sorted(map(tuple, d.generate(20_000, seed=4).collect()))
    even = Counter(r.item for r in di.UniformDist.of(freqs).generate(5000).collect())
    assert set(even) == set("abcde") and min(even.values()) > 850


def test_generate_with_one_item_of_nearly_all_mass(spark, monkeypatch):
    """The item covers nearly every bucket; its buckets are listed in many pieces."""
    monkeypatch.setattr(di, "SPAN_CHUNK", 1000)
    rare = spark.range(50_000).selectExpr("concat('x', id) AS item", "1L AS count")
    freqs = rare.unionByName(spark.createDataFrame([("big", 10**9)], "item string, count long"))
    draws = di.MapDist.of(freqs, weight="count").generate(3000, seed=1).collect()
    assert sorted(r.draw for r in draws) == list(range(3000))
    assert sum(r.item == "big" for r in draws) >= 2990


@pytest.mark.skipif("SGT_COUNTS" not in os.environ, reason="SGT_COUNTS and SGT_EXPECTED name two tables")
def test_good_turing_matches_a_published_table(spark):
    """Two files without header: r, n of a corpus, and r, p with the unseen mass at r = 0."""
    read = lambda name, kind: spark.read.csv(os.environ[name], sep="\t", schema=f"r long, {kind}")
    counts, expected = read("SGT_COUNTS", "n long"), read("SGT_EXPECTED", "p double")
    got = {r.r: r.p for r in sm.sgt_with_unseen(counts).collect()}
    want = {r.r: r.p for r in expected.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[r], p, rel_tol=1e-9) for r, p in want.items())
