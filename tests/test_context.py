import random

import regex
from pyspark.sql import functions as F

from corpusfreq.operators import collocates as co
from corpusfreq.operators import context as cx
from corpusfreq.operators import kwic as kw
from corpusfreq.operators import ngrams as ng
from corpusfreq.operators import tokens as tk
from corpusfreq.operators.index import index_documents

# Documents and their expected concordances.
DOCS = [
    "a b c d e f g h i j k l m n o p q r s t u v w x y z",
    "aa bb cc dd ee\n ff gg hh ii jj\n kk ll mkm nn oo\n pp qq rr ss tt\n uu vv ww xx yy\n zz",
    "aa bb cc dd ee\n ff gg hh ii    jj\n kk    ll    mjm    nn    oo\n    pp    qq rr ss tt\n"
    " uu vv ww xx yy\n zz",
    "aa bb cc dd ee\n ff gg hjh ii jj\n kk ll mm nn oo\n pp qq hjh ss tt\n uu vv ww xx yy\n zz",
    "aa bb cc dd ee\n ff gg hh ii jj\n kk ljl mm ljl oo\n pp qq rr ss tt\n uu vv ljl xx yy\n zz",
    "Yesterday is gone;\n 'tomorrow'\n doesn't exist;\n today is all there is.",
]
KWIC = {
    "m": [(0, 0, 24, 25, "g h i j k l", "m", "n o p q r")],
    "mkm": [(1, 2, 7, 10, "ii jj kk ll", "mkm", "nn oo pp qq")],
    "mjm": [(2, 2, 13, 16, "ii jj kk ll", "mjm", "nn oo pp qq")],
    "hjh": [
        (3, 1, 7, 10, "dd ee ff gg", "hjh", "ii jj kk ll"),
        (3, 3, 7, 10, "nn oo pp qq", "hjh", "ss tt uu vv"),
    ],
    "ljl": [
        (4, 2, 4, 7, "hh ii jj kk", "ljl", "mm ljl oo"),
        (4, 2, 11, 14, "jj kk ljl mm", "ljl", "oo pp qq rr"),
        (4, 4, 7, 10, "ss tt uu vv", "ljl", "xx yy zz"),
    ],
    "qq": [
        (1, 3, 4, 6, "mkm nn oo pp", "qq", "rr ss tt uu"),
        (2, 3, 10, 12, "mjm nn oo pp", "qq", "rr ss tt uu"),
        (3, 3, 4, 6, "mm nn oo pp", "qq", "hjh ss tt"),
        (4, 3, 4, 6, "mm ljl oo pp", "qq", "rr ss tt uu"),
    ],
    "today": [(5, 3, 1, 6, "doesn't exist;", "today", "is all there")],
    "tomorrow": [(5, 1, 2, 10, "Yesterday is gone; '", "tomorrow", "' doesn't exist")],
}


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def kwic_rows(df):
    rows = df.orderBy("doc_id", "line", "start").collect()
    return [(r.doc_id, r.line, r.start, r.end, r.prefix, r.target, r.suffix) for r in rows]


def test_kwic_goldens(spark):
    docs = corpus(spark, DOCS)
    index = index_documents(docs)
    for target, expected in KWIC.items():
        assert kwic_rows(kw.kwic(docs, target, 10)) == expected
    assert kwic_rows(kw.kwic(docs, "qq", 10, index=index)) == KWIC["qq"]
    assert kwic_rows(kw.kwic(docs, "nowhere", 10)) == []


def test_kwic_at_the_ends(spark):
    docs = corpus(spark, ["\n  '' First, last! \n", "x\n\n  \n  y"])
    assert kwic_rows(kw.kwic(docs, "first", 5)) == [(0, 1, 5, 10, "''", "First", ", last")]
    assert kwic_rows(kw.kwic(docs, "last", 5)) == [(0, 1, 12, 16, "First,", "last", "!")]
    compat = kwic_rows(kw.kwic(docs, "first", 5, compat=True))
    assert compat[0][4] == "First, last!"
    # Lines without tokens contribute nothing.
    assert kwic_rows(kw.kwic(docs, "y", 5)) == [(1, 3, 2, 3, "x", "y", "")]


def brute_kwic(text, target, size, stop=()):
    """Walk the tokens outwards from each hit, one at a time."""
    found = []
    for number, line in enumerate(text.split("\n")):
        for m in regex.finditer(r"[\p{L}\p{M}]+", line):
            if m.group().lower() not in stop:
                found.append((m.group(), number, m.start(), m.end()))
    bearing = sorted({t[1] for t in found})
    lines = text.split("\n")
    begin, joined = {}, ""
    for number in bearing:
        begin[number] = len(joined)
        joined += lines[number] + "\n"
    place = lambda t, k: begin[t[1]] + t[k]
    clean = lambda s: " ".join(s.split())
    out = []
    for h, hit in enumerate(found):
        if hit[0].lower() != target:
            continue
        first, measure = h, 0
        while first > 0 and measure <= size:
            first -= 1
            measure += 1 + len(found[first][0])
        last, measure = h, 1
        while last + 1 < len(found) and measure <= size:
            last += 1
            measure += 1 + len(found[last][0])
        left = place(found[first], 2) if first < h else begin[hit[1]]
        right = place(found[last], 3) if last > h else begin[hit[1]] + len(lines[hit[1]])
        out.append(
            (hit[1], hit[2], hit[3], clean(joined[left : place(hit, 2)]), hit[0],
             clean(joined[place(hit, 3) : right]))
        )
    return out


def random_texts(n, seed):
    rng = random.Random(seed)
    words = ["a", "bb", "Ccc", "déjà", "a", ",", "\n", "  ", "'", "\n\n", "7", "dddddddd"]
    return ["".join(rng.choice(words) + rng.choice([" ", "", " "]) for _ in range(rng.randint(0, 120)))
            for _ in range(n)]


def test_kwic_against_brute_force(spark):
    texts = random_texts(40, 11)
    docs = corpus(spark, texts)
    for target, size, stop in [("a", 10, ()), ("bb", 3, ()), ("déjà", 25, ("a", "ccc")), ("a", 0, ())]:
        expected = [
            (i, *row) for i, t in enumerate(texts) for row in brute_kwic(t, target, size, stop)
        ]
        assert kwic_rows(kw.kwic(docs, target, size, stop=list(stop))) == sorted(
            expected, key=lambda r: r[:3]
        )


def test_format_kwic(spark):
    rows = spark.createDataFrame(
        [("/x/y/name.txt", 2, 7, 10, "ii jj kk ll", "mkm", "nn oo pp qq"),
         ("/" + "n" * 30, 12345678, 7, 10, "p", "t", "s")],
        "doc_id string, line int, start int, end int, prefix string, target string, suffix string",
    )
    text = [r.text for r in kw.format_kwic(rows, 8).orderBy("line").collect()]
    assert text[0] == " " * 17 + "name.txt:      2:  7  jj kk ll  **mkm**  nn oo pp"
    assert text[1] == "n" * 30 + ":12345678:  7  " + " " * 7 + "p  **t**  s"


def test_sync_lines(spark):
    words = ["one", "two", "three", "four", "five"]
    lines = spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "doc_id int, line int, text string")
    hits = [(1, 2, 3), (1, 4, 5), (3, 4, 5), (4, 5, 6), (4, 7, 8), (4, 9, 10)]
    table = spark.createDataFrame([(0, *h) for h in hits], "doc_id int, line int, start int, end int")
    out = kw.sync_lines(lines, table).orderBy("line").collect()
    assert [[tuple(h) for h in r.hits] for r in out] == [
        [h for h in hits if h[0] == i] for i in range(5)
    ]
    none = kw.sync_lines(lines, table.where("false")).collect()
    assert [r.hits for r in none] == [[]] * 5


def vectors(spark, *vs):
    return spark.createDataFrame(list(enumerate(vs)), "doc_id int, vector array<string>")


def rows_of(spark, *vs):
    flat = [(d, i, x) for d, v in enumerate(vs) for i, x in enumerate(v)]
    return spark.createDataFrame(flat, "doc_id int, ord int, norm string")


def test_measured_context(spark):
    goodbye = ["good-bye", "cruel", "world"]
    today = "today is the first day of the , rest of my life .".split()
    out = cx.measured_contexts(vectors(spark, goodbye, today), 10, keep=["doc_id"], trim_after=True)
    last = {r.doc_id: r.context for r in out.orderBy("ord").collect()}
    assert last == {0: ["cruel", "world"], 1: ["of", "my", "life", "."]}
    pushed = cx.measured_contexts(vectors(spark, goodbye), 10, keep=["doc_id"]).orderBy("ord")
    assert [r.context for r in pushed.collect()] == [goodbye[:1], goodbye[:2], goodbye]


def test_measured_context_brute_force(spark):
    rng = random.Random(5)
    v = ["x" * rng.randint(0, 6) for _ in range(200)]
    for size in (0, 3, 10):
        held, expected = [], []
        for x in v:
            kept, measure = [], 0
            for y in held:
                kept.append(y)
                measure += 1 + len(y)
                if measure > size:
                    break
            held = [x, *kept]
            expected.append(held[::-1])
        out = cx.measured_contexts(vectors(spark, v), size).orderBy("ord").collect()
        assert [r.context for r in out] == expected


def test_context_windows(spark):
    v = [str(i) for i in range(1, 8)]
    docs, rows = vectors(spark, v, ["z"]), rows_of(spark, v, ["z"])
    for before, after in [(2, 2), (0, 3), (3, 0), (1, 9)]:
        expected = [
            (d, i, w[max(0, i - before) : i], w[i], w[i + 1 : i + 1 + after])
            for d, w in enumerate([v, ["z"]])
            for i in range(len(w))
        ]
        a = cx.context_windows(docs, before, after, keep=["doc_id"])
        b = cx.context_windows_of_rows(rows, before, after, block_rows=3)
        for df in (a, b):
            got = [tuple(r) for r in df.orderBy("doc_id", "ord").collect()]
            assert got == expected


def brute_collocates(vs, before, after):
    return sorted(
        (d, v[i], v[j], j - i)
        for d, v in enumerate(vs)
        for i in range(len(v))
        for j in range(max(0, i - before), min(len(v), i + after + 1))
        if i != j
    )


def test_collocates(spark):
    digits = [str(i) for i in range(10)]
    rng = random.Random(2)
    vs = [digits, ["1", "2"], ["0", "1", "2", "3"], ["x"], [], [rng.choice("abc") for _ in range(60)]]
    docs, rows = vectors(spark, *vs), rows_of(spark, *vs)
    for span in [(1, 1), (1, 0), (0, 1), (3, 3), (2, 3), (0, 0)]:
        expected = brute_collocates(vs, *span)
        a = co.collocates(docs, *span, keep=["doc_id"])
        assert sorted((r.doc_id, r.head, r.pair, r.dist) for r in a.collect()) == expected
        if span != (0, 0):
            b = co.collocates_of_rows(rows, *span, block_rows=7)
            assert sorted((r.doc_id, r.head, r.pair, r.dist) for r in b.collect()) == expected
        pairs = sorted(tuple(r) for r in co.collocate_pairs(a).collect())
        assert pairs == sorted((h, p) for _, h, p, _ in expected)


def test_collocates_around(spark):
    vs = [[str(i) for i in range(10)], ["5", "6"]]
    docs = vectors(spark, *vs)
    hits = spark.createDataFrame([(0, 0), (0, 5), (0, 40), (1, 1), (9, 0)], "doc_id int, ord int")
    got = co.collocates_around(docs, hits, 1, 2).collect()
    assert sorted((r.doc_id, r.head, r.pair, r.dist) for r in got) == [
        (0, "0", "1", 1), (0, "0", "2", 2),
        (0, "5", "4", -1), (0, "5", "6", 1), (0, "5", "7", 2),
        (1, "6", "5", -1),
    ]
    five = co.get_collocates(docs, "5").collect()
    assert sorted((r.doc_id, r.pair, r.dist) for r in five) == [
        (0, "6", 1), (0, "7", 2), (0, "8", 3), (1, "6", 1),
    ]


def test_collocate_stats(spark):
    c = spark.createDataFrame(
        [("a", "b", 1), ("a", "b", 3), ("a", "c", 2)], "head string, pair string, dist int"
    )
    pop = {(r.head, r.pair): (r.n, r.mean, r.variance) for r in co.collocate_stats(c).collect()}
    assert pop == {("a", "b"): (2, 2.0, 1.0), ("a", "c"): (1, 2.0, 0.0)}
    sample = co.collocate_stats(c, sample_variance=True)
    assert {r.pair: r.variance for r in sample.collect()} == {"b": 2.0, "c": None}
    from corpusfreq.operators.report import collocate_report

    assert [tuple(r) for r in collocate_report(sample).collect()] == [("a", "b", 2, 2.0, 2.0)]


def test_ngrams(spark):
    digits = [str(i) for i in range(10)]
    vs = [digits, ["a", "b"], []]
    docs, rows = vectors(spark, *vs), rows_of(spark, *vs)
    for n in (1, 2, 3, 4):
        for drop in (False, True):
            expected = sorted(
                (d, *v[i : i + n])
                for d, v in enumerate(vs)
                for i in range(max(0, len(v) - n + (0 if drop else 1)))
            )
            a = ng.ngrams(docs, n, drop_last=drop, keep=["doc_id"])
            assert sorted(tuple(r) for r in a.collect()) == expected
            b = ng.ngrams_of_rows(rows, n, drop_last=drop, block_rows=4).drop("ord")
            assert sorted(tuple(r) for r in b.collect()) == expected
    ords = ng.ngrams(docs, 3, with_ord=True, keep=["doc_id"]).where("doc_id = 0").orderBy("ord")
    assert [r.ord for r in ords.collect()] == list(range(8))


def test_models_and_interpolation(spark):
    words = "a b a b c a b a".split()
    uni, bi, tri = ng.ngram_models(vectors(spark, words))
    assert {r.item: r["count"] for r in uni.collect()} == {"a": 3, "b": 2, "c": 1}
    assert {(r.cond, r.item): r["count"] for r in bi.collect()} == {
        ("a", "b"): 3, ("b", "a"): 1, ("b", "c"): 1, ("c", "a"): 1,
    }
    full = ng.ngram_models(vectors(spark, words), full_counts=True)
    assert {r.item: r["count"] for r in full[0].collect()} == {"a": 4, "b": 3, "c": 1}
    query = spark.createDataFrame(
        [("a", "b", "a"), ("a", "b", "c"), ("x", "b", "c"), ("x", "y", "z")],
        "w1 string, w2 string, w3 string",
    )
    got = {tuple(r)[:3]: r.p for r in ng.interpolate(query, (uni, bi, tri), (0.2, 0.3, 0.5)).collect()}
    close = lambda a, b: abs(a - b) < 1e-12
    assert close(got["a", "b", "a"], 0.2 * 3 / 6 + 0.3 / 2 + 0.5 * 2 / 3)
    assert close(got["a", "b", "c"], 0.2 / 6 + 0.3 / 2 + 0.5 / 3)
    assert close(got["x", "b", "c"], 0.2 / 6 + 0.3 / 2)
    assert got["x", "y", "z"] == 0.0
