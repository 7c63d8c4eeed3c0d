"""URL filter, decontamination and line dedup against plain Python."""

import re
from collections import Counter

import pytest

from corpusfreq.llm import decontaminate, lines, urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow")]


def test_rules_and_list(spark):
    rows = [
        (1, "http://a.example.net/en/1"), (2, "http://a.example.net/de/1"), (3, "HTTP://B.Org/fr/x?y#z"),
        (4, "http://badnet/en"), (5, None), (6, "no scheme"), (7, "http://listed.com/p/?utm_source=a&k=1"),
        (8, "https://www.listed.com/p?k=1#top"), (9, "http://net"), (10, "http://listed.com/p?k=2"),
        (1, "http://a.example.net/en/1"), (None, "http://listed.com/p?k=1"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS block", "2 AS mask")
    listed = spark.createDataFrame([("http://LISTED.com/p?k=1",), (None,), ("junk",)], "url string")
    found = urls.filter_urls(pages, listed, RULES).collect()
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found)
    assert got == Counter(
        [
            (1, "a.example.net", "/en/1", "example.net/en/", "allow"), (1, "a.example.net", "/en/1", "example.net/en/", "allow"),
            (2, "a.example.net", "/de/1", "net/", "block"), (3, "b.org", "/fr/x", "org/fr/", "allow"),
            (4, "badnet", "/en", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
            (7, "listed.com", "/p/", None, "block"), (8, "www.listed.com", "/p", None, "block"),
            (9, "net", "", None, "allow"), (10, "listed.com", "/p", None, "allow"), (None, "listed.com", "/p", None, "block"),
        ]
    )


def test_bloom_only_saves_work(spark):
    """A filter of one block passes nearly everything; the verdicts stay exact."""
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 50, '.com/', id) AS url")
    listed = pages.where("page_id % 3 = 0").select("url")
    for keys_per_block in (6, 10**9):
        urls.KEYS_PER_BLOCK, before = keys_per_block, urls.KEYS_PER_BLOCK
        try:
            found = urls.filter_urls(pages, listed).where("verdict = 'block'").select("page_id").collect()
        finally:
            urls.KEYS_PER_BLOCK = before
        assert sorted(r[0] for r in found) == list(range(0, 3000, 3))


def test_empty_tables(spark, empty):
    no_urls = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(no_urls, no_urls, RULES).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert urls.filter_urls(pages, no_urls).first()["verdict"] == "allow"
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, none).count() == 0
    assert lines.drop_boilerplate(empty).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def items(spark, prose):
    long = [t for t in prose if len(words(t)) > 40]
    texts = [" ".join(words(long[0])[5:30]), long[1], "the", " ".join(words(long[2])[:13]), None, "", "Or, THE! " + words(long[3])[0]]
    rows = [(i * 5, t) for i, t in enumerate(texts)] + [(None, " ".join(words(long[4])[:20])), (100, long[1])]
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    places = {}
    for p, word in enumerate(w):
        places.setdefault(word, []).append(p)
    for item, body in items:
        v = words(body)
        n = min(13, len(v))
        for s in range(len(v) - n + 1) if v else ():
            for p in places.get(v[s], ()):
                if w[p : p + n] == v[s : s + n]:
                    hit.update(range(p, p + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), hit, sorted(found)


def test_contamination(spark, docs, items):
    """Every document, null, empty and very long ones among them."""
    listed = [tuple(r) for r in items.collect()]
    # The very long text, with an item in its middle.
    body = docs.where("doc_id = 1005").first()["text"].split(" ")
    planted = " ".join([*body[:15_000], listed[1][1], *body[15_000:]])
    more = spark.createDataFrame([(1006, planted)], "doc_id long, text string")
    short = docs.select("doc_id", "text").unionByName(more)
    want = Counter()
    for r in short.collect():
        n, hit, found = brute(r["text"], listed)
        want[(r["doc_id"], n, len(hit), tuple(found))] += 1
    rows = decontaminate.contamination(short, items).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows) == want
    for r in rows:
        marked = [k for s in r["spans"] for k in range(s["start"], s["stop"])]
        assert len(marked) == len(set(marked)) == r["n_hit"]


def test_shuffled_grams_give_the_same(docs, items):
    short = docs.where("doc_id < 100")
    usual = sorted(map(str, decontaminate.contamination(short, items).collect()))
    decontaminate.BROADCAST_GRAMS, before = 0, decontaminate.BROADCAST_GRAMS
    try:
        assert sorted(map(str, decontaminate.contamination(short, items).collect())) == usual
    finally:
        decontaminate.BROADCAST_GRAMS = before


def test_removal(spark, docs, items):
    listed = [tuple(r) for r in items.collect()]
    short = docs
    left = decontaminate.drop_contaminated(short, items)
    assert left.columns == docs.columns
    clean = Counter()
    for r in short.collect():
        n, hit, _ = brute(r["text"], listed)
        if not (hit and 20 * len(hit) >= n):
            clean[r["doc_id"]] += 1
    assert Counter(r["doc_id"] for r in left.collect()) == clean
    cut = {r["doc_id"]: r["text"] for r in decontaminate.drop_contaminated(short, items, spans_only=True).collect()}
    for r in short.collect():
        _, hit, _ = brute(r["text"], listed)
        rest = [w for i, w in enumerate(words(r["text"])) if i not in hit]
        assert words(cut[r["doc_id"]]) == rest
        if not hit:
            assert cut[r["doc_id"]] == r["text"]


def test_line_dedup(spark):
    rows = [(i, f"own {i}\nMenu\n\n{'Foot' if i % 4 == 0 else 'x' + str(i)}", "a", 0) for i in range(40)]
    rows += [(100 + i, f"Menu\nonly {i}", "b", 0) for i in range(4)]
    rows += [(200 + i, "Menu\nMenu", None, 0) for i in range(6)] + [(300, None, "a", 0), (301, "", "a", 0), (0, rows[0][1], "a", 0)]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").selectExpr("*", "1 AS line", "2 AS host", "3 AS total")
    cut = lines.with_lengths(lines.drop_boilerplate(pages, ratio=0.3, n_lines="n_lines", n_dropped="gone"))
    assert cut.columns == [*pages.columns, "n_lines", "gone"]
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["gone"], r["n_chars"]) for r in cut.collect())
    want = Counter()
    for d, t, s, _ in rows:
        if t is None:
            want[(d, None, 0, 0, None)] += 1
            continue
        boiler = {"a": {"Menu"}, None: {"Menu"}}.get(s, set())
        kept = [x for x in t.split("\n") if x not in boiler]
        body = "\n".join(kept)
        want[(d, body, t.count("\n") + 1, t.count("\n") + 1 - len(kept), len(body))] += 1
    assert got == want


def test_lines_of_long_texts_and_nameless_hosts(spark):
    """A text of many thousand lines; a host that is null and has null texts only."""
    long = "\n".join(["Menu"] + [f"line {i}" for i in range(20_000)])
    rows = [(1, long, "a")] + [(10 + i, f"Menu\nown {i}", "a") for i in range(9)] + [(50 + i, None, None) for i in range(7)]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(pages, ratio=0.5).collect()}
    assert got == {i: t.removeprefix("Menu\n") if t else t for i, t, _ in rows}
