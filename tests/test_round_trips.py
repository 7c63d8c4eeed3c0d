"""Merged block indexes, measured contexts over rows, t differences of tables, refreshed corpora."""

import math
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusfreq.operators import association as assoc
from corpusfreq.operators import context as cx
from corpusfreq.operators import index as ix
from corpusfreq.plans.ranking import running_total
from corpusfreq.sources import corpus as src
from corpusfreq.sources import incremental as inc


def test_merged_blocks_equal_the_index_of_both(spark):
    """Keys in one, two or three indexes, a key with most postings, repeated positions."""
    rnd = random.Random(8)
    parts = []
    for part in range(3):
        rows = [("hot", rnd.randint(0, 4000)) for _ in range(900)] + [(rnd.choice("abcdefg"), rnd.randint(0, 50)) for _ in range(60)]
        rows += [("same", 7)] * 40 + [("own" + str(part), part)] + ([("late", 10_000 + k) for k in range(100)] if part == 2 else [("late", k) for k in range(100)])
        parts.append(rows)
    blocks = [ix.posting_blocks(spark.createDataFrame(rows, "key string, pos int"), block_postings=16) for rows in parts]
    merged = ix.merge_posting_blocks(*blocks).collect()
    want = defaultdict(list)
    for key, pos in sum(parts, []):
        want[key].append(pos)
    got = defaultdict(list)
    for row in sorted(merged, key=lambda r: (r["key"], r["block"])):
        assert row["positions"]
        got[row["key"]] += row["positions"]
        if row["key"] != "same":
            assert len(row["positions"]) <= 3 * 16 + 20
    assert got == {k: sorted(v) for k, v in want.items()}
    for key in want:
        numbers = [r["block"] for r in merged if r["key"] == key]
        assert len(set(numbers)) == len(numbers) and min(numbers) >= 0
    # A merged index can be merged again, and merging with nothing changes nothing.
    nothing = blocks[0].where("key = 'none'")
    again = ix.merge_posting_blocks(ix.merge_posting_blocks(blocks[0], blocks[1]), blocks[2], nothing).collect()
    once = defaultdict(list)
    for row in sorted(again, key=lambda r: (r["key"], r["block"])):
        once[row["key"]] += row["positions"]
    assert once == got


@pytest.mark.parametrize("trim_after", [False, True])
@pytest.mark.parametrize(("size", "block_rows"), [(0, 4), (9, 16)])
def test_measured_contexts_over_rows(spark, trim_after, size, block_rows):
    """The same as inside a row, with one sequence that holds most of the rows."""
    rnd = random.Random(size)
    docs = [("long", ["w" * rnd.randint(0, 7) for _ in range(500)])]
    docs += [(f"d{i}", [rnd.choice(["a", "bb", "", "ccccccc"]) for _ in range(rnd.randint(0, 9))]) for i in range(40)]
    vectors = spark.createDataFrame(docs, "doc_id string, vector array<string>")
    rows = vectors.select("doc_id", F.posexplode("vector").alias("ord", "norm")).repartition(3)
    got = cx.measured_contexts_of_rows(rows, size, trim_after=trim_after, block_rows=block_rows)
    want = cx.measured_contexts(vectors, size, keep=["doc_id"], trim_after=trim_after)
    listed = lambda df: sorted((r["doc_id"], r["ord"], tuple(r["context"])) for r in df.collect())
    assert listed(got) == listed(want)


def test_running_total_of_any_numbers(spark):
    rows = [(i, v) for i, v in enumerate([None, 2.5, -4.0, None, 1.0] * 40)]
    df = spark.createDataFrame(rows, "i int, v double").repartition(7)
    got = [r["s"] for r in running_total(df, ["i"], "v", "s").orderBy("i").collect()]
    total, want = 0.0, []
    for _, v in rows:
        total += v or 0.0
        want.append(total)
    assert got == want
    assert running_total(df.where("i < 0"), ["i"], "v", "s").count() == 0
    assert dict(running_total(df.selectExpr("i"), ["i"], "i", "s").dtypes)["s"] == "bigint"


def test_t_differences_of_tables(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    grams = {(rnd.choice(words), rnd.choice(words)): rnd.randint(1, 9) for _ in range(90)}
    bigrams = spark.createDataFrame([(*g, n) for g, n in grams.items()], "w1 string, w2 string, count long")
    wanted = [(t, r) for t in words[:5] for r in words[3:8]] + [("w0", "w3"), ("none", "w1"), ("w1", "none")]
    near = defaultdict(lambda: defaultdict(int))
    for (a, b), n in grams.items():
        if n >= 2:
            near[a][b] += n
            if a != b:
                near[b][a] += n
    want = {}
    for t, r in set(wanted):
        for v, n in near[t].items():
            if r in near[t] and v != r:
                m = near[t][r]
                want[t, r, v] = (m, n, round((n - m) / math.sqrt(n + m), 9))
    table = spark.createDataFrame(wanted, "target string, rival string")
    got = {(r["target"], r["rival"], r["v"]): (r["n_rival"], r["n_v"], round(r["t"], 9)) for r in assoc.t_difference_table(bigrams, table, blocks=3).collect()}
    assert got == want and want
    # One target agrees with the form that takes Python values.
    single = {frozenset((r["v1"], r["v2"])): abs(round(r["t"], 9)) for r in assoc.t_differences(bigrams, "w1", ["w4"]).collect()}
    assert {frozenset((v, r)): abs(x[2]) for (t, r, v), x in want.items() if (t, r) == ("w1", "w4")} == single
    best = defaultdict(list)
    for (t, r, v), (_, _, score) in want.items():
        best[t, r].append((-score, v))
    top = defaultdict(list)
    for r in assoc.t_difference_table(bigrams, table, k=2, blocks=3).collect():
        top[r["target"], r["rival"]].append((-round(r["t"], 9), r["v"]))
    assert {k: sorted(v) for k, v in top.items()} == {k: sorted(v)[:2] for k, v in best.items()}


def test_a_corpus_follows_its_folder(spark, tmp_path):
    root, store = tmp_path / "files", f"file://{tmp_path}/store"
    (root / "sub").mkdir(parents=True)

    def write(name, text, when):
        (root / name).write_text(text)
        os.utime(root / name, (when, when))

    def texts():
        return {r["doc_id"].rsplit("/files/", 1)[1]: r["text"] for r in inc.current(spark, store).collect()}

    for name, text in (("a.txt", "one"), ("sub/b.txt", "two"), ("c.txt", "three"), (".hidden", "no")):
        write(name, text, 1_700_000_000)
    assert inc.refresh(spark, str(root), store) == 3
    assert texts() == {"a.txt": "one", "sub/b.txt": "two", "c.txt": "three"}
    assert inc.refresh(spark, str(root), store) == 0
    # One changed, one new with an old date, one gone.
    write("a.txt", "ONE", 1_700_000_100)
    write("old.txt", "past", 1_600_000_000)
    (root / "c.txt").unlink()
    changed = {r["doc_id"].rsplit("/files/", 1)[1]: r["present"] for r in inc.changed_files(spark, str(root), store).collect()}
    assert changed == {"a.txt": True, "old.txt": True, "c.txt": False}
    assert inc.refresh(spark, str(root), store) == 3
    assert texts() == {"a.txt": "ONE", "sub/b.txt": "two", "old.txt": "past"}
    # Unchanged files are not stored again; the time is part of the scan.
    assert inc.versions(spark, store).where("version = 1 AND present").count() == 2
    plan = src.visible_files(spark, str(root)).where(F.col("modificationTime") >= F.lit("2024-01-01").cast("timestamp"))
    assert "GreaterThanOrEqual(modificationTime" in plan._jdf.queryExecution().toString()
    # A file that comes back, with its old content, is there again.
    write("c.txt", "three", 1_700_000_000)
    assert inc.refresh(spark, str(root), store) == 1
    assert texts()["c.txt"] == "three"


def test_the_last_version_of_many(spark):
    """Ties by order take the greatest row; null orders come before all others."""
    rows = [("a", i, f"t{i}") for i in range(50)] + [("b", 1, "x"), ("b", 1, "y"), ("c", None, "n"), ("c", 0, "z"), ("d", None, "only"), (None, 3, "null")]
    got = src.make_corpus(spark.createDataFrame(rows, "doc_id string, seq int, text string"), "seq")
    assert {tuple(r) for r in got.collect()} == {("a", 49, "t49"), ("b", 1, "y"), ("c", 0, "z"), ("d", None, "only"), (None, 3, "null")}
