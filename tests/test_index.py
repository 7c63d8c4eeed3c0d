import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusfreq.operators import index as ix
from corpusfreq.operators import membership as me
from corpusfreq.operators import tokens as tk
from corpusfreq.operators import vocab as vo
from corpusfreq.plans.ranking import dense_index, ordinal_within, running_total
from corpusfreq.plans.skew import Lookup, lookup_join, lookup_joins

TEXTS = ["the cat\nthe dog", "A dog", "", "Ünï the the"]


def corpus(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_membership(spark, tmp_path):
    docs = corpus(spark)
    types = me.doc_types(docs)
    assert types.count() == types.distinct().count() == 7
    typed = me.with_types(docs)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(me.docs_containing(typed, "the")) == [0, 3]
    unknown = typed.withColumn("types", F.when(F.col("doc_id") != 1, F.col("types")))
    assert ids(me.docs_containing(unknown, "the")) == [0, 1, 3]
    assert ids(me.docs_containing_types(docs, types, "dog")) == [0, 1]
    path = str(tmp_path / "types")
    me.write_types(types, path)
    assert ids(me.docs_containing_types(docs, spark.read.parquet(path), "dog")) == [0, 1]


def test_inverted_index(spark, tmp_path):
    docs = corpus(spark)
    index = ix.index_documents(docs)
    nested = {(r.norm, r.doc_id): [tuple(p) for p in r.postings] for r in ix.document_postings(docs).collect()}
    assert nested["the", 0] == [(0, 0, 3), (1, 0, 3)] and nested["ünï", 3] == [(0, 0, 3)]
    merged = ix.merge_indexes(index, index_shift(docs))
    assert merged.count() == 2 * index.count()
    shifted = ix.map_postings(index, line=F.col("line") + 1).where("norm = 'cat'").first()
    assert shifted.line == 1
    hits = ix.docs_for_token(index, docs.where("doc_id < 3"), "the", columns=["text"]).collect()
    assert sorted((r.ord, r.doc_id) for r in hits) == [(0, 0), (2, 0)]
    path = str(tmp_path / "index")
    ix.write_index(index, path)
    assert spark.read.parquet(path).where("norm = 'the'").count() == 4


def index_shift(docs):
    return ix.index_documents(docs.withColumn("doc_id", F.col("doc_id") + 100))


def test_posting_blocks_are_bounded_and_whole(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 20)}", i) for i in range(1000)]
    index = spark.createDataFrame(rows, "key string, pos int")
    blocks = ix.posting_blocks(index, block_postings=64).collect()
    assert max(len(b.positions) for b in blocks) <= 64
    got, want = defaultdict(list), defaultdict(list)
    for b in sorted(blocks, key=lambda b: b.block):
        got[b.key] += b.positions
    for k, p in rows:
        want[k].append(p)
    assert got == want


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange rangepartitioning") + plan.count("Exchange hashpartitioning")


def test_posting_blocks_cut_in_place(spark):
    """The same lists after one shuffle, over keys longer than a batch, null keys and null positions."""
    hot = spark.range(0, 50_000, 1, 3).selectExpr("'hot' AS key", "struct(concat('d', id % 700) AS doc, id AS ord) AS pos")
    rest = spark.range(0, 3_000).selectExpr(
        "CASE WHEN id % 9 > 0 THEN concat('k', id % 400) END AS key", "CASE WHEN id % 7 > 0 THEN struct(concat('d', id % 5) AS doc, id AS ord) END AS pos"
    )
    index = hot.unionByName(rest)
    blocks = ix.posting_blocks(index, block_postings=64, by_rank=False)
    assert blocks.columns == ix.posting_blocks(index.limit(1)).columns and exchanges(blocks) == 1
    got, want = defaultdict(list), defaultdict(list)
    found = blocks.collect()
    assert len({b.block for b in found}) == len(found) and 0 < min(len(b.positions) for b in found)
    assert max(len(b.positions) for b in found) == 64 and len(found) < 50_000 / 64 + 401 + 400 + 2 * 4
    for b in sorted(found, key=lambda b: b.block):
        got[b.key] += [tuple(p) for p in b.positions]
    for r in index.where("pos IS NOT NULL").collect():
        want[r.key].append(tuple(r.pos))
    assert got == {k: sorted(v) for k, v in want.items()} and None in got
    for key in ("struct(id % 3 AS a)", "CASE WHEN id % 3 = 0 THEN double('NaN') ELSE double(id % 3) END"):
        other = ix.posting_blocks(spark.range(30).selectExpr(f"{key} AS key", "id AS pos"), by_rank=False).collect()
        lists = defaultdict(list)
        for b in sorted(other, key=lambda b: b.block):
            lists[str(b.key)] += b.positions
        assert sorted(lists.values()) == [list(range(i, 30, 3)) for i in range(3)] and len(other) < 3 + 4
    assert ix.posting_blocks(index.where("pos IS NULL"), by_rank=False).count() == 0


@pytest.mark.parametrize("by_rank", [True, False])
@pytest.mark.parametrize("apart", [True, False])
def test_merged_blocks_know_their_start(spark, by_rank, apart):
    rng = random.Random(6)
    shift = 10_000 if apart else 0
    parts = [
        [("hot", rng.randint(0, 3000) + shift * i) for _ in range(700)] + [(rng.choice("abcd"), rng.randint(0, 99) + shift * i) for _ in range(90)]
        + [(f"own{i}", 5)] + [("tied", 10_000 * i + 3)] * 70 + [("late" if i else "early", 7)] * 5
        for i in (2, 0, 1)
    ]
    blocks = [
        ix.posting_blocks(spark.createDataFrame(rows, "key string, pos int"), block_postings=16, by_rank=by_rank) for rows in parts
    ]
    merged = ix.merge_posting_blocks(*blocks).collect()
    want, got = defaultdict(list), defaultdict(list)
    for key, pos in sum(parts, []):
        want[key].append(pos)
    for r in sorted(merged, key=lambda r: (r.key, r.block)):
        assert r.start == len(got[r.key])
        got[r.key] += r.positions
    assert got == {k: sorted(v) for k, v in want.items()}
    for key in want:
        assert sorted(r.block for r in merged if r.key == key) == list(range(sum(r.key == key for r in merged)))


def test_merging_shuffles_no_postings_of_frequent_keys(spark, tmp_path):
    """Positions that lie apart: blocks of frequent keys get their numbers from a broadcast."""
    path, blocks = str(tmp_path / "blocks"), []
    for i in (1, 0):
        index = spark.range(200_000).selectExpr("concat('k', id % 5) AS key", f"id + {i} * 1000000 AS pos")
        ix.posting_blocks(index, by_rank=False).write.parquet(f"{path}{i}")
        blocks.append(spark.read.parquet(f"{path}{i}"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        merged = ix.merge_posting_blocks(*blocks).where("positions[0] >= 0")
        # Only the two sides of the join for the other keys.
        assert exchanges(merged) == 2 and merged.selectExpr("sum(size(positions))").first()[0] == 400_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_vocabulary(spark):
    rng = random.Random(4)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(300)]
    rows = spark.createDataFrame([(i // 7, i % 7, w) for i, w in enumerate(words)], "doc_id int, ord int, norm string")
    seen = list(dict.fromkeys(words))
    vocab = vo.build_vocab(rows)
    assert {r.item: r.ix for r in vocab.collect()} == {w: i for i, w in enumerate(seen)}
    assert vo.vocab_size(vocab).first().size == len(seen)
    empty = vo.vocab_size(vocab.where("false")).first()
    assert empty.size == 0 and empty.is_empty
    more = spark.createDataFrame([(0, 0, "zz"), (0, 1, words[0]), (0, 2, "yy")], "doc_id int, ord int, norm string")
    longer = vo.extend_vocab(vocab, more)
    ids = {r.item: r.ix for r in longer.collect()}
    assert ids["zz"] == len(seen) and ids["yy"] == len(seen) + 1 and len(ids) == len(seen) + 2
    assert vo.extend_vocab(longer, more).count() == longer.count()
    assert sorted(r.ix for r in vo.extend_vocab(vocab.where("false"), more).collect()) == [0, 1, 2]
    query = spark.createDataFrame([("zz",), (words[0],)], "norm string")
    assert {r.norm: r.ix for r in vo.lookup_items(query, vocab).collect()} == {"zz": None, words[0]: 0}
    assert [r.norm for r in vo.known_items(query, vocab).collect()] == [words[0]]
    numbers = spark.createDataFrame([(0,), (10_000,)], "ix long")
    assert {r.ix: r.item for r in vo.lookup_ids(numbers, vocab).collect()} == {0: words[0], 10_000: None}
    encoded = vo.encode_corpus(rows, vocab).orderBy("doc_id", "ord").collect()
    assert [r.ix for r in encoded] == [seen.index(w) for w in words]


def test_ranking(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 5 + list("xyz")), rng.random(), rng.randint(1, 9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, t double, v int")
    ranked = sorted(rows, key=lambda r: r[1])
    assert [r.ix for r in dense_index(df, ["t"], start=3).orderBy("t").collect()] == list(range(3, 503))
    total, sums = 0, []
    for r in ranked:
        total += r[2]
        sums.append(total)
    assert [r.s for r in running_total(df, ["t"], "v", "s").orderBy("t").collect()] == sums
    seen, expected = defaultdict(int), []
    for r in ranked:
        expected.append(seen[r[0]])
        seen[r[0]] += 1
    assert [r.ord for r in ordinal_within(df, "g", ["t"]).orderBy("t").collect()] == expected


def test_lookup_join_hot_cold_null_and_missing(spark):
    rows = spark.createDataFrame(
        [(i, k) for i, k in enumerate(["hot"] * 50 + ["cold", "cold", None, None, "gone"] + ["lost"] * 30)],
        "id int, k string",
    )
    table = spark.createDataFrame([("hot", 1, 50), ("cold", 2, 2), ("spare", 3, 1)], "key string, v int, n long")
    truth = {"hot": 1, "cold": 2}
    for weight in ("n", None):
        for share in (1, 2, 10_000):
            out = lookup_join(rows, table, {"k": "key"}, weight, {"v": "v"}, hot_share=share).collect()
            assert len(out) == rows.count()
            assert all(r.v == truth.get(r.k) for r in out)


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("lookups", [1, 2])
def test_hot_rows_spread_over_the_reduce_tasks(spark, unique, lookups):
    """Three quarters of the rows carry one word: no task may hold much more than the others."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        word = lambda seed: f"CASE WHEN pmod(hash(id, {seed}), 4) < 3 THEN 'hot' ELSE concat('w', id % 9000) END"
        rows = spark.range(0, 200_000, 1, 8).selectExpr("id", f"{word(1)} AS k", f"{word(2)} AS k2")
        if not unique:
            rows = rows.drop("id")
        counts = rows.groupBy("k").count().unionByName(rows.groupBy("k2").count().withColumnRenamed("k2", "k"))
        table = counts.groupBy(F.col("k").alias("key")).agg(F.sum("count").alias("n"))
        out = lookup_joins(rows, [Lookup(table, {k: "key"}, "n", {f"n_{k}": "n"}) for k in ["k", "k2"][:lookups]], 1000)
        assert out.where("n_k IS NULL").count() == 0 and out.count() == 200_000
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        if lookups == 1:  # the hot rows stay in the eight tasks they came in
            assert sum(sorted(sizes)[-8:]) >= 149_000
        assert max(sizes) <= 3 * sum(sizes) / len(sizes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
