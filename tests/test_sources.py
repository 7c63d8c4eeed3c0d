import os

from pyspark.sql import functions as F

from corpusfreq.sources import corpus as src


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def test_load_corpus(spark, tmp_path):
    root = tmp_path / ".parent" / "corpus"
    write(str(root / "spmone.txt"), "buy\nnow")
    write(str(root / "deep" / "er" / "two.txt"), "café".encode("latin-1"))
    write(str(root / ".hidden"), "no")
    write(str(root / ".dir" / "x.txt"), "no")
    docs = src.load_corpus(spark, str(root), encoding="ISO-8859-1")
    got = {os.path.basename(r.doc_id): r.text for r in docs.collect()}
    assert got == {"spmone.txt": "buy\nnow", "two.txt": "café"}
    tags = {os.path.basename(r.doc_id): r.tag for r in src.tag_by_name(docs).collect()}
    assert tags == {"spmone.txt": "SPAM", "two.txt": "HAM"}
    one = src.load_corpus(spark, str(root / "spmone.txt")).collect()
    assert [r.text for r in one] == ["buy\nnow"]
    # With wildcards hidden folders below the fixed part are skipped, too.
    for pattern in ("*", "d*", ".d*"):
        wild = src.load_corpus(spark, f"{root}/{pattern}", encoding="ISO-8859-1").collect()
        names = {os.path.basename(r.doc_id) for r in wild}
        assert names == {"*": {"spmone.txt", "two.txt"}, "d*": {"two.txt"}, ".d*": set()}[pattern]


def test_tag_rules(spark):
    docs = spark.createDataFrame([("/a/x1",), ("/x/ab",), ("/a/q",)], "doc_id string")
    rules = [("x", "X"), ("a", "A")]
    got = {r.doc_id: r.tag for r in src.tag_by_name(docs, rules, "other").collect()}
    assert got == {"/a/x1": "X", "/x/ab": "A", "/a/q": "other"}


def test_make_and_add(spark):
    docs = spark.createDataFrame(
        [("a", "old", 1), ("a", "new", 2), ("b", "only", 1)], "doc_id string, text string, seq int"
    )
    corpus = src.make_corpus(docs, "seq").select("doc_id", "text")
    assert sorted(map(tuple, corpus.collect())) == [("a", "new"), ("b", "only")]
    added = spark.createDataFrame([("b", "later"), ("c", "first")], "doc_id string, text string")
    both = src.add_documents(corpus, added)
    assert sorted(map(tuple, both.collect())) == [("a", "new"), ("b", "later"), ("c", "first")]
    # Several added rows of one id: the last in order or, without one, the greatest.
    twice = spark.createDataFrame([("b", "x", 2), ("b", "z", 1), ("b", "y", 0)], "doc_id string, text string, seq int")
    last = src.add_documents(corpus, twice, order_by="seq").collect()
    assert sorted(map(tuple, last)) == [("a", "new"), ("b", "x")]
    assert sorted(map(tuple, src.add_documents(corpus, twice.drop("seq")).collect())) == [("a", "new"), ("b", "z")]


def test_stop_words(spark, tmp_path):
    path = str(tmp_path / "stop.txt")
    write(path, "The of\nand the")
    lowered = src.load_stop_words(spark, path)
    assert sorted(r.norm for r in lowered.collect()) == ["and", "of", "the"]
    raw = src.load_stop_words(spark, path, lower=False)
    assert sorted(r.norm for r in raw.collect()) == ["The", "and", "of", "the"]


def test_pairs(spark, tmp_path):
    path = str(tmp_path / "pairs.tsv")
    write(path, "1\t10\n2\t20\nbad\n3\t1\t2\n1\t11\nx\t5\n")
    pairs = src.read_pairs(spark, path, "r long", "n double")
    assert sorted(map(tuple, pairs.collect())) == [(1, 11.0), (2, 20.0)]
    out = str(tmp_path / "out")
    src.write_pairs(pairs, out, "r", "n")
    again = src.read_pairs(spark, out, "r long", "n double")
    assert sorted(map(tuple, again.collect())) == [(1, 11.0), (2, 20.0)]


def test_last_line_wins_across_many_lines(spark, tmp_path):
    path = str(tmp_path / "long.tsv")
    write(path, "".join(f"{i % 7}\t{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        pairs = src.read_pairs(spark, path, "k int", "v int")
        assert {r.k: r.v for r in pairs.collect()} == {i % 7: i for i in range(5000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b"\xe9"),)], "content binary")
    assert df.select(src.decode_text(F.col("content"), "ISO-8859-1").alias("t")).first().t == "é"
