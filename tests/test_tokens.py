import random
import re

from pyspark.sql import functions as F

from corpusfreq.functions.arrays import running_sums
from corpusfreq.functions.text import slice_lines
from corpusfreq.operators import tokens as tk

# A sentence, the same on four lines, and the start columns of its tokens.
SENTENCE = "Now is the time for all good people to come to the aid of their country."
FOUR_LINES = "Now is the time for\nall good people to come\nto the aid of their\ncountry."
STARTS = [0, 4, 7, 11, 16, 20, 24, 29, 36, 39, 44, 47, 51, 55, 58, 64]
LINE_STARTS = [
    (0, 0), (0, 4), (0, 7), (0, 11), (0, 16),
    (1, 0), (1, 4), (1, 9), (1, 16), (1, 19),
    (2, 0), (2, 3), (2, 7), (2, 11), (2, 14),
    (3, 0),
]
WORDS = re.findall(r"\w+", SENTENCE)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def ordered(df):
    return df.orderBy("doc_id", "ord").collect()


def test_spans_of_a_sentence(spark):
    rows = ordered(tk.tokenize_spans(docs(spark, SENTENCE)))
    assert [(r.norm, r.start, r.end) for r in rows] == [
        (w, s, s + len(w)) for w, s in zip(WORDS, STARTS)
    ]


def test_line_positions(spark):
    rows = ordered(tk.tokenize(docs(spark, FOUR_LINES)))
    assert [(r.norm, r.line, r.start, r.end) for r in rows] == [
        (w, n, s, s + len(w)) for w, (n, s) in zip(WORDS, LINE_STARTS)
    ]


def test_lower_case(spark):
    lowered = [r.norm for r in ordered(tk.tokenizer(docs(spark, SENTENCE)))]
    assert lowered == [w.lower() for w in WORDS]
    normal = tk.normalize(tk.tokenize(docs(spark, SENTENCE)))
    assert [r.norm for r in ordered(normal)] == lowered


def test_positions_count_code_points(spark):
    text = "\U0001d49ćbc déjà\r\n\n1_2 x'y \U0001f600 z"
    rows = ordered(tk.tokenize(docs(spark, text)))
    expected = []
    for number, line in enumerate(text.split("\n")):
        import regex

        for m in regex.finditer(r"[\p{L}\p{M}]+", line):
            expected.append((m.group(), number, m.start(), m.end()))
    assert [(r.norm, r.line, r.start, r.end) for r in rows] == expected


def test_long_line_uses_block_scan(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("ab .,é") for _ in range(30_000))
    rows = ordered(tk.tokenize_spans(docs(spark, text, "", "...")))
    expected = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[abé]+", text)]
    assert [(r.norm, r.start, r.end) for r in rows] == expected


def test_running_sums_for_every_length(spark):
    df = spark.range(0, 200).select(
        "id", F.expr("transform(sequence(1, 200), x -> x * 3)").alias("a")
    )
    df = df.select("id", F.slice("a", 1, F.col("id").cast("int")).alias("a"))
    for r in df.select("a", running_sums(F.col("a")).alias("s")).collect():
        assert r.s == [sum(r.a[: i + 1]) for i in range(len(r.a))]


def test_other_patterns(spark):
    rows = ordered(tk.tokenize_spans(docs(spark, "a1 22 b3"), pattern=r"\d+"))
    assert [(r.norm, r.start) for r in rows] == [("1", 1), ("22", 3), ("3", 7)]


def test_line_offset(spark):
    rows = ordered(tk.tokenize(docs(spark, "a\nb"), offset=5))
    assert [r.line for r in rows] == [5, 6]


def test_stop_words_keep_positions(spark):
    source = docs(spark, FOUR_LINES)
    by_list = ordered(tk.tokenizer(source, stop=["the", "to", "is"]))
    table = spark.createDataFrame([("the",), ("to",), ("is",)], "norm string")
    by_table = tk.tokenizer(source, stop=table)
    again = ordered(tk.token_index(by_table))
    long_form = ordered(tk.token_index(by_table, long_groups=True))
    strip = lambda rows: [(r.ord, r.norm, r.line, r.start) for r in rows]
    assert strip(by_list) == strip(again) == strip(long_form)
    assert [r.norm for r in by_list][:3] == ["now", "time", "for"]
    assert by_list[1].start == 11


def test_document_arrays_and_vectors(spark):
    source = docs(spark, "B a b", "c")
    row = tk.tokenize_documents(source).orderBy("doc_id").first()
    assert [t.norm for t in row.tokens] == ["b", "a", "b"] and row.types == ["b", "a"]
    vectors = tk.corpus_vectors(source, target="b").collect()
    assert [(r.doc_id, r.vector) for r in vectors] == [(0, ["b", "a", "b"])]


def run_of(text, first, last):
    import regex

    out = []
    for number, line in enumerate(text.split("\n")):
        for m in regex.finditer(r"[\p{L}\p{M}]+", line):
            out.append((number, m.start(), m.end()))
    return out[first:last]


def test_slice_lines(spark):
    cases = [
        ("This is the first day of the rest of my life.", 2, 5, ["the first day"]),
        ("This is the first day\nof the rest of my life.", 2, 8, ["the first day", "of the rest"]),
        ("This is the first day\nof the rest\nof my life.", 2, 8, ["the first day", "of the rest"]),
        ("a b\nc d\n\ne f", 1, 5, ["b", "c d", "e"]),
        ("a b c", 1, 2, ["b c"]),
        ("a b c", 0, 0, []),
    ]
    rows = [(i, t, run_of(t, a, b)) for i, (t, a, b, _) in enumerate(cases)]
    df = spark.createDataFrame(
        rows, "id int, text string, run array<struct<line:int,start:int,end:int>>"
    )
    out = df.orderBy("id").select(slice_lines(F.col("text"), F.col("run")).alias("s")).collect()
    assert [r.s for r in out] == [c[3] for c in cases]
