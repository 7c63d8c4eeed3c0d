import random
from collections import Counter

from pyspark.sql import functions as F

from corpusfreq.operators import freqs as fr
from corpusfreq.operators import ngrams as ng
from corpusfreq.operators import tokens as tk
from corpusfreq.operators.report import freq_report, freq_show_report

# Two paragraphs and facts about them that the results must match.
PARAGRAPHS = [
    " *BEFORE!* YOU USE OR READ THIS ETEXT\n"
    " By using or reading any part of this PROJECT GUTENBERG-tm\n"
    " etext, you indicate that you understand, agree to and accept\n"
    ' this "Small Print!" statement.  If you do not, you can receive\n'
    " a refund of the money (if any) you paid for this etext by\n"
    " sending a request within 30 days of receiving it to the person\n"
    " you got it from.  If you received this etext on a physical\n"
    " medium (such as a disk), you must return it with your request.\n",
    " ABOUT PROJECT GUTENBERG-TM ETEXTS\n"
    " This PROJECT GUTENBERG-tm etext, like most PROJECT GUTENBERG-\n"
    ' tm etexts, is a "public domain" work distributed by Professor\n'
    " Michael S. Hart through the Project Gutenberg Association at\n"
    ' Illinois Benedictine College (the "Project").  Among other\n'
    " things, this means that no one owns a United States copyright\n"
    " on or for this work, so the Project (and you!) can copy and\n"
    " distribute it in the United States without permission and\n"
    " without paying copyright royalties.  Special rules, set forth\n"
    " below, apply if you wish to copy and distribute this etext\n"
    ' under the Project\'s "PROJECT GUTENBERG" trademark.\n ',
]
REPLACED = {
    "a": 6, "and": 5, "any": 2, "by": 3, "can": 2, "copy": 2, "copyright": 2,
    "distribute": 2, "etext": 6, "etexts": 2, "for": 2, "gutenberg": 6, "if": 4, "it": 4,
    "of": 3, "on": 2, "or": 3, "project": 9, "request": 2, "s": 2, "states": 2, "that": 2,
    "the": 7, "this": 9, "tm": 4, "to": 3, "united": 2, "without": 2, "work": 2, "you": 11,
    "*": 73,
}


def counts(df, *keys):
    keys = keys or ("item",)
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r["count"] for r in df.collect()}


def paragraphs(spark):
    docs = spark.createDataFrame(list(enumerate(PARAGRAPHS)), "doc_id int, text string")
    return docs, tk.tokenizer(docs)


def test_paragraphs_end_to_end(spark):
    docs, tokens = paragraphs(spark)
    freqs = fr.frequencies(tokens)
    table = counts(freqs)
    assert table == counts(fr.word_frequencies(docs))
    assert (table["you"], table["project"], table["this"], table["the"]) == (11, 9, 9, 7)
    hapax = fr.hapaxes(freqs)
    assert {r.item for r in hapax.collect()} == {w for w, c in table.items() if c == 1}
    assert counts(fr.replace_freqs_from_set(freqs, hapax, "*")) == REPLACED
    for weights in (None, freqs):
        replaced = fr.replace_from_set(tokens, hapax, "*", freqs=weights)
        assert counts(fr.frequencies(replaced)) == REPLACED

    vectors = (
        replaced.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "norm"))).alias("t"))
        .select("doc_id", F.col("t.norm").alias("vector"))
    )
    grams = counts(ng.ngram_freqs(vectors, 3, drop_last=True), "w1", "w2", "w3")
    assert grams["*", "*", "*"] == 13 and grams["you", "*", "*"] == 3
    assert grams["without", "*", "copyright"] == 1 and grams["you", "can", "copy"] == 1
    assert ("*", "*", "request") not in grams
    full = counts(ng.ngram_freqs(vectors, 3), "w1", "w2", "w3")
    assert full["*", "*", "request"] == 1
    assert sum(full.values()) - sum(grams.values()) == 2


def test_conditional_frequencies(spark):
    rows = [("a", 1), ("b", 2), ("c", 3)] * 4 + [("a", 2), ("b", 3), ("c", 4)]
    df = spark.createDataFrame(rows, "k string, v int")
    cond = fr.conditional_freqs(df, "k", "v")
    expected = {
        ("a", 1): 4, ("a", 2): 1, ("b", 2): 4, ("b", 3): 1, ("c", 3): 4, ("c", 4): 1,
    }
    assert counts(cond, "cond", "item") == expected
    assert counts(fr.marginal(cond)) == Counter(v for _, v in rows)
    assert {r.cond: r.total for r in fr.conditional_totals(cond).collect()} == Counter(
        k for k, _ in rows
    )
    assert fr.total(cond).first().total == len(rows)
    assert sorted(r.cond for r in fr.conditions(cond).collect()) == ["a", "b", "c"]
    query = spark.createDataFrame([("a", 1), ("a", 9), ("z", 1)], "cond string, item int")
    assert counts(fr.lookup_conditional(query, cond), "cond", "item") == {
        ("a", 1): 4, ("a", 9): 0, ("z", 1): 0,
    }
    assert counts(fr.merge(cond, cond), "cond", "item") == {k: 2 * c for k, c in expected.items()}
    probs = {(r.cond, r.item): r.p for r in fr.conditional_probabilities(cond).collect()}
    assert probs["a", 1] == 0.8 and probs["c", 4] == 0.2


def test_tables_match_counter(spark):
    rng = random.Random(3)
    items = [str(int(rng.paretovariate(0.8)) % 60) for _ in range(4000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "id int, norm string")
    freqs = fr.frequencies(df)
    truth = Counter(items)
    assert counts(freqs) == truth
    assert fr.total(freqs).first().total == len(items)
    assert fr.bins(freqs).first().bins == len(truth)
    nr = {r.r: r.n for r in fr.r_nr(freqs, 100).collect()}
    assert nr.pop(0) == 100 - len(truth)
    assert nr == Counter(truth.values())
    assert {r.r: r.n for r in fr.r_nr(freqs).collect()}[0] == 0
    best = max(truth.values())
    assert fr.max_value(freqs).first().item == min(k for k, c in truth.items() if c == best)
    assert fr.max_value(freqs.where("false")).count() == 0
    assert abs(fr.token_type_ratio(freqs).first().ratio - len(items) / len(truth)) < 1e-12
    assert abs(fr.probabilities(freqs).agg(F.sum("p")).first()[0] - 1) < 1e-9
    assert counts(fr.frequencies(fr.reconstitute(freqs), "item")) == truth
    running, expected = 0, []
    for x in items:
        running += truth[x]
        expected.append(float(running))
    walked = fr.cumulative_freqs(freqs, df, ["id"], "norm", weights=freqs).orderBy("id").collect()
    assert [r.cumulative for r in walked] == expected
    assert counts(fr.count_all(freqs, df)) == {k: 2 * c for k, c in truth.items()}
    grouped = fr.group_freqs_by(freqs, F.length("item"), F.col("item").substr(1, 1))
    assert counts(grouped, "cond", "item") == _regroup(truth)
    query = spark.createDataFrame([("1",), ("none",)], "item string")
    assert counts(fr.lookup(query, freqs)) == {"1": truth["1"], "none": 0}


def _regroup(truth):
    out = Counter()
    for k, c in truth.items():
        out[len(k), k[0]] += c
    return out


def test_reconstitute_splits_large_counts(spark, monkeypatch):
    monkeypatch.setattr(fr, "EXPAND_CHUNK", 7)
    freqs = spark.createDataFrame([("a", 50), ("b", 7), ("c", 0), ("d", 1)], "item string, count long")
    assert counts(fr.frequencies(fr.reconstitute(freqs), "item")) == {"a": 50, "b": 7, "d": 1}


def test_reports(spark):
    df = spark.createDataFrame([(x,) for x in "bbaaacd"], "norm string")
    top = freq_report(fr.frequencies(df), 3).collect()
    assert [r.line for r in top] == ["a\t3", "b\t2", "c\t1"]
    assert [r.line for r in freq_show_report(df, "norm", 1).collect()] == ["a\t3"]
