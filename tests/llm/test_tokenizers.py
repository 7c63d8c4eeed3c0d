"""Token counts and the alignment of two tokenizers against plain Python."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers

from corpusfreq.llm import align, token_counts, wordwise
from corpusfreq.llm.tokenizers import public_file

A_FILE, B_FILE = public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model")
ODD = [
    "<|endoftext|> a<|endoftext|>", "a▁b", "é", "𠮷 野家", "a\x00b", "  x  ", "\n\n\t", "<s>hi</s>", "<0x41>", "ﬁ １２", "=" * 40, "naïve café’s 10,000",
    "​", "á", "🙂🙂", "don't we'll", "x",
]


@pytest.fixture(scope="module")
def texts(spark, docs):
    """The documents of the other tests and odd ones, with columns named like results."""
    odd = spark.createDataFrame([(3000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3000, "again"), (3000, "again")], "doc_id long, text string")
    whole = docs.select("doc_id", "text").unionByName(odd)
    return whole.selectExpr("*", "1 AS n_tokens", "text AS digest", "2 AS row", "3 AS pairs", "'x' AS content", "4 AS id").repartition(5).cache()


def count(texts_):
    model = tokenizers.Tokenizer.from_file(A_FILE)
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts_]


def test_ids_word_by_word_are_the_librarys(monkeypatch):
    rnd = random.Random(6)
    parts = ["a", "The", " ", "  ", "   ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u180e", "\u200b", "é", "e\u0301", "12", "½", "'s",
             "'ll", "’t", "-", "--", "_", "▁", "▁▁", "𠮷", "🙂", "<|endoftext|>", "<s>", "<0x41>", "\x00", "ing", "="]
    texts = ["", " ", "  ", "   ", "a ", " a", "a  ", "a   b", "▁", "a▁", "x" * 200 + " " + "y" * 200, *ODD]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(6000)]
    plain, special = tokenizers.Tokenizer.from_file(A_FILE), tokenizers.Tokenizer.from_file(A_FILE)
    plain.encode_special_tokens = True
    cases = [(wordwise.ByteLevelWords(m), [e.ids for e in m.encode_batch(texts, add_special_tokens=False)]) for m in (plain, special)]
    monkeypatch.setattr(wordwise, "KEPT_WORDS", 500)
    for words, want in cases:
        assert words.by_word
        got = [np.frombuffer(ids, np.int32).tolist() for lo in range(0, len(texts), 97) for ids in words.ids(texts[lo : lo + 97])]
        bad = [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w]
        assert not bad, bad[:3]
    # Another kind of tokenizer gets whole texts.
    lower = tokenizers.Tokenizer.from_file(public_file("word_bpe_49k.json"))
    assert not wordwise.ByteLevelWords(lower).by_word
    assert wordwise.ByteLevelWords(lower).ids(["A b  C"]) == [wordwise.packed(lower.encode("A b  C", add_special_tokens=False).ids)]


def test_counts(spark, texts, tmp_path):
    cache = f"file://{tmp_path}/cache"
    rows = [(r["doc_id"], r["text"]) for r in texts.collect()]
    want = Counter((i, len((t or "").encode()), n) for (i, t), n in zip(rows, count([t for _, t in rows]), strict=True))
    got = token_counts.count_tokens(texts, A_FILE, cache)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert Counter(map(tuple, got.collect())) == want
    # Each distinct text was encoded once.
    tokenizer = token_counts.TokenizerFile(A_FILE)
    stored = token_counts.cached(spark, cache, tokenizer)
    assert stored.count() == len({t or "" for _, t in rows})


def test_cache_is_used_and_extended(spark, texts, tmp_path):
    cache, tokenizer = f"file://{tmp_path}/cache", token_counts.TokenizerFile(A_FILE)
    first = texts.where("doc_id < 50")
    token_counts.count_tokens(first, A_FILE, cache).count()
    before = token_counts.cached(spark, cache, tokenizer).count()
    # A count that no encoder would give shows that the stored one is taken; stored twice, it is one.
    planted = hashlib.sha256(b"planted").digest()
    for _ in range(2):
        spark.createDataFrame([(bytearray(planted), 777)], token_counts.SCHEMA).write.mode("append").parquet(token_counts.part_of(cache, tokenizer))
    more = first.select("doc_id", "text").unionByName(spark.createDataFrame([(9000, "planted"), (9001, "planted"), (9002, "fresh text")], "doc_id long, text string"))
    got = token_counts.count_tokens(more, A_FILE, cache).collect()
    assert len(got) == more.count()
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] >= 9000} == {9000: 777, 9001: 777, 9002: 2}
    assert token_counts.cached(spark, cache, tokenizer).count() == before + 2 + 1
    # Another tokenizer has counts of its own.
    other = token_counts.count_tokens(more, B_FILE, cache).where("doc_id >= 9000").collect()
    model = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    assert {r["n_tokens"] for r in other if r["doc_id"] < 9002} == {len(model.encode("planted"))}


def test_normalised_texts_share_a_count(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A b"), (2, "a b"), (3, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    cache = f"file://{tmp_path}/cache"
    got = token_counts.count_tokens(rows, public_file("word_bpe_49k.json"), cache, normalise=lower)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 2), (2, 3, 2), (3, 0, 0)]
    assert token_counts.cached(spark, cache, token_counts.TokenizerFile(public_file("word_bpe_49k.json"))).count() == 2


def test_counts_of_no_rows(empty, tmp_path):
    assert token_counts.count_tokens(empty, A_FILE, f"file://{tmp_path}/cache").collect() == []


def brute(rows):
    """Rows of the alignment, with overlaps looked up token by token."""
    a_model = tokenizers.Tokenizer.from_file(A_FILE)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    alphabet = align.byte_level_alphabet()
    out, docs_of, links_of = [], Counter(), []
    for i, text in rows:
        a, b = [], []
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            a_bytes = [bytes(alphabet[c] for c in a_model.id_to_token(x)) for x in a]
            pieces = [b_model.id_to_piece(x) for x in b]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, pieces, strict=True)]
            if not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
                a, b = [], []
        if not a:
            out.append([i, 0, 0, 0, 0, ""])
            links_of.append(Counter())
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, ends = 0, []
            for p in parts:
                ends.append((at, at + len(p)))
                at += len(p)
            spans.append(ends)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        sides = []
        for ids, ends in ((a, spans[0]), (b, spans[1])):
            parts = defaultdict(list)
            for x, (_, t) in zip(ids, ends, strict=True):
                parts[bisect.bisect_left(cuts, t)].append(str(x))
            sides.append([",".join(parts[g]) for g in range(len(cuts))])
        groups = ["|".join(g) for g in zip(*sides, strict=True)]
        links, k = Counter(), 0
        for x, (s, t) in zip(a, spans[0], strict=True):
            while spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(b) and spans[1][j][0] < t:
                links[x, b[j]] += 1
                j += 1
        docs_of.update(set(links))
        links_of.append(links)
        out.append([i, len(a), len(b), len(cuts), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    most = defaultdict(int)
    for (x, _), n in docs_of.items():
        most[x] = max(most[x], n)
    result = []
    for row, links in zip(out, links_of, strict=True):
        best = sum(n for (x, y), n in links.items() if docs_of[x, y] == most[x])
        result.append((*row[:5], best, sum(docs_of[p] * n for p, n in links.items()), row[5]))
    return Counter(result)


@pytest.mark.parametrize("max_hot", [align.MAX_HOT, 50, 0])
def test_alignment(texts, max_hot):
    """Whatever share of the pairs is broadcast, the rows are the same."""
    some = texts.where("doc_id IS NULL OR doc_id <> 1005") if max_hot < align.MAX_HOT else texts
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    got = align.alignment(some, A_FILE, B_FILE, max_hot=max_hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_alignment_of_no_rows(empty):
    assert align.alignment(empty, A_FILE, B_FILE).collect() == []


def test_partial_counts_in_parts(spark, texts, monkeypatch):
    some = texts.where("doc_id < 100")
    rows = align.aligned(some, A_FILE, B_FILE)
    monkeypatch.setattr(align, "GATHER", 10)
    size_b = sentencepiece.SentencePieceProcessor(model_file=B_FILE).get_piece_size()
    want = Counter(p for r in rows.select("pairs").collect() for p in r["pairs"])
    assert {r["pair"]: r["docs"] for r in align.pair_counts(rows, size_b).collect()} == dict(want)
