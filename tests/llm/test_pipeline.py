"""The pipeline against plain Python, stage by stage."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from corpusfreq.llm import lines, pieces  # noqa: E402
from corpusfreq.llm.tokenizers import model_file  # noqa: E402
from test_native import brute as contaminated_words  # noqa: E402
from test_search import brute as near_groups  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, docs, prose, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    # A line on every third page of a source, and copies of one text.
    boiler = docs.selectExpr(
        "doc_id", "CASE WHEN doc_id % 3 = 0 AND text IS NOT NULL THEN concat('Main menu\n', text) ELSE text END AS text",
        "lang", "source", "cast(length(text) AS long) AS n_chars",
    )
    boiler.write.parquet(f"{path}/documents.parquet")
    long = [t for t in prose if len(t.split()) > 40]
    rows = [(1, long[0]), (2, " ".join(long[1].split()[3:30])), (3, "zzz yyy"), (4, None)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]

    kept = corpus_pipeline.language_id(spark, docs, folder)
    assert kept.columns == columns
    after = [tuple(r) for r in kept.collect()]
    letters = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    assert Counter(r[:2] for r in after) == Counter(r[:2] for r in letters)

    cut = corpus_pipeline.line_dedup(spark, kept, folder)
    assert cut.columns == columns
    pages, found = Counter(r[3] for r in after), Counter()
    for r in after:
        found.update((r[3], x) for x in set(r[1].split("\n")) if x.strip(" "))
    gone = {k for k, n in found.items() if n >= lines.MIN_PAGES and n > lines.RATIO * pages[k[0]]}
    assert any(x == "Main menu" for _, x in gone)
    want = []
    for r in after:
        body = "\n".join(x for x in r[1].split("\n") if (r[3], x) not in gone)
        want.append((r[0], body, r[2], r[3], len(body)))
    after = [tuple(r) for r in cut.collect()]
    assert Counter(after) == Counter(want)

    single = corpus_pipeline.near_duplicates(spark, cut, folder)
    assert single.columns == columns
    groups = near_groups([(r[0], r[1]) for r in after], 5, 80)
    stay = {c for _, _, c in groups}
    after = [tuple(r) for r in single.collect()]
    assert Counter(r[0] for r in after) == Counter(stay)

    clean = corpus_pipeline.benchmark_decontamination(spark, single, folder)
    assert clean.columns == columns
    want = []
    for r in after:
        n, hit, _ = contaminated_words(r[1], items)
        if not (hit and 20 * len(hit) >= n):
            want.append(r)
    assert len(want) < len(after)
    after = [tuple(r) for r in clean.collect()]
    assert Counter(after) == Counter(want)

    library = pieces.PieceEncoder(model_file()).model
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    coded = {}
    for r in after:
        ids = library.encode(r[1]) if r[1] else []
        coded[r[0]] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else ""))
    last = corpus_pipeline.encoding(spark, clean, folder).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in last} == coded
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, last))


def test_idle_lean_encoders_hold_no_words(docs):
    """Workers are more than cores, so what they keep between tasks adds up in an executor."""
    import pyarrow as pa

    from corpusfreq.llm import pieces, workers
    from corpusfreq.llm.tokenizers import model_file

    few = docs.select("doc_id", "text").repartition(3)
    lean = pieces.digest_documents(few, model_file(), lean=True)
    roomy = pieces.digest_documents(few, model_file())
    assert sorted(lean.collect()) == sorted(roomy.collect())
    lean.collect()

    def kept(batches):
        for batch in batches:
            held = [e for (owner, _), e in workers._HELD.items() if owner == "pieces"]
            words = sum(len(t) for e in held if e.words == pieces.LEAN_WORDS for t in (e.memo, e.old, e.parts, e.pairs))
            yield pa.RecordBatch.from_pydict({"n": [words] * batch.num_rows})

    assert {r.n for r in few.select("doc_id").mapInArrow(kept, "n long").collect()} == {0}


def test_a_remembered_word_is_packed_ids():
    from corpusfreq.llm import pieces
    from corpusfreq.llm.tokenizers import model_file

    import sentencepiece

    encoder, library = pieces.PieceEncoder(model_file(), 3), sentencepiece.SentencePieceProcessor(model_file=model_file())
    for text in ["the cat sat on the mat", " two  blanks ", "▁marks▁▁inside ▁", "ünï 漢字   x", "", "a" * 200, "the mat"]:
        assert encoder.encode(text) == library.encode(text)
        assert all(isinstance(v, bytes) for t in (encoder.memo, encoder.parts) for v in t.values())
        encoder.forget()
        assert encoder.encode(text) == library.encode(text)
