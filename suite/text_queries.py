"""Sources, tokens, membership, indexes and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfreq.functions.text import line_tokens
from corpusfreq.operators import freqs as fr
from corpusfreq.operators import index as ix
from corpusfreq.operators import membership as me
from corpusfreq.operators import tokens as tk
from corpusfreq.operators import vocab as vo
from corpusfreq.session import new_shared_path
from corpusfreq.sources import corpus as src
from corpusfreq.sources import incremental as inc
from suite.registry import BENCH_WORDS, FREQS, TOKENS, WORDS, documents, query, table

# Words left out by the queries that use a stop list.
STOP = ["the", "of", "and", "de", "to", "in", "a", "der", "la", "is"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
TARGET = "the"


# --- A: sources -------------------------------------------------------------


@query("a1_load_corpus", "SELECT item_id, text FROM benchmark")
def a1(spark, sf):
    """The benchmark texts written one file each, then loaded as a folder of files."""
    path = new_shared_path(spark, "corpus")
    table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    docs = src.load_corpus(spark, path)
    number = F.regexp_extract("doc_id", r"item_id=(\d+)", 1).cast("long")
    # The text sink ends each row with a line break.
    return docs.select(number.alias("item_id"), F.regexp_replace("text", "\n$", "").alias("text"))


@query(
    "a1_refresh_corpus",
    """
    SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'again ' || text ELSE text END AS text
    FROM (SELECT item_id AS doc_id, replace(text, chr(10), ' ') AS text FROM benchmark) WHERE doc_id % 5 <> 2
    """,
)
def a1_refresh(spark, sf):
    """A stored corpus follows a folder: files are written, some changed, some gone."""
    root, store = new_shared_path(spark, "files"), new_shared_path(spark, "corpus")
    texts = table(spark, sf, "benchmark").select("item_id", F.translate("text", "\n", " ").alias("text"))
    texts.write.partitionBy("item_id").text(root)
    inc.refresh(spark, root, store)
    # Overwriting the folders of some items replaces their files; an empty write leaves none.
    changed = texts.where("item_id % 5 = 1").withColumn("text", F.concat(F.lit("again "), "text"))
    changed.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("item_id").text(root)
    for row in texts.where("item_id % 5 = 2").select("item_id").distinct().collect():  # the benchmark's items
        texts.where("item_id IS NULL").select("text").write.mode("overwrite").text(f"{root}/item_id={row['item_id']}")
    inc.refresh(spark, root, store)
    docs = inc.current(spark, store)
    number = F.regexp_extract("doc_id", r"item_id=(\d+)", 1).cast("long")
    return docs.where("text <> ''").select(number.alias("doc_id"), F.regexp_replace("text", "\n$", "").alias("text"))


@query(
    "a2_read_latin1",
    """
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'),
                                                  lambda h: chr(('0x' || h)::INT)), '') AS text
    FROM documents
    """,
)
def a2(spark, sf):
    """Latin-1 gives one character per byte of the encoded text."""
    content = F.encode("text", "UTF-8")
    return documents(spark, sf).select("doc_id", src.decode_text(content, "ISO-8859-1").alias("text"))


@query(
    "a3_make_corpus",
    """
    SELECT conv_id, turn, role, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1
    """,
)
def a3(spark, sf):
    return src.make_corpus(table(spark, sf, "conversations"), "turn", "conv_id")


@query(
    "a3_add_documents",
    """
    SELECT coalesce(b.item_id, d.doc_id) AS doc_id, coalesce(b.text, d.text) AS text
    FROM documents d FULL JOIN benchmark b ON d.doc_id = b.item_id
    """,
)
def a3_add(spark, sf):
    added = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return src.add_documents(documents(spark, sf).select("doc_id", "text"), added)


@query(
    "a4_tag_by_name",
    """
    SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'ONE' WHEN source LIKE 'src2%' THEN 'TWO'
                        ELSE 'REST' END AS tag
    FROM documents
    """,
)
def a4(spark, sf):
    named = documents(spark, sf).select("doc_id", F.concat_ws("/", "lang", "source").alias("path"))
    rules = [("src1", "ONE"), ("src2", "TWO")]
    return src.tag_by_name(named, rules, "REST", "path").select("doc_id", "tag")


@query("a5_load_stop_words", f"WITH {BENCH_WORDS} SELECT DISTINCT norm FROM bench")
def a5(spark, sf):
    path = new_shared_path(spark, "stop")
    table(spark, sf, "benchmark").select("text").write.text(path)
    return src.load_stop_words(spark, path)


@query(
    "a5_load_stop_words_as_written",
    r"""
    SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{M}]+')) AS norm FROM benchmark
    """,
)
def a5_raw(spark, sf):
    path = new_shared_path(spark, "stop")
    table(spark, sf, "benchmark").select("text").write.text(path)
    return src.load_stop_words(spark, path, lower=False)


@query("a6_read_pairs", f"WITH {FREQS} SELECT item, count FROM freqs")
def a6(spark, sf):
    """A frequency table written as text among lines that are not pairs, read back."""
    path = new_shared_path(spark, "pairs")
    src.write_pairs(fr.word_frequencies(documents(spark, sf)), path, "item", "count")
    events = table(spark, sf, "events")
    noise = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("event_id", "event_type", "user_id")])
    events.select(noise).write.mode("append").text(path)
    return src.read_pairs(spark, path, "item string", "count long")


# --- B: tokens --------------------------------------------------------------


@query(
    "b1_pos_tokenize",
    r"""
    WITH runs AS (
      SELECT doc_id, unnest(r) AS t, generate_subscripts(r, 1) AS k
      FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}]+|[^\p{L}\p{M}]+') AS r FROM documents)),
    ends AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM runs)
    SELECT doc_id, t AS norm, (e - length(t))::INT AS start, e::INT AS "end",
           (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS ord
    FROM ends WHERE regexp_matches(t, '^[\p{L}\p{M}]')
    """,
)
def b1(spark, sf):
    return tk.tokenize_spans(documents(spark, sf))


@query(
    "b2_line_tokenize",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(l) AS txt, generate_subscripts(l, 1) - 1 AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    runs AS (
      SELECT doc_id, line, unnest(r) AS t, generate_subscripts(r, 1) AS k
      FROM (SELECT doc_id, line, regexp_extract_all(txt, '[0-9]+|[^0-9]+') AS r FROM lines)),
    ends AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id, line ORDER BY k) AS e FROM runs)
    SELECT doc_id, (line + 100)::INT AS line, t AS norm, (e - length(t))::INT AS start, e::INT AS "end",
           (row_number() OVER (PARTITION BY doc_id ORDER BY line, k) - 1)::INT AS ord
    FROM ends WHERE regexp_matches(t, '^[0-9]')
    """,
)
def b2(spark, sf):
    """Another pattern (numbers) and a line offset."""
    return tk.tokenize(documents(spark, sf), pattern="[0-9]+", offset=100)


@query(
    "b3_tokenize",
    f'WITH {TOKENS} SELECT doc_id, ord, word AS norm, line, start, "end" FROM tokens',
)
def b3(spark, sf):
    return tk.tokenize(documents(spark, sf))


@query("b4_normalize", f'WITH {TOKENS} SELECT doc_id, ord, norm, line, start, "end" FROM tokens')
def b4(spark, sf):
    return tk.normalize(tk.tokenize(documents(spark, sf)))


@query("b5_tokenizer", f'WITH {TOKENS} SELECT doc_id, ord, norm, line, start, "end" FROM tokens')
def b5(spark, sf):
    return tk.tokenizer(documents(spark, sf))


@query(
    "b6_tokenizer_stop",
    f"""
    WITH {TOKENS}, {BENCH_WORDS}
    SELECT doc_id, ord, norm, line, start, "end" FROM tokens
    WHERE norm NOT IN (SELECT norm FROM bench)
    """,
)
def b6(spark, sf):
    """The stop list is a table: all words of the benchmark texts."""
    stop = src.stop_words(table(spark, sf, "benchmark"), "text")
    return tk.tokenizer(documents(spark, sf), stop=stop)


STOPPED_SQL = f"""
    WITH {TOKENS}
    SELECT doc_id, norm, line, start, "end",
           (row_number() OVER (PARTITION BY doc_id ORDER BY line, start) - 1)::INT AS ord
    FROM tokens WHERE norm NOT IN ({STOP_SQL})
"""


@query("b6_tokenizer_stop_list", STOPPED_SQL)
def b6_list(spark, sf):
    """The stop list is a short Python list, applied inside the row."""
    return tk.tokenizer(documents(spark, sf), stop=STOP)


@query("b8_token_index", STOPPED_SQL)
def b8(spark, sf):
    """Ordinals after filtering a token table."""
    left = tk.remove_stop_words(tk.tokenizer(documents(spark, sf)).drop("ord"), STOP)
    return tk.token_index(left)


@query(
    "b8_token_index_long_groups",
    """
    SELECT user_id, event_id, event_type,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord
    FROM events
    """,
)
def b8_long(spark, sf):
    """Ordinals in sequences gathered from many rows, without one task per sequence."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    placed = tk.token_index(rows, "user_id", ["ts", "event_id"], long_groups=True)
    return placed.select("user_id", "event_id", "event_type", "ord")


@query(
    "b9_tokenize_document",
    f"""
    WITH {WORDS}
    SELECT d.doc_id, count(w.norm) AS n_tokens, count(DISTINCT w.norm) AS n_types,
           coalesce(string_agg(w.norm, ' ' ORDER BY w.ord), '') AS tokens
    FROM documents d LEFT JOIN words w ON d.doc_id = w.doc_id GROUP BY d.doc_id
    """,
)
def b9(spark, sf):
    docs = tk.tokenize_documents(documents(spark, sf))
    return docs.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.size("types").cast("long").alias("n_types"),
        F.array_join(F.col("tokens.norm"), " ").alias("tokens"),
    )


@query(
    "b10_corpus_vectors",
    f"""
    WITH {WORDS}
    SELECT doc_id, string_agg(norm, ' ' ORDER BY ord) AS vector FROM words
    GROUP BY doc_id HAVING bool_or(norm = '{TARGET}')
    """,
)
def b10(spark, sf):
    vectors = tk.corpus_vectors(documents(spark, sf), TARGET)
    return vectors.select("doc_id", F.array_join("vector", " ").alias("vector"))


# --- C: membership ----------------------------------------------------------


@query("c1_doc_types", f"WITH {WORDS} SELECT DISTINCT doc_id, norm FROM words")
def c1(spark, sf):
    return me.doc_types(documents(spark, sf))


@query(
    "c2_docs_containing",
    f"""
    WITH {WORDS}
    SELECT doc_id FROM documents
    WHERE lang = 'fr' OR doc_id IN (SELECT doc_id FROM words WHERE norm = '{TARGET}')
    """,
)
def c2(spark, sf):
    """French documents have no type set here, so they pass."""
    typed = me.with_types(documents(spark, sf))
    partly = typed.withColumn("types", F.when(F.col("lang") != "fr", F.col("types")))
    return me.docs_containing(partly, TARGET).select("doc_id")


@query(
    "c2_docs_containing_stored",
    f"WITH {WORDS} SELECT DISTINCT doc_id FROM words WHERE norm = '{TARGET}'",
)
def c2_stored(spark, sf):
    """Through a stored type table that skips row groups."""
    docs = documents(spark, sf)
    path = new_shared_path(spark, "types")
    me.write_types(me.doc_types(docs), path)
    return me.docs_containing_types(docs, spark.read.parquet(path), TARGET).select("doc_id")


# --- D: indexes and vocabularies --------------------------------------------


@query(
    "d1_inverse_index",
    f"""
    WITH ranked AS (
      SELECT event_type AS key, event_id AS pos,
             row_number() OVER (ORDER BY event_type, event_id) - 1 AS ix FROM events)
    SELECT key, CAST(floor(ix / {ix.BLOCK_POSTINGS}) AS BIGINT) AS block, count(*) AS n,
           string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions
    FROM ranked GROUP BY 1, 2
    """,
)
def d1(spark, sf):
    """Any table by any key; a frequent key's postings are cut into blocks."""
    index = ix.inverse_index(table(spark, sf, "events"), F.col("event_type"), F.col("event_id"))
    blocks = ix.posting_blocks(index)
    positions = F.transform("positions", lambda p: p.cast("string"))
    return blocks.select(
        "key",
        "block",
        F.size("positions").cast("long").alias("n"),
        F.array_join(positions, " ").alias("positions"),
    )


@query(
    "d2_inverse_index_corpus",
    f"""
    WITH {TOKENS}
    SELECT norm, doc_id, count(*) AS n,
           string_agg(line || ':' || start || ':' || "end", ' ' ORDER BY line, start) AS postings
    FROM tokens GROUP BY norm, doc_id
    """,
)
def d2(spark, sf):
    nested = ix.document_postings(documents(spark, sf))
    place = F.transform(
        "postings",
        lambda p: F.concat_ws(
            ":", p["line"].cast("string"), p["start"].cast("string"), p["end"].cast("string")
        ),
    )
    return nested.select(
        "norm",
        "doc_id",
        F.size("postings").cast("long").alias("n"),
        F.array_join(place, " ").alias("postings"),
    )


@query(
    "d2_map_postings",
    f'WITH {TOKENS} SELECT norm, doc_id, line + 1 AS line, "end" - start AS width FROM tokens',
)
def d2_map(spark, sf):
    index = ix.index_documents(documents(spark, sf))
    mapped = ix.map_postings(index, line=F.col("line") + 1, width=F.col("end") - F.col("start"))
    return mapped.select("norm", "doc_id", "line", "width")


@query(
    "d3_merge_indexes",
    f"""
    WITH {WORDS}, {BENCH_WORDS}
    SELECT norm, 'd' || doc_id AS doc_id, ord FROM words
    UNION ALL SELECT norm, 'b' || item_id, ord FROM bench
    """,
)
def d3(spark, sf):
    docs = documents(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    items = table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("doc_id"), "text"
    )
    merged = ix.merge_indexes(ix.index_documents(docs), ix.index_documents(items))
    return merged.select("norm", "doc_id", F.col("ord").cast("long").alias("ord"))


@query(
    "d3_merge_blocks",
    f"""
    WITH {WORDS}, {BENCH_WORDS},
    both_ AS (SELECT norm, 'd' || doc_id AS doc_id, ord FROM words UNION ALL SELECT norm, 'b' || item_id, ord FROM bench)
    SELECT norm, row_number() OVER (PARTITION BY norm ORDER BY doc_id, ord) - 1 AS place, doc_id, ord::BIGINT AS ord FROM both_
    """,
)
def d3_blocks(spark, sf):
    """Stored block indexes of two corpora merged without ranking the postings again."""
    docs = documents(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    items = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("doc_id"), "text")
    blocks = []
    for part in (docs, items):
        pos = F.struct("doc_id", F.col("ord").cast("long").alias("ord"))
        long = vector_words(tk.corpus_vectors(part)).select("norm", pos.alias("pos"))
        path = new_shared_path(spark, "blocks")
        ix.posting_blocks(long, "norm", "pos", by_rank=False).write.parquet(path)
        blocks.append(spark.read.parquet(path))
    merged = ix.merge_posting_blocks(*blocks, key="norm")
    # A posting's place is the length of the key's blocks before its own, and its place there.
    rows = merged.select("norm", "start", F.posexplode("positions").alias("at", "p"))
    return rows.select("norm", (F.col("start") + F.col("at")).alias("place"), "p.doc_id", "p.ord")


VOCAB_SQL = (
    FREQS
    + """,
firsts AS (SELECT norm, doc_id, ord FROM words
           QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id, ord) = 1),
vocab AS MATERIALIZED (SELECT norm AS item, row_number() OVER (ORDER BY doc_id, ord) - 1 AS ix FROM firsts)
"""
)


def vector_words(vectors):
    rows = vectors.select("doc_id", F.posexplode_outer("vector").alias("ord", "norm"))
    return rows.where(F.col("ord").isNotNull())


def doc_words(spark, sf):
    """doc_id, ord, norm without positions."""
    return vector_words(tk.corpus_vectors(documents(spark, sf)))


def bench_words(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return vector_words(tk.corpus_vectors(items))


@query(
    "d4_build_vocab",
    f"WITH {VOCAB_SQL} SELECT v.item, v.ix, f.count FROM vocab v JOIN freqs f USING (item)",
)
def d4(spark, sf):
    return vo.build_vocab(doc_words(spark, sf))


@query(
    "d5_extend_vocab",
    f"""
    WITH {VOCAB_SQL}, {BENCH_WORDS},
    news AS (SELECT norm, item_id, ord FROM bench WHERE norm NOT IN (SELECT item FROM vocab)
             QUALIFY row_number() OVER (PARTITION BY norm ORDER BY item_id, ord) = 1)
    SELECT item, ix FROM vocab UNION ALL
    SELECT norm, (SELECT max(ix) FROM vocab) + row_number() OVER (ORDER BY item_id, ord) FROM news
    """,
)
def d5(spark, sf):
    vocab = vo.build_vocab(doc_words(spark, sf))
    return vo.extend_vocab(vocab, bench_words(spark, sf)).select("item", "ix")


@query(
    "d6_lookup_items",
    f"""
    WITH {VOCAB_SQL}, {BENCH_WORDS}
    SELECT b.item_id AS doc_id, b.ord::INT AS ord, b.norm, v.ix, v.ix IS NOT NULL AS known
    FROM bench b LEFT JOIN vocab v ON b.norm = v.item
    """,
)
def d6(spark, sf):
    found = vo.lookup_items(bench_words(spark, sf), vo.build_vocab(doc_words(spark, sf)))
    return found.withColumn("known", F.col("ix").isNotNull())


@query(
    "d6_lookup_ids",
    f"""
    WITH {VOCAB_SQL}
    SELECT e.event_id, v.item FROM events e LEFT JOIN vocab v ON e.event_id = v.ix
    """,
)
def d6_ids(spark, sf):
    ids = table(spark, sf, "events").select("event_id")
    return vo.lookup_ids(ids, vo.build_vocab(doc_words(spark, sf)), "event_id")


@query(
    "d6_known_items",
    f"""
    WITH {VOCAB_SQL}, {BENCH_WORDS}
    SELECT item_id AS doc_id, norm, ord::INT AS ord FROM bench WHERE norm IN (SELECT item FROM vocab)
    """,
)
def d6_known(spark, sf):
    return vo.known_items(bench_words(spark, sf), vo.build_vocab(doc_words(spark, sf)))


@query(
    "d6_vocab_size",
    f"WITH {FREQS} SELECT count(*) AS size, count(*) = 0 AS is_empty FROM freqs",
)
def d6_size(spark, sf):
    return vo.vocab_size(vo.build_vocab(doc_words(spark, sf)))


@query(
    "d7_encode_corpus",
    f"""
    WITH {VOCAB_SQL}
    SELECT w.doc_id, w.ord::INT AS ord, v.ix FROM words w JOIN vocab v ON w.norm = v.item
    """,
)
def d7(spark, sf):
    words = doc_words(spark, sf)
    return vo.encode_corpus(words, vo.build_vocab(words))


@query(
    "d8_docs_for_token",
    f"""
    WITH {WORDS}
    SELECT w.ord::INT AS ord, w.doc_id, d.lang, d.n_chars
    FROM words w JOIN documents d ON w.doc_id = d.doc_id
    WHERE w.norm = '{TARGET}'
    """,
)
def d8(spark, sf):
    """Postings from a stored index, with their documents."""
    docs = documents(spark, sf)
    path = new_shared_path(spark, "index")
    ix.write_index(ix.index_documents(docs), path)
    return ix.docs_for_token(spark.read.parquet(path), docs, TARGET, columns=["lang", "n_chars"])
