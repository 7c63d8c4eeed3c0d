"""Frequencies, n-grams, collocates and association scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfreq.functions import scores
from corpusfreq.operators import association as assoc
from corpusfreq.operators import collocates as co
from corpusfreq.operators import freqs as fr
from corpusfreq.operators import index as ix
from corpusfreq.operators import ngrams as ng
from corpusfreq.operators import report as rp
from corpusfreq.operators import tokens as tk
from suite.registry import BENCH_WORDS, BIGRAMS, FREQS, NR, WORDS, documents, query, table
from suite.text_queries import TARGET, bench_words, doc_words

MARKER = "*"


def vectors(spark, sf, *keep):
    return tk.corpus_vectors(documents(spark, sf), keep=keep)


def word_freqs(spark, sf):
    return fr.word_frequencies(documents(spark, sf))


def rounded(column: str, digits: int = 9):
    return F.round(column, digits).alias(column)


# Means and variances of small whole numbers are often binary fractions that end in
# exactly half a unit of the last digit kept; both sides step off that edge.
NUDGE = 1e-11


def rounded_stat(column: str):
    return F.round(F.col(column) + F.lit(NUDGE), 9).alias(column)


def stat_sql(expression: str) -> str:
    return f"round({expression} + {NUDGE}, 9)"


# --- A: reports -------------------------------------------------------------


@query(
    "a7_freq_report",
    f"""
    WITH {FREQS}
    SELECT item, count, item || chr(9) || count AS line FROM freqs
    ORDER BY count DESC, item LIMIT 50
    """,
)
def a7(spark, sf):
    return rp.freq_report(word_freqs(spark, sf), 50)


@query(
    "a7_freq_show_report",
    """
    SELECT event_type AS item, count(*) AS count, event_type || chr(9) || count(*) AS line
    FROM events GROUP BY event_type ORDER BY count DESC, item LIMIT 3
    """,
)
def a7_show(spark, sf):
    return rp.freq_show_report(table(spark, sf, "events"), "event_type", 3)


NEAR = (
    WORDS
    + f""",
near AS (
  SELECT doc_id, ord, norm AS head, pair, dist FROM (
    SELECT doc_id, ord, norm, lead(norm) OVER w AS a1, lead(norm, 2) OVER w AS a2, lead(norm, 3) OVER w AS a3
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
  LATERAL (VALUES (a1, 1), (a2, 2), (a3, 3)) AS v(pair, dist)
  WHERE norm = '{TARGET}' AND pair IS NOT NULL)
"""
)


@query(
    "a8_collocate_report",
    f"""
    WITH {NEAR}
    SELECT head, pair, count(*) AS n, {stat_sql('avg(dist)')} AS mean, {stat_sql('var_samp(dist)')} AS variance
    FROM near GROUP BY head, pair HAVING count(*) >= 2
    """,
)
def a8(spark, sf):
    found = co.get_collocates(vectors(spark, sf), TARGET)
    report = rp.collocate_report(co.collocate_stats(found, sample_variance=True))
    return report.select("head", "pair", "n", rounded_stat("mean"), rounded_stat("variance"))


# --- E: frequencies ---------------------------------------------------------


@query("e1_frequencies", f"WITH {FREQS} SELECT item, count FROM freqs")
def e1(spark, sf):
    return word_freqs(spark, sf)


@query(
    "e1_count_all",
    f"""
    WITH {FREQS}, {BENCH_WORDS}
    SELECT item, sum(count)::BIGINT AS count
    FROM (SELECT item, count FROM freqs UNION ALL SELECT norm, 1 FROM bench) GROUP BY item
    """,
)
def e1_more(spark, sf):
    """Further observations added to an existing table."""
    return fr.count_all(word_freqs(spark, sf), bench_words(spark, sf))


@query(
    "e2_frequency_lookup",
    f"""
    WITH {FREQS}, {BENCH_WORDS}
    SELECT b.item_id AS doc_id, b.ord::INT AS ord, b.norm, coalesce(f.count, 0) AS count
    FROM bench b LEFT JOIN freqs f ON b.norm = f.item
    """,
)
def e2(spark, sf):
    return fr.lookup(bench_words(spark, sf), word_freqs(spark, sf), "norm")


@query("e3_items", f"WITH {FREQS} SELECT item FROM freqs")
def e3(spark, sf):
    return fr.items(word_freqs(spark, sf))


@query("e4_total", f"WITH {WORDS} SELECT count(*) AS total FROM words")
def e4(spark, sf):
    return fr.total(word_freqs(spark, sf))


@query("e5_bins", f"WITH {WORDS} SELECT count(DISTINCT norm) AS bins FROM words")
def e5(spark, sf):
    return fr.bins(word_freqs(spark, sf))


@query("e6_hapaxes", f"WITH {FREQS} SELECT item FROM freqs WHERE count = 1")
def e6(spark, sf):
    return fr.hapaxes(word_freqs(spark, sf))


@query(
    "e7_replace_from_set",
    f"""
    WITH {FREQS}
    SELECT doc_id, ord::INT AS ord, CASE WHEN count = 1 THEN '{MARKER}' ELSE norm END AS norm
    FROM words JOIN freqs ON norm = item
    """,
)
def e7(spark, sf):
    words, freqs = doc_words(spark, sf), word_freqs(spark, sf)
    return fr.replace_from_set(words, fr.hapaxes(freqs), MARKER, freqs=freqs)


@query(
    "e8_replace_freqs_from_set",
    f"""
    WITH {FREQS}
    SELECT CASE WHEN count = 1 THEN '{MARKER}' ELSE item END AS item, sum(count)::BIGINT AS count
    FROM freqs GROUP BY 1
    """,
)
def e8(spark, sf):
    freqs = word_freqs(spark, sf)
    return fr.replace_freqs_from_set(freqs, fr.hapaxes(freqs), MARKER)


@query("e9_reconstitute", f"WITH {WORDS} SELECT norm AS item FROM words")
def e9(spark, sf):
    return fr.reconstitute(word_freqs(spark, sf))


LANG_FREQS = (
    WORDS
    + """,
cond AS (SELECT lang AS cond, norm AS item, count(*) AS count
         FROM words JOIN documents USING (doc_id) GROUP BY lang, norm)
"""
)


def lang_freqs(spark, sf):
    words = vectors(spark, sf, "lang").select("lang", F.explode_outer("vector").alias("norm"))
    words = words.where(F.col("norm").isNotNull())
    return fr.conditional_freqs(words, "lang", "norm")


@query("e10_conditional_freqs", f"WITH {LANG_FREQS} SELECT cond, item, count FROM cond")
def e10(spark, sf):
    return lang_freqs(spark, sf)


@query("e11_conditions", f"WITH {LANG_FREQS} SELECT DISTINCT cond FROM cond")
def e11(spark, sf):
    return fr.conditions(lang_freqs(spark, sf))


@query(
    "e12_group_freqs_by",
    f"""
    WITH {FREQS}
    SELECT length(item)::INT AS cond, substr(item, 1, 1) AS item, sum(count)::BIGINT AS count
    FROM freqs GROUP BY 1, 2
    """,
)
def e12(spark, sf):
    return fr.group_freqs_by(word_freqs(spark, sf), F.length("item"), F.substring("item", 1, 1))


@query(
    "e13_conditional_totals",
    f"WITH {LANG_FREQS} SELECT cond, sum(count)::BIGINT AS total FROM cond GROUP BY cond",
)
def e13(spark, sf):
    return fr.conditional_totals(lang_freqs(spark, sf))


@query("e13_grand_total", f"WITH {LANG_FREQS} SELECT sum(count)::BIGINT AS total FROM cond")
def e13_total(spark, sf):
    return fr.total(lang_freqs(spark, sf))


@query("e13_marginal", f"WITH {FREQS} SELECT item, count FROM freqs")
def e13_marginal(spark, sf):
    return fr.marginal(lang_freqs(spark, sf))


@query(
    "e13_lookup_conditional",
    f"""
    WITH {LANG_FREQS}, {BENCH_WORDS}
    SELECT b.item_id AS doc_id, b.ord::INT AS ord, b.norm, 'en' AS lang, coalesce(c.count, 0) AS count
    FROM bench b LEFT JOIN cond c ON c.cond = 'en' AND c.item = b.norm
    """,
)
def e13_lookup(spark, sf):
    asked = bench_words(spark, sf).withColumn("lang", F.lit("en"))
    return fr.lookup_conditional(asked, lang_freqs(spark, sf), "lang", "norm")


@query("e14_count_of_counts", f"WITH {NR} SELECT r, n FROM nr")
def e14(spark, sf):
    return fr.count_of_counts(word_freqs(spark, sf))


@query(
    "e14_r_nr",
    f"""
    WITH {NR}
    SELECT r, n FROM nr UNION ALL SELECT 0, 1000000 - (SELECT count(*) FROM freqs)
    """,
)
def e14_zero(spark, sf):
    return fr.r_nr(word_freqs(spark, sf), 1_000_000)


@query(
    "e15_cumulative_freqs",
    f"""
    WITH {FREQS}
    SELECT doc_id, ord::INT AS ord, norm,
           sum(count::DOUBLE) OVER (ORDER BY doc_id, ord ROWS UNBOUNDED PRECEDING) AS cumulative
    FROM words JOIN freqs ON norm = item
    """,
)
def e15(spark, sf):
    freqs = word_freqs(spark, sf)
    return fr.cumulative_freqs(freqs, doc_words(spark, sf), ["doc_id", "ord"], "norm")


@query("e16_token_type_ratio", f"WITH {FREQS} SELECT sum(count) / count(*) AS ratio FROM freqs")
def e16(spark, sf):
    return fr.token_type_ratio(word_freqs(spark, sf))


@query(
    "e17_max_value",
    f"WITH {FREQS} SELECT item, count FROM freqs ORDER BY count DESC, item LIMIT 1",
)
def e17(spark, sf):
    return fr.max_value(word_freqs(spark, sf))


@query(
    "e18_probabilities",
    f"WITH {FREQS} SELECT item, count::DOUBLE / (SELECT count(*) FROM words) AS p FROM freqs",
)
def e18(spark, sf):
    return fr.probabilities(word_freqs(spark, sf))


@query(
    "e18_conditional_probabilities",
    f"""
    WITH {LANG_FREQS}
    SELECT cond, item, count::DOUBLE / sum(count) OVER (PARTITION BY cond) AS p FROM cond
    """,
)
def e18_cond(spark, sf):
    return fr.conditional_probabilities(lang_freqs(spark, sf))


@query(
    "e19_merge",
    f"""
    WITH {FREQS}, {BENCH_WORDS}
    SELECT item, sum(count)::BIGINT AS count
    FROM (SELECT item, count FROM freqs UNION ALL SELECT norm, count(*) FROM bench GROUP BY norm)
    GROUP BY item
    """,
)
def e19(spark, sf):
    return fr.merge(word_freqs(spark, sf), fr.frequencies(bench_words(spark, sf)))


# --- F: n-grams -------------------------------------------------------------


def grams_sql(n: int, last: bool = True) -> str:
    leads = ", ".join(
        f"lead(norm, {k}) OVER w AS w{k + 1}" for k in range(1, n + (0 if last else 1))
    )
    names = ", ".join(f"w{k + 1}" for k in range(n))
    return (
        WORDS
        + f""",
grams AS (SELECT doc_id, ord::INT AS ord, norm AS w1, {leads} FROM words
          WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
ngrams AS (SELECT doc_id, ord, {names} FROM grams WHERE w{n + (0 if last else 1)} IS NOT NULL)
"""
    )


@query("f1_ngrams", f"WITH {grams_sql(3)} SELECT * FROM ngrams")
def f1(spark, sf):
    return ng.ngrams(vectors(spark, sf), 3, keep=["doc_id"], with_ord=True)


@query(
    "f1_bigram_freqs",
    f"WITH {grams_sql(2)} SELECT w1, w2, count(*) AS count FROM ngrams GROUP BY w1, w2",
)
def f1_bigrams(spark, sf):
    return ng.ngram_freqs(vectors(spark, sf), 2)


@query(
    "f1_fourgram_freqs",
    f"WITH {grams_sql(4)} SELECT w1, w2, w3, w4, count(*) AS count FROM ngrams GROUP BY ALL",
)
def f1_fourgrams(spark, sf):
    return ng.ngram_freqs(vectors(spark, sf), 4)


@query(
    "f1_ngrams_of_rows",
    """
    SELECT * FROM (
      SELECT user_id, event_type AS w1, lead(event_type) OVER w AS w2,
             lead(event_type, 2) OVER w AS w3, row_number() OVER w - 1 AS ord
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE w3 IS NOT NULL
    """,
)
def f1_rows(spark, sf):
    """Sequences gathered from many rows, cut into blocks."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    placed = tk.token_index(rows, "user_id", ["ts", "event_id"], long_groups=True)
    return ng.ngrams_of_rows(placed, 3, "user_id", "ord", "event_type")


@query(
    "f2_ngrams_drop_last",
    f"WITH {grams_sql(3, last=False)} SELECT * FROM ngrams",
)
def f2(spark, sf):
    return ng.ngrams(vectors(spark, sf), 3, drop_last=True, keep=["doc_id"], with_ord=True)


TRIGRAMS = grams_sql(3)


@query(
    "f4_unigram_model",
    f"WITH {TRIGRAMS} SELECT w1 AS item, count(*) AS count FROM ngrams GROUP BY w1",
)
def f4_uni(spark, sf):
    return ng.ngram_models(vectors(spark, sf))[0]


@query(
    "f4_bigram_model",
    f"WITH {TRIGRAMS} SELECT w1 AS cond, w2 AS item, count(*) AS count FROM ngrams GROUP BY w1, w2",
)
def f4_bi(spark, sf):
    return ng.ngram_models(vectors(spark, sf))[1]


@query(
    "f4_trigram_model",
    f"WITH {TRIGRAMS} SELECT w1, w2, w3 AS item, count(*) AS count FROM ngrams GROUP BY w1, w2, w3",
)
def f4_tri(spark, sf):
    return ng.ngram_models(vectors(spark, sf))[2].select("cond.*", "item", "count")


@query(
    "f4_bigram_model_full",
    f"WITH {BIGRAMS} SELECT w1 AS cond, w2 AS item, count FROM bigrams",
)
def f4_full(spark, sf):
    """Every bigram, not only those with a successor."""
    return ng.ngram_models(vectors(spark, sf), full_counts=True)[1]


CONV_TRIGRAMS = r"""
cwords AS (
  SELECT conv_id, turn, lower(word) AS norm, i
  FROM (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS i
        FROM (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{M}]+') AS w FROM conversations))),
cgrams AS (
  SELECT norm AS w1, lead(norm) OVER w AS w2, lead(norm, 2) OVER w AS w3 FROM cwords
  WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
asked AS (SELECT DISTINCT w1, w2, w3 FROM cgrams WHERE w3 IS NOT NULL)
"""


@query(
    "f5_ngram_interpolation",
    f"""
    WITH {TRIGRAMS}, {CONV_TRIGRAMS},
    uni AS (SELECT w1 AS a, count(*) / (SELECT count(*) FROM ngrams)::DOUBLE AS p FROM ngrams GROUP BY 1),
    bi AS (SELECT a, b, c::DOUBLE / sum(c) OVER (PARTITION BY a) AS p
           FROM (SELECT w1 AS a, w2 AS b, count(*) AS c FROM ngrams GROUP BY 1, 2)),
    tri AS (SELECT w1, w2, w3, c::DOUBLE / sum(c) OVER (PARTITION BY w1, w2) AS p
            FROM (SELECT w1, w2, w3, count(*) AS c FROM ngrams GROUP BY 1, 2, 3))
    SELECT q.w1, q.w2, q.w3,
           round(0.2 * coalesce(uni.p, 0) + 0.3 * coalesce(bi.p, 0) + 0.5 * coalesce(tri.p, 0), 12) AS p
    FROM asked q LEFT JOIN uni ON uni.a = q.w3 LEFT JOIN bi ON bi.a = q.w2 AND bi.b = q.w3
    LEFT JOIN tri ON tri.w1 = q.w1 AND tri.w2 = q.w2 AND tri.w3 = q.w3
    """,
)
def f5(spark, sf):
    """Trigrams of the conversations under a model of the documents."""
    turns = tk.corpus_vectors(table(spark, sf, "conversations"), doc="conv_id")
    asked = ng.ngrams(turns, 3).distinct()
    models = ng.ngram_models(vectors(spark, sf), store=True)
    scored = ng.interpolate(asked, models, (0.2, 0.3, 0.5), store=False)
    return scored.select("w1", "w2", "w3", rounded("p", 12))


# --- G: collocates ----------------------------------------------------------

SPAN = (
    WORDS
    + """,
spans AS (
  SELECT doc_id, norm AS head, pair, dist FROM (
    SELECT doc_id, norm, lag(norm) OVER w AS b1, lead(norm) OVER w AS a1, lead(norm, 2) OVER w AS a2
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
  LATERAL (VALUES (b1, -1), (a1, 1), (a2, 2)) AS v(pair, dist)
  WHERE pair IS NOT NULL)
"""
)


@query("g1_collocates", f"WITH {SPAN} SELECT doc_id, head, pair, dist FROM spans")
def g1(spark, sf):
    return co.collocates(vectors(spark, sf), 1, 2, keep=["doc_id"])


@query(
    "g1_collocates_of_rows",
    """
    SELECT user_id, ord, head, pair, dist FROM (
      SELECT user_id, event_type AS head, row_number() OVER w - 1 AS ord,
             lag(event_type) OVER w AS b1, lead(event_type) OVER w AS a1, lead(event_type, 2) OVER w AS a2
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    LATERAL (VALUES (b1, -1), (a1, 1), (a2, 2)) AS v(pair, dist) WHERE pair IS NOT NULL
    """,
)
def g1_rows(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    placed = tk.token_index(rows, "user_id", ["ts", "event_id"], long_groups=True)
    return co.collocates_of_rows(placed, 1, 2, "user_id", "ord", "event_type")


@query("g2_collocate_pairs", f"WITH {SPAN} SELECT head, pair FROM spans")
def g2(spark, sf):
    return co.collocate_pairs(co.collocates(vectors(spark, sf), 1, 2))


@query(
    "g3_collocates_around",
    rf"""
    WITH v AS (
      SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+'), lambda x: lower(x)) AS v FROM documents),
    hits AS (SELECT doc_id, quality * 10 + 1 AS i FROM labels)
    SELECT doc_id, (i - 1)::INT AS ord, v[i] AS head, v[i + d] AS pair, d::INT AS dist
    FROM hits JOIN v USING (doc_id), (VALUES (-2), (-1), (1), (2), (3)) AS t(d)
    WHERE i + d >= 1 AND v[i] IS NOT NULL AND v[i + d] IS NOT NULL
    """,
)
def g3(spark, sf):
    """Around the first or the eleventh token of every labelled document."""
    hits = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 10).alias("ord"))
    return co.collocates_around(vectors(spark, sf), hits, 2, 3)


@query("g4_get_collocates", f"WITH {NEAR} SELECT doc_id, ord::INT AS ord, head, pair, dist::INT AS dist FROM near")
def g4(spark, sf):
    found = tk.corpus_vectors(documents(spark, sf), TARGET)
    return co.get_collocates(found, TARGET)


@query(
    "g5_collocate_stats",
    f"""
    WITH {SPAN}
    SELECT head, pair, count(*) AS n, {stat_sql('avg(dist)')} AS mean, {stat_sql('var_pop(dist)')} AS variance
    FROM spans GROUP BY head, pair
    """,
)
def g5(spark, sf):
    stats = co.collocate_stats(co.collocates(vectors(spark, sf), 1, 2))
    return stats.select("head", "pair", "n", rounded_stat("mean"), rounded_stat("variance"))


@query(
    "g6_collocate_stats_online",
    f"""
    WITH {SPAN}
    SELECT head, pair, count(*) AS n, {stat_sql('avg(dist)')} AS mean, {stat_sql('var_samp(dist)')} AS variance
    FROM spans GROUP BY head, pair
    """,
)
def g6(spark, sf):
    found = co.collocates(vectors(spark, sf), 1, 2)
    stats = co.collocate_stats(found, sample_variance=True)
    return stats.select("head", "pair", "n", rounded_stat("mean"), rounded_stat("variance"))


# --- H: association ---------------------------------------------------------

COUNTED = (
    BIGRAMS
    + """,
totals AS (SELECT (SELECT sum(count) FROM freqs)::DOUBLE AS n, (SELECT sum(count) FROM bigrams)::DOUBLE AS m),
counted AS (SELECT g.w1, g.w2, g.count, a.count AS c1, b.count AS c2, n, m
            FROM bigrams g JOIN freqs a ON g.w1 = a.item JOIN freqs b ON g.w2 = b.item, totals)
"""
)
T_SQL = """(count / m - (c1 / n) * (c2 / n))
    / (sqrt((count * pow(1 - count / m, 2) + (m - count) * pow(count / m, 2)) / m) / sqrt(m))"""


def bigrams(spark, sf):
    return ng.ngram_freqs(vectors(spark, sf), 2)


@query(
    "h1_t_test_ngram",
    f"""
    WITH {BIGRAMS}, {BENCH_WORDS},
    asked AS (SELECT DISTINCT w1, w2 FROM (
      SELECT norm AS w1, lead(norm) OVER (PARTITION BY item_id ORDER BY ord) AS w2 FROM bench)
      WHERE w2 IS NOT NULL),
    counted AS (SELECT q.w1, q.w2, coalesce(g.count, 0) AS count,
                       coalesce(a.count, 0) AS c1, coalesce(b.count, 0) AS c2,
                       (SELECT sum(count) FROM freqs)::DOUBLE AS n, (SELECT sum(count) FROM bigrams)::DOUBLE AS m
                FROM asked q LEFT JOIN bigrams g USING (w1, w2)
                LEFT JOIN freqs a ON q.w1 = a.item LEFT JOIN freqs b ON q.w2 = b.item)
    SELECT w1, w2, count, CASE WHEN count > 0 THEN round({T_SQL}, 9) END AS t FROM counted
    """,
)
def h1(spark, sf):
    """The bigrams of the benchmark texts, tested in the documents."""
    items = tk.corpus_vectors(table(spark, sf, "benchmark"), doc="item_id")
    asked = ng.ngrams(items, 2).distinct()
    scored = assoc.t_test_ngram(asked, bigrams(spark, sf), word_freqs(spark, sf))
    return scored.select("w1", "w2", "count", rounded("t"))


@query(
    "h2_t_test_matrix", f"WITH {COUNTED} SELECT w1, w2, count, round({T_SQL}, 9) AS t FROM counted"
)
def h2(spark, sf):
    scored = assoc.t_test_matrix(bigrams(spark, sf), word_freqs(spark, sf))
    return scored.select("w1", "w2", "count", rounded("t"))


@query(
    "h2_t_test_matrix_compat", f"WITH {COUNTED} SELECT w1, w2, count, round(-({T_SQL}), 9) AS t FROM counted"
)
def h2_compat(spark, sf):
    scored = assoc.t_test_matrix(bigrams(spark, sf), word_freqs(spark, sf), compat=True)
    return scored.select("w1", "w2", "count", rounded("t"))


@query(
    "h2_t_test_trigrams",
    f"""
    WITH {TRIGRAMS}, freqs AS (SELECT norm AS item, count(*) AS count FROM words GROUP BY 1),
    tri AS (SELECT w1, w2, w3, count(*) AS count FROM ngrams GROUP BY ALL),
    counted AS (SELECT t.*, a.count AS c1, b.count AS c2, c.count AS c3,
                       (SELECT sum(count) FROM freqs)::DOUBLE AS n, (SELECT sum(count) FROM tri)::DOUBLE AS m
                FROM tri t JOIN freqs a ON w1 = a.item JOIN freqs b ON w2 = b.item JOIN freqs c ON w3 = c.item)
    SELECT w1, w2, w3, count, round({T_SQL.replace("(c2 / n)", "(c2 / n) * (c3 / n)")}, 9) AS t FROM counted
    """,
)
def h2_tri(spark, sf):
    tri = ng.ngram_freqs(vectors(spark, sf), 3)
    scored = assoc.t_test_matrix(tri, word_freqs(spark, sf), ("w1", "w2", "w3"))
    return scored.select("w1", "w2", "w3", "count", rounded("t"))


AGAINST = ["of", "in", "is"]

DIFFERENCES = f"""
    WITH {BIGRAMS},
    near AS (SELECT v, sum(count)::BIGINT AS n FROM (
               SELECT CASE WHEN w1 = '{TARGET}' THEN w2 ELSE w1 END AS v, count FROM bigrams
               WHERE count > 1 AND (w1 = '{TARGET}' OR w2 = '{TARGET}')) GROUP BY v)
    SELECT a.v AS v1, a.n AS n1, b.v AS v2, b.n AS n2, round((a.n - b.n) / sqrt(a.n + b.n), 9) AS t
    FROM near a JOIN near b ON a.v < b.v
    WHERE a.v IN ('of', 'in', 'is') OR b.v IN ('of', 'in', 'is')
"""


@query("h3_t_difference_matrix", DIFFERENCES)
def h3(spark, sf):
    """Every neighbour of the target against three words."""
    scored = assoc.t_differences(bigrams(spark, sf), TARGET, AGAINST)
    return scored.select("v1", "n1", "v2", "n2", rounded("t"))


@query(
    "h3_t_difference_matrix_compat",
    f"SELECT d.* FROM ({DIFFERENCES}) d, (VALUES (0), (1)) AS twice(i)",
)
def h3_compat(spark, sf):
    scored = assoc.t_differences(bigrams(spark, sf), TARGET, AGAINST, compat=True)
    return scored.select("v1", "n1", "v2", "n2", rounded("t"))


# The most frequent words: targets and rivals of the table form.
FREQUENT, NEAREST = 20, 10
TABLE_DIFFERENCES = f"""
    WITH {BIGRAMS},
    words_ AS (SELECT item FROM freqs ORDER BY count DESC, item LIMIT {FREQUENT}),
    near AS (SELECT w, v, sum(count)::BIGINT AS n FROM (
               SELECT w1 AS w, w2 AS v, count FROM bigrams WHERE count > 1
               UNION ALL SELECT w2, w1, count FROM bigrams WHERE count > 1 AND w1 <> w2) GROUP BY w, v),
    pairs_ AS (SELECT a.item AS target, b.item AS rival FROM words_ a JOIN words_ b ON a.item <> b.item),
    scored AS (
      SELECT target, rival, b.v, a.n AS n_rival, b.n AS n_v, (b.n - a.n) / sqrt(b.n + a.n) AS t
      FROM pairs_ JOIN near a ON a.w = target AND a.v = rival JOIN near b ON b.w = target AND b.v <> rival)
    SELECT target, rival, v, n_rival, n_v, round(t, 9) AS t FROM scored
    QUALIFY row_number() OVER (PARTITION BY target, rival ORDER BY t DESC, v) <= {NEAREST}
"""


@query("h3_t_difference_table", TABLE_DIFFERENCES)
def h3_table(spark, sf):
    """The frequent words as targets and as rivals: the words that go best with each target."""
    words = word_freqs(spark, sf).orderBy(F.desc("count"), "item").limit(FREQUENT).select("item")
    wanted = words.select(F.col("item").alias("target")).join(words.select(F.col("item").alias("rival")), F.col("target") != F.col("rival"))
    scored = assoc.t_difference_table(bigrams(spark, sf), wanted, NEAREST)
    return scored.select("target", "rival", "v", "n_rival", "n_v", rounded("t"))


def likelihood_sql(params):
    return f"""
    WITH {COUNTED},
    params AS (SELECT *, {params} FROM counted),
    llr AS (SELECT *, -2 * (
        CASE WHEN count = 0 THEN 0 ELSE count * log2(p) END
        + CASE WHEN c1 = count THEN 0 ELSE (c1 - count) * log2(1 - p) END
        + CASE WHEN c2 = count THEN 0 ELSE (c2 - count) * log2(p) END
        + CASE WHEN n - c1 = c2 - count THEN 0 ELSE (n - c1 - c2 + count) * log2(1 - p) END
        - CASE WHEN count = 0 THEN 0 ELSE count * log2(q1) END
        - CASE WHEN c1 = count THEN 0 ELSE (c1 - count) * log2(1 - q1) END
        - CASE WHEN c2 = count THEN 0 ELSE (c2 - count) * log2(q2) END
        - CASE WHEN n - c1 = c2 - count THEN 0 ELSE (n - c1 - c2 + count) * log2(1 - q2) END) AS v FROM params)
    SELECT w1, c1 / n AS p1, w2, c2 / n AS p2, count / m AS p12, round(v, 6) AS llr FROM llr
    """


@query(
    "h4_likelihood_matrix_compat", likelihood_sql("count / m AS p, c1 / n AS q1, c2 / n AS q2")
)
def h4_compat(spark, sf):
    scored = assoc.likelihood_matrix(word_freqs(spark, sf), bigrams(spark, sf), compat=True)
    return scored.select("w1", "p1", "w2", "p2", "p12", rounded("llr", 6))


@query(
    "h4_likelihood_matrix",
    likelihood_sql("c2 / n AS p, count / c1 AS q1, (c2 - count) / (n - c1) AS q2"),
)
def h4(spark, sf):
    scored = assoc.likelihood_matrix(word_freqs(spark, sf), bigrams(spark, sf))
    return scored.select("w1", "p1", "w2", "p2", "p12", rounded("llr", 6))


@query(
    "h5_pmi_matrix",
    f"""
    WITH {COUNTED}
    SELECT w1, c1 / n AS p1, w2, c2 / n AS p2, count / m AS p12,
           round(log2((count / m) / ((c1 / n) * (c2 / n))), 9) AS pmi FROM counted
    """,
)
def h5(spark, sf):
    scored = assoc.pmi_matrix(word_freqs(spark, sf), bigrams(spark, sf))
    return scored.select("w1", "p1", "w2", "p2", "p12", rounded("pmi"))


@query(
    "h5_pmi_matrix_compat",
    f"""
    WITH {COUNTED}
    SELECT w1, c1 / n AS p1, w2, c2 / n AS p2, count / m AS p12, round(-log2(c1 / n), 9) AS pmi FROM counted
    """,
)
def h5_compat(spark, sf):
    scored = assoc.pmi_matrix(word_freqs(spark, sf), bigrams(spark, sf), compat=True)
    return scored.select("w1", "p1", "w2", "p2", "p12", rounded("pmi"))


@query(
    "h6_mle_matrix",
    f"""
    WITH {BIGRAMS}
    SELECT w1, w2, count, count::DOUBLE / sum(count) OVER (PARTITION BY w1) AS p FROM bigrams
    QUALIFY count(*) OVER (PARTITION BY w1) > 1
    """,
)
def h6(spark, sf):
    return assoc.mle_matrix(bigrams(spark, sf))


@query(
    "h7_matrix_list",
    f"WITH {FREQS} SELECT item, count, round(sqrt(count) * length(item), 9) AS score FROM freqs",
)
def h7(spark, sf):
    scored = assoc.score_rows(word_freqs(spark, sf), F.sqrt("count") * F.length("item"))
    return scored.select("item", "count", rounded("score"))
