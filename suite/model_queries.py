"""Contexts, concordances, statistics, smoothing, distributions and the classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfreq.functions import scores
from corpusfreq.functions.text import norm_ws, slice_lines
from corpusfreq.operators import bayes as nb
from corpusfreq.operators import context as cx
from corpusfreq.operators import distributions as di
from corpusfreq.operators import folds as fo
from corpusfreq.operators import freqs as fr
from corpusfreq.operators import index as ix
from corpusfreq.operators import kwic as kw
from corpusfreq.operators import smoothing as sm
from corpusfreq.operators import stats as st
from corpusfreq.operators import tokens as tk
from corpusfreq.session import new_shared_path, stored
from suite.count_queries import (
    COUNTED,
    lang_freqs,
    rounded,
    rounded_stat,
    stat_sql,
    vectors,
    word_freqs,
)
from suite.registry import BENCH_WORDS, FREQS, NR, TOKENS, WORDS, documents, query, table
from suite.text_queries import TARGET, bench_words

# --- I: contexts and concordances -------------------------------------------


def window_sql(source: str, key: str, before: int, after: int) -> str:
    def part(name: str, offsets: range, function: str) -> str:
        words = ", ".join(f"{function}(item, {abs(k)}) OVER w" for k in offsets)
        return f"concat_ws(' ', {words}) AS {name}"

    return f"""
    SELECT {key}, ord, {part('before', range(-before, 0), 'lag')}, item AS "view",
           {part('after', range(1, after + 1), 'lead')}
    FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY ord)
    """


def joined_window(df, key):
    return df.select(
        key,
        F.col("ord").cast("long").alias("ord"),
        F.array_join("before", " ").alias("before"),
        "view",
        F.array_join("after", " ").alias("after"),
    )


@query(
    "i1_context_window",
    f"WITH {WORDS} {window_sql('(SELECT doc_id, ord, norm AS item FROM words)', 'doc_id', 3, 2)}",
)
def i1(spark, sf):
    return joined_window(cx.context_windows(vectors(spark, sf), 3, 2, keep=["doc_id"]), "doc_id")


EVENT_ROWS = """(SELECT user_id, event_type AS item,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events)"""


@query("i1_context_window_of_rows", window_sql(EVENT_ROWS, "user_id", 2, 2))
def i1_rows(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    placed = tk.token_index(rows, "user_id", ["ts", "event_id"], long_groups=True)
    found = cx.context_windows_of_rows(placed, 2, 2, "user_id", "ord", "event_type")
    return joined_window(found, "user_id")


MEASURE = 12


def measured_sql(trim_after: bool) -> str:
    """i belongs to the context of h if the items after i fit the size."""
    upto = "h.c" if trim_after else "h.c - h.w"
    return f"""
    WITH {WORDS},
    sums AS (SELECT doc_id, ord, norm, length(norm) + 1 AS w,
                    sum(length(norm) + 1) OVER (PARTITION BY doc_id ORDER BY ord) AS c FROM words)
    SELECT h.doc_id, h.ord::INT AS ord, string_agg(i.norm, ' ' ORDER BY i.ord) AS context
    FROM sums h JOIN sums i ON i.doc_id = h.doc_id AND i.ord BETWEEN h.ord - {MEASURE} AND h.ord
    WHERE i.ord = h.ord OR {upto} - i.c <= {MEASURE}
    GROUP BY h.doc_id, h.ord
    """


def measured(spark, sf, trim_after):
    found = cx.measured_contexts(vectors(spark, sf), MEASURE, keep=["doc_id"], trim_after=trim_after)
    return found.select("doc_id", "ord", F.array_join("context", " ").alias("context"))


@query("i2_measured_context", measured_sql(False))
def i2(spark, sf):
    return measured(spark, sf, False)


@query("i2_measured_context_append", measured_sql(True))
def i2_append(spark, sf):
    return measured(spark, sf, True)


def measured_rows_sql(trim_after: bool) -> str:
    upto = "h.c" if trim_after else "h.c - h.w"
    return f"""
    WITH sums AS (SELECT user_id, ord, item, length(item) + 1 AS w,
                         sum(length(item) + 1) OVER (PARTITION BY user_id ORDER BY ord) AS c FROM {EVENT_ROWS})
    SELECT h.user_id, h.ord::BIGINT AS ord, string_agg(i.item, ' ' ORDER BY i.ord) AS context
    FROM sums h JOIN sums i ON i.user_id = h.user_id AND i.ord BETWEEN h.ord - {3 * MEASURE} AND h.ord
    WHERE i.ord = h.ord OR {upto} - i.c <= {3 * MEASURE}
    GROUP BY h.user_id, h.ord
    """


def measured_rows(spark, sf, trim_after):
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    placed = tk.token_index(rows, "user_id", ["ts", "event_id"], long_groups=True)
    found = cx.measured_contexts_of_rows(placed, 3 * MEASURE, "user_id", "ord", "event_type", trim_after)
    return found.select("user_id", F.col("ord").cast("long").alias("ord"), F.array_join("context", " ").alias("context"))


@query("i2_measured_context_of_rows", measured_rows_sql(False))
def i2_rows(spark, sf):
    """The events of each user, a sequence gathered from many rows."""
    return measured_rows(spark, sf, False)


@query("i2_measured_context_of_rows_append", measured_rows_sql(True))
def i2_rows_append(spark, sf):
    return measured_rows(spark, sf, True)


SIZE = 30


def kwic_sql(target: str = TARGET, size: int = SIZE) -> str:
    squeeze = r"trim(regexp_replace({}, '[\t-\r\p{{Zs}}]+', ' ', 'g'))"
    return (
        TOKENS
        + f""",
bearing AS (SELECT DISTINCT doc_id, line FROM tokens),
offsets AS (
  SELECT doc_id, line, txt, sum(length(txt) + 1) OVER (PARTITION BY doc_id ORDER BY line)
                            - length(txt) - 1 AS off
  FROM lines JOIN bearing USING (doc_id, line)),
whole AS (SELECT doc_id, string_agg(txt, chr(10) ORDER BY line) AS body FROM offsets GROUP BY doc_id),
placed AS (
  SELECT t.*, (off + start)::BIGINT AS a, (off + "end")::BIGINT AS z, off::BIGINT AS off,
         (off + length(txt))::BIGINT AS stop, "end" - start + 1 AS w,
         sum("end" - start + 1) OVER (PARTITION BY t.doc_id ORDER BY ord) AS c
  FROM tokens t JOIN offsets o ON t.doc_id = o.doc_id AND t.line = o.line),
hits AS (SELECT * FROM placed WHERE norm = '{target}'),
reach AS (
  SELECT h.doc_id, h.ord,
         min(i.a) FILTER (WHERE i.ord < h.ord AND h.c - h.w - i.c <= {size}) AS l,
         max(i.z) FILTER (WHERE i.ord > h.ord AND 1 + i.c - i.w - h.c <= {size}) AS r
  FROM hits h JOIN placed i ON i.doc_id = h.doc_id AND i.ord BETWEEN h.ord - {size} AND h.ord + {size}
  GROUP BY h.doc_id, h.ord),
kwic AS (
  SELECT h.doc_id, h.line, h.start, h."end",
         {squeeze.format("substr(body, coalesce(l, off) + 1, a - coalesce(l, off))")} AS prefix,
         h.word AS target,
         {squeeze.format("substr(body, z + 1, coalesce(r, stop) - z)")} AS suffix
  FROM hits h JOIN reach USING (doc_id, ord) JOIN whole USING (doc_id))
"""
    )


@query("i3_kwic", f"WITH {kwic_sql()} SELECT * FROM kwic")
def i3(spark, sf):
    return kw.kwic(documents(spark, sf), TARGET, SIZE)


COMPAT_KWIC = kwic_sql().replace(
    "substr(body, coalesce(l, off) + 1, a - coalesce(l, off))",
    "CASE WHEN l IS NULL THEN substr(body, a + 1, stop - a) ELSE substr(body, l + 1, a - l) END",
)


@query("i3_kwic_compat", f"WITH {COMPAT_KWIC} SELECT * FROM kwic")
def i3_compat(spark, sf):
    """The prefix of a document's first token is the rest of its line."""
    return kw.kwic(documents(spark, sf), TARGET, SIZE, compat=True)


@query("i3_kwic_indexed", f"WITH {kwic_sql('zu', 50)} SELECT * FROM kwic")
def i3_index(spark, sf):
    """Only the documents that a stored inverted index lists are read for context."""
    docs = documents(spark, sf)
    path = new_shared_path(spark, "index")
    ix.write_index(ix.index_documents(docs), path)
    return kw.kwic(docs, "zu", 50, index=spark.read.parquet(path))


@query(
    "a9_format_kwic",
    f"""
    WITH {kwic_sql()}
    SELECT doc_id, line, start,
      lpad(doc_id::VARCHAR, greatest(25, length(doc_id::VARCHAR))::INT, ' ') || ':'
      || lpad(line::VARCHAR, greatest(7, length(line::VARCHAR))::INT, ' ') || ':'
      || lpad(start::VARCHAR, greatest(3, length(start::VARCHAR))::INT, ' ') || '  '
      || lpad(right(prefix, {SIZE}), {SIZE}, ' ') || '  **' || target || '**  ' || left(suffix, {SIZE}) AS text
    FROM kwic
    """,
)
def a9(spark, sf):
    return kw.format_kwic(kw.kwic(documents(spark, sf), TARGET, SIZE), SIZE)


@query(
    "i4_slice_text",
    f"""
    WITH {TOKENS},
    numbered AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM tokens),
    run AS (SELECT * FROM numbered WHERE ord >= 2 AND ord < n - 2),
    bounds AS (SELECT doc_id, count(*) AS n, arg_min(line, ord) AS l1, arg_min(start, ord) AS s1,
                      arg_max(line, ord) AS l2, arg_max("end", ord) AS e2 FROM run GROUP BY doc_id),
    used AS (SELECT DISTINCT doc_id, line FROM run)
    SELECT doc_id, string_agg(
      substr(txt, CASE WHEN line = l1 THEN s1 ELSE 0 END + 1,
        (CASE WHEN line = l2 AND n > 1 THEN e2 ELSE length(txt) END
         - CASE WHEN line = l1 THEN s1 ELSE 0 END)::BIGINT), '|' ORDER BY line) AS text
    FROM used JOIN bounds USING (doc_id) JOIN lines USING (doc_id, line) GROUP BY doc_id
    """,
)
def i4(spark, sf):
    """Each text without its first two and last two tokens, line by line."""
    docs = tk.tokenize_documents(documents(spark, sf))
    run = F.slice("tokens", 3, F.greatest(F.size("tokens") - 4, F.lit(0)))
    sliced = docs.select("doc_id", slice_lines(F.col("text"), run).alias("parts"))
    return sliced.where(F.size("parts") > 0).select(
        "doc_id", F.array_join("parts", "|").alias("text")
    )


@query(
    "i5_sync_lines",
    f"""
    WITH {TOKENS},
    hits AS (SELECT doc_id, line, string_agg(start || '-' || "end", ' ' ORDER BY start) AS hits
             FROM tokens WHERE norm = '{TARGET}' GROUP BY doc_id, line)
    SELECT doc_id, line, txt AS text, coalesce(hits, '') AS hits
    FROM lines LEFT JOIN hits USING (doc_id, line)
    """,
)
def i5(spark, sf):
    docs = documents(spark, sf)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    hits = tk.tokenizer(docs).where(F.col("norm") == TARGET)
    synced = kw.sync_lines(lines, hits)
    spans = F.transform(
        "hits", lambda h: F.concat_ws("-", h["start"].cast("string"), h["end"].cast("string"))
    )
    return synced.withColumn("hits", F.array_join(spans, " "))


@query(
    "i6_norm_ws",
    r"""
    SELECT page_id, trim(regexp_replace(html, '[\t-\r\p{Zs}]+', ' ', 'g')) AS html FROM pages
    """,
)
def i6(spark, sf):
    return table(spark, sf, "pages").select("page_id", norm_ws(F.col("html")).alias("html"))


@query(
    "i7_kwic_rows",
    f"WITH {kwic_sql('of', 10)} SELECT doc_id, line, start, prefix, target, suffix FROM kwic",
)
def i7(spark, sf):
    rows = kw.kwic(documents(spark, sf), "of", 10)
    return rows.select("doc_id", "line", "start", "prefix", "target", "suffix")


# --- J: statistics ----------------------------------------------------------


@query(
    "j1_summary_stats",
    """
    SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS mean,
           round(var_samp(l_extendedprice) / 1e6, 4) AS variance FROM lineitem
    """,
)
def j1(spark, sf):
    stats = st.summary_stats(table(spark, sf, "lineitem"), "l_extendedprice")
    return stats.select("n", rounded("mean", 4), F.round(F.col("variance") / 1e6, 4).alias("variance"))


@query(
    "j1_merge_states",
    f"""
    SELECT event_type, count(*) AS n, {stat_sql("avg(value)")} AS mean,
           round(var_pop(value) * count(*), 4) AS m2 FROM events GROUP BY event_type
    """,
)
def j1_merge(spark, sf):
    """States of the users, merged per event type."""
    states = st.stats_state(table(spark, sf, "events"), "value", ["event_type", "user_id"])
    merged = st.merge_states(states, ["event_type"])
    return merged.select("event_type", "n", rounded_stat("mean"), rounded("m2", 4))


@query(
    "j2_summary_stats_by",
    f"""
    SELECT event_type, year(ts) AS year, count(*) AS n, {stat_sql("avg(value)")} AS mean,
           {stat_sql("var_samp(value)")} AS variance FROM events GROUP BY 1, 2
    """,
)
def j2(spark, sf):
    events = table(spark, sf, "events")
    stats = st.summary_stats_by(events, "value", event_type="event_type", year=F.year("ts"))
    year = F.col("year").cast("long").alias("year")
    return stats.select("event_type", year, "n", rounded_stat("mean"), rounded_stat("variance"))


@query(
    "j3_complete_stats",
    f"""
    SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN {stat_sql("avg(value)")} END AS mean,
           {stat_sql("var_samp(value)")} AS variance FROM events GROUP BY user_id
    """,
)
def j3(spark, sf):
    done = st.complete_stats(st.stats_state(table(spark, sf, "events"), "value", ["user_id"]))
    return done.select("user_id", "n", rounded_stat("mean"), rounded_stat("variance"))


@query(
    "j4_z_score",
    """
    SELECT l_orderkey, l_linenumber, l_returnflag,
           round((l_quantity - avg(l_quantity) OVER w) / stddev_samp(l_quantity) OVER w, 9) AS z
    FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)
    """,
)
def j4(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"
    )
    scored = st.z_scores(rows, "l_quantity", ["l_returnflag"])
    return scored.select("l_orderkey", "l_linenumber", "l_returnflag", rounded("z"))


@query(
    "j5_t_test",
    """
    SELECT l_returnflag, round((avg(l_quantity) - (SELECT avg(l_quantity) FROM lineitem))
           / (stddev_samp(l_quantity) / sqrt(count(*))), 7) AS t FROM lineitem GROUP BY l_returnflag
    """,
)
def j5(spark, sf):
    """Is a return flag's mean quantity different from the overall mean?"""
    rows = table(spark, sf, "lineitem")
    expected = rows.agg(F.avg("l_quantity")).scalar()
    stats = st.summary_stats_by(rows, "l_quantity", l_returnflag="l_returnflag")
    t = scores.t_test(F.col("mean"), expected, F.sqrt("variance"), F.col("n"))
    return stats.select("l_returnflag", F.round(t, 7).alias("t"))


@query(
    "j6_t_test_differences",
    f"""
    WITH {FREQS}, {BENCH_WORDS},
    b AS (SELECT norm AS item, count(*) AS c2 FROM bench GROUP BY norm)
    SELECT item, count AS c1, coalesce(c2, 0) AS c2,
           round((count - coalesce(c2, 0)) / sqrt(count + coalesce(c2, 0)), 9) AS t
    FROM freqs LEFT JOIN b USING (item)
    """,
)
def j6(spark, sf):
    """Each word's count in the documents against its count in the benchmark texts."""
    bench = fr.frequencies(bench_words(spark, sf))
    counts = fr.lookup(word_freqs(spark, sf).withColumnRenamed("count", "c1"), bench)
    counts = counts.withColumnRenamed("count", "c2")
    scored = counts.withColumn("t", scores.t_difference(F.col("c1"), F.col("c2")))
    return scored.select("item", "c1", "c2", rounded("t"))


@query(
    "j7_likelihood_ratio",
    """
    SELECT o_orderkey, round(-2 * (
        3 * log2(0.25) + (k - 3) * log2(0.75) + 5 * log2(0.25) + (n - k - 5) * log2(0.75)
        - 3 * log2(0.5) - (k - 3) * log2(0.5) - 5 * log2(0.125) - (n - k - 5) * log2(0.875)), 6) AS ratio
    FROM (SELECT o_orderkey, 10 + o_custkey % 50 AS k, 200 + o_orderkey AS n FROM orders)
    """,
)
def j7(spark, sf):
    """Binomial hypotheses with given probabilities; powers are taken in logarithms."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        (10 + F.col("o_custkey") % 50).alias("k"),
        (200 + F.col("o_orderkey")).alias("n"),
    )
    ratio = scores.likelihood_ratio(
        F.col("k"), F.lit(8), F.lit(3), F.col("n"), F.lit(0.25), F.lit(0.5), F.lit(0.125)
    )
    return rows.select("o_orderkey", F.round(ratio, 6).alias("ratio"))


@query(
    "j8_pmi",
    f"WITH {COUNTED} SELECT w1, w2, round(log2((count / n) / ((c1 / n) * (c2 / n))), 9) AS pmi FROM counted",
)
def j8(spark, sf):
    """From plain counts, all over the number of tokens."""
    from corpusfreq.operators.association import with_item_counts
    from suite.count_queries import bigrams

    # Either part of a lookup, and the total, read the tables again.
    items, pairs = stored(word_freqs(spark, sf), "items"), stored(bigrams(spark, sf), "bigrams")
    counted = with_item_counts(pairs, items, ("w1", "w2"))
    n = items.agg(F.sum("count")).scalar()
    value = scores.pmi_counts(F.col("count"), F.col("c_w1"), F.col("c_w2"), n)
    return counted.select("w1", "w2", F.round(value, 9).alias("pmi"))


@query(
    "j9_mle",
    f"WITH {COUNTED} SELECT w1, w2, count / c1::DOUBLE AS p FROM counted",
)
def j9(spark, sf):
    from corpusfreq.operators.association import with_item_counts
    from suite.count_queries import bigrams

    items, pairs = stored(word_freqs(spark, sf), "items"), stored(bigrams(spark, sf), "bigrams")
    counted = with_item_counts(pairs, items, ("w1",))
    return counted.select("w1", "w2", scores.mle(F.col("count"), F.col("c_w1")).alias("p"))


def sgt_sql(compat: bool = False) -> str:
    if compat:
        cut = "1.96 * (r + 1) * nn / (n * n * (1 + nn / n))"
    else:
        cut = "1.96 * sqrt((r + 1) * (r + 1) * nn / (n * n) * (1 + nn / n))"
    return (
        NR
        + f""",
gaps AS (
  SELECT r, n::DOUBLE AS n, coalesce(lag(r) OVER w, 0) AS i, lead(r) OVER w AS k0,
         CASE WHEN lead(r) OVER w = r + 1 THEN (lead(n) OVER w)::DOUBLE END AS nn
  FROM nr WINDOW w AS (ORDER BY r)),
fit AS (SELECT regr_slope(ln(2 * n / (coalesce(k0, 2 * r - i) - i)), ln(r)) AS b,
               regr_intercept(ln(2 * n / (coalesce(k0, 2 * r - i) - i)), ln(r)) AS a FROM gaps),
est AS (SELECT r, n, nn, (r + 1) * nn / n AS x,
               (r + 1) * exp(a + b * ln(r + 1)) / exp(a + b * ln(r)) AS y, {cut} AS cut
        FROM gaps, fit),
star AS (SELECT r, n, CASE WHEN bool_or(nn IS NULL OR abs(x - y) <= cut) OVER (ORDER BY r)
                           THEN y ELSE x END AS r_star FROM est),
p0 AS (SELECT sum(n) FILTER (WHERE r = 1) / sum(r * n)::DOUBLE AS p0 FROM nr),
sgt AS (SELECT r, n::BIGINT AS n, r_star,
               (1 - p0) * r_star / (SELECT sum(n * r_star) FROM star) AS p FROM star, p0)
"""
    )


def sgt_rows(counts, compat=False):
    fitted = sm.sgt_table(counts, compat=compat)
    return fitted.select("r", "n", rounded("r_star", 6), rounded("p", 12))


SGT_ROWS = "SELECT r, n, round(r_star, 6) AS r_star, round(p, 12) AS p FROM sgt"


@query("j10_simple_good_turing", f"WITH {sgt_sql()} {SGT_ROWS}")
def j10(spark, sf):
    return sgt_rows(fr.count_of_counts(word_freqs(spark, sf)))


@query("j10_simple_good_turing_compat", f"WITH {sgt_sql(True)} {SGT_ROWS}")
def j10_compat(spark, sf):
    return sgt_rows(fr.count_of_counts(word_freqs(spark, sf)), compat=True)


@query(
    "j10_sgt_with_unseen",
    f"""
    WITH {sgt_sql()}
    SELECT r, round(r_star, 6) AS r_star, round(p, 12) AS p FROM sgt
    UNION ALL SELECT 0, 0.0, round(p0, 12) FROM p0
    """,
)
def j10_unseen(spark, sf):
    fitted = sm.sgt_with_unseen(fr.count_of_counts(word_freqs(spark, sf)))
    return fitted.select("r", rounded("r_star", 6), rounded("p", 12))


@query(
    "j11_absolute_discounting",
    f"""
    WITH {NR},
    t AS (SELECT sum(n) FILTER (WHERE r = 1) AS n1, sum(r * n)::DOUBLE AS total FROM nr)
    SELECT item, count, round((count - 0.75) / total, 12) AS p FROM freqs, t
    UNION ALL SELECT NULL, 0, round((1000000 - n1) * 0.75 / (n1 * total), 12) FROM t
    """,
)
def j11(spark, sf):
    freqs = word_freqs(spark, sf)
    unseen = freqs.agg(F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("count"))
    scored = sm.absolute_discounting(
        freqs.unionByName(unseen), fr.count_of_counts(freqs), 0.75, 1_000_000, "count"
    )
    return scored.select("item", "count", rounded("p", 12))


# --- K: distributions -------------------------------------------------------


def asked_sql(value: str, join: str = "") -> str:
    return f"SELECT b.item_id AS doc_id, b.ord::INT AS ord, b.norm, {value} AS p FROM bench b {join}"


@query(
    "k1_uniform_dist",
    f"""
    WITH {FREQS}, {BENCH_WORDS},
    members AS (SELECT item FROM freqs UNION SELECT lower(event_type) FROM events)
    {asked_sql('1.0::DOUBLE / (SELECT count(*) FROM members)')}
    """,
)
def k1(spark, sf):
    """Document words merged with event types; any queried word gets the same value."""
    words = di.UniformDist.of(word_freqs(spark, sf))
    types = table(spark, sf, "events").select(F.lower("event_type").alias("item"))
    merged = words.merge(di.UniformDist.of(types))
    return merged.probability(bench_words(spark, sf), "norm")


@query(
    "k2_map_dist",
    f"""
    WITH {FREQS}, {BENCH_WORDS},
    both_p AS (
      SELECT item, count / (SELECT sum(count) FROM freqs)::DOUBLE AS p FROM freqs UNION ALL
      SELECT norm, count(*) / (SELECT count(*) FROM bench)::DOUBLE FROM bench GROUP BY norm)
    SELECT item, round(sum(p) / (SELECT sum(p) FROM both_p), 12) AS p FROM both_p GROUP BY item
    """,
)
def k2(spark, sf):
    words = di.MapDist.of(word_freqs(spark, sf), weight="count")
    bench = di.MapDist.of(fr.frequencies(bench_words(spark, sf)), weight="count")
    return words.merge(bench).table.select("item", rounded("p", 12))


@query(
    "k3_mle_dist",
    f"""
    WITH {FREQS}, {BENCH_WORDS},
    merged AS (SELECT item, sum(count) AS count FROM (
      SELECT item, count FROM freqs UNION ALL SELECT norm, 1 FROM bench) GROUP BY item)
    SELECT item, count::DOUBLE / sum(count) OVER (PARTITION BY substr(item, 1, 1)) AS p FROM merged
    """,
)
def k3(spark, sf):
    """The history of a word is its first letter."""
    first = F.substring("item", 1, 1)
    words = di.MleDist.of(word_freqs(spark, sf), first)
    bench = di.MleDist.of(fr.frequencies(bench_words(spark, sf)), first)
    return words.merge(bench).table


@query(
    "k4_sgt_dist",
    f"""
    WITH {sgt_sql()}, {BENCH_WORDS}
    {asked_sql('round(coalesce(s.p, (SELECT p0 FROM p0)), 12)',
               'LEFT JOIN freqs f ON f.item = b.norm LEFT JOIN sgt s ON s.r = f.count')}
    """,
)
def k4(spark, sf):
    scored = di.SgtDist.of(word_freqs(spark, sf)).probability(bench_words(spark, sf), "norm")
    return scored.select("doc_id", "ord", "norm", rounded("p", 12))


@query(
    "k4_sgt_discount",
    f"""
    WITH {sgt_sql()}
    SELECT round((SELECT r_star FROM sgt WHERE r = 1) * (SELECT sum(count) FROM freqs), 4) AS discount
    """,
)
def k4_discount(spark, sf):
    return di.SgtDist.of(word_freqs(spark, sf)).discount().select(rounded("discount", 4))


@query(
    "k5_lidstone_dist",
    f"""
    WITH {FREQS}, {BENCH_WORDS}
    {asked_sql('(coalesce(f.count, 0) + 0.5::DOUBLE) / ((SELECT sum(count) FROM freqs) + 500000.0::DOUBLE)',
               'LEFT JOIN freqs f ON f.item = b.norm')}
    """,
)
def k5(spark, sf):
    # The formula holds for corpora of more words than bins as well.
    lidstone = di.LidstoneDist.of(word_freqs(spark, sf), 0.5, bins=1_000_000, strict=False)
    return lidstone.probability(bench_words(spark, sf), "norm")


@query(
    "k6_log_probability",
    f"""
    WITH {FREQS}, {BENCH_WORDS}
    SELECT b.item_id AS doc_id, b.ord::INT AS ord, b.norm,
           round(log2(f.count / (SELECT sum(count) FROM freqs)::DOUBLE), 9) AS log_p
    FROM bench b LEFT JOIN freqs f ON f.item = b.norm
    """,
)
def k6(spark, sf):
    d = di.MapDist.of(word_freqs(spark, sf), weight="count")
    scored = d.log_probability(bench_words(spark, sf), "norm")
    return scored.select("doc_id", "ord", "norm", rounded("log_p"))


@query(
    "k6_log_probability_compat",
    f"""
    WITH {FREQS}, {BENCH_WORDS}
    SELECT b.item_id AS doc_id, b.ord::INT AS ord, b.norm,
           round(1 / log2(f.count / (SELECT sum(count) FROM freqs)::DOUBLE), 9) AS log_p
    FROM bench b LEFT JOIN freqs f ON f.item = b.norm
    """,
)
def k6_compat(spark, sf):
    d = di.MapDist.of(word_freqs(spark, sf), weight="count")
    scored = d.log_probability(bench_words(spark, sf), "norm", compat=True)
    return scored.select("doc_id", "ord", "norm", rounded("log_p"))


@query(
    "k6_max_probability",
    f"""
    WITH {FREQS}
    SELECT item, count / (SELECT sum(count) FROM freqs)::DOUBLE AS p FROM freqs
    ORDER BY count DESC, item LIMIT 1
    """,
)
def k6_max(spark, sf):
    return di.MapDist.of(word_freqs(spark, sf), weight="count").max_probability()


@query("k6_samples", f"WITH {FREQS} SELECT item FROM freqs")
def k6_samples(spark, sf):
    return di.MapDist.of(word_freqs(spark, sf), weight="count").samples()


DRAWS = 20_000


@query(
    "k7_sample_from",
    f"""
    WITH {FREQS},
    weights AS (SELECT item, round(count / (SELECT sum(count) FROM freqs)::DOUBLE * pow(2::DOUBLE, 60))::BIGINT AS w
                FROM freqs),
    intervals AS (SELECT item, (sum(w) OVER (ORDER BY item) - w)::BIGINT AS lo FROM weights),
    draws AS (
      SELECT draw, floor(('0x' || substr(md5('7:' || draw), 1, 13))::BIGINT / pow(2::DOUBLE, 52)
                         * (SELECT sum(w)::BIGINT FROM weights))::BIGINT AS x
      FROM range({DRAWS}) t(draw))
    SELECT draw, item FROM draws ASOF JOIN intervals ON x >= lo
    """,
)
def k7(spark, sf):
    return di.MapDist.of(word_freqs(spark, sf), weight="count").generate(DRAWS, seed=7)


# --- L: naive Bayes ---------------------------------------------------------


def labelled(spark, sf):
    """Labelled documents; the label is the quality mark."""
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    docs = documents(spark, sf).join(marks, F.col("doc_id") == F.col("id")).drop("id")
    return docs.withColumn("label", F.concat(F.lit("q"), "quality")).select(
        "doc_id", "label", "text"
    )


LABELLED = (
    WORDS
    + """,
train_docs AS (SELECT doc_id, 'q' || quality AS label FROM labels JOIN documents USING (doc_id)),
feats AS (SELECT DISTINCT doc_id, label, norm AS feature FROM words JOIN train_docs USING (doc_id))
"""
)


@query(
    "l1_to_training",
    f"""
    WITH {LABELLED}
    SELECT t.doc_id, t.label, f.feature, true AS value
    FROM train_docs t JOIN feats f ON t.doc_id = f.doc_id
    """,
)
def l1(spark, sf):
    training = nb.to_training(labelled(spark, sf))
    rows = training.select("doc_id", "label", F.inline_outer("features"))
    return rows.where(F.col("feature").isNotNull())


@query(
    "l2_train",
    f"""
    WITH {LABELLED}
    SELECT label, feature, true AS value, count(*) AS count FROM feats GROUP BY label, feature
    UNION ALL SELECT label, NULL, NULL, count(*) FROM train_docs GROUP BY label
    """,
)
def l2(spark, sf):
    """Label counts (without a feature) and feature counts."""
    counts = nb.train(nb.to_training(labelled(spark, sf)))
    labels = counts.labels.select(
        "label",
        F.lit(None).cast("string").alias("feature"),
        F.lit(None).cast("boolean").alias("value"),
        "count",
    )
    return counts.features.unionByName(labels)


@query(
    "l2_merge_trainers",
    f"""
    WITH {LABELLED}
    SELECT label, feature, true AS value, count(*) AS count FROM feats GROUP BY label, feature
    """,
)
def l2_merge(spark, sf):
    """Two trainers, one for each half of a hash, merged."""
    training = fo.hash_folds(nb.to_training(labelled(spark, sf)), 2)
    halves = [nb.train(training.where(F.col("fold") == k)) for k in (0, 1)]
    return halves[0].merge(halves[1]).features


FINISHED = f"""
    WITH {LABELLED},
    n AS (SELECT label, count(*) AS n FROM train_docs GROUP BY label),
    lf AS (SELECT label, feature, count(*) AS c FROM feats GROUP BY label, feature),
    f AS (SELECT feature, 1 + (count(*) < (SELECT count(*) FROM train_docs))::INT AS bins
          FROM feats GROUP BY feature)
"""


@query(
    "l3_finish_training",
    FINISHED
    + """
    SELECT label, feature, true AS value, c AS count, (c + 0.5::DOUBLE) / (n + 0.5::DOUBLE * bins) AS p
    FROM lf JOIN n USING (label) JOIN f USING (feature)
    """,
)
def l3(spark, sf):
    return nb.finish_training(nb.train(nb.to_training(labelled(spark, sf))))


@query(
    "l3_finish_training_compat",
    FINISHED
    + """
    SELECT label, feature, true AS value, c AS count, (c + 0.5::DOUBLE) / (c + 0.5::DOUBLE * 1) AS p
    FROM lf JOIN n USING (label) JOIN f USING (feature)
    """,
)
def l3_compat(spark, sf):
    """Raw counts: a feature that only has the value true is certain."""
    return nb.finish_training(nb.train(nb.to_training(labelled(spark, sf))), compat=True)


@query(
    "l3_label_distribution",
    FINISHED
    + """
    SELECT label, (n + 0.5::DOUBLE) / ((SELECT sum(n) FROM n) + 0.5::DOUBLE * (SELECT count(*) FROM n)) AS p
    FROM n
    """,
)
def l3_labels(spark, sf):
    return nb.label_distribution(nb.train(nb.to_training(labelled(spark, sf))))


SCORED = (
    FINISHED
    + """,
    asked AS (SELECT DISTINCT doc_id, norm AS feature FROM words),
    known AS (SELECT doc_id, feature, bins FROM asked JOIN f USING (feature)),
    terms AS (SELECT k.doc_id, n.label, ln((coalesce(lf.c, 0) + 0.5) / (n.n + 0.5 * k.bins)) AS v
              FROM known k CROSS JOIN n LEFT JOIN lf ON lf.label = n.label AND lf.feature = k.feature),
    scores AS (
      SELECT d.doc_id, n.label,
             ln((n.n + 0.5) / ((SELECT sum(n) FROM n) + 0.5 * (SELECT count(*) FROM n)))
             + coalesce((SELECT sum(v) FROM terms t WHERE t.doc_id = d.doc_id AND t.label = n.label), 0) AS score
      FROM documents d CROSS JOIN n),
    tops AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM scores),
    post AS (SELECT doc_id, label, score, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY doc_id) AS p
             FROM tops)
"""
)


def all_posteriors(spark, sf):
    """Train on the labelled documents, score every document."""
    counts = nb.train(nb.to_training(labelled(spark, sf)))
    test = nb.to_training(documents(spark, sf), F.lit("?"))
    return nb.posteriors(counts, test)


@query(
    "l4_classify_proba",
    SCORED + "SELECT doc_id, label, round(score, 6) AS score, round(p, 6) AS p FROM post",
)
def l4(spark, sf):
    scored = nb.classify_proba(all_posteriors(spark, sf))
    return scored.select("doc_id", "label", rounded("score", 6), rounded("p", 6))


@query(
    "l5_classify",
    SCORED
    + """
    SELECT doc_id, label AS predicted FROM post
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1
    """,
)
def l5(spark, sf):
    return nb.classify(all_posteriors(spark, sf))


SHUFFLED = """(SELECT doc_id, row_number() OVER (ORDER BY md5('5:' || doc_id), doc_id) - 1 AS place
               FROM documents)"""


@query("l6_shuffle", f"SELECT doc_id, place FROM {SHUFFLED}")
def l6(spark, sf):
    return fo.shuffled(documents(spark, sf).select("doc_id"), seed=5)


@query(
    "l7_split_folds",
    f"SELECT doc_id, place, (ntile(10) OVER (ORDER BY place) - 1)::INT AS fold FROM {SHUFFLED}",
)
def l7(spark, sf):
    return fo.split_folds(fo.shuffled(documents(spark, sf).select("doc_id"), seed=5), 10)


HASH_FOLD = "(('0x' || substr(md5('3:' || doc_id), 1, 8))::BIGINT % 5)::INT"


@query("l7_hash_folds", f"SELECT doc_id, {HASH_FOLD} AS fold FROM documents")
def l7_hash(spark, sf):
    return fo.hash_folds(documents(spark, sf).select("doc_id"), 5, seed=3)


@query(
    "l8_leave_one_out",
    f"""
    WITH {LABELLED}, folded AS (SELECT *, {HASH_FOLD} AS fold FROM feats),
    asked AS (SELECT DISTINCT fold, label, feature FROM folded)
    SELECT a.fold, a.label, a.feature,
           (SELECT count(*) FROM folded o
            WHERE o.label = a.label AND o.feature = a.feature AND o.fold <> a.fold) AS count
    FROM asked a
    """,
)
def l8(spark, sf):
    """Training counts without the own fold, for each fold's features."""
    training = fo.hash_folds(nb.to_training(labelled(spark, sf)), 5, seed=3)
    own = nb.train(training, ["fold"]).features.drop("value")
    wanted = own.select("fold", "label", "feature")
    return fo.leave_one_out(wanted, own)


# Documents in the order of a digest, cut into ten runs, the first ones one longer.
SHUFFLED = """
    placed AS (SELECT doc_id, label, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1 AS i,
                      count(*) OVER () // 10 AS size, count(*) OVER () % 10 AS larger FROM train_docs),
    docs AS (SELECT doc_id, label, (CASE WHEN i < larger * (size + 1) THEN i // (size + 1)
                    ELSE larger + (i - larger * (size + 1)) // greatest(size, 1) END)::INT AS fold FROM placed),
"""
HASHED = f"docs AS (SELECT doc_id, label, {HASH_FOLD} AS fold FROM train_docs),"


def cross_sql(folds):
    return f"""
    WITH {LABELLED},
    {folds}
    ff AS (SELECT doc_id, label, feature, fold FROM feats JOIN docs USING (doc_id, label)),
    folds AS (SELECT DISTINCT fold FROM docs),
    n AS (SELECT folds.fold, label, count(*) AS n FROM folds JOIN docs ON docs.fold <> folds.fold
          GROUP BY 1, 2),
    total AS (SELECT fold, sum(n) AS n, count(*) AS labels FROM n GROUP BY fold),
    lf AS (SELECT folds.fold, label, feature, count(*) AS c FROM folds JOIN ff ON ff.fold <> folds.fold
           GROUP BY 1, 2, 3),
    f AS (SELECT lf.fold, feature, 1 + (sum(c) < any_value(total.n))::INT AS bins
          FROM lf JOIN total ON total.fold = lf.fold GROUP BY 1, 2),
    terms AS (SELECT a.doc_id, n.label, sum(ln((coalesce(lf.c, 0) + 0.5) / (n.n + 0.5 * f.bins))) AS v
              FROM ff a JOIN f ON f.fold = a.fold AND f.feature = a.feature JOIN n ON n.fold = a.fold
              LEFT JOIN lf ON lf.fold = a.fold AND lf.label = n.label AND lf.feature = a.feature
              GROUP BY 1, 2),
    scores AS (SELECT d.doc_id, d.fold, d.label AS truth, n.label,
                      ln((n.n + 0.5) / (total.n + 0.5 * total.labels)) + coalesce(v, 0) AS score
               FROM docs d JOIN n ON n.fold = d.fold JOIN total ON total.fold = d.fold
               LEFT JOIN terms t ON t.doc_id = d.doc_id AND t.label = n.label),
    tops AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM scores),
    post AS (SELECT *, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY doc_id) AS p FROM tops),
    best AS (SELECT doc_id, label AS predicted FROM post
             QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1),
    results AS (SELECT d.doc_id, d.fold, d.label, predicted, coalesce(post.p, 0) AS p_true
                FROM docs d JOIN best USING (doc_id)
                LEFT JOIN post ON post.doc_id = d.doc_id AND post.label = d.label),
    evaluated AS (
      SELECT fold, count(*) FILTER (WHERE predicted = label) AS hits, count(*) AS n,
             count(*) FILTER (WHERE predicted = 'q1' AND label = 'q1') AS tp,
             count(*) FILTER (WHERE predicted = 'q1' AND label <> 'q1') AS fp,
             count(*) FILTER (WHERE predicted <> 'q1' AND label = 'q1') AS fn,
             avg(pow(1 - p_true, 2)) AS mse,
             exp(-avg(CASE WHEN p_true > 0 THEN ln(p_true) END)) AS perplexity
      FROM results GROUP BY fold),
    measures AS (
      SELECT fold, hits, n, hits / n::DOUBLE AS accuracy,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS recall,
             CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1,
             mse, perplexity FROM evaluated)
"""


CROSS = cross_sql(HASHED)
MEASURES = ["accuracy", "precision", "recall", "f1", "mse"]


def folded(spark, sf):
    """The training rows with their folds, stored since counts, scores and truth read them."""
    return stored(fo.hash_folds(nb.to_training(labelled(spark, sf)), 5, seed=3), "training")


def evaluated(spark, sf):
    training = folded(spark, sf)
    results = nb.fold_results(nb.cross_validated(training), training)
    return nb.evaluate(results, "q1")


@query(
    "l9_cross_validated",
    CROSS + "SELECT doc_id, fold, label, round(score, 6) AS score, round(p, 6) AS p FROM post",
)
def l9_proba(spark, sf):
    scored = nb.classify_proba(nb.cross_validated(folded(spark, sf)))
    return scored.select("doc_id", "fold", "label", rounded("score", 6), rounded("p", 6))


@query(
    "l9_evaluate",
    CROSS
    + f"SELECT fold, hits, n, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES)},"
    " round(ln(perplexity), 6) AS log_perplexity FROM measures",
)
def l9(spark, sf):
    log = F.round(F.ln("perplexity"), 6).alias("log_perplexity")
    return evaluated(spark, sf).select("fold", "hits", "n", *[rounded(m, 6) for m in MEASURES], log)


@query(
    "l9_average",
    CROSS
    + f"SELECT sum(hits)::BIGINT AS hits, sum(n)::BIGINT AS n, "
    f"{', '.join(f'round(avg({m}), 6) AS {m}' for m in MEASURES)} FROM measures",
)
def l9_average(spark, sf):
    mean = nb.average_folds(evaluated(spark, sf))
    return mean.select("hits", "n", *[rounded(m, 6) for m in MEASURES])


@query(
    "l9_cross_validate",
    cross_sql(SHUFFLED)
    + f"SELECT sum(hits)::BIGINT AS hits, sum(n)::BIGINT AS n, "
    f"{', '.join(f'round(avg({m}), 6) AS {m}' for m in [*MEASURES, 'ln(perplexity)'])} FROM measures".replace(
        "AS ln(perplexity)", "AS log_perplexity"
    ),
)
def l9_cross_validate(spark, sf):
    """The whole experiment: shuffle, split, train and test on each fold, average."""
    measured = nb.cross_validate(labelled(spark, sf), "label", "q1")
    mean = nb.average_folds(measured.withColumn("log_perplexity", F.ln("perplexity")))
    return mean.select("hits", "n", *[rounded(m, 6) for m in [*MEASURES, "log_perplexity"]])
