"""Queries made of DataFrame functions only: URL filter, decontamination, line dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfreq.llm import decontaminate, lines, urls
from corpusfreq.llm.registry import query, table

RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

# The list: pages of hosts that name adult, casino or betting sites.
LISTED = r"(^|\.)(adult|casino|free)-[^.]*\."

URL_SQL = rf"""
WITH parts AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '') AS q
  FROM pages),
cut AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS body,
         regexp_replace(regexp_replace(q, '(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS query
  FROM parts),
canon AS (
  SELECT page_id, host, path,
         CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN body || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS key
  FROM cut),
listed AS (SELECT DISTINCT key AS entry FROM canon WHERE regexp_matches(host, '{LISTED}')),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM canon)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN entry IS NOT NULL END AS listed,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
                 WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN entry IS NULL THEN 'allow' ELSE 'block' END END AS verdict
FROM ruled LEFT JOIN listed ON key = entry
"""


@query("op8_url_filter", URL_SQL)
def op8(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(urls.url_host(F.col("url")).rlike(LISTED)).select("url")
    return urls.filter_urls(pages, listed, RULES)


SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECON_SQL = rf"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEP}'), lambda x: x <> '') AS w
  FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEP}'), lambda x: x <> '') AS w
  FROM benchmark),
starts AS (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM bw WHERE len(w) > 0),
grams AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS gram FROM starts),
lens AS (SELECT DISTINCT n FROM grams),
dp AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM dw),
dwin AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram FROM dp, lens WHERE p + n - 1 <= len(w)),
hits AS MATERIALIZED (SELECT DISTINCT doc_id, p, d.n, item_id FROM dwin d JOIN grams g ON d.gram = g.gram AND d.n = g.n),
pos AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) AS k FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id
"""


@query("op9_decontaminate", DECON_SQL)
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, source, i, line FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents)),
total AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
boiler AS (
  SELECT source, line FROM (SELECT source, line, count(DISTINCT doc_id) AS pages FROM l WHERE trim(line, ' ') <> '' GROUP BY source, line)
  JOIN total USING (source) WHERE pages >= {lines.MIN_PAGES} AND pages > {lines.RATIO}::DOUBLE * total),
marked AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN boiler b ON l.source = b.source AND l.line = b.line),
cut AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS body
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(body) END AS text_sha256
FROM documents d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""


@query("op10_line_dedup", LINES_SQL)
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = lines.drop_boilerplate(docs, n_lines="n_lines", n_dropped="n_dropped")
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))
