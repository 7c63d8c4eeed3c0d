"""URL filter: host and path rules, then a listed-URL test by a blocked Bloom filter.

The Bloom filter is a table of at most ``MAX_BLOCKS`` 64-bit words, so it is broadcast
at any list size; URLs that pass it go to an exact join with the list, which
removes the false positives. A fuller filter passes more URLs to that join and
never changes the result.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no
rule, is not listed and gets ``allow``. Repeated rows are kept, each with its verdict.
Null list entries are ignored. An empty list blocks nothing. URLs of any length are
read whole. Other columns are not read, so their names never clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BLOCKS = 1 << 16
KEYS_PER_BLOCK = 6
BITS_PER_KEY = 4
MAX_RULES = 1000
# Campaign parameters that do not change the page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without end slash, query without campaign parameters.

    Null where the URL has no host.
    """
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, rf"(^|&){TRACKING}", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.when(
        host != "", F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    )


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest (host, path, verdict) rule that fits, else null.

    A rule fits its host and every subdomain of it if the path starts with the rule's.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; put single pages into the URL list")
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    if not fits:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def bloom_bits(h: Column) -> Column:
    """The key's bits inside its 64-bit block."""
    mask = None
    for i in range(BITS_PER_KEY):
        place = F.shiftrightunsigned(h, 24 + 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def blocked_bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, mask): one 64-bit word for each occupied block, ``blocks`` rows at most."""
    h = F.xxhash64(key)
    return listed.groupBy(F.pmod(h, F.lit(blocks)).alias("block")).agg(F.bit_or(bloom_bits(h)).alias("mask"))


def block_count(n_keys: int) -> int:
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * KEYS_PER_BLOCK < n_keys:
        blocks *= 2
    return blocks


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
) -> DataFrame:
    """Per page: id, host, path, rule, listed (null where a rule decided), verdict."""
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    judged = pages.select(
        F.col(id_col), host.alias("host"), path.alias("path"), canonical_url(F.col(url_col)).alias("canon")
    ).withColumn("fit", apply_rules(F.col("host"), F.col("path"), rules))
    exact = listed.select(canonical_url(F.col(listed_col)).alias("entry")).where("entry IS NOT NULL").distinct()
    blocks = block_count(exact.count())
    bloom = blocked_bloom(exact, "entry", blocks)

    ruled = judged.where("fit IS NOT NULL").select(id_col, "host", "path", "fit", F.lit(None).cast("boolean").alias("listed"))
    # Null keys match nothing in the broadcast join and stay where they are.
    h = F.xxhash64("canon")
    open_ = judged.where("fit IS NULL").withColumn("at", F.when(F.col("canon").isNotNull(), F.pmod(h, F.lit(blocks))))
    tested = open_.join(F.broadcast(bloom), F.col("at") == F.col("block"), "left").withColumn(
        "maybe", F.coalesce(F.col("mask").bitwiseAND(bloom_bits(h)) == bloom_bits(h), F.lit(False))
    )
    kept = [id_col, "host", "path", "fit"]
    clean = tested.where(~F.col("maybe")).select(*kept, F.lit(False).alias("listed"))
    hits = tested.where("maybe").join(exact, F.col("canon") == F.col("entry"), "left")
    hits = hits.select(*kept, F.col("entry").isNotNull().alias("listed"))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return ruled.unionByName(clean).unionByName(hits).select(
        id_col, "host", "path", F.col("fit.rule").alias("rule"), "listed", verdict.alias("verdict")
    )
