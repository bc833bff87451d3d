"""URL filters, in DataFrame operations only.

Rules (a host and the beginning of a path) and listed canonical URLs become
keys of one table.  A blocked Bloom filter of these keys, which grows with
their number, lets possible hits of the URLs' own keys pass to an exact join
on the key, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplicia.llm.shared import LOWER, UPPER, ascii_lower

#: Blocks of the Bloom filter have four 64-bit words; up to so many, some 20 MB and 8 million keys, it is broadcast.
BROADCAST_BLOCKS = 1 << 19
KEYS_PER_BLOCK = 16
BLOCK_WORDS = 4


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def canonical(url: Column) -> Column:
    """Host and path without scheme, query and fragment; an empty path is /."""
    return F.concat(url_host(url), F.coalesce(F.nullif(url_path(url), F.lit("")), F.lit("/")))


def _bits(key: Column) -> list[Column]:
    """One bit in each word of a block."""
    h = F.xxhash64(F.lit("bit"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(BLOCK_WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the column key: at most ``blocks`` rows, however many keys there are."""
    words = {f"w{i}": b for i, b in enumerate(_bits(F.col("key")))}
    return keys.select(_block(F.col("key"), blocks).alias("block"), *(b.alias(n) for n, b in words.items())).groupBy("block").agg(*(F.bit_or(n).alias(n) for n in words))


def possible_hits(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``candidates`` whose key may be in ``keys``: all that are, and a few others.

    There is a block for every KEYS_PER_BLOCK keys at least.  A filter of
    BROADCAST_BLOCKS at most is broadcast; a larger one is joined block by
    block, so that no task holds all of it.
    """
    blocks = 1 << max(0, keys.count() // KEYS_PER_BLOCK).bit_length()
    table = bloom_filter(keys, blocks)
    if blocks <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    bits = _bits(F.col("key"))
    hit = [F.col(f"w{i}").bitwiseAND(b) != 0 for i, b in enumerate(bits)]
    joined = candidates.withColumn("block", _block(F.col("key"), blocks)).join(table, "block")
    for h in hit:
        joined = joined.where(h)
    return joined.select(*candidates.columns)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame) -> DataFrame:
    """Judge every page's URL.

    ``pages`` has page_id and url; ``rules`` are (action, host/path) with
    action allow or block, a short configuration; ``listed`` has a column url of
    blocked URLs and may be of any size.  A rule fits its host and all
    subdomains where the URL's path starts with the rule's; of the rules that
    fit, the longest wins.  Without one, a URL whose canonical form is listed
    is blocked and any other allowed.

    Returns page_id, host, path, rule (null without one) and verdict, one row
    for each input row; repeated rows stay.  A null URL or one without ://
    has empty host and path, no rule, and is allowed.  Nulls and repeats in
    ``listed`` are ignored; empty tables are fine.  Other columns of both
    tables are ignored, whatever their names.  URLs may be of any length; each
    distinct one is judged once.
    """
    spark = pages.sparkSession
    policy = spark.createDataFrame([(r, a, len(r)) for a, r in rules], "key string, action string, length int")
    shapes = sorted({(r.partition("/")[0].count(".") + 1, len(r) - r.find("/")) for _, r in rules})
    block_list = listed.where(F.instr("url", "://") > 0).select(F.concat(F.lit("="), canonical(F.col("url"))).alias("key")).distinct()
    block_list = block_list.select("key", F.lit("block").alias("action"), F.lit(0).alias("length"))
    known = policy.union(block_list)

    # Equal URLs get equal verdicts, so each distinct URL is judged once.
    urls = pages.select("url").where(F.instr("url", "://") > 0).distinct()
    parsed = urls.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.size(F.split("host", r"\."))
    prefixes = [
        F.when((labels >= n) & (F.length("path") >= k), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, k)))
        for n, k in shapes
    ]
    keys = F.array(F.concat(F.lit("="), canonical(F.col("url"))), *prefixes)
    candidates = parsed.select("url", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
    hits = possible_hits(candidates, known).join(known, "key")
    best = hits.groupBy("url").agg(F.max(F.struct("length", "key", "action")).alias("best"))
    found = best.select(F.col("url").alias("hit_url"), F.when(F.col("best.length") > 0, F.col("best.key")).alias("rule"), "best.action")
    own = pages.select("page_id", "url")
    return own.join(found, own["url"] == found["hit_url"], "left").select(
        "page_id",
        F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(url_path(F.col("url")), F.lit("")).alias("path"),
        "rule",
        F.coalesce("action", F.lit("allow")).alias("verdict"),
    )


#: The policy of the registered query.
POLICY = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: A page is listed if the MD5 digest of its id begins with one of these.
LISTED_DIGITS = "0123"


def listed_pages(pages: DataFrame) -> DataFrame:
    """The list of the registered query: the URLs of some pages, chosen by a hash of the id, in another spelling
    (upper-case scheme and host, another query and fragment), and for every page one URL on its host that is no page."""
    url, host, path = F.col("url"), url_host(F.col("url")), url_path(F.col("url"))
    digit = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 1)
    spelled = F.concat(F.lit("HTTP://"), F.translate(host, LOWER, UPPER), path, F.lit("?listed=1#top"))
    known = pages.where((F.instr(url, "://") > 0) & digit.isin(list(LISTED_DIGITS))).select(spelled.alias("url"))
    gone = pages.where(F.instr(url, "://") > 0).select(F.concat(F.lit("http://"), host, path, F.lit("~gone")).alias("url"))
    return known.union(gone)


#: DuckDB SQL for filter_urls(pages, POLICY, listed_pages(pages)).
FILTER_URLS_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, coalesce(instr(url, '://') > 0, false) AS fit FROM pages),
parsed AS (
  SELECT page_id, fit, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests),
judged AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM parsed),
canonical AS (SELECT *, host || coalesce(nullif(path, ''), '/') AS page FROM judged),
list AS (SELECT DISTINCT page AS listed FROM canonical WHERE fit AND substr(md5(CAST(page_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3'))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN fit AND listed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM canonical LEFT JOIN list ON page = listed
"""
