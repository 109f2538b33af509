"""URL filter: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

Everything is DataFrame or SQL functions.  The filter is a table of blocks, each WORDS longs
of 64 bits; a URL sets one bit in every word of one block.  Probing joins a page to its
block and tests the bits.  Possible hits go on to an exact hash join with the list, which
removes the false positives; sure misses never reach that join.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a block, and listed URLs that a block is sized for (about 25 bits a URL).
WORDS = 4
URLS_PER_BLOCK = 10
#: A block row is broadcast only below this size.
BROADCAST_BYTES = 32 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Scheme, www., user, default port, fragment, tracking parameters and the last slash go; host in lower case.

    '' for null and where there is no ://.
    """
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", ""), r"^www\.", "")
    query = F.when(url.contains("://"), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)).otherwise("")
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))), "&")
    return F.coalesce(F.concat(host, F.regexp_replace(path, r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")), F.lit(""))


def by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (host, path, verdict) that fits; null where none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def _bits(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    spread = F.xxhash64(F.lit("bloom"), key)
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)), [F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def build_filter(listed: DataFrame, n_listed: int, urls_per_block: float = URLS_PER_BLOCK) -> tuple[DataFrame, int]:
    """The filter's blocks (block, w0, w1 ...) for the column `canonical` of listed, and their number."""
    n_blocks = 1 << max(0, math.ceil(math.log2(max(1, n_listed) / urls_per_block)))
    block, bits = _bits(F.col("canonical"), n_blocks)
    words = [F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(WORDS)]
    return listed.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)]).groupBy("block").agg(*words), n_blocks


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], urls_per_block: float = URLS_PER_BLOCK) -> DataFrame:
    """page_id, host, path, canonical, rule, possible, verdict of every row of pages (page_id, url).

    listed: column `canonical`, repeats and nulls allowed.  A rule decides where one fits;
    else a listed URL is blocked and any other allowed.  Null urls and urls without :// have
    empty host and path and canonical form '' (never listed).  Rows are neither lost nor
    repeated; extra columns of pages are not carried.
    """
    listed = listed.select("canonical").filter(F.col("canonical") != "").distinct()
    n_listed = listed.count()
    blocks, n_blocks = build_filter(listed, n_listed, urls_per_block)
    if n_blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical"))
    rule, said = by_rules(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("said", said)
    block, bits = _bits(F.col("canonical"), n_blocks)
    probed = parsed.withColumn("block", block).join(blocks, "block", "left")
    hit = F.lit(True)
    for i, b in enumerate(bits):
        hit = hit & (F.getbit(F.col(f"w{i}"), b) == 1)
    probed = probed.withColumn("possible", F.coalesce(hit & F.col("said").isNull(), F.lit(False)))
    columns = ["page_id", "host", "path", "canonical", "rule", "possible"]
    sure = probed.filter(~F.col("possible")).select(*columns, F.coalesce("said", F.lit("allow")).alias("verdict"))
    exact = listed.withColumn("found", F.lit(True))
    maybe = probed.filter("possible").join(exact, "canonical", "left")
    return sure.unionByName(maybe.select(*columns, F.when(F.col("found"), "block").otherwise("allow").alias("verdict")))
