"""The corpus operators' queries and their SQL: thin calls over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversation, digest, media, mixing, quality, repetition, sharding, simhash, spm, substring, urlfilter, warc
from .common import table
from .oracle_conversation import CONVERSATION_SQL

#: Rules of the URL query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The URL query's list: the canonical URLs whose MD5 begins with one of these, an eighth of all, whatever their hosts.
LISTED_BY = ("0", "1")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url", "html"))
    return made.withColumnRenamed("key", "page_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)
    return groups.select("doc_id", simhash.print_hex().alias("fingerprint"), "component_id")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=8)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(table(spark, sf_dir, "documents").select("doc_id", "text"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs that are listed, by their own hash: no part of a URL tells whether it is."""
    canonical = pages.select(urlfilter.canonical(F.col("url")).alias("canonical"))
    return canonical.filter(F.left(F.md5("canonical"), F.lit(1)).isin(*LISTED_BY))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, listed_urls(pages), RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents").select("doc_id", "text"))
    stored = stored.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)}).drop("payload_bytes")
    read = media.load(stored)
    tail = F.expr(f"crc32(substring(payload, -{media.UNIT}, {media.UNIT}))")
    return read.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op12_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.summaries(conversation.damaged(table(spark, sf_dir, "conversations")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_mixing, op3_simhash, op4_substring, op5_sentencepiece, op6_sharding, op7_repetition, op8_url_filter, op9_fingerprints, op10_quality, op11_media, op12_conversation, op13_alignment)}

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op12_conversation": CONVERSATION_SQL,
    "op8_url_filter": r"""
        WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
                     || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(CASE WHEN contains(url, '://') THEN regexp_extract(url, '^[^?#]*\?([^#]*)', 1) ELSE '' END, '&'),
                        lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&'), ''), '') AS canonical FROM h),
        l AS (SELECT DISTINCT canonical FROM c WHERE left(md5(canonical), 1) IN ('0', '1')),
        r AS (SELECT c.*, l.canonical IS NOT NULL AS listed, CASE
                WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
                WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
                WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
                WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule FROM c LEFT JOIN l USING (canonical))
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op2_mixing": rf"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size,
                          md5('mix:' || doc_id::VARCHAR) AS key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
        c AS (SELECT *, (rank % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap, 3 * source_size / (rank % 3 + 1)::DOUBLE AS ratio,
                     sum(source_size) OVER ()::BIGINT AS total, sum(rank % 3 + 1) OVER ()::BIGINT AS weights FROM s),
        b AS (SELECT *, coalesce(sum(cap) OVER o, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER o, 0)::BIGINT AS weight_before FROM c
              WINDOW o AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, cap * (weights - weight_before) <= (total - cap_before) * weight AS full_ FROM b),
        g AS (SELECT *, total - coalesce(sum(cap) FILTER (full_) OVER (), 0)::BIGINT AS rest, weights - coalesce(sum(weight) FILTER (full_) OVER (), 0)::BIGINT AS rest_weight FROM f),
        t AS (SELECT source, source_size, CASE WHEN full_ THEN cap::DOUBLE ELSE (rest * weight)::DOUBLE / greatest(rest_weight, 1) END AS target FROM g),
        r AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM r)
        SELECT doc_id, size, source_size, target,
               (whole * size + least(greatest(budget - whole * source_size - (upto - size), 0), size))::BIGINT AS taken FROM e""",
    "op4_substring": rf"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORDS}'), []) AS w FROM documents),
        b AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS block FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
        again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY block ORDER BY doc_id, s) AS k FROM b) WHERE k > 1),
        p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s FROM d),
        c AS (SELECT p.*, coalesce(p.s - max(again.s) OVER (PARTITION BY p.doc_id ORDER BY p.s) < 20, false) AS gone FROM p LEFT JOIN again ON again.doc_id = p.doc_id AND again.s = p.s),
        g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY s) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
    "op7_repetition": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{_WORDS}'), []) AS w FROM documents),
        l AS (SELECT doc_id, line, strlen(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS size FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
        m AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id, line) > 1 AS again FROM l WHERE size > 0),
        n AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, sum(size) AS chars, coalesce(sum(size) FILTER (again), 0) AS dup_chars FROM m GROUP BY doc_id),
        q AS (SELECT * FROM (VALUES {", ".join(f"({k}, {v}::DOUBLE)" for k, v in repetition.GRAM_LIMITS.items())}) v(n, lim)),
        p AS (SELECT doc_id, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s FROM d),
        g AS (SELECT doc_id, n, lim, s, length(word) AS chars, CASE WHEN s + n - 1 <= len(w) THEN md5(array_to_string(w[s:s + n - 1], ' ')) END AS gram FROM p CROSS JOIN q),
        r AS (SELECT *, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, n, gram) > 1 AS rep FROM g),
        i AS (SELECT *, coalesce(s - max(CASE WHEN rep THEN s END) OVER (PARTITION BY doc_id, n ORDER BY s) < n, false) AS inside FROM r),
        e AS (SELECT doc_id, n, lim, sum(chars) AS word_chars, coalesce(sum(chars) FILTER (inside), 0) AS inside, count(*) FILTER (inside) AS n_inside FROM i GROUP BY ALL),
        x AS (SELECT doc_id, any_value(word_chars)::BIGINT AS word_chars, max(inside / word_chars / lim) AS gram_share, max(n_inside) FILTER (n = {repetition.WINDOW})::BIGINT AS n_repeat_words FROM e GROUP BY doc_id),
        a AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
                     coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gram_share, 0)::DOUBLE AS gram_share, coalesce(n_dup_lines / n_lines, 0)::DOUBLE AS line_share, coalesce(dup_chars / chars, 0)::DOUBLE AS line_char_share
              FROM d LEFT JOIN x USING (doc_id) LEFT JOIN n USING (doc_id))
        SELECT *, n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.REPEAT_PERCENT} * n_words AS base_failed,
               NOT base_failed AND gram_share <= 1 AND line_share <= {repetition.LINE_LIMIT} AND line_char_share <= {repetition.LINE_CHAR_LIMIT} AS kept FROM a""",
}
