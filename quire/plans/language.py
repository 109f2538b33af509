"""Named queries on what a text layer reads as, on layers that replace it and on broken layers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import policy, text
from quire.operators import languages, pages

Spark = SparkSession
_KEYS = ["doc_id", "page"]
#: Frequent words of the languages at hand, a stand-in for a language model.
PROFILES = {"eng": ("the", "of", "and", "to", "in", "is", "that", "was"), "fra": ("le", "la", "les", "des", "et", "est", "une", "dans"), "deu": ("der", "die", "und", "das", "ist", "nicht", "ein", "den"), "spa": ("el", "los", "que", "y", "las", "del", "con", "por")}
#: Names of languages by ISO 639-3 code, as the evidence has them.
NAMES = {"eng": "English", "fra": "French", "deu": "German", "spa": "Spanish"}
COMMON = ("the", "of", "and", "to", "in", "a", "is", "for", "on", "that", "by", "with")


def _layers(spark: Spark, d: str) -> DataFrame:
    return pages.layers(pages.explode_pages(pages.documents(spark, d)))


def _read(spark: Spark, d: str) -> DataFrame:
    return text.with_language(_layers(spark, d).select(*_KEYS, "text"), text.by_profile(PROFILES))


def language_vote(spark: Spark, d: str) -> DataFrame:
    return _read(spark, d).select(*_KEYS, "language", "readability", "unreadable")


def text_reading(spark: Spark, d: str) -> DataFrame:
    """A page's reading as manifests hold it: names for codes; image pages (every fifth document) have none."""
    names = spark.createDataFrame(list(NAMES.items()), "language string, name string")
    r = language_vote(spark, d).filter("doc_id % 5 <> 0")
    return r.join(F.broadcast(names), "language", "left").select(*_KEYS, "language", F.coalesce("name", F.lit("")).alias("name"), "readability", "unreadable")


def text_override(spark: Spark, d: str) -> DataFrame:
    """Pages with the text that evaluation puts in place of their layer; what is overridden isn't kept."""
    p = pages.explode_pages(pages.documents(spark, d))
    made = p.filter("doc_id % 9 = 0 and page = 0").select(*_KEYS, text.garble_cid("text").alias("override"))
    joined = p.join(made, _KEYS, "left")
    used = F.coalesce("override", "text")
    return joined.select(*_KEYS, text.cid_share(used).alias("cid_share"), text.chars(used).alias("chars"), F.col("override").isNull().alias("kept"))


def common_words(spark: Spark, d: str) -> DataFrame:
    return _layers(spark, d).select(*_KEYS, F.round(text.common_share(F.col("text"), COMMON), 6).alias("share"))


def odd_body(spark: Spark, d: str) -> DataFrame:
    """Every eleventh document has a character of each kind put in front."""
    marked = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("\x01� "), "text")).otherwise(F.col("text"))
    return _layers(spark, d).select(*_KEYS, F.round(text.odd_body_share(marked), 8).alias("share"))


def stored_text(spark: Spark, d: str) -> DataFrame:
    """Whole documents as one page each: all of it is measured, the beginning stored."""
    whole = F.coalesce("text", F.lit(""))
    return pages.documents(spark, d).select("doc_id", text.chars(whole).alias("chars"), F.length(text.stored(whole)).alias("stored"), F.md5(text.stored(whole)).alias("digest"))


def garbled_layers(spark: Spark, d: str) -> DataFrame:
    """Three broken layers of each first page."""
    p = pages.explode_pages(pages.documents(spark, d)).filter("page = 0")
    return p.select("doc_id", F.md5(text.garble_codes(F.col("text"))).alias("codes"), F.md5(text.garble_shift(F.col("text"))).alias("shift"), F.md5(text.garble_bytes(F.col("text"))).alias("bytes"))


def layer_trust(spark: Spark, d: str) -> DataFrame:
    """The trust gate on what is measured: readability, shares, hidden text and coverage of every page; images have no layer."""
    m = pages.measured(_read(spark, d))
    hidden, coverage = F.col("doc_id") % 6 == 0, (F.col("doc_id") * 13 + F.col("page") * 7) % 100 / 100.0
    trusted = (F.col("doc_id") % 5 != 0) & policy.trusted(F.col("chars"), F.col("unreadable"), F.col("cid_share"), F.col("odd_char_share"), hidden, coverage)
    return m.select(*_KEYS, trusted.alias("trusted"), (~trusted & (F.col("doc_id") % 5 != 0) & (F.col("chars") > 0)).alias("needs_ocr"))


def _documents(spark: Spark, d: str) -> DataFrame:
    """Documents; three sixteenths of them, by a hash of their id, are held out from fitting."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    return docs.withColumn("held_out", F.left(F.md5(F.col("doc_id").cast("string")), F.lit(1)).isin("0", "1", "2"))


def _model(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    return languages.fit(_documents(spark, d).filter("not held_out"))


def language_model(spark: Spark, d: str) -> DataFrame:
    return _model(spark, d)[0]


def language_scores(spark: Spark, d: str) -> DataFrame:
    """Every document's most likely language, with the scores of the first two."""
    docs = _documents(spark, d).withColumn("clean", text.cleaned(F.col("text")))
    made = languages.scored(docs, _model(spark, d), ["doc_id"]).select("doc_id", F.col("lang").alias("said"), "grams", "micro", "second")
    return docs.select("doc_id", "lang", "held_out").join(made, "doc_id", "left")


def language_accuracy(spark: Spark, d: str) -> DataFrame:
    """Documents and rightly named ones by language, held out and fitted on."""
    return language_scores(spark, d).filter("lang is not null").groupBy("held_out", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("lang")).alias("right"))


QUERIES = {f.__name__: f for f in (language_model, language_scores, language_accuracy, language_vote, text_reading, text_override, common_words, odd_body, stored_text, garbled_layers, layer_trust)}


def lines_and_chunks(source: str) -> str:
    """SQL for lines and chunks of the texts of a table (doc_id, page, text): li, fo and ch (doc_id, page, chunk, text)."""
    return rf"""li AS (SELECT doc_id, page, i, ls[i] AS line FROM (SELECT doc_id, page, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, page, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
            lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ls FROM {source}))),
        fo AS (SELECT doc_id, page, i, line AS t, 0 AS k, length(line) >= 80 AS closed FROM li WHERE i = 1 UNION ALL
            SELECT n.doc_id, n.page, n.i, CASE WHEN f.closed THEN n.line ELSE f.t || ' ' || n.line END, CASE WHEN f.closed THEN k + 1 ELSE k END, length(CASE WHEN f.closed THEN n.line ELSE f.t || ' ' || n.line END) >= 80
            FROM fo f JOIN li n ON n.doc_id = f.doc_id AND n.page = f.page AND n.i = f.i + 1),
        ck AS (SELECT doc_id, page, k, arg_max(t, i) AS t, arg_max(closed, i) AS closed FROM fo GROUP BY doc_id, page, k),
        cl AS (SELECT *, max(k) OVER w AS last, lead(t) OVER (w ORDER BY k) AS next, lead(closed) OVER (w ORDER BY k) AS next_closed FROM ck WINDOW w AS (PARTITION BY doc_id, page)),
        ch AS (SELECT doc_id, page, k AS chunk, CASE WHEN k = last - 1 AND NOT next_closed AND length(next) < 40 THEN t || ' ' || next ELSE t END AS text FROM cl WHERE NOT (k = last AND last > 0 AND NOT closed AND length(t) < 40))"""


FITTED = r"""WITH d AS (SELECT doc_id, lang, left(md5(doc_id::VARCHAR), 1) IN ('0', '1', '2') AS held_out, trim(regexp_replace(lower(regexp_replace(text, '\s+', ' ', 'g')), '[^\p{L}\p{M}\s]', '', 'g')) AS clean FROM documents),
    g AS (SELECT doc_id, lang, held_out, gram, count(*) AS n FROM (SELECT doc_id, lang, held_out, unnest(list_transform(range(1, greatest(length(clean), 1) + 1), lambda i: substr(' ' || clean || ' ', i, 3))) AS gram FROM d WHERE clean <> '') GROUP BY ALL),
    f AS (SELECT lang, gram, sum(n)::BIGINT AS n FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
    l AS (SELECT lang, sum(n)::BIGINT AS total, (SELECT count(DISTINCT gram) FROM f) AS kinds FROM f GROUP BY lang),
    k AS (SELECT gram, lang, n, round(ln((n + 1) / (total + kinds)::DOUBLE) * 1000000)::BIGINT AS micro FROM f JOIN l USING (lang))"""
SCORED = FITTED + """, s AS (SELECT g.doc_id, l.lang, sum(g.n)::BIGINT AS grams, sum(CASE WHEN g.gram IN (SELECT gram FROM k) THEN g.n * coalesce(k.micro, round(ln(1 / (total + kinds)::DOUBLE) * 1000000)::BIGINT) ELSE 0 END)::BIGINT AS micro
        FROM g CROSS JOIN l LEFT JOIN k ON k.gram = g.gram AND k.lang = l.lang GROUP BY ALL),
    w AS (SELECT *, row_number() OVER v AS place, lead(micro) OVER v AS second FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY micro DESC, lang)),
    sc AS (SELECT d.doc_id, d.lang, d.held_out, w.lang AS said, grams, micro, second FROM d LEFT JOIN w ON w.doc_id = d.doc_id AND place = 1)"""


def oracles(pages_sql: str, layers_sql: str, measured_sql: str) -> dict[str, str]:
    hits = ", ".join(f"{{'n': len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in words)}))), 'o': {-i}, 'code': '{k}'}}" for i, (k, words) in enumerate(PROFILES.items()))
    guard = r"""CASE WHEN len(regexp_extract_all(text, '[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f\x{FFFD}]')) >= 0.02 * greatest(length(text), 1) THEN 'control or undefined characters'
            WHEN len(w) > 0 AND 2 * len(list_filter(w, lambda n: n = 1)) >= len(w) THEN 'many one-letter fragments' WHEN list_sum(w) > 0 AND coalesce(list_sum(list_filter(w, lambda n: n >= 25)), 0) >= 0.6 * list_sum(w) THEN 'words run together without spaces' ELSE '' END"""
    counted = r"list_filter(list_transform(regexp_extract_all(text, '[^\s]+'), lambda t: len(regexp_extract_all(t, '\p{L}'))), lambda n: n > 0) AS w"
    vote = rf"""WITH RECURSIVE {layers_sql}, {lines_and_chunks('l')},
        gd AS (SELECT doc_id, page, {guard} AS why FROM (SELECT *, {counted} FROM l)),
        cc AS (SELECT doc_id, page, chunk, len(regexp_extract_all(text, '\p{{L}}')) AS letters, regexp_replace(regexp_replace(lower(regexp_replace(text, '\s+', ' ', 'g')), '[^\p{{L}}\p{{M}}\s]', '', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM ch),
        sc AS (SELECT doc_id, page, chunk, letters, list_max([{hits}]) AS best, len(ws) AS n FROM (SELECT *, string_split(clean, ' ') AS ws FROM cc WHERE letters >= 5 AND clean <> '')),
        vo AS (SELECT doc_id, page, chunk, letters, CASE WHEN best.n > 0 THEN best.code ELSE 'zxx' END AS code, letters * least(1.0::DOUBLE, best.n * 4.0::DOUBLE / n) AS mass FROM sc),
        to_ AS (SELECT doc_id, page, sum(letters) AS weight, coalesce(sum(mass) FILTER (code <> 'zxx'), 0) AS total FROM vo GROUP BY ALL),
        la AS (SELECT doc_id, page, code, sum(mass) AS mass, min(chunk) AS first FROM vo WHERE code <> 'zxx' GROUP BY ALL),
        tp AS (SELECT doc_id, page, code, mass FROM la QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY mass DESC, first) = 1),
        re AS (SELECT gd.doc_id, gd.page, why, coalesce(weight, 0) AS weight, coalesce(total, 0) AS total, tp.code, tp.mass FROM gd LEFT JOIN to_ USING (doc_id, page) LEFT JOIN tp USING (doc_id, page)),
        vote AS (SELECT doc_id, page, CASE WHEN why <> '' OR weight < 20 THEN '' WHEN mass >= 0.5 * total THEN code ELSE '' END AS language,
            CASE WHEN why <> '' THEN 0.0::DOUBLE WHEN weight < 20 THEN NULL ELSE round(total / weight, 3) END AS readability,
            CASE WHEN why <> '' THEN why WHEN weight < 20 OR round(total / weight, 3) >= 0.2 THEN '' ELSE 'does not read as text in any language' END AS unreadable FROM re)"""
    names = ", ".join(f"('{k}', '{v}')" for k, v in NAMES.items())
    mine = ", ".join(repr(w) for w in COMMON)
    return {
        "chunk_fold": f"WITH RECURSIVE {pages_sql}, {lines_and_chunks('p')} SELECT doc_id, page, chunk, text FROM ch",
        "language_vote": f"{vote} SELECT * FROM vote",
        "language_model": f"{FITTED} SELECT gram, lang, n, micro FROM k",
        "language_scores": f"{SCORED} SELECT * FROM sc",
        "language_accuracy": f"{SCORED} SELECT held_out, lang, count(*) AS n, count(*) FILTER (said = lang) AS right FROM sc WHERE lang IS NOT NULL GROUP BY ALL",
        "text_reading": f"{vote} SELECT doc_id, page, language, coalesce(name, '') AS name, readability, unreadable FROM vote LEFT JOIN (VALUES {names}) names(language, name) USING (language) WHERE doc_id % 5 <> 0",
        "text_override": rf"""WITH {pages_sql}, o AS (SELECT *, doc_id % 9 = 0 AND page = 0 AS over FROM p), u AS (SELECT doc_id, page, over, CASE WHEN over THEN regexp_replace(text, '[A-Za-z]', '(cid:12)', 'g') ELSE text END AS text FROM o)
            SELECT doc_id, page, len(regexp_extract_all(text, '\(cid:[0-9]+\)')) * 7 / greatest(length(text), 1) AS cid_share, length(trim(text, E' \t\n\r\f\x0b')) AS chars, NOT over AS kept FROM u""",
        "common_words": f"WITH {layers_sql}, w AS (SELECT doc_id, page, regexp_extract_all(lower(text), '[a-z'']+') AS ws FROM l) SELECT doc_id, page, round(len(list_filter(ws, lambda w: w IN ({mine}))) / greatest(len(ws), 1), 6) AS share FROM w",
        "odd_body": rf"""WITH {layers_sql}, b AS (SELECT doc_id, page, regexp_replace(CASE WHEN doc_id % 11 = 0 THEN chr(57344) || chr(1) || chr(65533) || ' ' || text ELSE text END, '\s', '', 'g') AS body FROM l)
            SELECT doc_id, page, round(len(regexp_extract_all(body, '[\p{{Co}}\p{{Cc}}\x{{FFFD}}]')) / greatest(length(body), 1), 8) AS share FROM b""",
        "stored_text": r"SELECT doc_id, length(trim(coalesce(text, ''), E' \t\n\r\f\x0b')) AS chars, length(left(coalesce(text, ''), 50000)) AS stored, md5(left(coalesce(text, ''), 50000)) AS digest FROM documents",
        "garbled_layers": rf"""WITH {pages_sql}, f AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).') AS cs FROM p WHERE page = 0)
            SELECT doc_id, md5(list_aggregate(list_transform(cs, lambda c: CASE WHEN regexp_matches(c, '^\p{{L}}$') THEN '(cid:' || (unicode(c) % 97 + 3) || ')' ELSE c END), 'string_agg', '')) AS codes,
                md5(list_aggregate(list_transform(cs, lambda c: CASE WHEN regexp_matches(c, '^\p{{L}}$') THEN chr(unicode(c) + 29) ELSE c END), 'string_agg', '')) AS shift,
                md5(list_aggregate(list_transform(cs, lambda c: CASE WHEN c = 'e' THEN 'Ã©' WHEN c = 'a' THEN '' WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 2048 THEN chr(192 + unicode(c) // 64) || chr(128 + unicode(c) % 64)
                    ELSE chr(224 + unicode(c) // 4096) || chr(128 + unicode(c) // 64 % 64) || chr(128 + unicode(c) % 64) END), 'string_agg', '')) AS bytes FROM f""",
        "layer_trust": f"""{vote}, {measured_tail(measured_sql)}, q AS (SELECT m.doc_id, m.page, chars, m.doc_id % 5 <> 0 AND chars > 50 AND NOT (m.doc_id % 6 = 0 AND (m.doc_id * 13 + m.page * 7) % 100 / 100.0 > 0.9) AND unreadable = '' AND cid_share < 0.05 AND odd_char_share < 0.05 AS trusted
            FROM m JOIN vote ON vote.doc_id = m.doc_id AND vote.page = m.page) SELECT doc_id, page, trusted, NOT trusted AND doc_id % 5 <> 0 AND chars > 0 AS needs_ocr FROM q""",
    }


def measured_tail(measured_sql: str) -> str:
    """The last common table expression of the measures' SQL, which builds on the layers."""
    return measured_sql[measured_sql.rindex("m AS (SELECT *,") :]
